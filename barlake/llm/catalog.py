"""The queries of this folder and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barlake.llm.shared import ship

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.quality_lines import judged

    return judged(table(spark, sf_dir, "documents"))


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.compact_windows import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op3_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.toxicity_ftrl import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.pii_bootstrap import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op5_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.tiling import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_warc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.warc_merge import archive_history, digest_rows

    history = archive_history(table(spark, sf_dir, "pages"))
    return digest_rows(history).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_group_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.group_prefix_join import join_components

    return join_components(table(spark, sf_dir, "documents"))


def op9_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.fair_mix import mix

    return mix(table(spark, sf_dir, "documents"))


def op10_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.bitplane import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.burst_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.metric_join import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barlake.llm.phrase_automata import collocations

    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_line_frequency, op2_compact_windows, op3_toxicity_ftrl, op4_pii_bootstrap, op5_string_tiling, op6_token_counts,
        op7_warc_merge, op8_group_prefix_join, op9_fair_mix, op10_bitplane_ids, op11_burst_trie, op12_metric_join,
        op13_phrase_automata)}


def oracle_sql() -> dict[str, str]:
    from barlake.llm import burst_trie, fair_mix, metric_join, phrase_automata, quality_lines, warc_merge

    return {"op1_line_frequency": quality_lines.ORACLE, "op7_warc_merge": warc_merge.ORACLE,
            "op9_fair_mix": fair_mix.ORACLE, "op11_burst_trie": burst_trie.ORACLE,
            "op12_metric_join": metric_join.ORACLE, "op13_phrase_automata": phrase_automata.ORACLE}
