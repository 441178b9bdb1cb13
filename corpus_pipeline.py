"""Corpus pipeline: quality rules, near duplicates, benchmark decontamination, source mix, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but
the last return the columns of ``documents``; each is written as Parquet and read again.
Rows with null or empty text fail the quality rules. An empty input gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barlake.llm import catalog
from barlake.llm.bitplane import token_files
from barlake.llm.fair_mix import mixed_rows
from barlake.llm.group_prefix_join import first_rows
from barlake.llm.quality_lines import kept_rows
from barlake.llm.shared import scratch
from barlake.llm.tiling import clean_rows


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines over the limit leave the texts of the others."""
    return kept_rows(docs, chars_col="n_chars")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return first_rows(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover a benchmark item go."""
    return clean_rows(docs, catalog.table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files(docs, catalog.tokenizer("byte_bpe_50k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage),
          ("mix", mix_stage), ("token_files", token_stage)]

#: Tokenizing and tiling have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
