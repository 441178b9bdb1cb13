"""Token counts by a two-tier lookup of pre-token lengths, without any pre-token shuffle.

A text is cut before every single space and line feed. Such a cut is exact when no
vocabulary piece holds the two characters beside it, which :class:`Counter` checks against
the vocabulary, so the tokens of a text are the tokens of its pieces.

- Tier 1: a table of the most frequent pieces and their token counts, fitted on the
  starts of at most ``SAMPLE_ROWS`` documents and broadcast. At most ``HOT_ENTRIES`` entries of at most
  ``HOT_CHARS`` characters, whatever the corpus.
- Tier 2: per worker, a bounded cache in front of the library.

The tiers hold exact counts, so the sample changes speed only, never a result.
"""

from __future__ import annotations

from collections import Counter as Tally
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import Generations, ship

SAMPLE_ROWS = 2_000
SAMPLE_CHARS = 8_192
HOT_ENTRIES = 50_000
HOT_CHARS = 64
CACHE_ENTRIES = 300_000


class Counter:
    """Token counts of texts under one sentencepiece model, without begin and end tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        vocabulary = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())
                      if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        #: characters that stand beside each other inside some piece: no cut between those
        self.joined = {p[k:k + 2] for p in vocabulary for k in range(len(p) - 1)}
        before_space = {p[k] for p in vocabulary for k in range(len(p) - 1) if p[k + 1] == "▁"} - {"▁"}
        with_feed = any("\n" in p for p in vocabulary)
        #: identity normaliser with one leading space: what the cuts rely on
        self.cuts = not before_space and not with_feed and self._plain()
        self.pieces = Generations(self._piece, CACHE_ENTRIES)

    def _plain(self) -> bool:
        probe = " a  ÅＡ b \n c "
        return self.model.decode(self.model.encode(probe)) in (probe, probe[1:])

    def _whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def _piece(self, key: str) -> int:
        if not key:  # a single space with nothing behind it
            return 1
        if key[-1] in ".," and len(key) > 1 and key[-2] != "\n" and key[-2:] not in self.joined:
            return self.pieces[key[:-1]] + self.pieces["\n" + key[-1]] - 1
        # the library adds a space in front; behind a line feed the text has none
        return self._whole(key) - (key[0] == "\n")

    def split(self, text: str) -> list[str] | None:
        """The text's pieces, or None where spaces meet and so may share a token."""
        text = text.replace("▁", " ")
        if not self.cuts or "  " in text or " \n" in text or text[:1] == " " or text[:1] == "\n":
            return None
        return text.replace("\n", " \n").split(" ")

    def count(self, text: str, lengths) -> int:
        if not text:
            return 0
        pieces = self.split(text)
        return self._whole(text) if pieces is None else sum(map(lengths.__getitem__, pieces))


class Hot(dict):
    """Tier 1 in front of tier 2."""

    def __init__(self, table: dict, cache: Generations):
        super().__init__(table)
        self.cache = cache

    def __missing__(self, key):
        return self.cache[key]


@lru_cache(maxsize=2)
def _counter(model_path: str) -> Counter:
    return Counter(model_path)


def hot_table(docs: DataFrame, model_path: str, text_col: str = "text") -> tuple[str, bytes]:
    """The frequent pieces of the sample (joined by spaces, which no piece holds) and their counts, one byte each.

    ``take`` reads as few partitions as it needs and brings at most ``SAMPLE_ROWS`` strings
    of ``SAMPLE_CHARS`` characters to the driver.
    """
    counter, seen = _counter(model_path), Tally()
    for row in docs.select(F.substring(F.col(text_col), 1, SAMPLE_CHARS).alias("text")).where("text is not null").take(SAMPLE_ROWS):
        seen.update(counter.split(row.text) or ())
    top = [(p, n) for p, _ in seen.most_common(HOT_ENTRIES) if len(p) <= HOT_CHARS and (n := counter.pieces[p]) < 256]
    return " ".join(p for p, _ in top), bytes(n for _, n in top)


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens, over_limit. Null texts are empty: 0 bytes, 0 tokens."""
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(hot_table(docs, model_path, text_col))

    @F.pandas_udf("long")
    def n_tokens(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(model_path)
        names, counts = table.value
        lengths = Hot(dict(zip(names.split(" "), counts)) if counts else {}, counter.pieces)
        for batch in texts:
            yield pd.Series([counter.count(t, lengths) for t in batch], dtype="int64")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), n_tokens("text").alias("n_tokens")) \
        .withColumn("over_limit", F.col("n_tokens") > limit)
