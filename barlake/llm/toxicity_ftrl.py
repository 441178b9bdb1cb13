"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words, word pairs at distance 1 (bigrams), 2 and 3
(skip-grams), hashed into ``2 ** BITS`` coordinates, each with value 1. The words are runs of
word characters of the lower-cased text.

Training. At most ``max_rows`` labelled rows (those with the smallest hash of the document
id; the documented bound of the fit) go through FTRL-proximal with per-coordinate rates and
L1. A coordinate takes part when at least ``MIN_ROWS`` training rows have it, with the value
log(rows / its rows), scaled to 1 for the rarest, so common words carry little. Toxic rows
weigh ``TOXIC_WEIGHT`` times. The fit is sequential by nature, so it is one task, but a bounded one;
the coordinates are extracted beforehand, in parallel. L1 leaves a few thousand weights,
``max_rows`` bounds them, and they are broadcast.

Scoring covers every whole text in one pass over the documents, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import Generations, ship

BITS = 24
MAX_ROWS = 12_000
MIN_ROWS = 4
TOXIC_WEIGHT = 5.0
CACHE_ENTRIES = 150_000
#: FTRL-proximal: learning rate, its smoothing, L1, passes over the rows.
ALPHA, BETA, L1, PASSES = 2.0, 1.0, 6.0, 4

_WORD = re.compile(r"\w+")
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_BIAS = 0


@lru_cache(maxsize=1)
def _hashes() -> Generations:
    return Generations(lambda word: zlib.crc32(word.encode("utf-8", "surrogatepass")), CACHE_ENTRIES)


def coordinates(text: str) -> list[np.ndarray]:
    """Coordinates of the words and of the pairs at distance 1, 2 and 3; repeats included."""
    found = _WORD.findall(text.lower())
    ids = np.fromiter(map(_hashes().__getitem__, found), np.uint32, len(found))
    shift = np.uint32(32 - BITS)
    out = [(ids * _MIX[0]) >> shift]
    for gap, mix in zip((1, 2, 3), _MIX):
        if len(ids) > gap:
            pair = (ids[:-gap] ^ mix) * _MIX[1] + ids[gap:] * _MIX[2]
            out.append((pair ^ (pair >> np.uint32(15))) * _MIX[0] >> shift)
    return out


def features(text: str) -> np.ndarray:
    """Distinct coordinates of a text, the bias included."""
    return np.unique(np.concatenate([np.array([_BIAS], np.uint32), *coordinates(text)]))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Weights after FTRL-proximal over ``rows`` (coordinates) in order, ``PASSES`` times."""
    z, n = np.zeros(len(values)), np.zeros(len(values))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) * ALPHA / (BETA + np.sqrt(ni)))

    for _ in range(PASSES):
        for at, label in zip(rows, labels):
            zi, ni, x = z[at], n[at], values[at]
            w = weights(zi, ni)
            p = 1.0 / (1.0 + np.exp(-np.clip((w * x).sum(), -35, 35)))
            g = (p - label) * (TOXIC_WEIGHT if label else 1.0) * x
            grown = ni + g * g
            z[at] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ALPHA * w
            n[at] = grown
    return weights(z, n)


def fit_rows(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) other than zero; a weight has its coordinate's value in it."""
    seen = np.zeros(1 << BITS, np.uint16 if len(rows) < 1 << 16 else np.uint32)
    for at in rows:
        seen[at] += 1
    seen[_BIAS] = max(seen[_BIAS], MIN_ROWS)
    least = min(MIN_ROWS, max(len(rows), 1))
    names = np.flatnonzero(seen >= least).astype(np.uint32)
    values = np.log(len(rows) / seen[names]) / max(np.log(len(rows) / MIN_ROWS), 1.0)
    values[names == _BIAS] = 1.0
    w = ftrl([np.searchsorted(names, at[seen[at] >= least]) for at in rows], labels, values) * values
    return names[w != 0], w[w != 0]


def held_out(doc_id: Column) -> Column:
    """The rows that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights other than zero, fitted on the rows that aren't held out.

    Rows without id or label don't count; a document with several labels is toxic if one says so.
    """
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .where("id is not null and y is not null").where(~held_out(F.col("id")))
             .groupBy("id").agg((F.max("y") > 0).cast("int").alias("y")))
    order = F.xxhash64("id")
    picked = known.orderBy(order, "id").limit(max_rows)

    @F.pandas_udf("binary")
    def extracted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: features(t).astype("<u4").tobytes())

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(picked), "id")  # two numbers for each of at most max_rows ids
    rows = rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
    rows = rows.select("id", "y", extracted("text").alias("at"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.argsort([zlib.crc32(b"%d" % i) for i in frame["id"]], kind="stable")]
        at, w = fit_rows([np.frombuffer(b, "<u4") for b in frame["at"]], frame["y"].to_numpy())
        return pd.DataFrame({"at": at, "w": w})

    weights = rows.groupBy(F.lit(0).alias("model")).applyInPandas(fit, "at long, w double").toPandas()
    return weights["at"].to_numpy(np.int64), weights["w"].to_numpy(np.float64)


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id",
          text_col: str = "text", **options) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Null texts are empty texts."""
    ship(docs.sparkSession)
    at, w = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    model = docs.sparkSession.sparkContext.broadcast((at.astype(np.uint32), w.astype(np.float32)))

    @F.pandas_udf("double")
    def toxic(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        dense = np.zeros(1 << BITS, np.float32)
        dense[model.value[0]] = model.value[1]
        bias = float(dense[_BIAS])
        for batch in batches:
            out = np.empty(len(batch))
            for k, text in enumerate(batch):
                hit = [c[dense[c] != 0] for c in coordinates(text)]
                at = np.unique(np.concatenate(hit))
                margin = bias + float(dense[at[at != _BIAS]].sum(dtype=np.float64))
                out[k] = 1.0 / (1.0 + np.exp(-np.clip(margin, -35, 35)))
            yield pd.Series(out)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxic("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
