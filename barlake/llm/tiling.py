"""Benchmark decontamination by greedy string tiling.

1. *Seeds.* Every run of ``min_match`` words of a benchmark item is a seed; an item with fewer words is
   one seed as a whole, and its own length is its least match. A bit table of
   ``FILTER_BITS`` bits over the seeds' hashes, a fixed size whatever the benchmark, is
   broadcast; one pass over the whole texts keeps the stretches of words that may hold seeds. Every
   tile consists of seeds, so the stretches are all that tiling needs of a document.
2. *Pairs.* The documents' seeds join the benchmark's. A tile of k words starts at least k /
   ``min_match`` seeds, so a pair whose tiles cover the share ``coverage`` of an item has
   ``coverage * words / min_match`` places of the item in common; pairs below are dropped,
   which loses nothing.
3. *Tiling.* For each pair, the longest common run of unmarked words is marked again and
   again, found by running Karp-Rabin with falling length, until none of ``min_match``
   words is left. Tiles don't overlap, their order doesn't matter: reordered passages count.
4. *Threshold.* A document is contaminated when tiles cover ``coverage`` or more of the
   words of some item.

Words are lower-cased (A-Z) and stripped of the punctuation around them. Items without words have no
seeds and match nothing; null texts are empty.
Documents without a pair have coverage 0. Rows that share an id are one document; equal
rows get equal results, and rows with null id are judged by their text alike.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import Generations, ship, small_batches, written
from barlake.llm.shingles import rolled

MIN_MATCH = 5
COVERAGE = 0.5
FILTER_BITS = 1 << 24
_MARKS = string.punctuation.encode()


@lru_cache(maxsize=1)
def _hashes() -> Generations:
    return Generations(lambda word: xxhash.xxh3_64_intdigest(word.strip(_MARKS) or word), 100_000)


def word_codes(text: str | None) -> np.ndarray:
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_hashes().__getitem__, found), np.uint64, len(found))


def tiles(item: np.ndarray, parts: list[np.ndarray], min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item with a document's stretches: (item start, document start, length).

    Document positions count through the stretches, one apart. ``length`` falls from the item's own
    to ``min_match``. For each length, a table of the hashes of the item's unmarked runs is
    probed with those of the document, matches are extended as far as they go and the longest
    are marked first.
    """
    seam = 1 << 64
    doc = []
    for part in parts:
        doc += [*map(int, part), seam]
        seam += 1  # a word that nothing equals
    item = [int(x) for x in item]
    mod, base = (1 << 61) - 1, 1_000_003
    free_i, free_d, found = [True] * len(item), [True] * len(doc), []

    def runs(words: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
        """(start, hash) of unmarked runs of ``size`` words, the hash rolled from run to run."""
        top, h, n = pow(base, size - 1, mod), 0, 0
        for k, word in enumerate(words):
            if not free[k]:
                h = n = 0
                continue
            if n == size:
                h = (h - words[k - size] * top) % mod
                n -= 1
            h, n = (h * base + word) % mod, n + 1
            if n == size:
                yield k - size + 1, h

    size = min(len(item), len(doc))
    while size >= min_match:
        table = defaultdict(list)
        for start, h in runs(item, free_i, size):
            table[h].append(start)
        matches, longest = [], 0
        for start, h in runs(doc, free_d, size):
            for at in table.get(h, ()):
                k = 0
                while (at + k < len(item) and start + k < len(doc) and free_i[at + k] and free_d[start + k]
                       and item[at + k] == doc[start + k]):
                    k += 1
                if k >= size:
                    matches.append((k, at, start))
                    longest = max(longest, k)
        if longest > size:  # longer matches first
            size = longest
            matches = [m for m in matches if m[0] == longest]
        for k, at, start in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_i[at:at + k]) and all(free_d[start:start + k]):
                free_i[at:at + k], free_d[start:start + k] = [False] * k, [False] * k
                found.append((at, start, k))
        # nothing of this length: look at half of it, and above again if something longer is there
        size = size - 1 if matches or size <= 2 * min_match else size // 2
    return found


def least_match(words: int, min_match: int) -> int:
    """Shortest tile of an item: ``min_match``, or all of a shorter item."""
    return max(1, min(words, min_match))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def benchmark_items(benchmark: DataFrame, min_match: int, item_col: str, text_col: str) -> DataFrame:
    """item, n, words (codes), seeds (by place). One row per item; several texts of an item are several rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [word_codes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(c) for c in codes], pa.int64()), pa.array([_signed(c) for c in codes], pa.list_(pa.int64())),
                pa.array([_signed(rolled(c, least_match(len(c), min_match))) for c in codes], pa.list_(pa.int64()))], names=["item", "n", "words", "seeds"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).distinct()
    return rows.mapInArrow(run, "item long, n long, words array<long>, seeds array<long>")


def _filter(items: DataFrame) -> np.ndarray:
    """Bits of the seeds' hashes: at most FILTER_BITS / 64 rows reach the driver."""
    bit = F.expr(f"pmod(seed, {FILTER_BITS})")
    rows = (items.select(F.explode("seeds").alias("seed")).groupBy(F.shiftright(bit, 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(seed, {FILTER_BITS}) & 63 AS int))")).alias("bits")).toPandas())
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    table[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def stretches(docs: DataFrame, items: DataFrame, min_match: int) -> DataFrame:
    """id, content, seeds, parts: what the documents may share with the benchmark."""
    table = docs.sparkSession.sparkContext.broadcast(_filter(items))
    # runs as long as some short item: at most min_match - 1 lengths
    short = [r.n for r in items.where((F.col("n") > 0) & (F.col("n") < min_match)).select("n").distinct().collect()]
    sizes = [*sorted(short), min_match]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            rows = []
            for doc, content, text in zip(*(c.to_pylist() for c in batch.columns)):
                codes = word_codes(text)
                used, shared = np.zeros(len(codes) + 1, np.int8), []
                for size in sizes:
                    seeds = rolled(codes, size)
                    at = seeds.view(np.int64) & np.int64(FILTER_BITS - 1)
                    hit = ((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                    for k in range(size):
                        used[k:k + len(hit)] |= hit
                    shared.append(seeds[hit])
                shared = np.unique(np.concatenate(shared))
                if not len(shared):
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], used])))
                parts = [_signed(codes[a:b]).tolist() for a, b in zip(edge[::2], edge[1::2])]
                rows.append({"id": doc, "content": content, "seeds": _signed(shared).tolist(), "parts": parts})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("id", pa.int64()), ("content", pa.int64()), ("seeds", pa.list_(pa.int64())), ("parts", pa.list_(pa.list_(pa.int64())))]))

    return docs.mapInArrow(run, "id long, content long, seeds array<long>, parts array<array<long>>")


def overlaps(docs: DataFrame, benchmark: DataFrame, *, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
             id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs that pass the seed count: doc_id, content, item_id, tiled_words, item_words, coverage."""
    ship(docs.sparkSession)
    items = benchmark_items(benchmark, min_match, item_col, item_text_col)
    items = written(items.select(F.xxhash64("item", "words").alias("key"), "*"), "items")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("content"), text.alias("text"))
    with small_batches(docs.sparkSession):
        found = written(stretches(rows, items, min_match), "stretches")
    seeds = items.select("key", "n", F.explode("seeds").alias("seed")).groupBy("key", "n", "seed").agg(F.count("*").alias("places"))
    needed = F.col("n") * coverage / min_match - 1e-6
    # equal texts share their seeds: one of them looks for items, and its pairs serve all
    contents = found.groupBy("content").agg(F.min_by(F.struct("seeds", "parts"), F.struct("id", F.size("seeds"))).alias("x"))
    contents = written(contents.select("content", "x.seeds", "x.parts"), "contents")
    pairs = (contents.select("content", F.explode("seeds").alias("seed")).join(seeds, "seed")
             .groupBy("content", "key", "n").agg(F.sum("places").alias("common")).where(F.col("common") >= needed).select("content", "key"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, words, parts = (batch.column(k).to_pylist() for k in (2, 3, 4))
            covered = [sum(t[2] for t in tiles(np.array(w, np.int64), [np.array(p, np.int64) for p in ps],
                                                   least_match(len(w), min_match))) for w, ps in zip(words, parts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(item, pa.int64()), pa.array(covered, pa.int64()),
                                              pa.array([len(w) for w in words], pa.int64())],
                                             names=["content", "item_id", "tiled_words", "item_words"])

    full = (pairs.join(contents.select("content", "parts"), "content").join(items.select("key", "item", "words"), "key")
            .select("content", "key", "item", "words", "parts"))
    tiled = full.mapInArrow(tile, "content long, item_id long, tiled_words long, item_words long")
    return (found.select("id", "content").distinct().join(tiled, "content")
            .select(F.col("id").alias("doc_id"), "content", "item_id", "tiled_words", "item_words",
                    (F.col("tiled_words") / F.col("item_words")).alias("coverage")))


def contamination(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, contaminated, item_id (best covered, smallest id on ties; null if none), tiled_words, coverage."""
    pairs = overlaps(docs, benchmark, coverage=coverage, id_col=id_col, text_col=text_col, **options)
    best = (pairs.groupBy(F.col("doc_id").alias("id"), F.col("content").alias("of"))
            .agg(F.max(F.struct("coverage", "tiled_words", -F.col("item_id"), "item_id")).alias("b")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("content"))
    on = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("content") == F.col("of"))
    share = F.coalesce("b.coverage", F.lit(0.0))
    return rows.join(best, on, "left").select(
        "doc_id", (share >= coverage).alias("contaminated"), F.when(share > 0, F.col("b.item_id")).alias("item_id"),
        F.coalesce("b.tiled_words", F.lit(0)).alias("tiled_words"), share.alias("coverage"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, *, coverage: float = COVERAGE, id_col: str = "doc_id",
               text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with their own columns."""
    pairs = overlaps(docs, benchmark, coverage=coverage, id_col=id_col, text_col=text_col, **options)
    bad = pairs.where(F.col("coverage") >= coverage).select(F.col("doc_id").alias("_id"), F.col("content").alias("_content")).distinct()
    on = docs[id_col].cast("long").eqNullSafe(bad["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad["_content"])
    return docs.join(bad, on, "left_anti")
