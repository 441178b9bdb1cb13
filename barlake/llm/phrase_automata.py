"""Phrase collocations from weighted acyclic automata.

Texts are cut into pieces and words; a path of an automaton is a language followed by 1 to 3
word symbols (64-bit hashes), its weight the number of occurrences.

1. *Words* are counted per language with their symbols. Two words with one symbol (or two
   languages) are detected there, and the symbols are drawn again with another seed, so equal
   symbols always mean equal words.
2. *Shards.* Each task collects the n-grams of its texts in sorted runs and builds a minimal
   acyclic transducer of every prefix range of a run: states from the last level up, equal
   states once. n-grams whose parts occur fewer than ``MIN_COUNT`` times can't reach it either;
   fixed-size bit tables of the frequent words (for pairs) and pairs (for triples) keep most of
   them out. False hits are counted like all others, so results don't depend on the tables.
3. *Union.* Transducers of one prefix range meet in one task, which adds the weights of equal
   paths and builds the range's automaton of paths with ``MIN_COUNT`` or more. First words with
   very many occurrences have ranges of their own, cut by the second word.
4. *Composition.* Every candidate asks for its parts (both cuts of a triple): questions go to
   the range of the part and walk its automaton. A range's automaton is held by ``COPIES``
   tasks, which share its questions. The walk also tells which pairs a triple covers.
5. *Scores* are exact integers of any size. Each language's first ``TOP`` follow from a rank
   that keeps all ties, and only those phrases' words are looked up.

Defined results: null text is empty, null language is ``und`` (and counts with it); repeated
rows count each; other columns are ignored; an empty table, or one without a candidate, gives
no row. Texts of any length are processed whole.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.shared import Generations, ship, written

MIN_COUNT = 10
COVER_PERCENT = 50
TOP = 2000
NO_LANG = "und"
WORDS_KEPT = 500_000
RUN_NGRAMS = 1_000_000
RANGE_NGRAMS = 2_000_000
RANGES = 65_536
COPIES = 8
TABLE_BITS = 1 << 26
CHUNK_WORDS = 1 << 13
CACHE_ENTRIES = 200_000

# The contract's separators of pieces (fixed values), and A-Z in lower case.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_ENDS + _UPPER, b"\xff" * len(_ENDS) + _UPPER.lower())
_END = b"\xff"  # no byte of a text in UTF-8


def marked_words(text: str | None) -> list[bytes]:
    """Words of a text in order; ``_END`` stands between pieces."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    return data.replace(_END, b" \xff ").split()


def symbol(word: bytes, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(word, seed) or 1  # 0 marks the end of a piece


# ---------------------------------------------------------------------------
# the automaton


class Transducer:
    """A minimal acyclic transducer: all paths have the same length, the last arc has the weight.

    ``labels[j]`` and ``to[j]`` are the arcs of level j by state (the last ``to`` holds weights);
    ``start[j]`` are the first arcs of level j's states. Level 0 has one state.
    """

    def __init__(self, labels: list[np.ndarray], to: list[np.ndarray], start: list[np.ndarray]):
        self.labels, self.to, self.start = labels, to, start

    @classmethod
    def of(cls, paths: np.ndarray, weights: np.ndarray) -> Transducer:
        """From sorted distinct paths (one row each)."""
        n, depth = paths.shape
        labels, to, start = [], [], []
        rows, target = np.arange(n), weights.astype(np.int64)
        for j in range(depth - 1, -1, -1):
            # states of level j: runs of rows with the same path above them
            if j:
                above = paths[rows, :j]
                first = np.flatnonzero(np.r_[True, (above[1:] != above[:-1]).any(1)])
            else:
                first = np.zeros(1, np.int64)
            arcs = paths[rows, j]
            size = np.diff(np.r_[first, len(rows)])
            keep, state = _equal_states(arcs, target, first, size)
            pick = np.repeat(keep, size)
            labels.insert(0, arcs[pick])
            to.insert(0, target[pick])
            start.insert(0, np.r_[0, np.cumsum(size[keep])])
            rows, target = rows[first], state
        return cls(labels, to, start)

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths in order, and their weights."""
        columns, state = [], np.zeros(1, np.int64)
        for labels, to, start in zip(self.labels, self.to, self.start):
            size = start[state + 1] - start[state]
            at = np.repeat(start[state] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            columns = [np.repeat(c, size) for c in columns] + [labels[at]]
            state = to[at]
        return np.stack(columns, 1), state

    def weight(self, asked: np.ndarray) -> np.ndarray:
        """Weights of ``asked`` paths (the composition with them); 0 where there is none."""
        state, known = np.zeros(len(asked), np.int64), np.ones(len(asked), bool)
        for j, (labels, to, start) in enumerate(zip(self.labels, self.to, self.start)):
            lo, hi = start[state], start[state + 1]
            end = hi.copy()
            want = asked[:, j]
            while (open_ := lo < hi).any():  # all arcs of a state at once, by halves
                mid = (lo + hi) // 2
                less = open_ & (labels[np.minimum(mid, len(labels) - 1)] < want)
                lo = np.where(less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
            at = np.minimum(lo, len(labels) - 1)
            known &= (lo < end) & (labels[at] == want)
            state = np.where(known, to[at], 0)
        return np.where(known, state, 0)

    def dump(self) -> bytes:
        symbols, index = np.unique(np.concatenate(self.labels), return_inverse=True)
        parts = [struct.pack("<BI", len(self.labels), len(symbols)), symbols.astype("<u8").tobytes()]
        at = 0
        for labels, to, start in zip(self.labels, self.to, self.start):
            parts.append(struct.pack("<II", len(labels), len(start)))
            parts += [index[at:at + len(labels)].astype("<u4").tobytes(), to.astype("<i8").tobytes(), np.diff(start).astype("<u4").tobytes()]
            at += len(labels)
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def load(cls, data: bytes) -> Transducer:
        data = zstandard.decompress(data)
        depth, n = struct.unpack_from("<BI", data)
        at = 5
        symbols = np.frombuffer(data, "<u8", n, at)
        at += 8 * n
        labels, to, start = [], [], []
        for _ in range(depth):
            arcs, states = struct.unpack_from("<II", data, at)
            at += 8
            labels.append(symbols[np.frombuffer(data, "<u4", arcs, at)])
            to.append(np.frombuffer(data, "<i8", arcs, at + 4 * arcs))
            at += 12 * arcs
            start.append(np.r_[0, np.cumsum(np.frombuffer(data, "<u4", states - 1, at), dtype=np.int64)])
            at += 4 * (states - 1)
        return cls(labels, to, start)


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def _equal_states(arcs: np.ndarray, target: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the states to keep, number of the kept state that each state equals)."""
    sign = np.add.reduceat(_mixed(_mixed(arcs) + target.astype(np.uint64)), first) + size.astype(np.uint64)
    _, lead, group = np.unique(sign, return_index=True, return_inverse=True)
    like = lead[group]
    like[size[like] != size] = -1
    like = np.where(like < 0, np.arange(len(first)), like)
    # arc by arc, as equal sums may still differ
    at = np.repeat(first[like] - first, size) + np.arange(len(arcs))
    same = np.logical_and.reduceat((arcs[at] == arcs) & (target[at] == target), first)
    like = np.where(same, like, np.arange(len(first)))
    keep = like == np.arange(len(first))
    return keep, (np.cumsum(keep) - 1)[like]


def summed(paths: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct paths with the sums of their weights."""
    if not len(paths):
        return paths, weights
    order = np.lexsort(paths.T[::-1])
    paths, weights = paths[order], weights[order]
    first = np.flatnonzero(np.r_[True, (paths[1:] != paths[:-1]).any(1)])
    return paths[first], np.add.reduceat(weights, first)


# ---------------------------------------------------------------------------
# prefix ranges


class Ranges:
    """Which prefix range a path lies in: by (language, first word), and for frequent ones by second word too."""

    def __init__(self, plain: int, heavy: dict[tuple[int, int], tuple[int, int]]):
        self.plain = plain
        keys = sorted(heavy)
        self.keys = np.array([_pair(np.uint64(a), np.uint64(b)) for a, b in keys], np.uint64)
        order = np.argsort(self.keys)
        self.keys = self.keys[order]
        spans = np.array([heavy[k] for k in keys], np.int64).reshape(-1, 2)[order]
        self.first, self.parts = spans[:, 0], spans[:, 1]

    def of(self, paths: np.ndarray) -> np.ndarray:
        prefix = _pair(paths[:, 0], paths[:, 1])
        out = (_high(_mixed(prefix)) * self.plain >> 32).astype(np.int64)
        if len(self.keys) and paths.shape[1] > 2:
            at = np.minimum(np.searchsorted(self.keys, prefix), len(self.keys) - 1)
            hit = self.keys[at] == prefix
            inner = _high(_mixed(paths[hit, 2])).astype(np.int64) * self.parts[at[hit]] >> 32
            out[hit] = self.first[at[hit]] + inner
        return out


def _high(a: np.ndarray) -> np.ndarray:
    return (a >> np.uint64(32)).astype(np.int64)


def _pair(a, b):
    with np.errstate(over="ignore"):
        return _mixed(np.asarray(a, np.uint64)) + np.asarray(b, np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _slots(paths: np.ndarray, bits: int) -> np.ndarray:
    """Places of paths in a table of ``bits`` bits (a power of two)."""
    mixed = paths[:, 0].copy()
    for j in range(1, paths.shape[1]):
        mixed = _pair(mixed, paths[:, j])
    return (_mixed(mixed) & np.uint64(bits - 1)).astype(np.int64)


def _bits(rows: DataFrame) -> np.ndarray:
    """A bit table from rows (word, bits). The driver gets it in pieces of CHUNK_WORDS words, at most
    TABLE_BITS / 8 bytes, and no row per word."""
    size = min(CHUNK_WORDS, TABLE_BITS // 64)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece = None, None
        for batch in batches:
            word, bits = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            edge = np.flatnonzero(np.r_[True, word[1:] // size != word[:-1] // size]) if len(word) else []
            for lo, hi in zip(edge, np.r_[edge[1:], len(word)].astype(np.int64)):
                at = int(word[lo]) // size
                if at != now:
                    if now is not None:
                        yield made(now, piece)
                    now, piece = at, np.zeros(size, np.uint64)
                np.bitwise_or.at(piece, word[lo:hi] % size, bits[lo:hi])
        if now is not None:
            yield made(now, piece)

    def made(at: int, piece: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([piece.tobytes()], pa.binary())], names=["at", "data"])

    chunk = F.floor(F.col("word") / size)
    grouped = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).withColumn("chunk", chunk)
    got = grouped.repartition("chunk").sortWithinPartitions("word").select("word", "bits").mapInArrow(pieces, "at long, data binary")
    table = np.zeros(TABLE_BITS // 64, np.uint64)
    for r in got.collect():
        table[r["at"] * size:(r["at"] + 1) * size] = np.frombuffer(r["data"], np.uint64)
    return table


def _bit_rows(paths: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    slots = np.unique(_slots(paths, bits))
    word, first = np.unique(slots >> 6, return_index=True)
    ones = np.left_shift(np.uint64(1), (slots & 63).astype(np.uint64))
    return word, np.bitwise_or.reduceat(ones, first).view(np.int64)


def _has(table: np.ndarray, paths: np.ndarray) -> np.ndarray:
    slots = _slots(paths, 64 * len(table))
    return (table[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


# ---------------------------------------------------------------------------
# Spark steps


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a, np.uint64).view(np.int64))


def _unsigned(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def word_counts(texts: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, l, h, f) of all words, l and h the symbols of language and word; and the symbols' seed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(marked_words(text))
            if sum(map(len, counts.values())) > WORDS_KEPT:
                yield from emit(counts)
                counts.clear()
        yield from emit(counts)

    def emit(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(_END, None)
            if words:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()),
                                                  pa.array(list(words.values()), pa.int64())], names=["lang", "word", "f"])

    counted = written(texts.mapInArrow(run, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    seed = 0
    while True:
        def named(batches: Iterator[pa.RecordBatch], seed=seed) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = [symbol(x.encode("utf-8", "surrogatepass"), seed) for x in batch.column(0).to_pylist()]
                words = [symbol(x, seed) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(np.array(langs, np.uint64)),
                                                  _signed(np.array(words, np.uint64)), batch.column(2)], names=["lang", "word", "l", "h", "f"])

        words = written(counted.mapInArrow(named, "lang string, word binary, l long, h long, f long"), "symbols")
        twice = words.groupBy("l", "h").agg(F.count("*").alias("k")).where("k > 1")  # also two languages with one symbol
        if twice.isEmpty() and words.groupBy("l").agg(F.min("lang").alias("a"), F.max("lang").alias("b")).where("a <> b").isEmpty():
            return words, seed
        seed += 1


def shards(texts: DataFrame, size: int, seed: int, frequent: np.ndarray, ranges: Ranges) -> DataFrame:
    """(rng, data): transducers of the n-grams of ``size`` words whose parts are in the bit table."""
    shared = texts.sparkSession.sparkContext.broadcast((frequent, ranges))  # fixed size; at most RANGES heavy words

    def build(runs: dict[int, list[np.ndarray]], table: Ranges) -> Iterator[pa.RecordBatch]:
        for lang, parts in runs.items():
            grams = np.concatenate(parts)
            paths, weights = summed(grams, np.ones(len(grams), np.int64))
            paths = np.column_stack([np.full(len(paths), lang, np.uint64), paths])
            rng = table.of(paths)
            order = np.argsort(rng, kind="stable")
            rng, paths, weights = rng[order], paths[order], weights[order]
            first = np.flatnonzero(np.r_[True, rng[1:] != rng[:-1]])
            data = [Transducer.of(paths[a:b], weights[a:b]).dump() for a, b in zip(first, np.r_[first[1:], len(rng)])]
            yield pa.RecordBatch.from_arrays([pa.array(rng[first].astype(np.int32)), pa.array(data, pa.binary())], names=["rng", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, at = shared.value
        known = Generations(lambda w: symbol(w, seed), CACHE_ENTRIES)
        known[_END] = 0
        langs: dict[str, int] = {}
        runs: dict[int, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = marked_words(text)
                if len(found) < size:
                    continue
                l = langs.get(lang) or langs.setdefault(lang, symbol(lang.encode("utf-8", "surrogatepass"), seed))  # noqa: E741
                h = np.fromiter((0 if w == _END else known[w] for w in found), np.uint64, len(found))
                width = size - 1  # the parts that must be frequent: words of pairs, pairs of triples
                part = np.column_stack([np.full(len(h) - width + 1, l, np.uint64), *[h[j:len(h) - width + 1 + j] for j in range(width)]])
                good = (part != 0).all(1)
                good[good] = _has(table, part[good])
                at_gram = np.flatnonzero(good[:-1] & good[1:])
                if len(at_gram):
                    runs.setdefault(l, []).append(np.stack([h[at_gram + j] for j in range(size)], 1))
                    held += len(at_gram)
                if held >= RUN_NGRAMS:
                    yield from build(runs, at)
                    runs.clear()
                    held = 0
        yield from build(runs, at)

    return texts.mapInArrow(run, "rng int, data binary")


def united(parts: DataFrame, least: int = MIN_COUNT) -> DataFrame:
    """(rng, data): one automaton per prefix range with the summed weights of ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, paths, weights, held = None, [], [], 0

        def whole() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate(paths), np.concatenate(weights))

        def ended() -> Iterator[pa.RecordBatch]:
            if now is not None:
                p, w = whole()
                p, w = p[w >= least], w[w >= least]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([Transducer.of(p, w).dump()], pa.binary())],
                                                     names=["rng", "data"])

        for batch in batches:
            for rng, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if rng != now:
                    yield from ended()
                    now, paths, weights, held = rng, [], [], 0
                p, w = Transducer.load(data).paths()
                paths.append(p)
                weights.append(w)
                held += len(p)
                if held > RANGE_NGRAMS and len(paths) > 1:
                    p, w = whole()
                    paths, weights = [p], [w]
                    held = len(p) // 2  # the next sum is due when the range has grown by half
        yield from ended()

    return parts.repartition("rng").sortWithinPartitions("rng").mapInArrow(run, "rng int, data binary")


def _word_ranges(words: DataFrame, ranges: Ranges) -> DataFrame:
    """(rng, data): the same automata for frequent single words."""
    shared = words.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = np.column_stack([_unsigned(batch.column(0)), _unsigned(batch.column(1))])
            if not len(paths):
                continue
            paths, weights = summed(paths, batch.column(2).to_numpy().astype(np.int64))
            rng = shared.value.of(paths)
            for r in np.unique(rng):
                data = Transducer.of(paths[rng == r], weights[rng == r]).dump()
                yield pa.RecordBatch.from_arrays([pa.array([int(r)], pa.int32()), pa.array([data], pa.binary())], names=["rng", "data"])

    return united(words.where(F.col("f") >= MIN_COUNT).select("l", "h", "f").mapInArrow(run, "rng int, data binary"))


def _bits_of(automata: DataFrame) -> np.ndarray:
    size = TABLE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                word, bits = _bit_rows(Transducer.load(data).paths()[0], size)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], names=["word", "bits"])

    return _bits(automata.mapInArrow(run, "word long, bits long"))


# Cuts of a candidate: (words of the part, first word of it, slot). Slots: l1, r1, l2, r2.
_CUTS = {2: [(1, 0, 0), (1, 1, 1)], 3: [(1, 0, 0), (2, 1, 1), (2, 0, 2), (1, 2, 3)]}
_ASKED = "size int, rng int, copy int, role int, data binary, l long, h1 long, h2 long, h3 long, n int, slot int, a long"


def _questions(automata: DataFrame, size: int, ranges: Ranges) -> DataFrame:
    """A row per candidate and part, with the size and range of the part's automaton."""
    shared = automata.sparkSession.sparkContext.broadcast(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1).to_pylist():
                paths, a = Transducer.load(data).paths()
                wide = np.column_stack([paths, np.zeros((len(paths), 4 - paths.shape[1]), np.uint64)])
                copy = (_slots(paths, 1 << 20) % COPIES).astype(np.int32)
                for words, first, slot in _CUTS[size]:
                    part = np.column_stack([paths[:, 0], paths[:, first + 1:first + 1 + words]])
                    full = lambda x: pa.array(np.full(len(paths), x, np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [full(words), pa.array(shared.value.of(part).astype(np.int32)), pa.array(copy), full(1), pa.nulls(len(paths), pa.binary()),
                         *[_signed(wide[:, j]) for j in range(4)], full(size), full(slot), pa.array(a)],
                        names=[x.split()[0] for x in _ASKED.split(", ")])

    return automata.mapInArrow(run, _ASKED)


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers of questions that arrive behind the automaton of their range."""
    names = ["l", "h1", "h2", "h3", "slot", "f", "a"]
    now, machine = None, None
    for batch in batches:
        spots = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2, 3)], 1)
        edge = np.flatnonzero(np.r_[True, (spots[1:] != spots[:-1]).any(1)])
        for lo, hi in zip(edge, np.r_[edge[1:], len(spots)]):
            part = batch.slice(lo, hi - lo)
            size, spot = int(spots[lo, 0]), tuple(spots[lo, :3])
            if spots[lo, 3] == 0:
                now, machine = spot, Transducer.load(part.column(4)[0].as_py())
                continue
            if now != spot:
                raise ValueError("a candidate's part has no automaton")
            whole = np.stack([_unsigned(part.column(k)) for k in (5, 6, 7, 8)], 1)
            n, slot, a = (part.column(k).to_numpy() for k in (9, 10, 11))
            first = np.zeros(len(n), np.int64)
            for k, cuts in _CUTS.items():
                for words, at, s in cuts:
                    if words == size:
                        first[(n == k) & (slot == s)] = at
            rows = np.arange(len(n))
            path = np.column_stack([whole[:, 0], *[whole[rows, first + 1 + j] for j in range(size)]])
            f = machine.weight(path)
            yield pa.RecordBatch.from_arrays([*[_signed(whole[:, j]) for j in range(4)], pa.array(slot), pa.array(f), pa.array(a)], names=names)
            cover = (n > size) & (size > 1) & (100 * a >= COVER_PERCENT * f)  # the part is a candidate that its triple covers
            if cover.any():
                path = np.unique(path[cover], axis=0)
                k = len(path)
                yield pa.RecordBatch.from_arrays([*[_signed(path[:, j]) for j in range(3)], pa.array(np.zeros(k, np.int64)),
                                                  pa.array(np.full(k, -1, np.int32)), pa.array(np.zeros(k, np.int64)),
                                                  pa.array(np.zeros(k, np.int64))], names=names)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for l1, r1, l2, r2, a in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6, 7, 8))):
            best = (1_000_000 * a * a // (l1 * r1), 1, l1, r1)
            if l2 is not None:
                best = min(best, (1_000_000 * a * a // (l2 * r2), 2, l2, r2))
            out.append(best)
        score, _, left, right = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(8), *[pa.array(x, pa.int64()) for x in (left, right, score)]],
                                         names=["l", "h1", "h2", "h3", "a", "left", "right", "score"])


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words, seed = word_counts(texts)
    langs = written(words.groupBy("l", "lang").agg(F.sum("f").alias("n")), "langs")

    total = langs.agg(F.sum("n")).collect()[0][0] or 0
    plain = int(min(RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_NGRAMS))))
    per_range = max(1, total // plain)
    heavy, at = {}, plain
    for r in words.where(F.col("f") > per_range).select("l", "h", "f").orderBy("l", "h").collect():  # fewer than RANGES rows
        parts = -(-r["f"] // per_range)
        heavy[r["l"] % (1 << 64), r["h"] % (1 << 64)] = (at, parts)
        at += parts
    ranges = Ranges(plain, heavy)

    singles = written(_word_ranges(words, ranges), "automata-1")
    pairs = written(united(shards(texts, 2, seed, _bits_of(singles), ranges)), "automata-2")
    triples = written(united(shards(texts, 3, seed, _bits_of(pairs), ranges)), "automata-3")

    none = {c: F.lit(None).cast("long") for c in ("l", "h1", "h2", "h3", "a")}
    machines = [x.select(F.lit(size).alias("size"), "rng", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), F.lit(0).alias("role"), "data",
                         *[none[c].alias(c) for c in ("l", "h1", "h2", "h3")], F.lit(0).alias("n"), F.lit(0).alias("slot"), none["a"].alias("a"))
                for size, x in ((1, singles), (2, pairs))]
    asked = _questions(pairs, 2, ranges).union(_questions(triples, 3, ranges)).union(machines[0]).union(machines[1])
    met = asked.repartition("size", "rng", "copy").sortWithinPartitions("size", "rng", "copy", "role")
    answers = met.mapInArrow(_composed, "l long, h1 long, h2 long, h3 long, slot int, f long, a long")
    per_slot = [F.max(F.when(F.col("slot") == k, F.col("f"))).alias(name) for k, name in enumerate(("l1", "r1", "l2", "r2"))]
    found = (answers.groupBy("l", "h1", "h2", "h3").agg(*per_slot, F.max("a").alias("a"), F.max(F.col("slot") == -1).alias("covered"))
             .where("not covered").drop("covered"))
    scored = found.mapInArrow(_scored, "l long, h1 long, h2 long, h3 long, a long, left long, right long, score long")
    best = Window.partitionBy("l").orderBy(F.desc("score"), F.desc("a"))
    first = written(scored.withColumn("place", F.rank().over(best)).where(F.col("place") <= top).drop("place"), "first")

    each = first.select("l", "h1", "h2", "h3", F.posexplode(F.array("h1", "h2", "h3")).alias("at", "h")).where("h <> 0")
    spelled = (each.join(words.select("l", "h", "word"), ["l", "h"]).groupBy("l", "h1", "h2", "h3")
               .agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("w")))
    named = first.join(spelled.select("l", "h1", "h2", "h3", F.array_join(F.col("w.word"), " ").alias("phrase")), ["l", "h1", "h2", "h3"])
    order = Window.partitionBy("l").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(langs, "l").select("lang", "rank", "phrase", "a", F.col("left").alias("l"), F.col("right").alias("r"), "n", "score")


ORACLE = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (
  SELECT lang, unnest(w) AS phrase, 1 AS k, 1 AS c FROM s
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2, 1 FROM s WHERE len(w) >= 2
  UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3, 1 FROM s WHERE len(w) >= 3),
f AS (SELECT lang, phrase, k, sum(c)::BIGINT AS a FROM g GROUP BY lang, phrase, k),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
x AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 10),
cuts AS (
  SELECT lang, phrase, k, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM x
  UNION ALL SELECT lang, phrase, k, a, 2, w[1] || ' ' || w[2], w[3] FROM x WHERE k = 3),
scored AS (
  SELECT cuts.*, lf.a AS l, rf.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (lf.a::HUGEINT * rf.a) AS score
  FROM cuts JOIN f lf ON lf.lang = cuts.lang AND lf.phrase = cuts.lp JOIN f rf ON rf.lang = cuts.lang AND rf.phrase = cuts.rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
covers AS (
  SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM x WHERE k = 3
  UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM x WHERE k = 3),
kept AS (
  SELECT * FROM best b WHERE k = 3 OR NOT EXISTS (SELECT 1 FROM covers c WHERE c.lang = b.lang AND c.phrase = b.phrase AND 100 * c.a >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n.n, score::BIGINT AS score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
