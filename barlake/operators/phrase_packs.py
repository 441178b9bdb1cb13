"""Word runs as 64-bit hashes in compressed blobs; used inside tasks by ``polarity``.

A run of 1 to ``MAX_WORDS`` words is one hash of its words' hashes. Sorted hashes travel as differences, byte
plane by byte plane, in one row per bucket (the ``BUCKET_BITS`` top bits): some 3 to 6 bytes a run, where a row of
its own with the run's text takes 17 and more. Rows (b, n, data) hold ``n`` sorted hashes of bucket ``b``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

MAX_WORDS = 3
BUCKET_BITS = 9
#: Hashes a task holds before it sorts them, and words of a pack.
HELD = 1 << 22
PACK_WORDS = 1 << 21
SPAN_WORDS = 1 << 18
#: Low bits of a hash that make room for a text's number or a count where only the bits above are compared.
LOW_BITS = 24
_LOW = np.uint64((1 << LOW_BITS) - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Stands for a null valence.
NULL = np.array([0x7FF8000000000001], np.uint64).view(np.float64)[0]
BLOB = "b int, n int, data binary"
#: Bits of a hash by which most runs outside a pack's hits are told before they are looked up.
NEAR_BITS = 22


@lru_cache(maxsize=200_000)
def _hash(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


def flat_words(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(all words, number of words by row) of a column of word lists."""
    offsets = column.offsets.to_numpy()
    return column.values.slice(offsets[0], offsets[-1] - offsets[0]), np.diff(offsets)


def numbered(parts: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, each word's place among them); common words get the small numbers."""
    flat = pa.concat_arrays(parts).dictionary_encode()
    at = flat.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(at, minlength=len(flat.dictionary)), kind="stable")
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    return flat.dictionary.take(pa.array(order)), number[at]


def hashes_of(distinct: pa.Array) -> np.ndarray:
    return np.fromiter(map(_hash, distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words, by place."""
    n = max(len(words) - k + 1, 0)
    out = words[:n].copy()
    for d in range(1, k):
        out *= _STEP
        out ^= out >> np.uint64(32)
        out += words[d:d + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def runs(words: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, hash, place) of the runs of 1 to MAX_WORDS words inside a row; ``row`` is each word's."""
    for k in range(1, MAX_WORDS + 1):
        found = run_hashes(words, k)
        at = np.nonzero(row[:len(found)] == row[k - 1:])[0] if len(found) else np.zeros(0, np.int64)
        yield k, found[at], at


def spans(sizes: np.ndarray) -> Iterator[tuple[slice, slice]]:
    """(rows, words) of parts of some SPAN_WORDS words; what a task makes of a pack stays this small."""
    end, low = np.cumsum(sizes), 0
    while low < len(sizes):
        begin = int(end[low] - sizes[low])
        high = max(low + 1, int(np.searchsorted(end, begin + SPAN_WORDS, "right")))
        yield slice(low, high), slice(begin, int(end[high - 1]))
        low = high


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def press(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(map(_planes, columns)), codec="zstd", asbytes=True)


def unpress(data: bytes, *shape: tuple[type, int]) -> list[np.ndarray]:
    """The columns of ``press``, each given as (type, length)."""
    sizes = [np.dtype(t).itemsize * n for t, n in shape]
    raw, out, at = pa.decompress(data, decompressed_size=sum(sizes), codec="zstd", asbytes=True), [], 0
    for (t, n), size in zip(shape, sizes):
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(t).itemsize, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(t))
        at += size
    return out


def gaps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=np.uint64(0))


def unzipped(data: bytes, n: int, *more: tuple[type, int]) -> list[np.ndarray]:
    first, *others = unpress(data, (np.uint64, n), *more)
    return [np.cumsum(first, dtype=np.uint64), *others]


def _buckets(values: np.ndarray) -> Iterator[tuple[int, slice]]:
    top = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cuts = np.concatenate([[0], np.nonzero(np.diff(top))[0] + 1, [len(top)]]) if len(top) else np.zeros(1, np.int64)
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield int(top[low]), slice(low, high)


def blob_rows(values: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """(b, n, data) of sorted hashes and what belongs to each."""
    rows = [(b, s.stop - s.start, press(gaps(values[s]), *(c[s] for c in columns))) for b, s in _buckets(values)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                       pa.array([r[2] for r in rows], pa.binary())], names=["b", "n", "data"])


def _summed(parts: list[np.ndarray], most: int) -> np.ndarray:
    """Sorted keys (high bits, count in the low ones), one per high bits, with the sum of the counts up to ``most``."""
    keys = np.concatenate(parts)
    keys.sort()
    high = keys & ~_LOW
    first = np.nonzero(np.concatenate([[True], high[1:] != high[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    if not len(first):
        return keys
    counts = np.add.reduceat((keys & _LOW).astype(np.int64), first)
    return high[first] | np.minimum(counts, most).astype(np.uint64)


PACK = "pack long, b int, n int, data binary"


def _row(schema: dict[str, pa.DataType], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.values())], names=list(schema))


def labelled_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, data): packs of some PACK_WORDS words of the rows (list of words, y)."""
    words, sizes, labels, n = [], [], [], 0

    def packed() -> pa.RecordBatch:
        distinct, number = numbered(words)
        size, y = np.concatenate(sizes), np.concatenate(labels)
        body = press(number, size.astype(np.uint32), y)
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([distinct], names=["word"])
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(batch)
        return _row({"n": pa.int32(), "data": pa.binary()}, n, np.array([n, len(size), len(body)], np.int64).tobytes() + body + sink.getvalue().to_pybytes())

    for batch in batches:
        flat, size = flat_words(batch.column(0))
        some = size > 0
        words.append(flat)
        sizes.append(size[some])
        labels.append(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)[some])
        n += len(flat)
        if n >= PACK_WORDS:
            yield packed()
            words, sizes, labels, n = [], [], [], 0
    if n:
        yield packed()


def _labelled(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, numbers, sizes, y) of a pack."""
    n, rows, size = np.frombuffer(data, np.int64, 3).tolist()
    number, sizes, y = unpress(data[24:24 + size], (np.uint32, n), (np.uint32, rows), (np.int64, rows))
    return pa.ipc.open_stream(data[24 + size:]).read_next_batch().column(0), number, sizes.astype(np.int64), y


def run_counts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blobs of the runs in packs, low bits off, with the number of rows that have them, up to ``most``."""
    done: list[np.ndarray] = []

    def blobs() -> pa.RecordBatch:
        all_ = _summed(done, most)
        return blob_rows(all_ & ~_LOW, (all_ & _LOW).astype(np.uint32))

    for batch in batches:
        for data in batch.column(0).to_pylist():
            distinct, number, sizes, _ = _labelled(data)
            hashes = hashes_of(distinct)
            for rows, at in spans(sizes):
                row = np.repeat(np.arange(len(sizes[rows]), dtype=np.uint64), sizes[rows])
                each = np.concatenate([(found & ~_LOW) | row[place] for _, found, place in runs(hashes[number[at]], row)])
                each.sort()  # by run and row
                each = each[np.concatenate([[True], each[1:] != each[:-1]])]
                done.append(_summed([(each & ~_LOW) | np.uint64(1)], most))
                if sum(map(len, done)) >= HELD:
                    done = [_summed(done, most)]
                    if len(done[0]) >= HELD // 2:
                        yield blobs()
                        done = []
    if done:
        yield blobs()


def frequent(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Blobs of the runs whose counts reach ``least``, from blobs with counts that are sorted by bucket."""
    now, parts = None, []

    def chosen() -> pa.RecordBatch:
        keys = _summed(parts, least)
        return blob_rows(keys[(keys & _LOW) >= least] & ~_LOW)

    for batch in batches:
        for b, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            if b != now and parts:
                yield chosen()
                parts = []
            now = b
            high, count = unzipped(data, n, (np.uint32, n))
            parts.append(high | count.astype(np.uint64))
    if parts:
        yield chosen()


def table_slices(batches: Iterator[pa.RecordBatch], bits: int, *more: type) -> Iterator[pa.RecordBatch]:
    """(b, data): the part of a table of 2 ** ``bits`` bits that bucket b's hashes set, from blobs that are sorted by
    bucket; ``more`` are the types of the blobs' further columns."""
    now, flags = None, np.zeros(1 << (bits - BUCKET_BITS), bool)

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([press(np.packbits(flags))], pa.binary())], names=["b", "data"])

    for batch in batches:
        for b, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            if b != now and now is not None:
                yield part()
                flags[:] = False
            now = b
            values = unzipped(data, n, *((t, n) for t in more))[0]
            flags[((values >> np.uint64(64 - bits)) & np.uint64(len(flags) - 1)).astype(np.int64)] = True
    if now is not None:
        yield part()


class Table:
    """A bit table: false for most hashes that it hasn't got, true for all that it has."""

    def __init__(self, bits: int, slices: list[tuple[int, bytes]]):
        self.bits, self.slices, self.table = bits, slices, None

    def __getstate__(self) -> tuple:
        return self.bits, self.slices

    def __setstate__(self, state: tuple) -> None:
        self.bits, self.slices = state
        self.table = None

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.table is None:
            part = 1 << (self.bits - BUCKET_BITS - 3)
            self.table = np.zeros(part << BUCKET_BITS, np.uint8)
            for b, data in self.slices:
                self.table[b * part:(b + 1) * part] = unpress(data, (np.uint8, part))[0]
        at = hashes >> np.uint64(64 - self.bits)
        return (self.table[(at >> np.uint64(3)).astype(np.int64)] >> (~at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def known_runs(batches: Iterator[pa.RecordBatch], table: Table) -> Iterator[pa.RecordBatch]:
    """(b, n, data): the runs in packs that the table lets through, by bucket: text, and the sums of y and of 1 - y over the rows
    that have them."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        all_, first, of = np.unique(np.concatenate([x[0] for x in parts]), return_index=True, return_inverse=True)
        sums = [np.zeros(len(all_), np.int64) for _ in range(2)]
        for j, out in enumerate(sums, 1):
            np.add.at(out, of, np.concatenate([x[j] for x in parts]))
        return all_, *sums, pa.concat_arrays([x[3] for x in parts]).take(pa.array(first))

    def blobs() -> Iterator[pa.RecordBatch]:
        all_, p, n, token = parts[0]
        token = token.cast(pa.string())
        _, at, text = token.buffers()
        at, text = np.frombuffer(at, np.int32, len(token) + 1), np.frombuffer(text, np.uint8)
        for b, s in _buckets(all_):
            size = np.diff(at[s.start:s.stop + 1]).astype(np.uint32)
            yield _row({"b": pa.int32(), "n": pa.int32(), "data": pa.binary()}, b, len(size),
                       int(size.sum()).to_bytes(8, "little") + press(size, p[s], n[s], text[at[s.start]:at[s.stop]]))

    for batch in batches:
        for data in batch.column(0).to_pylist():
            distinct, number, sizes, labels = _labelled(data)
            hashes = hashes_of(distinct)
            for rows, words in spans(sizes):
                number_, y, row = number[words], labels[rows], np.repeat(np.arange(len(sizes[rows])), sizes[rows])
                for k, found, at in runs(hashes[number_], row):
                    some = table.has(found)
                    found, at = found[some], at[some]
                    if not len(found):
                        continue
                    each, first, of = np.unique(found, return_index=True, return_inverse=True)
                    pair = np.unique((of << LOW_BITS) | row[at])
                    start = np.nonzero(np.diff(pair >> LOW_BITS, prepend=-1))[0]
                    p = np.add.reduceat(y[pair & int(_LOW)], start)
                    token = [distinct.take(pa.array(number_[at[first] + d])) for d in range(k)]
                    parts.append((each, p, np.diff(start, append=len(pair)) - p, pc.binary_join_element_wise(*token, " ") if k > 1 else token[0]))
                if sum(len(x[0]) for x in parts) >= HELD // 2:
                    parts = [merged()]
                    if len(parts[0][0]) >= HELD // 4:
                        yield from blobs()
                        parts = []
    if parts:
        parts = [merged()]
        yield from blobs()


def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, p, n), summed by token, from the blobs of ``known_runs``, which are sorted by bucket."""
    now, parts = None, []

    def summed() -> list[pa.RecordBatch]:
        sums = pa.concat_tables(parts).group_by("token", use_threads=False).aggregate([("p", "sum"), ("n", "sum")])
        return sums.select(["token", "p_sum", "n_sum"]).rename_columns(["token", "p", "n"]).to_batches()

    for batch in batches:
        for b, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            if b != now and parts:
                yield from summed()
                parts = []
            now = b
            size, p, q, text = unpress(data[8:], (np.uint32, n), (np.int64, n), (np.int64, n), (np.uint8, int.from_bytes(data[:8], "little")))
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            token = pa.StringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(text))
            parts.append(pa.table({"token": token, "p": p, "n": q}))
    if parts:
        yield from summed()


def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blobs of a lexicon (list of words, valence), with the valences."""
    hashes, valences, held = [], [], 0

    def blobs() -> pa.RecordBatch:
        all_, v = np.concatenate(hashes), np.concatenate(valences)
        order = np.argsort(all_)
        return blob_rows(all_[order], v[order])

    for batch in batches:
        flat, sizes = flat_words(batch.column(0))
        distinct, number = numbered([flat])
        words, row = hashes_of(distinct)[number], np.repeat(np.arange(len(sizes)), sizes)
        v = batch.column(1).fill_null(NULL).to_numpy(zero_copy_only=False)
        for k, found, at in runs(words, row):
            whole = sizes[row[at]] == k
            hashes.append(found[whole])
            valences.append(v[row[at[whole]]])
            held += len(hashes[-1])
        if held >= HELD // 2:
            yield blobs()
            hashes, valences, held = [], [], 0
    if held:
        yield blobs()


def asked(distinct: np.ndarray, number: np.ndarray, sizes: np.ndarray, table: Table) -> np.ndarray:
    """The distinct runs of a pack that the table lets through, sorted."""
    single = run_hashes(distinct, 1)
    found = [single[table.has(single)]]
    for rows, words in spans(sizes):
        row = np.repeat(np.arange(len(sizes[rows]), dtype=np.int32), sizes[rows])
        found += [f[table.has(f)] for k, f, _ in runs(distinct[number[words]], row) if k > 1]
    found = np.concatenate(found)
    found.sort()
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def packs(batches: Iterator[pa.RecordBatch], table: Table, codes: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """Packs of some PACK_WORDS words of the rows (what to keep, emphasis, words, capitals), each a row with b = -1, and blobs of
    the runs that each asks the lexicon for. ``codes`` are of the words with a part in the rules."""
    held, n, seq = [], 0, 0
    schema = {"pack": pa.int64(), "b": pa.int32(), "n": pa.int32(), "data": pa.binary()}

    def packed() -> Iterator[pa.RecordBatch]:
        distinct, number = numbered([x[1] for x in held])
        code = np.fromiter((codes.get(w, 0) for w in distinct.cast(pa.binary()).to_pylist()), np.uint8, len(distinct))
        distinct, pack = hashes_of(distinct), (TaskContext.get().partitionId() << 32) + seq
        sizes, caps = (np.concatenate([x[j] for x in held]) for j in (2, 3))
        body = press(distinct, code, number, np.packbits(caps), sizes.astype(np.uint32))
        sink = pa.BufferOutputStream()
        kept = pa.Table.from_batches([x[0] for x in held]).combine_chunks()
        held.clear()
        with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(kept)
        data = np.array([len(distinct), n, len(sizes), len(body)], np.int64).tobytes() + body + sink.getvalue().to_pybytes()
        yield _row(schema, pack, -1, n, data)
        blobs = blob_rows(asked(distinct, number, sizes, table))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blobs), pack)), *blobs.columns], names=list(schema))

    for batch in batches:
        *kept, low, caps = batch.columns
        flat, sizes = flat_words(low)
        some = sizes > 0
        if not some.any():
            continue
        kept = pa.RecordBatch.from_arrays(kept, names=[f"c{j}" for j in range(len(kept))]).filter(pa.array(some))
        held.append((kept, flat, sizes[some], flat_words(caps)[0].to_numpy(zero_copy_only=False)))
        n += len(flat)
        if n >= PACK_WORDS:
            yield from packed()
            n, seq = 0, seq + 1
    if held:
        yield from packed()


def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pack, b, n, data): which of the runs that a pack asks of bucket b the lexicon has, and their valences. Rows (b, kind,
    pack, n, data) are blobs of the lexicon (kind 0) and of packs (1), sorted by b and kind, so a task holds one bucket of the lexicon."""
    now, parts, known = None, [], None
    schema = {"pack": pa.int64(), "b": pa.int32(), "n": pa.int32(), "data": pa.binary()}
    for batch in batches:
        for b, kind, pack, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            if b != now:
                now, parts, known = b, [], None
            if kind == 0:
                parts.append(unzipped(data, n, (np.float64, n)))
                continue
            if not parts:
                continue
            if known is None:
                all_, v = (np.concatenate([x[j] for x in parts]) for j in range(2))
                order = np.argsort(all_)
                known = all_[order], v[order].view(np.uint64)
            runs_ = unzipped(data, n)[0]
            at = np.minimum(np.searchsorted(known[0], runs_), len(known[0]) - 1)
            some = np.nonzero(known[0][at] == runs_)[0]
            if len(some):
                values, of = np.unique(known[1][at[some]], return_inverse=True)
                yield _row(schema, pack, b, len(some), len(values).to_bytes(4, "little") + press(np.diff(some, prepend=0).astype(np.uint32), of.astype(np.uint32), values))


def answer(b: int, n: int, data: bytes, runs_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, valence) of the hits among all runs that the pack asks for."""
    steps, of, values = unpress(data[4:], (np.uint32, n), (np.uint32, n), (np.uint64, int.from_bytes(data[:4], "little")))
    begin = int(np.searchsorted(runs_, np.uint64(b << (64 - BUCKET_BITS))))
    return runs_[begin + np.cumsum(steps, dtype=np.int64)], values[of].view(np.float64)


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
    """(distinct words, their codes, numbers, capitals, sizes, kept rows) of a pack."""
    n_distinct, n, n_rows, size = np.frombuffer(data, np.int64, 4).tolist()
    distinct, code, number, caps, sizes = unpress(data[32:32 + size], (np.uint64, n_distinct), (np.uint8, n_distinct), (np.uint32, n),
                                                  (np.uint8, -(-n // 8)), (np.uint32, n_rows))
    return distinct, code, number, np.unpackbits(caps, count=n).astype(bool), sizes.astype(np.int64), pa.ipc.open_stream(data[32 + size:]).read_all()
