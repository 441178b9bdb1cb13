"""Token-id files: fixed-size id blocks, transposed into byte or bit planes, each plane compressed.

File format. A token file is a Parquet folder whose rows are *segments*. A segment holds the
ids of whole documents, in ascending document order, and its own chunk index:

==============  ==========================================================
shard, seg      position: shards ascend with the document ids, segments inside a shard
n_ids           ids in the segment
doc_ids         its documents, in order
lengths         ids per document, end id included
blocks          ``(offset, n_ids, planes)`` for every ``block_ids`` ids; ``planes`` are the
                zstandard frames of byte plane 0..3 or bit plane 0..31, low first
plane_bits      8 or 1
==============  ==========================================================

Ids are unsigned 32-bit. A reader needs one row to restore a segment, so nothing is
shuffled to read the files back, and a lost task is simply read again.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barlake.llm.shared import Generations, scratch, ship

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 20
ZSTD_LEVEL = 1
CACHE_ENTRIES = 400_000

SEGMENT_SCHEMA = (
    "shard int, seg int, n_ids long, doc_ids array<long>, lengths array<long>, "
    "blocks array<struct<offset:long,n_ids:long,planes:array<binary>>>, plane_bits int"
)
_BLOCKS = pa.list_(pa.struct([("offset", pa.int64()), ("n_ids", pa.int64()), ("planes", pa.list_(pa.binary()))]))
_SEGMENT = pa.schema([("shard", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                      ("lengths", pa.list_(pa.int64())), ("blocks", _BLOCKS), ("plane_bits", pa.int32())])

#: Texts are encoded in groups of at most so many texts, and of not much more than so many characters.
GROUP, GROUP_CHARS = 2048, 1 << 23


#: Letters of blocks whose classes no Unicode version has changed.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
#: The punctuation that ends a piece behind a letter: a pre-token of its own (RE2).
_MARKS = f"([{_LETTERS}])([!-/:-@\\[-`{{-~]+)( |$)"
#: Of keys joined by spaces, those that are a word, perhaps behind a line feed.
_WORDS = re.compile(f"(?<![^ ])\n?[{_LETTERS}]+(?![^ ])")
#: Before marks, and the end of a text; texts with such characters aren't cut.
_GLUED, _END = "\x01", "\x02"


def _byte_characters() -> str:
    """The character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The byte-level pre-tokenizer never joins a word with the single space or line feed behind
    it, nor with the punctuation that ends the piece, so texts whose white space is only that
    are cut there, and each piece is encoded once per worker: a piece is keyed without its
    leading space, with its leading line feed, or as marks behind a letter.
    Other texts, and texts with an added token's string, go whole to the tokenizer.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # words of letters are one pre-token each, so they go to the model without a pattern
        self.words = Tokenizer(Tokenizer.from_file(tokenizer_path).model)
        self.bytes = _byte_characters()
        self.feed = self._whole("\n")
        self.pieces = Generations(self._piece, CACHE_ENTRIES)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, key: str) -> bytes:
        if key[0] == _GLUED:
            return self._whole(key[1:])
        return self._whole(key if key[0] == "\n" else " " + key)

    def _learn(self, keys: list[str]) -> None:
        """Encodes the words among new keys together; other keys are encoded one by one when they are met."""
        known, old = self.pieces, self.pieces.old
        kept = [k for k in keys if k in old and k not in known]
        known.put_all(kept, [old[k] for k in kept])
        words = _WORDS.findall(" ".join([k for k in keys if k not in old and k not in known]))  # no key has a space
        if not words:
            return
        behind = [w for w in words if w[0] == "\n"]
        inside = [w for w in words if w[0] != "\n"]
        text = "".join(behind) + "".join(["\n " + w for w in inside])
        parts = codecs.charmap_decode(text[1:].encode(), "strict", self.bytes)[0].split(self.bytes[10])
        found = self.words.encode_batch([parts], is_pretokenized=True, add_special_tokens=False)[0]
        ends = (4 * np.cumsum(np.bincount(np.asarray(found.word_ids), minlength=len(parts)))).tolist()
        data, feed = np.asarray(found.ids, "<u4").tobytes(), self.feed
        ids = [data[a:b] for a, b in zip([0, *ends], ends)]
        known.put_all(behind + inside, [feed + x for x in ids[:len(behind)]] + ids[len(behind):])

    def _plain(self, text: str) -> bool:
        """Whether single spaces and line feeds are all the white space, and stand between words."""
        return not (not text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n"
                    or not text.replace("\n", " ").isprintable() or any(a in text for a in self.added))

    def _encoded(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of plain texts, each as if behind a line feed: their pieces are numbered, the numbers
        replaced by the ids of the distinct pieces."""
        joined = "".join(["\n" + t + " " + _END for t in texts]).replace("\n", " \n")[1:]
        marked = pc.replace_substring_regex(pa.array([joined], pa.large_string()), _MARKS, f"\\1 {_GLUED}\\2\\3")
        pieces = pc.split_pattern(marked, " ").values.dictionary_encode()
        keys, at = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        end = keys.index(_END)
        keys[end] = keys[0]  # any known piece: its ids are not used
        self._learn(keys)
        ids = [self.pieces[k] for k in keys]
        ids[end] = b""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        sizes = size[at]
        stops = np.cumsum(sizes)
        found = table[np.repeat(first[at] - (stops - sizes), sizes) + np.arange(stops[-1])]
        start, skip = 0, len(self.feed) // 4
        for stop in stops[at == end].tolist():
            yield found[start + skip:stop].tobytes()
            start = stop

    def _groups(self, texts: list[str]) -> Iterator[list[str]]:
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if len(group) >= GROUP or held >= GROUP_CHARS:
                yield group
                group, held = [], 0
        if group:
            yield group

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for group in self._groups(texts):
            plain = [self._plain(t) for t in group]
            cut = [t for t, p in zip(group, plain) if p]
            found = self._encoded(cut) if cut else iter(())
            for text, p in zip(group, plain):
                yield next(found) if p else self._whole(text) if text else b""


@lru_cache(maxsize=1)
def encoder(tokenizer_path: str) -> Encoder:
    """The worker's encoder: a worker keeps it, and the pieces it knows, for all its tasks."""
    return Encoder(tokenizer_path)


def to_planes(ids: np.ndarray, plane_bits: int) -> list[bytes]:
    """The block's planes: byte k (or bit k) of every id, low planes first."""
    by_byte = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if plane_bits == 8:
        return [row.tobytes() for row in by_byte]
    return [np.packbits((row >> k) & 1).tobytes() for row in by_byte for k in range(8)]


def from_planes(planes: list[bytes], n_ids: int, plane_bits: int) -> np.ndarray:
    if plane_bits == 8:
        rows = [np.frombuffer(p, np.uint8) for p in planes]
    else:
        bits = [np.unpackbits(np.frombuffer(p, np.uint8), count=n_ids) for p in planes]
        rows = [sum((bits[8 * b + k] << k for k in range(8)), np.zeros(n_ids, np.uint8)) for b in range(4)]
    return np.ascontiguousarray(np.stack(rows).T).reshape(-1).view("<u4")


def encode_segments(docs: DataFrame, tokenizer_path: str, *, end_id: int = 0, block_ids: int = BLOCK_IDS,
                    segment_ids: int = SEGMENT_IDS, plane_bits: int = 8, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Segments of all documents in ascending id order (one range shuffle of the texts).

    Null texts are empty. Null ids come first. Rows with one id are ordered by their text.
    A segment closes behind the document that fills it, so it holds less than
    ``segment_ids`` ids plus one document.
    """
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, shard, seg = encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        press = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        end = np.asarray([end_id], "<u4").tobytes()
        doc_ids, lengths, parts = [], [], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            blocks = [{"offset": k, "n_ids": min(block_ids, len(ids) - k),
                       "planes": [press.compress(p) for p in to_planes(ids[k:k + block_ids], plane_bits)]}
                      for k in range(0, len(ids), block_ids)]
            return pa.RecordBatch.from_pylist([{"shard": shard, "seg": seg, "n_ids": len(ids), "doc_ids": doc_ids,
                                                "lengths": lengths, "blocks": blocks, "plane_bits": plane_bits}], schema=_SEGMENT)

        held = 0
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                data += end
                doc_ids.append(doc_id)
                lengths.append(len(data) // 4)
                parts.append(data)
                held += len(data) // 4
                if held >= segment_ids:
                    yield flush()
                    seg, held, doc_ids, lengths, parts = seg + 1, 0, [], [], []
        if doc_ids:
            yield flush()

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    return rows.repartitionByRange("id", tie).sortWithinPartitions("id", tie, "text").mapInArrow(run, SEGMENT_SCHEMA)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, **options) -> None:
    (encode_segments(docs, tokenizer_path, **options).write
     .option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path))


def _restore(row: dict) -> np.ndarray:
    import zstandard

    press = zstandard.ZstdDecompressor()
    blocks = [from_planes([press.decompress(p) for p in b["planes"]], b["n_ids"], row["plane_bits"]) for b in row["blocks"]]
    return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


def segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_SCHEMA).parquet(path)


def segment_starts(files: DataFrame) -> DataFrame:
    """(shard, seg, base): ids in all segments before. Reads the index columns only.

    The global sum runs over one row per shard, that is per write task.
    """
    index = files.select("shard", "seg", "n_ids")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (index.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
              .select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("shard_base")))
    inside = Window.partitionBy("shard").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return (index.withColumn("seg_base", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
            .join(shards, "shard").select("shard", "seg", (F.col("shard_base") + F.col("seg_base")).alias("base")))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, ends = _restore(row), np.cumsum(row["lengths"], dtype=np.int64)
                starts = ends - np.asarray(row["lengths"], np.int64)
                n = len(starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * n, pa.int32()), pa.array([row["seg"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
                ], names=["shard", "seg", "doc_id", "local", "n_tokens", "ids_crc32"])

    files = segments(spark, path)
    docs = files.mapInArrow(run, "shard int, seg int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(segment_starts(files), ["shard", "seg"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The round trip itself: doc_id, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, ends = _restore(row), np.cumsum(row["lengths"], dtype=np.int64)
                parts = [ids[b - n:b].astype(np.int64) for b, n in zip(ends, row["lengths"])]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                                                 names=["doc_id", "ids"])

    return segments(spark, path).mapInArrow(run, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the token files of ``docs`` in the shared folder and reads them back."""
    path = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_path, **options)
    return read_documents(docs.sparkSession, path)
