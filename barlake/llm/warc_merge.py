"""WARC archives with a globally merged capture index.

*Archives.* One record per capture, WARC/1.0: ``response`` with the payload, or ``revisit`` (same
payload digest) that names the response it repeats. Only digests are shuffled to learn who
revisits; payloads are written where they are read, those of ids outside a bit table of the
revisiting ids (fixed size, false hits are told apart by id and digest) without any join. A task
packs its records into archives of at most ``FILE_BYTES`` bytes or one larger record, each record
its own gzip member as the format recommends, so a record can be read by offset and length.
Archives are binary values of a table that Spark commits, so a lost task is simply run again.

*Runs.* Reading the archives back, each one gives a run: its captures sorted by URL key and
timestamp, with archive, offset and length.

*Merge.* Captures with the smallest hashes of (run, place), about ``SAMPLE_KEYS`` at most, give keys
that cut the key space into ranges of about ``RANGE_ROWS`` captures, however the captures lie in
archives; cuts are by (URL key, timestamp, id), so one URL with many captures spans ranges. The
rows of a range arrive run by run and a loser tree merges them k ways. The result is ordered
by range and place: the global capture history.

Null payloads are empty; null URLs are empty keys. Payloads under ``MIN_BYTES`` bytes are
never revisited. Rows that share an id and a payload are one capture each; the smallest id's
is the response, and of equal rows every one is. Rows with null id are responses.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.llm.shared import scratch, ship, written

MIN_BYTES = 100
FILE_BYTES = 1 << 24
FILTER_BITS = 1 << 24
GZIP_LEVEL = 1
RANGE_ROWS = 50_000
SAMPLE_KEYS = 200_000
EPOCH = 1_704_067_200  # captures without a time get this second plus their id

_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n\r\n"
_DAY = 86_400


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, without www, then path and sorted query; lower case, no fragment."""
    try:
        parts = urlsplit(url.strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url.strip().lower()
    labels = host.split(".")
    if len(labels) > 1 and re.fullmatch(r"www\d*", labels[0]):
        labels = labels[1:]
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(labels)) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{query}" if query else "")


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, bytes, digest, refers_to: who is a response and who revisits it."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), payload.alias("payload"))
    facts = rows.select("id", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"))
    first = (facts.where(F.col("bytes") >= MIN_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
             .where("first <> last"))
    repeats = (facts.where(F.col("bytes") >= MIN_BYTES).join(first, "digest").where("id <> first")
               .select(F.col("id").alias("of"), F.col("digest").alias("of_digest"), "first").distinct())
    repeats = written(repeats, "repeats")
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = (repeats.select(F.col("of").alias("id")).groupBy(F.shiftright(slot, 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(id), {FILTER_BITS}) & 63 AS int))")).alias("bits")).toPandas())
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)  # at most so many rows reach the driver
    bitmap[bits["word"].to_numpy(np.int64)] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    table = pages.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf("boolean")
    def listed(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((table.value[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool))

    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    maybe = F.col("id").isNotNull() & listed(slot)
    alone = rows.where(~maybe).withColumn("refers_to", F.lit(None).cast("long"))
    asked = rows.where(maybe).join(repeats, (F.col("id") == F.col("of")) & (F.col("digest") == F.col("of_digest")), "left").withColumn("refers_to", F.col("first"))
    return alone.select(*_CAUGHT).unionByName(asked.withColumn("payload", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("")).select(*_CAUGHT))


_CAUGHT = ["id", "url", "payload", "bytes", "digest", "refers_to"]


def _record() -> Column:
    """The record's text, without the two blank lines that end it."""
    uri = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), "[<>]", "")
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    second = F.lit(EPOCH) + F.pmod(F.coalesce("id", F.lit(0)), F.lit(3_650 * _DAY))
    date = F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("id"), F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"), F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                                 name("refers_to"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END))
    return F.concat(head, block)


def write_warc(caught: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Archives (archive, content): every task closes its archive before it passes ``file_bytes``."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        part, number, members, held = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:05d}-{number:05d}.warc.gz"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for text in batch.column(0):
                press = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                data = press.compress(text.as_py().encode("utf-8", "surrogatepass") + _END.encode()) + press.flush()
                if members and held + len(data) > file_bytes:
                    yield close()
                    number, members, held = number + 1, [], 0
                members.append(data)
                held += len(data)
        if members:
            yield close()

    packed = caught.select(_record().alias("value")).mapInArrow(pack, "archive string, content binary")
    packed.write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


_RUN = "run string, seq long, url_key string, ts string, id long, payload_bytes long, digest string, type string, refers_to long, offset long, length long"


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of every gzip member of an archive."""
    import zlib

    at = 0
    while at < len(content):
        press = zlib.decompressobj(31)
        record = press.decompress(memoryview(content)[at:]) + press.flush()
        end = len(content) - len(press.unused_data)
        yield at, end - at, record
        at = end


def parse(content: bytes) -> Iterator[dict]:
    """The records of an archive. Lengths come from the headers, so payloads may hold anything."""
    for at, length, record in members(content):
        head_end = record.index(b"\r\n\r\n")
        lines = record[:head_end].decode("utf-8", "surrogatepass").split("\r\n")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        start, size = head_end + 4, int(fields["Content-Length"])
        block = record[start:start + size]
        payload = block[block.index(b"\r\n\r\n") + 4:]
        named = lambda k: None if (v := fields[k][len("<urn:capture:"):-1]) == "null" else int(v)
        kind = fields["WARC-Type"]
        digest = hashlib.sha256(payload).hexdigest() if kind == "response" else fields["WARC-Payload-Digest"].split(":")[1]
        yield {"url_key": url_key(fields["WARC-Target-URI"]), "ts": re.sub(r"\D", "", fields["WARC-Date"]), "id": named("WARC-Record-ID"),
               "payload_bytes": len(payload) if kind == "response" else int(fields["X-Payload-Length"]), "digest": digest, "type": kind,
               "refers_to": named("WARC-Refers-To") if kind == "revisit" else None, "offset": at, "length": length}


def _key(r: dict) -> tuple:
    return r["url_key"], r["ts"], -1 if r["id"] is None else r["id"]


def runs(spark: SparkSession, path: str) -> DataFrame:
    """One sorted run per archive."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = sorted(parse(content.as_py()), key=_key)
                for k in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_pylist([r | {"run": name, "seq": k + n} for n, r in enumerate(rows[k:k + 10_000])], schema=_RUN_SCHEMA)

    return spark.read.schema("archive string, content binary").parquet(path).mapInArrow(read, _RUN)


_RUN_SCHEMA = pa.schema([(f.split()[0], pa.int64() if f.split()[1] == "long" else pa.string()) for f in _RUN.split(", ")])


class LoserTree:
    """k-way merge: the root holds the least head, each inner node the loser of its match."""

    def __init__(self, sources: list[Iterator]):
        self.sources, self.k = sources, len(sources)
        self.heads = [next(s, None) for s in sources]
        self.tree = [-1] * self.k
        for source in range(self.k):
            self._play(source)

    def _beats(self, a: int, b: int) -> bool:
        if a == -1 or b == -1:  # while the tree is filled, an empty place beats all
            return a == -1
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x[0], a) < (y[0], b))

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            if self._beats(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[w := self.tree[0]] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.sources[w], None)
            self._play(w)


def merged(indexed: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The runs merged into one order: their columns with range_id and place."""
    spark = indexed.sparkSession
    n = indexed.count()
    wanted = min(n, SAMPLE_KEYS // 2, 50 * -(-n // range_rows))  # keys, whatever the runs are
    heads = indexed.where(F.pmod(F.xxhash64("run", "seq"), F.lit(1 << 40)) < int((1 << 40) * (wanted / max(n, 1))))
    keys = sorted(map(tuple, heads.select("url_key", "ts", F.coalesce("id", F.lit(-1)).alias("i")).collect()))  # about ``wanted`` keys
    apart = max(1, round(len(keys) * range_rows / max(n, 1)))
    cuts = spark.sparkContext.broadcast(keys[apart::apart])

    @F.pandas_udf("int")
    def range_of(url: pd.Series, ts: pd.Series, i: pd.Series) -> pd.Series:
        from bisect import bisect_right

        return pd.Series([bisect_right(cuts.value, k) for k in zip(url, ts, i)], dtype="int32")

    fields = [c.split()[0] for c in _RUN.split(", ")]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        current = None

        def flush() -> Iterator[pa.RecordBatch]:
            tree = LoserTree([iter([(_key(r), r) for r in rows]) for rows in held.values()])
            out = [r | {"place": k} for k, (_, r) in enumerate(tree)]
            for k in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[k:k + 10_000], schema=schema)

        schema = None
        for batch in batches:
            schema = schema or pa.schema([*batch.schema, ("place", pa.int64())])
            for row in batch.to_pylist():
                if current is not None and row["range_id"] != current:
                    yield from flush()
                    held.clear()
                current = row["range_id"]
                held.setdefault(row["run"], []).append(row)
        if held:
            yield from flush()

    ranged = indexed.withColumn("range_id", range_of("url_key", "ts", F.coalesce("id", F.lit(-1))))
    parts = max(1, min(len(cuts.value) + 1, 20_000))
    dealt = ranged.repartition(parts, "range_id").sortWithinPartitions("range_id", "run", "seq")
    return dealt.select(*fields, "range_id").mapInArrow(merge, f"{_RUN}, range_id int, place long")


def archive_history(pages: DataFrame, *, range_rows: int = RANGE_ROWS, file_bytes: int = FILE_BYTES, **columns) -> DataFrame:
    """Writes the archives in the shared folder, reads them back and merges their runs."""
    spark = pages.sparkSession
    ship(spark)
    path = scratch(spark, "warc")
    write_warc(captures(pages, **columns), path, file_bytes)
    return merged(written(runs(spark, path), "runs"), range_rows)


def digest_rows(history: DataFrame) -> DataFrame:
    return history.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"),
                          F.col("type").alias("record_type"), "refers_to", "url_key", "ts", "range_id", "place")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN d.payload_bytes >= 100 AND d.page_id <> f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.payload_bytes >= 100 AND d.page_id <> f.first THEN f.first END AS refers_to
FROM d JOIN f ON f.payload_digest = d.payload_digest
"""
