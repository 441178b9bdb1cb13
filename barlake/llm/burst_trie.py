"""Prefix trie of conversations, built as a burst trie.

A conversation is the sequence of its turns' ids (128-bit digests of role and text). Equal
sequences are one entry with its members' count, smallest id and digest of ids.

1. *Containers.* Entries lie in suffix containers under a trie head, at first one head per
   first turn.
2. *Bursting.* A container of more than ``CONTAINER`` entries bursts: its entries' common
   prefix becomes trie heads, and each next turn id a container of its own. The common prefix
   is that of the least and the greatest sequence, so a round goes down to the next branching
   however long the prefix is. Rounds go on until no container is oversized, and each ends
   in a written table.
3. *Sweep.* Containers are sorted by sequence and swept in one pass with a stack of open
   nodes, which gives every node below the heads with its subtree's sums.
4. *Heads.* Containers' tops are summed into the heads above them.

Defined results: rows with null conv_id are left out; turns are ordered by turn (null
first), then role, then text; null role or text is empty; repeated rows are turns of their
own; an empty table has no node. Ids from a text of any length are 16 bytes; a conversation's
ids are one row (20 bytes a turn, no texts). Other columns are ignored, whatever their names.
The digest of a node's ids is sequential by its definition: one task streams a group of equal
conversations in order, without holding it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.llm.shared import written

#: Rebuilding: conversations of one hundred share the first turns of its first one (fixed values).
FAMILY = 100
SHARED = 6
#: Entries that a container holds at most.
CONTAINER = 8192
SALTS = 16
BATCH = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()

_ENTRY = "ids array<binary>, chars array<int>, n long, lo long, ends string"
_NODE = ("lo long, depth int, parent long, n long, children long, leaves long, saved long, ends string, "
         "up array<binary>, up_chars array<int>")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, chars: every conversation's turns in order, as digests and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    placed = rows.select("conv_id", F.row_number().over(order).alias("at"), digest.alias("id"), F.char_length("text").alias("c"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "c"))).alias("t"))
    return whole.select("conv_id", F.col("t.id").alias("ids"), F.col("t.c").alias("chars"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ids, chars after a conversation's first turns were replaced by its family's."""
    own = turn_rows(conversations)
    first = (own.where(F.pmod("conv_id", F.lit(FAMILY)) == 0)
             .select(F.col("conv_id").alias("base"), *[F.slice(c, 1, SHARED - 1).alias(f"b_{c}") for c in ("ids", "chars")]))
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    rows = (own.withColumn("h", shared).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(first, "base", "left"))

    def joined(c: str, kind: str) -> Column:
        head = F.coalesce(F.slice(F.col(f"b_{c}"), F.lit(1), F.col("h")), F.array().cast(kind))
        return F.concat(head, F.slice(F.col(c), F.col("h") + 1, F.greatest(F.size(c), F.lit(1)))).alias(c)

    return rows.select("conv_id", joined("ids", "array<binary>"), joined("chars", "array<int>"))


def entries(sequences: DataFrame) -> DataFrame:
    """Distinct sequences: ids, chars, n, lo (smallest member), ends (digest of all members)."""
    key = F.md5(F.array_join(F.transform("ids", F.hex), ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, sha = [], None, None
        for batch in batches:
            keys, convs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (k, conv) in enumerate(zip(keys, convs)):
                if now is None or k != now[0]:
                    if now is not None:
                        done.append((*now[1:], sha.hexdigest()))
                    now, sha = [k, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), 0, conv], hashlib.sha256()
                sha.update(b"%d" % conv if now[3] == 0 else b",%d" % conv)
                now[3] += 1
            if len(done) >= BATCH:
                yield _batch(done, _ENTRY_SCHEMA)
                done = []
        if now is not None:
            done.append((*now[1:], sha.hexdigest()))
        if done:
            yield _batch(done, _ENTRY_SCHEMA)

    rows = sequences.select(key.alias("k"), "conv_id", "ids", "chars")
    return rows.repartition("k").sortWithinPartitions("k", "conv_id").mapInArrow(run, _ENTRY)


_ENTRY_SCHEMA = pa.schema([("ids", pa.list_(pa.binary())), ("chars", pa.list_(pa.int32())), ("n", pa.int64()),
                           ("lo", pa.int64()), ("ends", pa.string())])
_NODE_SCHEMA = pa.schema([("lo", pa.int64()), ("depth", pa.int32()), ("parent", pa.int64()), ("n", pa.int64()),
                          ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
                          ("up", pa.list_(pa.binary())), ("up_chars", pa.list_(pa.int32()))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def burst(found: DataFrame, container: int = CONTAINER) -> DataFrame:
    """``found`` with ``hd``: the depth of each entry's container. Shorter entries end at a trie head."""
    rows = found.withColumn("hd", F.lit(1))
    head = F.slice(F.col("ids"), F.lit(1), F.col("hd"))
    while True:
        inside = rows.where(F.size("ids") >= F.col("hd")).select(head.alias("head"), "ids")
        full = (inside.groupBy("head").agg(F.count("*").alias("k"), F.min("ids").alias("a"), F.max("ids").alias("b"))
                .where(F.col("k") > container))
        alike = F.zip_with(F.col("a"), F.slice("b", F.lit(1), F.size("a")), lambda x, y: F.coalesce(x == y, F.lit(False)))
        common = F.coalesce(F.nullif(F.array_position(alike, False), F.lit(0)) - 1, F.size("a").cast("long"))
        full = written(full.select("head", (common + 1).cast("int").alias("new")), "burst")
        if full.isEmpty():
            return rows
        salted = full.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = rows.select("*", head.alias("head"), F.pmod("lo", F.lit(SALTS)).cast("int").alias("salt"))
        rows = written(keyed.join(salted, ["head", "salt"], "left").withColumn("hd", F.coalesce("new", "hd"))
                       .drop("head", "salt", "new"), "containers")


class _Open:
    """A node whose subtree is being swept."""

    def __init__(self, depth: int, chars: int):
        self.depth, self.chars = depth, chars
        self.n, self.lo, self.leaves, self.saved, self.ends, self.below = 0, None, 0, 0, NO_ENDS, []

    def take(self, n: int, lo: int) -> None:
        self.n += n
        self.lo = lo if self.lo is None else min(self.lo, lo)


def _closed(node: _Open, above: _Open | None, out: list[tuple], up: tuple) -> None:
    """Ends a node: its children's rows are complete now, its own row waits for the parent."""
    out.extend((lo, depth, node.lo, *rest, None, None) for lo, depth, *rest in node.below)
    leaves = node.leaves if node.below else 1
    saved = node.saved + (node.n - 1) * node.chars
    row = (node.lo, node.depth, node.n, len(node.below), leaves, saved, node.ends)
    if above is None:
        out.append((*row[:2], None, *row[2:], *up))
    else:
        above.take(node.n, node.lo)
        above.leaves += leaves
        above.saved += saved
        above.below.append(row)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers that arrive sorted by sequence; a top carries the ids above it."""
    out, stack, before, top = [], [], [], 0

    def unwind(keep: int) -> None:
        while len(stack) > keep:
            node = stack.pop()
            _closed(node, stack[-1] if stack else None, out, (before[:top - 1], before_chars[:top - 1]))

    before_chars: list[int] = []
    for batch in batches:
        for ids, chars, n, lo, ends, hd in zip(*(c.to_pylist() for c in batch.columns)):
            same = 0
            if hd == top and ids[:hd] == before[:hd]:
                same = hd
                while same < min(len(ids), len(before)) and ids[same] == before[same]:
                    same += 1
            unwind(max(0, same - top + 1) if same else 0)
            before, before_chars, top = ids, chars, hd
            for depth in range(hd + len(stack), len(ids) + 1):
                stack.append(_Open(depth, chars[depth - 1]))
            stack[-1].take(n, lo)
            stack[-1].ends = ends
            if len(out) >= BATCH:
                yield _batch(out, _NODE_SCHEMA)
                out.clear()
    unwind(0)
    if out:
        yield _batch(out, _NODE_SCHEMA)


def trie_nodes(sequences: DataFrame, container: int = CONTAINER) -> DataFrame:
    """All nodes of the trie over ``sequences`` (conv_id, ids, chars): lo, depth, parent, n, children, leaves, saved, ends."""
    rows = burst(written(entries(sequences), "entries"), container)
    head = F.slice(F.col("ids"), F.lit(1), F.col("hd"))
    inside = (rows.where(F.size("ids") >= F.col("hd")).withColumn("head", head).repartition("head").sortWithinPartitions("head", "ids")
              .select("ids", "chars", "n", "lo", "ends", "hd"))
    nodes = written(inside.mapInArrow(_sweep, _NODE), "nodes")

    tops = nodes.where("up is not null")
    ended = rows.where(F.size("ids") < F.col("hd")).select(F.col("ids").alias("up"), F.col("chars").alias("up_chars"), "n", "lo",
                                                           F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), "ends")
    items = tops.select("up", "up_chars", "n", "lo", "leaves", "saved", F.lit(None).cast("string").alias("ends")).unionByName(ended)
    each = items.withColumn("d", F.explode(F.sequence(F.lit(0), F.size("up"))))
    heads = written(each.groupBy(F.slice(F.col("up"), F.lit(1), F.col("d")).alias("path")).agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("below"),
        F.max(F.when(F.col("d") == F.size("up"), F.col("ends"))).alias("ends"),
        F.max(F.when(F.col("d") > 0, F.get("up_chars", F.col("d") - 1)).otherwise(0)).alias("chars")), "heads")

    above = F.slice(F.col("path"), F.lit(1), F.size("path") - 1)
    own = ((F.col("n") - 1) * F.col("chars")).alias("own")
    spread = heads.select("path", own, F.explode(F.sequence(F.lit(0), F.size("path"))).alias("d"))
    sums = spread.groupBy(F.slice(F.col("path"), F.lit(1), F.col("d")).alias("path")).agg(F.sum("own").alias("own"))
    kids = (tops.select(F.col("up").alias("path")).union(heads.where(F.size("path") > 0).select(above.alias("path")))
            .groupBy("path").agg(F.count("*").alias("children")))
    over = heads.select(F.col("path").alias("p_path"), F.col("lo").alias("parent"))
    children = F.coalesce("children", F.lit(0))
    top_rows = (heads.join(sums, "path").join(kids, "path", "left")
                .join(over, F.when(F.size("path") > 0, above) == F.col("p_path"), "left")
                .select("lo", F.size("path").alias("depth"), "parent", "n", children.cast("long").alias("children"),
                        F.when(children > 0, F.col("leaves")).otherwise(1).cast("long").alias("leaves"),
                        (F.col("below") + F.col("own")).alias("saved"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends")))

    salted = over.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keep = ["lo", "depth", "parent", "n", "children", "leaves", "saved", "ends"]
    linked = (tops.drop("parent").withColumn("t_salt", F.pmod("lo", F.lit(SALTS)).cast("int"))
              .join(salted, (F.col("up") == F.col("p_path")) & (F.col("t_salt") == F.col("salt")), "left"))
    return nodes.where("up is null").select(keep).unionByName(linked.select(keep)).unionByName(top_rows.select(keep))


def conversation_trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node of the trie over the rebuilt conversations."""
    nodes = trie_nodes(rebuilt(conversations), container)
    return nodes.select(F.col("lo").alias("conv_id"), F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
                        F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
                        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


#: The checksum of decimal ids, bit by bit (the reversed polynomial 0xEDB88320 is a fixed value).
ORACLE = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS at
  FROM conversations WHERE conv_id IS NOT NULL),
k AS (
  SELECT c, c - c % 100 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * length(c::VARCHAR))), lambda s, i:
           CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(s, ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE s END) % 2 = 1
                THEN xor((CASE WHEN i % 8 = 0 THEN xor(s, ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE s END) // 2, 3988292384::BIGINT)
                ELSE (CASE WHEN i % 8 = 0 THEN xor(s, ascii(substr(c::VARCHAR, (i // 8 + 1)::INT, 1))::BIGINT) ELSE s END) // 2 END),
           4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT k.c, t.at AS ord, t.role, t.text FROM k JOIN t ON t.c = k.base AND t.at <= k.h
  UNION ALL
  SELECT k.c, 1000000 + t.at, t.role, t.text FROM k JOIN t ON t.c = k.c AND t.at > k.h),
s AS (
  SELECT k.c, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.ord) FILTER (r.ord IS NOT NULL), []) AS seq
  FROM k LEFT JOIN r ON r.c = k.c GROUP BY k.c),
p AS (SELECT c, len(seq) AS len, d, seq[1:d] AS path FROM s, unnest(range(0, len(seq) + 1)) AS u(d)),
n AS (
  SELECT path, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '')) AS ends_sha256
  FROM p GROUP BY path, d),
m AS (
  SELECT a.*, CASE WHEN a.depth > 0 THEN (a.n_convs - 1) * length(a.path[a.depth].text) ELSE 0 END AS own,
         (SELECT count(*) FROM n b WHERE b.depth = a.depth + 1 AND b.path[1:a.depth] = a.path) AS n_children
  FROM n a)
SELECT a.conv_id, a.depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children,
       sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(b.own)::BIGINT AS saved_tokens, a.ends_sha256
FROM m a JOIN m b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path
LEFT JOIN m q ON a.depth > 0 AND q.depth = a.depth - 1 AND q.path = a.path[1:a.depth - 1]
GROUP BY a.conv_id, a.depth, q.conv_id, a.n_convs, a.n_children, a.ends_sha256
"""
