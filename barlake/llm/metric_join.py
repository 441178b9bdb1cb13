"""Near duplicates of vectors by an exact metric range join.

The metric is the angle between vectors; two vectors link when their cosine is at least
``COSINE``, that is when their angle is at most r = arccos(COSINE).

1. *Vectors.* Equal vectors are one class (its id is its smallest vector id, its weight the
   number of its rows), so copies are never compared.
2. *Pivots* come from a sample of at most ``SAMPLE`` classes: centres of dense places (balls of
   radius r / 2) and, for all else, cells around further sampled vectors. Any pivots give the
   same links; good ones save work.
3. *Cells.* A vector within r / 2 of a ball's centre belongs to that ball, others to the nearest
   cell. By the triangle inequality all members of a ball link with each other, so they are
   counted, not compared, however many they are.
4. *Boundary replication.* Cells are ordered; a vector visits a later cell only if the cell may
   hold a partner: its angle to the pivot must be within r of the angles that the cell's
   members have to it and, for nearest-pivot cells, it must be within r of the half space of
   vectors nearer to that pivot. Each unordered pair of cells is looked at from one side only.
5. *Independent joins.* A cell's members are cut into blocks of at most ``BLOCK_BYTES``; a task
   holds one block and streams its visitors past it. A block with many visitors is held by
   several tasks, which share them out. Tasks return counts per vector and links that span
   what they found connected, not pairs. Cosines are single precision products; those within
   ``MARGIN`` of the limit are computed again in double precision.
6. *Components* of the spanning links, in which a ball is one node.

No pair within the angle is lost and nothing is capped. Where vectors have no structure (random
directions in many dimensions) neither inequality excludes much, and the number of
comparisons grows with the square of the vectors that lie in no ball, as for every exact method.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link
with nothing; so do vectors of different lengths with each other. Rows with null id take no part
(null component, not kept). Equal rows (same id and vector) count as one vector and get equal
results; an id that stands over different vectors counts once for each. Other columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.components import components
from barlake.llm.shared import ship, written

COSINE = 0.9
SAMPLE = 4096
BALLS = 256
#: Sampled vectors that make a place dense.
DENSE = 8
CELL_ROWS = 8192
CELLS = 64
BLOCK_BYTES = 1 << 26
#: Visitors that one task streams past a block, about.
VISIT_ROWS = 1 << 20
CHUNK = 512
MARGIN = 1e-4
#: Slack of angles, in radians, far above rounding errors in them.
SLACK = 1e-5


def _stack(vectors: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    top = np.abs(rows).max(1, keepdims=True)  # scaled first, so that squares neither vanish nor overflow
    rows = rows / top
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _angle(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows, classes): vec_id and key of every row; key, cls, w, dim, vec (doubles as bytes) of every class that can link."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for x in batch.column(1):
                v = None if not x.is_valid else x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                good = v is not None and len(v) > 0 and x.values.null_count == 0 and bool(np.isfinite(v).all()) and bool(v.any())
                packed.append((v + 0.0).tobytes() if good else None)  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["id", "vec"])

    plain = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = written(plain.mapInArrow(pack, "id long, vec binary").withColumn("key", F.sha2("vec", 256)), "vectors")
    some = rows.where("vec is not null and id is not null")
    each = some.groupBy("key", "id").agg(F.any_value("vec").alias("vec"))
    found = each.groupBy("key").agg(F.min("id").alias("cls"), F.count("*").alias("w"), F.any_value("vec").alias("vec"))
    return rows.select("id", "key"), written(found.withColumn("dim", (F.length("vec") / 8).cast("int")), "classes")


class Pivots:
    """Centres of one vector length: the balls first, then the cells in their order."""

    def __init__(self, balls: np.ndarray, cells: np.ndarray, first: int):
        self.balls, self.cells, self.first = balls, cells, first

    def homes(self, unit: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """Cell number and angle to its pivot of every row. Balls have numbers above all cells."""
        at = unit @ self.cells.T
        home, angle = at.argmax(1), _angle(at.max(1))
        if len(self.balls):
            near = unit @ self.balls.T
            best, far = near.argmax(1), _angle(near.max(1))
            inside = far <= radius / 2 - SLACK
            home = np.where(inside, len(self.cells) + best, home)
            angle = np.where(inside, far, angle)
        return self.first + home, angle


def pivots(found: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS) -> dict[int, Pivots]:
    """Pivots by vector length, from a bounded sample of the classes."""
    sizes = {r["dim"]: r["n"] for r in found.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    share = min(1.0, 0.8 * SAMPLE / total) if total else 1.0
    drawn = found.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.select("dim", "key", "vec").orderBy("key").limit(SAMPLE).collect()
    out, first = {}, 0
    for dim, n in sorted(sizes.items()):
        sample = [r["vec"] for r in rows if r["dim"] == dim]
        unit = _unit(_stack(sample)) if sample else np.eye(1, dim)
        near = unit @ unit.T >= cosine
        left, balls = np.ones(len(unit), bool), []
        while len(balls) < BALLS:
            degree = (near & left).sum(1) * left
            top = int(degree.argmax())
            if degree[top] < DENSE:
                break
            centre = unit[near[top] & left].mean(0)
            centre /= math.sqrt(float(centre @ centre))
            balls.append(centre)
            inside = _angle(unit @ centre) <= math.acos(cosine) / 2 - SLACK
            inside[top] = True
            left &= ~inside
        rest = unit[left] if left.any() else unit[:1]
        cells = rest[:min(CELLS, max(1, -(-n // cell_rows)))]
        out[dim] = Pivots(np.array(balls).reshape(len(balls), dim), cells, first)
        first += len(balls) + len(cells)
    return out


def _by_dim(batch: pa.RecordBatch, dim_at: int, vec_at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, unit vectors) for every vector length of a batch."""
    dims = batch.column(dim_at).to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _unit(_stack(batch.column(vec_at).take(pa.array(at)).to_pylist()))


def homes(found: DataFrame, at: dict[int, Pivots], radius: float) -> DataFrame:
    """cls, w, dim, vec, home, angle of every class."""
    table = found.sparkSession.sparkContext.broadcast(at)  # at most SAMPLE vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, angle = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for dim, rows, unit in _by_dim(batch, 2, 3):
                home[rows], angle[rows] = table.value[dim].homes(unit, radius)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(angle)], names=["cls", "w", "dim", "vec", "home", "angle"])

    return found.select("cls", "w", "dim", "vec").mapInArrow(run, "cls long, w long, dim int, vec binary, home int, angle double")


def visits(homed: DataFrame, at: dict[int, Pivots], spans: dict[int, tuple[float, float]], radius: float) -> DataFrame:
    """``homed`` with ``seen``: the later cells that may hold a partner of each class."""
    table = homed.sparkSession.sparkContext.broadcast((at, spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots_of, span = table.value
        for batch in batches:
            home = batch.column(4).to_numpy()
            seen: list[np.ndarray] = [np.zeros(0, np.int32)] * batch.num_rows
            for dim, rows, unit in _by_dim(batch, 2, 3):
                p = pivots_of[dim]
                centres, k = np.concatenate([p.cells, p.balls]), len(p.cells)
                own = home[rows] - p.first
                cosines = unit @ centres.T
                angles = _angle(cosines)
                lo, hi = (np.array([span.get(p.first + c, (9.0, -9.0))[e] for c in range(len(centres))]) for e in (0, 1))
                reach = (angles <= hi + radius + SLACK) & (angles >= lo - radius - SLACK) & (np.arange(len(centres)) > own[:, None])
                for c in range(1, k):  # the half space of vectors nearer to pivot c than to any other pivot
                    width = np.sqrt(((p.cells - p.cells[c]) ** 2).sum(1))
                    width[width == 0] = np.inf
                    depth = ((cosines[:, :k] - cosines[:, c:c + 1]) / width).max(1)
                    reach[depth > math.sin(radius) + SLACK, c] = False
                for row, hit in zip(rows, reach):
                    seen[row] = (p.first + np.flatnonzero(hit)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen, pa.list_(pa.int32()))],
                                             names=["cls", "w", "dim", "vec", "home", "angle", "seen"])

    return homed.mapInArrow(run, "cls long, w long, dim int, vec binary, home int, angle double, seen array<int>")


class _Block:
    """Members of one block, and what its visitors link with."""

    def __init__(self, cosine: float):
        self.cosine = cosine
        self.cls: list[int] = []
        self.w: list[int] = []
        self.vec: list[bytes] = []
        self.ready = False

    def close(self) -> None:
        self.unit = _unit(_stack(self.vec))
        self.short = np.ascontiguousarray(self.unit.T.astype(np.float32))
        self.ids, self.weight = np.array(self.cls), np.array(self.w)
        self.count = np.zeros(len(self.ids), np.int64)
        self.label = np.arange(len(self.ids))
        self.vec, self.ready = [], True

    def linked(self, unit: np.ndarray) -> np.ndarray:
        cosines = unit.astype(np.float32) @ self.short
        hit = cosines >= self.cosine
        row, col = np.nonzero(np.abs(cosines - np.float32(self.cosine)) <= MARGIN)
        for i in range(0, len(row), 65_536):
            r, c = row[i:i + 65_536], col[i:i + 65_536]
            hit[r, c] = (unit[r] * self.unit[c]).sum(1) >= self.cosine
        return hit

    def meet(self, ids: np.ndarray, weight: np.ndarray, hit: np.ndarray, out: list[tuple]) -> None:
        """Counts links of ``ids`` with members, and adds links that span what is connected."""
        some = np.flatnonzero(hit.any(1))
        if not len(some):
            return
        hit = hit[some]
        self.count += weight[some] @ hit
        for i, row, n in zip(ids[some].tolist(), hit, (hit @ self.weight).tolist()):
            out.append((i, None, n))
            at = np.flatnonzero(row)
            labels, first = np.unique(self.label[at], return_index=True)
            out.extend((i, int(x), None) for x in self.ids[at[first]])
            if len(labels) > 1:
                self.label[np.isin(self.label, labels[1:])] = labels[0]


def _joined(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, block = None, None

        def flush() -> pa.RecordBatch:
            a, b, n = zip(*out)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

        def finish() -> None:
            if block is not None and block.ready:
                out.extend((int(i), None, int(n)) for i, n in zip(block.ids, block.count) if n)

        for batch in batches:
            spots = np.stack([batch.column(k).to_numpy() for k in (0, 1, 2)], 1)
            roles = batch.column(3).to_numpy()
            edge = np.flatnonzero(np.r_[True, (spots[1:] != spots[:-1]).any(1) | (roles[1:] != roles[:-1])])
            for lo, hi in zip(edge, np.r_[edge[1:], len(roles)]):
                part, spot, role = batch.slice(lo, hi - lo), tuple(spots[lo]), roles[lo]
                if spot != now:
                    finish()
                    now, block = spot, _Block(cosine)
                ids, w, vecs = (part.column(k).to_pylist() for k in (4, 5, 6))
                if role == 0:  # members come first
                    block.cls += ids
                    block.w += w
                    block.vec += vecs
                    continue
                if not block.cls:
                    continue
                if not block.ready:
                    block.close()
                unit, ids, w = _unit(_stack(vecs)), np.array(ids), np.array(w)
                for k in range(0, len(ids), CHUNK):
                    end = min(k + CHUNK, len(ids))
                    hit = block.linked(unit[k:end])
                    if role == 1:  # members among themselves: each pair from its later side
                        hit &= block.ids[None, :] < ids[k:end, None]
                    block.meet(ids[k:end], w[k:end], hit, out)
                    if len(out) >= 65_536:
                        yield flush()
        finish()
        if out:
            yield flush()

    return run


def metric_links(found: DataFrame, cosine: float = COSINE, *, cell_rows: int = CELL_ROWS, block_bytes: int = BLOCK_BYTES,
                 visit_rows: int = VISIT_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(homed, parts, balls): classes with their cell; counts (a, n) and spanning links (a, b) of
    all links but those inside balls; ball, its weight and smallest class."""
    spark = found.sparkSession
    radius = math.acos(cosine)
    at = pivots(found, cosine, cell_rows)
    homed = written(homes(found, at, radius), "homes")
    cells = homed.groupBy("home").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n"), F.max("dim").alias("dim"),
                                      F.sum("w").alias("w"), F.min("cls").alias("first")).collect()  # one row per pivot
    is_ball = {p.first + len(p.cells) + k for p in at.values() for k in range(len(p.balls))}
    seen = written(visits(homed, at, {c["home"]: (c["lo"], c["hi"]) for c in cells}, radius), "visits")
    guests = {r["cell"]: r["n"] for r in seen.select(F.explode("seen").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}

    plan = []  # cell, its blocks, the tasks that hold a copy of each
    for c in cells:
        blocks = max(1, math.ceil(c["n"] * c["dim"] * 8 / block_bytes))
        come = guests.get(c["home"], 0) + (0 if c["home"] in is_ball else c["n"])
        plan.append((c["home"], blocks, max(1, math.ceil(come / visit_rows)), c["home"] in is_ball))
    layout = spark.createDataFrame(plan, "cell int, blocks int, copies int, ball boolean")
    layout = F.broadcast(layout)  # one row per pivot

    def spot(blocks: Column, copy: Column, role: Column) -> list[Column]:
        return [F.col("cell"), blocks.cast("int").alias("block"), copy.cast("int").alias("copy"), role.cast("int").alias("role"), F.col("cls"), "w", "vec"]

    block_of = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    copy_of = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("copies"))
    own = seen.withColumnRenamed("home", "cell").join(layout, "cell")
    asked = spark.createDataFrame([(k,) for k in guests] or [(-1,)], "asked int")
    members = (own.join(F.broadcast(asked), F.col("cell") == F.col("asked"), "left").where("not ball or asked is not null")
               .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))))
    members = members.select(*spot(block_of, F.col("copy"), F.lit(0)))
    among = (own.where("not ball").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(*spot(F.col("block"), copy_of, F.lit(1))))
    come = (seen.withColumn("cell", F.explode("seen")).join(layout, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select(*spot(F.col("block"), copy_of, F.lit(2))))
    met = members.union(among).union(come).repartition("cell", "block", "copy").sortWithinPartitions("cell", "block", "copy", "role")
    parts = written(met.mapInArrow(_joined(cosine), "a long, b long, n long"), "parts")
    balls = spark.createDataFrame([(c["home"], c["w"], c["first"]) for c in cells if c["home"] in is_ball], "ball int, ball_w long, ball_cls long")
    return homed, parts, balls


def near_vectors(vectors: DataFrame, cosine: float = COSINE, *, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    rows, found = classes(vectors, id_col, vector_col)
    homed, parts, balls = metric_links(found, cosine, **options)
    nodes = homed.select("cls", "home").join(F.broadcast(balls), F.col("home") == F.col("ball"), "left")  # at most BALLS a length
    nodes = written(nodes.select("cls", F.coalesce("ball_cls", "cls").alias("node"), F.coalesce("ball_w", F.lit(0)).alias("ball_w")), "nodes")
    ends = (parts.where("b is not null").join(nodes.select(F.col("cls").alias("a"), F.col("node").alias("u")), "a")
            .join(nodes.select(F.col("cls").alias("b"), F.col("node").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b")))
    joined = components(ends)
    counts = parts.where("n is not null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    figures = (found.select("key", "cls", "w").join(nodes, "cls").join(counts, "cls", "left")
               .join(joined.select(F.col("id").alias("node"), "component"), "node", "left")
               .select("key", (F.coalesce("n", F.lit(0)) + F.when(F.col("ball_w") > 0, F.col("ball_w")).otherwise(F.col("w")) - 1).alias("links"),
                       F.coalesce("component", "node").alias("component")))
    out = rows.join(figures, "key", "left")
    known = F.col("id").isNotNull()
    component = F.when(known, F.coalesce("component", "id"))
    return out.select(F.col("id").alias("vec_id"), F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
                      component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


ORACLE = """
WITH RECURSIVE g AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
d AS (SELECT a, count(DISTINCT b) AS n FROM l GROUP BY a),
c AS (SELECT a, min(b) AS lo FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, least(e.vec_id, coalesce(c.lo, e.vec_id)) AS component_id,
       least(e.vec_id, coalesce(c.lo, e.vec_id)) = e.vec_id AS kept
FROM embeddings e LEFT JOIN d ON d.a = e.vec_id LEFT JOIN c ON c.a = e.vec_id
"""
