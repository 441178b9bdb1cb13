"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every document of a source, in shuffled order, gets a virtual finish time: the source's words
up to and including it, divided by the source's target. Repeats of a source follow its first
pass, so a document's copy ``e`` finishes at ``(e * source_size + cumulated) / target``. All
copies are ranged globally by (finish time, source, shuffle key, id, size, copy) and cut where
their running word count would pass the budget (all words of all documents).

Nothing needs one task per source: cumulated words are sums per (source, hash bucket), a
prefix sum over at most ``BUCKETS`` rows per source, and a running sum inside each bucket. The
global cut is found the same way, from a histogram over slices of the finish time; only the
slice with the cut is sorted. What is sorted whole is the table of sources, one row each.

Null texts have size 0; null sources are one source, last in order; null ids are allowed.
Rows that agree in id and size are interchangeable. No documents or no words: nothing taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from barlake.llm.shared import words, written

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BUCKETS = 4096
SLICES = 1 << 16
#: Finish times from here on share the last slice; the cut lies near 1.
LATEST = 4


def sources(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: rank by code point (null last), size, target.

    Targets share all words by weight; none exceeds ``max_repeats`` times its size, and the
    excess is shared by weight among the rest. In ascending order of limit / weight the
    limited sources are a prefix, so two running sums give the level of the others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    per = (sized.groupBy("source").agg(F.sum("size").alias("source_size"))
           .withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", weight)
           .withColumn("most", F.col("source_size") * max_repeats))
    rising = Window.orderBy((F.col("most").cast("double") / F.col("weight")), "rank")
    all_rows = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows) - F.coalesce(F.sum("most").over(before), F.lit(0))
    open_weight = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    limited = F.col("most").cast("double") * open_weight <= left.cast("double") * F.col("weight")
    per = per.withColumn("limited", limited)
    budget = F.sum("source_size").over(all_rows)
    taken = F.sum(F.when(F.col("limited"), F.col("most")).otherwise(0)).over(all_rows)
    open_sum = F.sum(F.when(F.col("limited"), 0).otherwise(F.col("weight"))).over(all_rows)
    level = (budget - taken).cast("double") / F.when(open_sum > 0, open_sum)
    return per.select(
        "source", "rank", "source_size", budget.alias("budget"),
        F.when(F.col("limited"), F.col("most").cast("double")).otherwise(level * F.col("weight")).alias("target"))


def _sized(docs: DataFrame, carry: bool, id_col: str, text_col: str, source_col: str) -> DataFrame:
    key = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    cols = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"),
            key.alias("key"), F.substring(key, 1, 3).alias("bucket")]
    return docs.select(*cols, *([F.struct("*").alias("row")] if carry else []))


def _bases(sized: DataFrame) -> DataFrame:
    """Per (source, bucket): words in the source's buckets before, and the source's figures."""
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    named = sources(sums.select("source", F.col("in_bucket").alias("size"))).withColumnRenamed("source", "of")
    sums = sums.withColumn("base", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
    return (sums.join(named, F.col("source").eqNullSafe(F.col("of")))
            .select(F.col("source").alias("of"), F.col("bucket").alias("of_bucket"), "base", "rank", "source_size", "budget", "target"))


def _placed(sized: DataFrame, bases: DataFrame) -> DataFrame:
    """Rows with the words of their source up to and including them."""
    inside = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("of_bucket"))
    return (sized.join(bases, on).withColumn("upto", F.col("base") + F.sum("size").over(inside)).drop("of", "of_bucket", "base"))


def _finish(copy: int) -> Column:
    done = (F.col("source_size") * copy + F.col("upto")).cast("double")
    return done / F.when(F.col("target") > 0, F.col("target"))


def _slice(finish: Column) -> Column:
    return F.least(F.floor(finish * SLICES), F.lit(LATEST * SLICES))


def _place(copy: int) -> Column:
    """A copy's place in the global order."""
    return F.struct(_finish(copy).alias("finish"), F.col("rank"), F.col("key"), F.col("id"), F.col("size"), F.lit(copy).alias("copy"))


def _cut(placed: DataFrame, max_repeats: int) -> Row | None:
    """The slice of the cut and the last place in it that is taken; one row on the driver.

    None where no slice passes the budget, so that every copy is taken.
    """
    copies = (placed.where("size > 0").select("size", "budget", F.explode(F.array(*[_place(e) for e in range(max_repeats)])).alias("place"))
              .withColumn("slice", _slice(F.col("place.finish"))))
    sums = copies.groupBy("slice").agg(F.sum("size").alias("words"), F.max("budget").alias("budget"))
    upto = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # at most LATEST * SLICES + 1 rows
    crossed = (sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
               .where(F.col("before") + F.col("words") > F.col("budget")).orderBy("slice").limit(1).collect())
    if not crossed:
        return None
    at, before, budget = crossed[0]["slice"], crossed[0]["before"], crossed[0]["budget"]
    running = F.sum("size").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = (copies.where(F.col("slice") == at).withColumn("running", running + before).where(F.col("running") <= budget)
            .agg(F.max("place").alias("place")).collect()[0]["place"])
    return Row(slice=at, place=last)


def _copies(cut: Row | None, max_repeats: int) -> Column:
    """How many copies of a row the mix takes."""
    if cut is None:
        return F.lit(max_repeats)
    def taken(e: int) -> Column:
        early = _slice(_finish(e)) < cut.slice
        if cut.place is not None:
            p = cut.place
            last = F.struct(F.lit(p["finish"]).alias("finish"), F.lit(p["rank"]).cast("int").alias("rank"), F.lit(p["key"]).alias("key"),
                            F.lit(p["id"]).alias("id"), F.lit(p["size"]).cast("long").alias("size"), F.lit(p["copy"]).cast("int").alias("copy"))
            early = early | ((_slice(_finish(e)) == cut.slice) & (_place(e) <= last))
        return F.when(early, 1).otherwise(0)
    return sum((taken(e) for e in range(1, max_repeats)), taken(0))


def _columns(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame]:
    slim = _sized(docs, False, id_col, text_col, source_col)
    bases = written(_bases(slim), "mix-bases")
    return bases, written(_placed(slim, bases), "mix-places")


def mix(docs: DataFrame, *, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words, repeats counted)."""
    _, placed = _columns(docs, id_col, text_col, source_col)
    copies = F.when(F.col("size") > 0, _copies(_cut(placed, max_repeats), max_repeats)).otherwise(0)
    return placed.select(F.col("id").alias("doc_id"), "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"),
                         (F.col("size") * copies).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, *, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with their own columns."""
    bases, placed = _columns(docs, id_col, text_col, source_col)
    copies = F.when(F.col("size") > 0, _copies(_cut(placed, max_repeats), max_repeats)).otherwise(0)
    rows = _placed(_sized(docs, True, id_col, text_col, source_col), bases)
    return rows.select(F.explode(F.array_repeat("row", copies.cast("int"))).alias("row")).select("row.*")


ORACLE = """
WITH sized AS (
  SELECT doc_id AS id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, source_size * 3 AS most FROM per),
weighted AS (SELECT *, CAST(rank % 3 + 1 AS BIGINT) AS weight FROM ranked),
levels AS (
  SELECT *, sum(source_size) OVER () AS budget,
    CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY CAST(most AS DOUBLE) / weight, rank
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS remaining,
    CAST(sum(weight) OVER (ORDER BY CAST(most AS DOUBLE) / weight, rank
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_weight FROM weighted),
limits AS (SELECT *, CAST(most AS DOUBLE) * open_weight <= remaining * weight AS limited FROM levels),
targets AS (
  SELECT source, rank, source_size, CAST(budget AS BIGINT) AS budget, CASE WHEN limited THEN CAST(most AS DOUBLE) ELSE
    CAST(budget - sum(CASE WHEN limited THEN most ELSE 0 END) OVER () AS DOUBLE)
    / nullif(CAST(sum(CASE WHEN limited THEN 0 ELSE weight END) OVER () AS DOUBLE), 0) * weight END AS target FROM limits),
placed AS (
  SELECT s.*, t.rank, t.source_size, t.budget, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY key, id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (
  SELECT p.*, e.e, CAST(p.source_size * e.e + p.upto AS DOUBLE) / nullif(p.target, 0) AS finish
  FROM placed p CROSS JOIN (SELECT unnest([0, 1, 2]) AS e) e WHERE p.size > 0),
running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, key, id, size, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM copies),
took AS (SELECT id, size, count(*) AS n FROM running WHERE total <= budget GROUP BY id, size)
SELECT p.id AS doc_id, p.size, p.source_size, coalesce(p.target, 0.0) AS target, CAST(p.size * coalesce(t.n, 0) AS BIGINT) AS taken
FROM placed p LEFT JOIN took t ON t.id = p.id AND t.size = p.size
"""
