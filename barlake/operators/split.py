"""Train/test split (M1): exact stratified shares by order statistics of a hash.

Every row has a 60-bit hash of its key (md5, the same in any engine). The test side is, per
label, the rows with the smallest hashes: exactly ceil(test_size * n) rows in all, dealt to the
labels in proportion (largest remainders first). The cut of a label is found over hash buckets:
counts per (label, bucket), a running sum over that small table, and a sort of the one bucket
that holds the cut. No label is sorted whole and rows aren't shuffled to be marked. The split
ignores time, as the reference does; ``time_split`` cuts by date per ticker instead. Row order
from sorted input files (T4) only mattered for the split; the hash rule needs no order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LABELS = 1000
_BUCKET_BITS = 12
_HEX = 15  # hex digits of md5 used: 60 bits, exact in a BIGINT and a DOUBLE ratio


def hash_unit(seed: int, *cols: str) -> Column:
    return unit_of(*[F.col(c) for c in cols], F.lit(seed))


def unit_of(*parts: Column) -> Column:
    """Uniform value in [0, 1) from the md5 of the parts' texts."""
    key = F.concat_ws("|", *[c.cast("string") for c in parts])
    h = F.conv(F.substring(F.md5(key), 1, _HEX), 16, 10).cast("long")
    return h.cast("double") / float(16 ** _HEX)


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
                 key_cols: tuple[str, ...] = ("ticker", "date"), label: str | None = "target_direction") -> DataFrame:
    """Adds ``split`` = 'test' / 'train', stratified by ``label`` (None: by nothing). Rows with equal keys lie together."""
    label_col = F.col(label) if label is not None else F.lit(0)
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols], F.lit(str(seed)))
    place = F.struct(F.conv(F.substring(F.md5(key), 1, _HEX), 16, 10).cast("long").alias("h"), key.alias("k"))
    rows = df.select(label_col.alias("label"), place.alias("place"))
    bucket = F.shiftright(F.col("place.h"), _HEX * 4 - _BUCKET_BITS)

    counts = rows.groupBy("label", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("end", F.sum("n").over(upto))
    found = counts.groupBy("label").agg(F.sum("n").alias("n")).limit(MAX_LABELS + 1).collect()
    if len(found) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels: not a column of classes")
    spark = df.sparkSession
    kind = rows.schema["label"].dataType.simpleString()
    quotas = spark.createDataFrame(list(shares({r["label"]: r["n"] for r in found}, test_size).items()), f"q_label {kind}, quota long")
    at_cut = (counts.join(F.broadcast(quotas), F.col("label").eqNullSafe(F.col("q_label")))  # at most MAX_LABELS rows
              .where((F.col("end") >= F.col("quota")) & (F.col("end") - F.col("n") < F.col("quota")))
              .select("q_label", F.col("bucket").alias("q_bucket"), (F.col("quota") - F.col("end") + F.col("n")).alias("r")))
    inside = rows.join(F.broadcast(at_cut), F.col("label").eqNullSafe(F.col("q_label")) & (bucket == F.col("q_bucket")))
    order = Window.partitionBy("q_label").orderBy("place")
    cuts = inside.withColumn("i", F.row_number().over(order)).where(F.col("i") == F.col("r")).select("q_label", F.col("place").alias("_cut"))
    marked = df.join(F.broadcast(cuts), label_col.eqNullSafe(F.col("q_label")), "left")
    return marked.withColumn("split", F.when(place <= F.col("_cut"), "test").otherwise("train")).drop("q_label", "_cut")


def shares(counts: dict, test_size: float) -> dict:
    """Test rows per label: ceil(test_size * n) in all, by largest remainder (the smaller label on a tie)."""
    n = sum(counts.values())
    wanted = math.ceil(test_size * n)
    quota = {k: wanted * c // n for k, c in counts.items()}
    by_rest = sorted(counts, key=lambda k: (-(wanted * counts[k] % n), k is not None, k))
    for k in by_rest[:wanted - sum(quota.values())]:
        quota[k] += 1
    return quota


def time_split(df: DataFrame, test_size: float = 0.2, key: str = "ticker", order: str = "date") -> DataFrame:
    """Last ``test_size`` share of each ticker's rows (by date) is the test side."""
    w = Window.partitionBy(key).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    rn = F.row_number().over(w)
    return df.withColumn("split", F.when(rn > F.floor(n * (1.0 - test_size)), "test").otherwise("train"))
