"""Running counts over sorted values, split so no group runs in one task.

Used by the KS drift test (cumulative counts up to each distinct value) and
by ROC-AUC (negatives below each score). Rows are collapsed to distinct
``(group, bucket, value)`` counts, so a hot value is one row. The bucket is an
order-preserving function of the value alone (sign, binary exponent and a
slice of the mantissa), so no statistics pass is needed. The collapsed table
is hash-partitioned once on ``(group, bucket)``; both consumers read that one
exchange (reused), so the upstream runs once. Cumulative counts are the
totals of lower buckets (a running sum over the small per-bucket table) plus
a running sum inside ``partitionBy(group, bucket)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SUB_BUCKETS = 64
_EXP_OFFSET = 1100  # covers the double exponent range


def order_bucket(v: Column, sub: int = SUB_BUCKETS) -> Column:
    """Monotone non-decreasing integer bucket of a double (NULL stays NULL)."""
    a = F.abs(v)
    e = F.greatest(F.least(F.floor(F.log2(a)), F.lit(_EXP_OFFSET - 1)), F.lit(-_EXP_OFFSET))
    m = a / F.pow(F.lit(2.0), e)
    s = F.greatest(F.least(F.floor((m - 1.0) * sub), F.lit(sub - 1)), F.lit(0))
    mag = (e + _EXP_OFFSET) * sub + s + 1
    top = F.lit(2 * _EXP_OFFSET * sub + 2)
    return (F.when(v.isNull(), F.lit(None))
            .when(v == float("inf"), top).when(v == float("-inf"), -top)
            .when(v > 0, mag).when(v < 0, -mag).otherwise(F.lit(0))).cast("long")


def cumulative_counts(df: DataFrame, group_cols: list[str], value_col: str,
                      flag_cols: list[str]) -> DataFrame:
    """One row per (group, distinct value): for each flag f, ``n_f`` rows at this
    value, ``cum_f`` rows at or below it, and ``tot_f`` rows in the group."""
    v = F.col(value_col)
    keys = [*group_cols, "_b"]
    raw = (df.select(*group_cols, v.alias(value_col), order_bucket(v).alias("_b"),
                     *[F.col(f) for f in flag_cols])
           .groupBy(*keys, value_col)
           .agg(*[F.count_if(F.col(f)).alias(f"n_{f}") for f in flag_cols])
           .repartition(*[F.col(k) for k in keys]))
    # reads the same columns as the join below (max(value) keeps `value` unpruned), so
    # both branches share one exchange subtree and the upstream runs once
    per_bucket = raw.groupBy(*keys).agg(F.max(value_col).alias("_vmax"),
                                        *[F.sum(f"n_{f}").alias(f"_bn_{f}") for f in flag_cols])
    lower = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    per_bucket = per_bucket.select(
        *keys,
        *[F.coalesce(F.sum(f"_bn_{f}").over(lower), F.lit(0)).alias(f"_below_{f}") for f in flag_cols],
        *[F.sum(f"_bn_{f}").over(whole).alias(f"tot_{f}") for f in flag_cols],
    )
    inner = Window.partitionBy(*keys).orderBy(value_col).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = raw.join(per_bucket, keys)
    return out.select(
        *group_cols, value_col,
        *[F.col(f"n_{f}") for f in flag_cols],
        *[(F.col(f"_below_{f}") + F.sum(f"n_{f}").over(inner)).alias(f"cum_{f}") for f in flag_cols],
        *[F.col(f"tot_{f}") for f in flag_cols],
    )


QUANTILE_SUB_BUCKETS = 1024


def exact_quantile(df: DataFrame, group_cols: list[str], value_col: str, p: float,
                   out: str = "quantile") -> DataFrame:
    """Exact linear-interpolated quantile per group (``percentile`` semantics) without
    merging a group's values in one task.

    Target ranks lo = floor(p * (n - 1)) and lo + 1 (0-based). Distinct values are
    counted per (group, order bucket); the rank range of each bucket comes from a
    running sum over the small bucket table; only the buckets holding the two
    target ranks are opened, and inside them a running count finds the values.
    """
    v = F.col(value_col)
    keys = [*group_cols, "_b"]
    counts = (df.where(v.isNotNull())
              .select(*group_cols, v.alias("_v"), order_bucket(v, QUANTILE_SUB_BUCKETS).alias("_b"))
              .groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")))
    per_bucket = counts.groupBy(*keys).agg(F.sum("_c").alias("_bc"))
    below = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = per_bucket.select(
        *keys, F.coalesce(F.sum("_bc").over(below), F.lit(0)).alias("_start"), "_bc",
        F.sum("_bc").over(Window.partitionBy(*group_cols)).alias("_n"))
    pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
    ranges = ranges.withColumns({"_lo": F.floor(pos), "_frac": pos - F.floor(pos)})
    ranges = ranges.withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1))
    hit = (((F.col("_lo") >= F.col("_start")) & (F.col("_lo") < F.col("_start") + F.col("_bc")))
           | ((F.col("_hi") >= F.col("_start")) & (F.col("_hi") < F.col("_start") + F.col("_bc"))))
    wanted = ranges.where(hit)
    inner = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = (counts.join(wanted, keys)
               .withColumn("_end", F.col("_start") + F.sum("_c").over(inner))      # exclusive rank end
               .withColumn("_first", F.col("_end") - F.col("_c")))
    at = lambda r: (F.col(r) >= F.col("_first")) & (F.col(r) < F.col("_end"))
    picked = located.groupBy(*group_cols).agg(
        F.max(F.when(at("_lo"), F.col("_v"))).alias("_vlo"),
        F.max(F.when(at("_hi"), F.col("_v"))).alias("_vhi"),
        F.first("_frac").alias("_frac"))
    return picked.select(*group_cols, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias(out))
