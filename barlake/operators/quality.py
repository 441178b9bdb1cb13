"""Data-quality report per ticker (G1, J2, F6-F10) and table profile.

Two aggregates over the raw bars, per (ticker, date) and then per ticker: a date
that occurs twice counts once as a trading day. Partial aggregation runs map-side, so a
hot ticker is spread over its dates first. Missing trading days come from a
closed-form weekday count instead of a calendar table: no join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.functions.calendar import weekdays_between
from barlake.functions.numeric import fdiv
from barlake.schemas import PRICE_COLS

# fixed values: issue texts of the quality report (X17; built with format_string into an
# array_compact list, X21)
MSG_MISSING = "%d missing trading day(s) found"
MSG_NULLS = "%s has %d null(s)"
MSG_NEGATIVE = "%s has %d negative value(s)"
MSG_ZERO_VOLUME = "Volume is zero on %d trading day(s)"
MSG_BAD_SPLIT = "Adj Close / Close ratio is extreme on %d day(s) — possible bad split adjustment"


def _c(name: str):
    return F.col(f"`{name}`")


def quality_counts(bars: DataFrame) -> DataFrame:
    """Per ticker: rows, missing weekdays and every issue count (one aggregate)."""
    cols = set(bars.columns)
    price_cols = [c for c in PRICE_COLS if c in cols]
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.min("date").alias("_dmin"),
        F.max("date").alias("_dmax"),
        F.count_if(F.weekday("date") < 5).alias("_weekday_rows"),
    ]
    for c in price_cols:
        aggs.append(F.count_if(_c(c).isNull()).alias(f"nulls_{c}"))
        aggs.append(F.count_if(_c(c) < 0).alias(f"negatives_{c}"))
    if "Volume" in cols:
        aggs.append(F.count_if(_c("Volume") == 0).alias("zero_volume"))
    if "Adj Close" in cols and "Close" in cols:
        ratio = fdiv(_c("Adj Close"), _c("Close"))
        aggs.append(F.count_if((ratio < 0.5) | (ratio > 1.5)).alias("bad_split"))
    per_day = bars.groupBy("ticker", "date").agg(*[a for a in aggs[:1] + aggs[4:]])
    sums = [F.sum(c).alias(c) for c in per_day.columns if c not in ("ticker", "date")]
    out = per_day.groupBy("ticker").agg(*sums, *aggs[1:4])
    out = out.withColumn(
        "missing_days", weekdays_between(F.col("_dmin"), F.col("_dmax")) - F.col("_weekday_rows")
    )
    return out.drop("_weekday_rows")


def validate(bars: DataFrame) -> DataFrame:
    """Validation report ``(ticker, rows, issues)``; issue order: gaps, per-column
    nulls then negatives, zero volume, bad split."""
    counts = quality_counts(bars)
    cols = set(counts.columns)
    parts = [F.when(F.col("missing_days") > 0, F.format_string(MSG_MISSING, F.col("missing_days")))]
    for c in PRICE_COLS:
        if f"nulls_{c}" in cols:
            n, g = F.col(f"`nulls_{c}`"), F.col(f"`negatives_{c}`")
            parts.append(F.when(n > 0, F.format_string(MSG_NULLS, F.lit(c), n)))
            parts.append(F.when(g > 0, F.format_string(MSG_NEGATIVE, F.lit(c), g)))
    if "zero_volume" in cols:
        parts.append(F.when(F.col("zero_volume") > 0, F.format_string(MSG_ZERO_VOLUME, F.col("zero_volume"))))
    if "bad_split" in cols:
        parts.append(F.when(F.col("bad_split") > 0, F.format_string(MSG_BAD_SPLIT, F.col("bad_split"))))
    return counts.select(
        "ticker", F.col("rows").cast("long").alias("rows"),
        F.col("missing_days").cast("long").alias("missing_days"),
        F.array_compact(F.array(*parts)).alias("issues"),
    )


def missing_days(bars: DataFrame, calendar: DataFrame | None = None) -> DataFrame:
    """Missing trading days as rows (J2 / U2): calendar minus bars, ``left_anti``.

    The calendar is built per ticker from its own date span unless given.
    """
    if calendar is None:
        from barlake.functions.calendar import weekday_sequence

        span = bars.groupBy("ticker").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
        calendar = span.select("ticker", F.explode(weekday_sequence(F.col("_a"), F.col("_b"))).alias("date"))
    return calendar.join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


_PANDAS_DTYPE = {
    "double": "float64", "float": "float32", "bigint": "int64", "int": "int32",
    "smallint": "int16", "tinyint": "int8", "boolean": "bool", "string": "object",
    "date": "datetime64[ns]", "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]",
}


def profile(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Table profile per key (G6): row count, column list, null counts map, dtypes map."""
    cols = [c for c in df.columns if c not in (key, "date")]
    null_aggs = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(cols)]
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias("row_count"), *null_aggs)
    dtypes = dict(df.dtypes)
    return agg.select(
        key,
        F.col("row_count").cast("long").alias("row_count"),
        F.array(*[F.lit(c) for c in cols]).alias("columns"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                          F.array(*[F.col(f"_n{i}").cast("long") for i in range(len(cols))])).alias("null_counts"),
        F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(_PANDAS_DTYPE.get(dtypes[c], dtypes[c])))]).alias("dtypes"),
    )


def run_metadata(df: DataFrame, report: DataFrame, start: str, end: str) -> DataFrame:
    """Run metadata record per ticker."""
    return (
        profile(df)
        .join(report.select("ticker", F.col("issues").alias("validation_issues")), "ticker", "left")
        .select(
            "ticker",
            F.struct(F.lit(start).alias("start"), F.lit(end).alias("end")).alias("date_range"),
            "row_count", "columns", "null_counts", "dtypes",
            F.coalesce("validation_issues", F.array().cast("array<string>")).alias("validation_issues"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("run_timestamp"),
        )
    )
