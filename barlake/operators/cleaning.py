"""Cleaning (J1, W14, F11, G2-G4, X4) and preprocessing.

Plan shape: every step is a window over ``partitionBy(ticker)``, so after the
single ``Exchange hashpartitioning(ticker)`` the calendar densify, forward
fill, sparse-ticker filter, volume cap and the preprocess windows all run in
the same partitions. The calendar densify is join-free: each bar explodes into
the weekdays up to (not including) its successor, so there is no calendar
table and no re-shuffle on ``(ticker, date)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlake.config import DataConfig
from barlake.functions.calendar import weekday_sequence
from barlake.functions.numeric import fdiv, flog
from barlake.functions.windows import RollingSet, series, whole
from barlake.schemas import VALUE_COLS


def _c(name: str):
    return F.col(f"`{name}`")


def densify(bars: DataFrame, value_cols: list[str] | None = None) -> DataFrame:
    """Reindex onto the business-day calendar between each ticker's first and
    last bar (J1): adds missing weekdays as empty rows and drops weekend bars."""
    value_cols = value_cols or [c for c in VALUE_COLS if c in bars.columns]
    spans = bars.withColumn("_next", F.lead("date").over(series())).withColumn(
        "_days", weekday_sequence(F.col("date"), F.coalesce(F.date_sub(F.col("_next"), 1), F.col("date")))
    )
    exploded = spans.select("*", F.explode("_days").alias("_d"))
    own = F.col("_d") == F.col("date")
    return exploded.select(
        "ticker", F.col("_d").alias("date"),
        *[F.when(own, _c(c)).alias(c) for c in value_cols],
    )


def forward_fill(df: DataFrame, limit: int, cols: list[str], key="ticker", order: str = "date") -> DataFrame:
    """``ffill(limit=N)`` per column: last non-null among this and the N previous rows."""
    w = series(key, order).rowsBetween(-limit, 0)
    return df.select(
        *[c for c in df.columns if c not in cols],
        *[F.last(_c(c), ignorenulls=True).over(w).alias(c) for c in cols],
    ).select(*df.columns)


def clean_with_report(bars: DataFrame, cfg: DataConfig = DataConfig()) -> tuple[DataFrame, DataFrame]:
    """Clean all tickers at once. Returns ``(cleaned, report)``.

    report: ticker, missing_pct (after fill, over all value cells), kept flag,
    volume cap and number of capped rows. Tickers above the missing threshold
    are dropped whole (F11); remaining rows with any gap are dropped (F5); the
    volume is clipped at the exact linear-interpolated percentile (G3, X4).
    """
    value_cols = [c for c in VALUE_COLS if c in bars.columns]
    dense = forward_fill(densify(bars, value_cols), cfg.max_consecutive_fill, value_cols)
    n_null = sum(F.when(_c(c).isNull(), 1).otherwise(0) for c in value_cols)
    scored = dense.withColumn(
        "_missing_pct", F.avg(n_null / F.lit(float(len(value_cols)))).over(whole())
    )
    # a row survives when its ticker is kept and every value is present; the cap is the
    # percentile over surviving rows only (percentile skips the NULLs of the mask)
    survives = (F.col("_missing_pct") <= F.lit(cfg.max_missing_pct)) & F.coalesce(
        sum_bool([_c(c).isNotNull() for c in value_cols]), F.lit(False))
    p = cfg.volume_outlier_cap_percentile / 100.0
    capped = scored.withColumn("_keep", survives).withColumn(
        "_cap", F.percentile(F.when(F.col("_keep"), _c("Volume")), F.lit(p)).over(whole()))
    cleaned = capped.where(F.col("_keep")).select(
        "ticker", "date",
        *[(F.least(_c(c), F.col("_cap")) if c == "Volume" else _c(c)).alias(c) for c in value_cols],
    )
    # the report is one aggregate over the same windowed rows (no second pass)
    report = capped.groupBy("ticker").agg(
        F.first("_missing_pct").alias("missing_pct"),
        F.first("_cap").alias("_cap"),
        F.count_if(F.col("_keep") & (_c("Volume") > F.col("_cap"))).alias("n_capped"),
        F.count_if(F.col("_keep")).alias("cleaned_rows"),
    ).select(
        "ticker", "missing_pct",
        (F.col("missing_pct") <= F.lit(cfg.max_missing_pct)).alias("kept"),
        F.when(F.col("missing_pct") <= F.lit(cfg.max_missing_pct), F.col("_cap")).alias("volume_cap"),
        F.col("n_capped").cast("long").alias("n_capped"),
        F.col("cleaned_rows").cast("long").alias("cleaned_rows"),
    )
    return cleaned, report


def sum_bool(conds):
    """AND of a list of boolean Columns."""
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def clean(bars: DataFrame, cfg: DataConfig = DataConfig()) -> DataFrame:
    return clean_with_report(bars, cfg)[0]


def preprocess(cleaned: DataFrame, cfg: DataConfig = DataConfig(), key="ticker", order: str = "date",
               drop: bool = True) -> DataFrame:
    """Log return (W1) and 20-row normalised volume (W2), then drop warm-up rows."""
    # window values once as columns, then plain arithmetic on them
    rs = RollingSet(key, order)
    vol_mean = rs.get("vol", "avg", _c("Volume"), cfg.volume_norm_window)
    staged = cleaned.withColumns({"_prev_close": F.lag(_c("Close"), 1).over(series(key, order)), **rs.columns()})
    out = staged.withColumns({
        "log_return": flog(fdiv(_c("Close"), F.col("_prev_close"))),
        "volume_normalised": fdiv(_c("Volume"), vol_mean),
    }).drop("_prev_close", *rs.names())
    return out.na.drop(how="any", subset=[c for c in out.columns if not c.startswith("_")]) if drop else out


def sparse_summary(report: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Job summary per ticker (G23): OK / DROPPED, FAILED when never fetched."""
    base = report.select("ticker", F.when(F.col("kept"), "OK").otherwise("DROPPED").alias("status"),
                         "cleaned_rows")
    if requested is None:
        return base
    req = requested.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return req.join(base, "ticker", "left").select(
        "ticker", F.coalesce("status", F.lit("FAILED")).alias("status"),
        F.coalesce("cleaned_rows", F.lit(0)).cast("long").alias("cleaned_rows"))


def latest_rows(df: DataFrame, n: int = 1, key: str = "ticker", order: str = "date") -> DataFrame:
    """Last n rows per ticker (W16), newest first by ``rn``."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
