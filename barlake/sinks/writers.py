"""Sinks (K1-K4, K6, K7). Writes are partitioned by ticker (and run date) with
dynamic partition overwrite, so a same-day rerun replaces only its own folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _save(df: DataFrame, keys: list[str], mode: str):
    """Writer with one folder per key. Rows are dealt by ticker and month, so a ticker with a
    large share of all rows is written by many tasks."""
    deal = ["ticker"] + ([F.date_trunc("month", F.col("date"))] if "date" in df.columns else [])
    return (df.repartition(*deal).write.partitionBy(*keys).mode(mode)
            .option("partitionOverwriteMode", "dynamic"))


def _run_date(run_date: str | None):
    return F.lit(run_date) if run_date else F.date_format(F.current_date(), "yyyy-MM-dd")


def write_raw(df: DataFrame, raw_dir: str, run_date: str | None = None) -> None:
    """Versioned raw table ``ticker=/run_date=``; rerunning a day overwrites it (K1)."""
    _save(df.withColumn("run_date", _run_date(run_date)), ["ticker", "run_date"], "overwrite").parquet(raw_dir)


def save_features(df: DataFrame, features_dir: str, mode: str = "overwrite") -> None:
    """Feature store, one folder per ticker (K2)."""
    _save(df, ["ticker"], mode).parquet(features_dir)


def write_metadata(meta: DataFrame, metadata_dir: str, run_date: str | None = None) -> None:
    """Run metadata records as JSON, one folder per ticker and day (K3)."""
    _save(meta.withColumn("run_date", _run_date(run_date)), ["ticker", "run_date"], "overwrite").json(metadata_dir)


def prediction_records(scored: DataFrame, feature_cols: list[str], latency_ms) -> DataFrame:
    """Log records: timestamp, ticker, the first five feature columns as a map,
    prediction, confidence, latency rounded to 2 places (K4, T6)."""
    first5 = feature_cols[:5]
    return scored.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "ticker",
        F.create_map(*[x for c in first5 for x in (F.lit(c), F.col(c).cast("double"))]).alias("features"),
        F.col("prediction").cast("int").alias("prediction"),
        F.col("confidence").cast("double").alias("confidence"),
        F.round(F.lit(float(latency_ms)), 2).alias("latency_ms"),
    )


def append_prediction_log(records: DataFrame, log_dir: str) -> None:
    """Append one JSON line per record (K4)."""
    records.write.mode("append").json(log_dir)


def append_training_runs(runs: DataFrame, runs_dir: str) -> None:
    """Training-run records: params, metrics, confusion counts, importances (K6)."""
    runs.withColumn("run_timestamp", F.current_timestamp()).write.mode("append").parquet(runs_dir)
