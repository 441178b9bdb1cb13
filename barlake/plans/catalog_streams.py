"""Registered queries of the streams with state. Files are delivered in three parts and drained after each,
so that state passes from run to run; part of the rows arrives late."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.config import DEFAULT
from barlake.operators import drift as D
from barlake.plans import sql_twins as sq
from barlake.plans.catalog import _KS_SQL, FEATURE_COLS, KPI_SPEC, PD_SPEC, RA_SPEC, RETRAIN_SPEC, register
from barlake.plans.pipeline import feature_table
from barlake.plans.projection import spark_project, sql_project
from barlake.session import checkpoint_dir, staged
from barlake.sources.bars import bars_from_lineitem
from barlake.sources.fixtures import prediction_log, scored_table
from barlake.streaming import prediction_stream as PS

_MON = DEFAULT.monitoring
PARTS = 3
LATE_DAYS = 30


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _drain_log(spark: SparkSession, sf_dir: str, base: str, **options) -> DataFrame:
    """The events' log delivered by event id (so times arrive mixed), monitored part by part: the last monitor row."""
    log = staged(prediction_log(spark, sf_dir), "log")
    for part in range(PARTS):
        log.where(F.col("event_id") % PARTS == part).drop("event_id").write.mode("append").json(f"{base}/log")
        PS.monitor(spark, f"{base}/log", f"{base}/table", f"{base}/monitor", f"{base}/log-checkpoint", _MON, **options).awaitTermination()
    rows = spark.read.parquet(f"{base}/monitor")
    return rows.where(F.col("epoch_id") == rows.select(F.max("epoch_id")).scalar())


def _drain_outcomes(spark: SparkSession, scored: DataFrame, base: str) -> DataFrame:
    """Rows (ticker, date, prediction, label) delivered as two streams by thirds of the dates; of the
    last ``LATE_DAYS`` days of a third, some rows come with the next: the joined rows."""
    scored = staged(scored, "scored")
    span = scored.agg(F.min("date").alias("a"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("days"))
    first, days = span.select("a").scalar(), span.select("days").scalar()

    def third(date):
        return F.floor(PARTS * F.datediff(date, first) / days)

    for part in range(PARTS):
        for value, share in (("prediction", 3), ("label", 5)):
            late = F.day("date") % share == 0
            arrives = F.when(late, F.least(third(F.date_add("date", LATE_DAYS)), F.lit(PARTS - 1))).otherwise(third(F.col("date")))
            mine = scored.where(arrives == part).select("ticker", "date", value)
            mine.write.mode("append").parquet(f"{base}/{value}")
        PS.outcomes(spark, f"{base}/prediction", f"{base}/label", f"{base}/outcomes", f"{base}/accuracy",
                    f"{base}/outcome-checkpoint", f"{LATE_DAYS + 15} days", _MON).awaitTermination()
    return spark.read.parquet(f"{base}/outcomes").drop("epoch_id")


MONITOR_SPEC = KPI_SPEC + [c for c in PD_SPEC if c[0] not in ("n_records", "threshold")]


@register("stream_monitor", sql_project(
    f"SELECT * FROM ({sq.log_kpis_sql()}) k, ({sq.prediction_drift_sql(_MON.drift_lookback_days, _MON.prediction_drift_threshold, _MON.min_log_rows)}) d",
    MONITOR_SPEC))
def q_stream_monitor(spark, sf_dir):
    """The monitor row after the last of three drained runs; state is one row of totals and newest records."""
    return spark_project(_drain_log(spark, sf_dir, _folder(spark, "stream-monitor")), MONITOR_SPEC)


@register("stream_rolling_accuracy", sql_project(sq.rolling_accuracy_sql(
    _MON.rolling_accuracy_window, _MON.rolling_accuracy_min_periods), RA_SPEC))
def q_stream_rolling_accuracy(spark, sf_dir):
    """J4/W15 on streams: predictions and actuals joined with watermarks, late rows on both sides."""
    joined = _drain_outcomes(spark, scored_table(spark, sf_dir), _folder(spark, "stream-outcomes"))
    return spark_project(D.rolling_share(joined, _MON), RA_SPEC)


@register("stream_retrain", sql_project(sq.retrain_sql(sq.features_sql("l_returnflag"), _KS_SQL, _MON).format(total=len(FEATURE_COLS)), RETRAIN_SPEC))
def q_stream_retrain(spark, sf_dir):
    """Retrain decisions of the log's last batch, from the stored drift roll-up, the accuracies
    that the outcome stream keeps and the prediction shift of the log's state."""
    base = _folder(spark, "stream-retrain")
    ft = staged(feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag")), "features")
    rollup = staged(D.drift_rollup(D.feature_drift(ft, _MON), len(FEATURE_COLS)), "rollup")
    rollup.write.parquet(f"{base}/rollup")
    _drain_outcomes(spark, ft.select("ticker", "date", (F.col("macd_histogram") > 0).cast("int").alias("prediction"),
                                     F.col("target_direction").alias("label")), base)
    _drain_log(spark, sf_dir, base, rollup_dir=f"{base}/rollup", accuracy_dir=f"{base}/accuracy")
    decisions = spark.read.parquet(f"{base}/monitor_decisions")
    last = decisions.where(F.col("epoch_id") == decisions.select(F.max("epoch_id")).scalar()).drop("epoch_id")
    return spark_project(rollup.join(last, "ticker").withColumns({
        "drifted_features": F.array_join("drifted_features", ","), "reasons": F.array_join("reasons", " | ")}), RETRAIN_SPEC)
