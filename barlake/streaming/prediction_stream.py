"""Structured Streaming over the prediction log and the outcomes of predictions.

P1 ingests new JSON-lines files of the log into a parquet table exactly once
(file source + checkpoint; ``availableNow`` drains what is there and stops).

P2 evaluates the log monitors per micro-batch. What a batch needs of the log before it
is one row of state: running totals and the newest 30 records. Each batch merges its own
totals and newest records into it, so its cost doesn't grow with the log.

Outcomes are a stream-stream join of predictions and actuals on (ticker, date) with
watermarks: rows up to ``late`` behind the newest date meet their partner, older join state is
dropped. The newest 30 joined rows of each ticker are the state that its rolling accuracy needs.

State is versioned: batch N reads the folder ``epoch_id=N-1`` and overwrites ``epoch_id=N``, so a
replayed batch starts from the same state and replaces its own output. Where that folder is
absent, state is rebuilt from the stored rows of the earlier batches. Older versions are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from barlake.config import MonitorConfig
from barlake.operators import drift as D
from barlake.schemas import PREDICTION_LOG
from barlake.sources.tables import path_exists

LOG_ORDER = ("timestamp", "ticker")
OUTCOME_SIDES = {"prediction": "ticker string, date date, prediction int", "label": "ticker string, date date, label int"}


def log_stream(spark: SparkSession, log_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(PREDICTION_LOG).option("mode", "FAILFAST")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(log_dir).withColumn("ingest_time", F.current_timestamp())


def ingest(spark: SparkSession, log_dir: str, table_dir: str, checkpoint: str,
           available_now: bool = True) -> StreamingQuery:
    """Log files -> parquet table, exactly once per file."""
    w = (log_stream(spark, log_dir).writeStream.format("parquet")
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start(table_dir)


def epoch(folder: str, epoch_id: int) -> str:
    return f"{folder}/epoch_id={epoch_id}"


def stored(df: DataFrame, folder: str, epoch_id: int) -> DataFrame:
    """``df`` as the batch's own version in ``folder``, read back; a replayed batch overwrites it."""
    df.write.mode("overwrite").parquet(epoch(folder, epoch_id))
    return df.sparkSession.read.schema(df.schema).parquet(epoch(folder, epoch_id))


def _state_before(spark: SparkSession, state_dir: str, rows_dir: str, epoch_id: int, schema: T.StructType, rebuild) -> DataFrame | None:
    """State after batch ``epoch_id`` - 1: its stored version, else rebuilt from the rows stored before; None at the start."""
    if epoch_id == 0:
        return None
    if path_exists(spark, epoch(state_dir, epoch_id - 1)):
        return spark.read.schema(schema).parquet(epoch(state_dir, epoch_id - 1))
    rows = spark.read.parquet(rows_dir).where(F.col("epoch_id") < epoch_id).drop("epoch_id") if path_exists(spark, rows_dir) else None
    return None if rows is None else rebuild(rows)


def _forget(spark: SparkSession, state_dir: str, epoch_id: int) -> None:
    """Deletes the version that neither this batch nor its replay reads."""
    if epoch_id >= 2:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(epoch(state_dir, epoch_id - 2))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def log_state(log: DataFrame, cfg: MonitorConfig = MonitorConfig(), before: DataFrame | None = None) -> DataFrame:
    """One row: totals of all records so far and the newest of them, newest first."""
    totals, newest = D.log_totals(log), log.select(*LOG_ORDER, "prediction")
    if before is not None:
        totals = totals.unionByName(before.select(*totals.columns)).agg(*[F.sum(c).alias(c) for c in totals.columns])
        newest = newest.unionByName(before.select(F.inline("newest")))
    return totals.withColumn("newest", D.newest_records(newest, cfg, LOG_ORDER).scalar())


def log_report(state: DataFrame, cfg: MonitorConfig = MonitorConfig()) -> DataFrame:
    """KPIs (G7) and prediction drift (G19) of a log state, one row."""
    kpis = state.select(
        F.col("n").alias("total_requests"),
        (F.try_divide(F.col("ups"), F.col("n_predicted")) * 100).alias("up_pct"),
        (F.try_divide(F.col("confidence"), F.col("n_confident")) * 100).alias("avg_confidence_pct"))
    drift = D.shift_of(state, cfg).drop("n_records")
    return kpis.withColumns({c: drift.select(c).scalar() for c in drift.columns})


def monitor(spark: SparkSession, log_dir: str, table_dir: str, monitor_dir: str, checkpoint: str,
            cfg: MonitorConfig = MonitorConfig(), available_now: bool = True, state_dir: str | None = None,
            rollup_dir: str | None = None, accuracy_dir: str | None = None) -> StreamingQuery:
    """Per micro-batch store the new records, merge the state, write one monitor row.

    With ``rollup_dir`` (the feature-drift table per ticker that the batch monitor keeps) the
    batch also writes the retrain decision per ticker (G22) to ``<monitor_dir>_decisions``;
    ``accuracy_dir`` is where ``outcomes`` keeps the newest rolling accuracies. Every
    write goes to the batch's own ``epoch_id=`` folder.
    """
    state_dir = state_dir or f"{monitor_dir}_state"

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        new = stored(batch.drop("ingest_time"), table_dir, epoch_id)
        schema = log_state(new, cfg).schema
        before = _state_before(spark, state_dir, table_dir, epoch_id, schema, lambda rows: log_state(rows, cfg))
        state = stored(log_state(new, cfg, before), state_dir, epoch_id)
        report = log_report(state, cfg)
        stored(report.withColumn("evaluated_at", F.current_timestamp()), monitor_dir, epoch_id)
        if rollup_dir is not None:
            accuracy = newest_accuracy(spark, accuracy_dir, cfg) if accuracy_dir is not None else None
            decision = D.retrain_decision(spark.read.parquet(rollup_dir), report, accuracy, cfg)
            stored(decision, f"{monitor_dir}_decisions", epoch_id)
        _forget(spark, state_dir, epoch_id)

    w = log_stream(spark, log_dir).writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def outcome_stream(predictions: DataFrame, actuals: DataFrame, late: str) -> DataFrame:
    """J4 on streams: (ticker, date, prediction, label, correct) of rows that meet within the watermark."""
    def side(df: DataFrame, value: str) -> DataFrame:
        return df.select("ticker", F.col("date").cast("timestamp").alias("event_time"), value).withWatermark("event_time", late)

    joined = side(predictions, "prediction").join(side(actuals, "label"), ["ticker", "event_time"])
    return joined.select("ticker", F.col("event_time").cast("date").alias("date"), "prediction", "label",
                         (F.col("prediction") == F.col("label")).cast("int").alias("correct"))


def outcome_state(rows: DataFrame, cfg: MonitorConfig = MonitorConfig(), before: DataFrame | None = None) -> DataFrame:
    """Per ticker the newest rows that a rolling accuracy needs: ticker, newest (date, correct), newest first.

    ``row_number() <= n`` runs as a window group limit: each task keeps n rows per ticker before the shuffle.
    """
    rows = rows.select("ticker", "date", "correct")
    if before is not None:
        rows = rows.unionByName(before.select("ticker", F.inline("newest")))
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc(), F.col("correct").desc())
    top = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= cfg.rolling_accuracy_window)
    return top.groupBy("ticker").agg(F.sort_array(F.collect_list(F.struct("date", "correct")), asc=False).alias("newest"))


def accuracy_of(state: DataFrame, cfg: MonitorConfig = MonitorConfig()) -> DataFrame:
    """ticker, date, rolling_accuracy (null below the least number of known outcomes) of an outcome state."""
    known = F.filter("newest", lambda x: x["correct"].isNotNull())
    right = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x["correct"])
    share = F.when(F.size(known) >= cfg.rolling_accuracy_min_periods, right / F.size(known))
    return state.select("ticker", F.element_at("newest", 1)["date"].alias("date"), share.alias("rolling_accuracy"))


def newest_accuracy(spark: SparkSession, state_dir: str, cfg: MonitorConfig = MonitorConfig()) -> DataFrame | None:
    """Accuracies of the newest version that ``outcomes`` has written; None before the first."""
    if not path_exists(spark, state_dir):
        return None
    # versions still there are two at most, each one row per ticker
    states = spark.read.parquet(state_dir)
    newest = states.select(F.max("epoch_id")).scalar()
    return accuracy_of(states.where(F.col("epoch_id") == newest), cfg)


def outcomes(spark: SparkSession, predictions_dir: str, actuals_dir: str, table_dir: str, state_dir: str, checkpoint: str,
             late: str = "45 days", cfg: MonitorConfig = MonitorConfig(), available_now: bool = True) -> StreamingQuery:
    """Parquet files of predictions and of actuals -> joined rows per batch, and the accuracy state per ticker.

    Rows more than ``late`` behind the newest date of the slower side find no partner any more.
    """
    def read(path: str, value: str) -> DataFrame:
        return spark.readStream.schema(OUTCOME_SIDES[value]).parquet(path)

    def per_batch(batch: DataFrame, epoch_id: int) -> None:
        new = stored(batch, table_dir, epoch_id)
        schema = outcome_state(new, cfg).schema
        before = _state_before(spark, state_dir, table_dir, epoch_id, schema, lambda rows: outcome_state(rows, cfg))
        stored(outcome_state(new, cfg, before), state_dir, epoch_id)
        _forget(spark, state_dir, epoch_id)

    joined = outcome_stream(read(predictions_dir, "prediction"), read(actuals_dir, "label"), late)
    w = joined.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
