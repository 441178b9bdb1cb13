"""Batch jobs composed from the operators (section 3 of the survey, re-aimed):

* ``build``: bars -> quality report -> clean -> preprocess -> versioned raw +
  metadata -> features -> feature store; per-ticker outcomes are data (G23).
* ``features_for``: compute-if-missing cache over the feature store (K7).
* ``analyze``: request table -> one analysis row per valid request (J7) and
  one appended log record each (K4).
* ``anomalies``: stored forest + feature store -> newest anomalies and their share.
* ``monitor``: feature drift + prediction drift + rolling accuracy -> retrain.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.config import DEFAULT, Config
from barlake.operators import drift as D
from barlake.operators import iforest as IF
from barlake.operators import report as RP
from barlake.operators.classifiers import score_latest
from barlake.operators.cleaning import sparse_summary
from barlake.operators.quality import run_metadata, validate
from barlake.operators.requests import check_requests, missing_tickers, normalise_ticker
from barlake.plans.blocked import features_from_preprocessed_blocked
from barlake.plans.pipeline import cleaned_with_report, feature_table, preprocessed_bars
from barlake.schemas import model_columns
from barlake.session import staged
from barlake.sinks import writers as W
from barlake.sources.tables import load_feature_data


def build(bars: DataFrame, out_dir: str, start: str, end: str, cfg: Config = DEFAULT,
          sentiment: DataFrame | None = None, run_date: str | None = None,
          requested: DataFrame | None = None) -> DataFrame:
    """Run the whole build for all tickers of ``bars``; returns the job summary per ticker.

    Reads and replaces what belongs to this run only: the raw version of its run date for
    the tickers it kept. Other tickers, and older versions of dropped ones, stay untouched.
    """
    spark = bars.sparkSession
    run_date = run_date or spark.range(1).select(F.date_format(F.current_date(), "yyyy-MM-dd")).first()[0]
    report = validate(bars)
    clean_rep = cleaned_with_report(bars, cfg)[1]
    W.write_raw(preprocessed_bars(bars, cfg), f"{out_dir}/raw", run_date)
    mine = clean_rep.where("kept").select("ticker")
    raw = (spark.read.parquet(f"{out_dir}/raw").where(F.col("run_date").cast("string") == run_date)
           .join(mine, "ticker", "left_semi").drop("run_date"))
    W.write_metadata(run_metadata(raw, report, start, end), f"{out_dir}/metadata", run_date)
    feats = features_from_preprocessed_blocked(raw, cfg, sentiment, cfg.layout.block_rows)
    W.save_features(feats, f"{out_dir}/features")
    stored = load_feature_data(spark, f"{out_dir}/features").join(mine, "ticker", "left_semi")
    counts = stored.groupBy("ticker").agg(F.count(F.lit(1)).alias("feature_rows"))
    return (sparse_summary(clean_rep, requested).join(counts, "ticker", "left")
            .withColumn("feature_rows", F.coalesce("feature_rows", F.lit(0)).cast("long"))
            .withColumn("feature_columns", F.lit(len(feats.columns))))


def features_for(spark: SparkSession, requested: DataFrame, features_dir: str, bars: DataFrame,
                 cfg: Config = DEFAULT, sentiment: DataFrame | None = None, save: bool = True) -> DataFrame:
    """Stored features for the requested tickers, computing and appending the misses (K7)."""
    wanted = requested.select(normalise_ticker(F.col("ticker")).alias("ticker")).distinct()
    try:
        existing = load_feature_data(spark, features_dir)
    except FileNotFoundError:
        existing = None
    misses = wanted if existing is None else missing_tickers(requested, existing)
    fresh = feature_table(bars.join(misses, "ticker", "left_semi"), cfg, sentiment)
    if save:
        W.save_features(fresh, features_dir, mode="append")
        existing = load_feature_data(spark, features_dir)
    elif existing is not None:
        existing = existing.unionByName(fresh, allowMissingColumns=True)
    else:
        existing = fresh
    return existing.join(wanted, "ticker", "left_semi")


def analyze(spark: SparkSession, requests: DataFrame, bars: DataFrame, models: dict,
            forest: IF.Forest | None = None, info: DataFrame | None = None,
            sentiment: DataFrame | None = None, log_dir: str | None = None,
            cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Returns (one analysis row per valid request, rejected requests with reasons).

    A request is a series of its own: its id takes the place of the ticker in every
    window, so several ranges of one ticker stay apart. Status: OK, INSUFFICIENT_DATA (fewer
    than 30 cleaned rows or too sparse), INSUFFICIENT_FEATURES, NO_DATA (no bars in the range).
    """
    t0 = time.time()
    checked = check_requests(requests)
    valid = checked.where("valid")
    rejected = checked.where(~F.col("valid"))
    named = valid.select("ticker", "request_id")

    def per_request(df: DataFrame) -> DataFrame:
        return df.join(named, "ticker").drop("ticker").withColumnRenamed("request_id", "ticker")

    win = bars.join(valid.select("ticker", "start", "end", "request_id"), "ticker")
    win = win.where((F.col("date") >= F.col("start")) & (F.col("date") < F.col("end"))).drop("start", "end", "ticker")
    win = win.withColumnRenamed("request_id", "ticker")
    rep = cleaned_with_report(win, cfg)[1]
    feats = feature_table(win, cfg, None if sentiment is None else per_request(sentiment))
    preds = score_latest(feats, models)
    flag = None
    if forest is not None:
        flag = IF.score(forest, RP.latest_row(feats)).select("ticker", (F.col("anomaly") == -1).alias("anomaly_flag"))
    rec = RP.analysis_record(feats, preds, flag, None if info is None else per_request(info))
    few = ~F.col("kept") | (F.col("cleaned_rows") < 30)
    status = rep.select("ticker", F.when(few, "INSUFFICIENT_DATA").otherwise("OK").alias("status"))
    rec = status.join(rec, "ticker", "left").withColumnRenamed("ticker", "request_id")
    rec = valid.select("request_id", "ticker", "start", "end").join(rec, "request_id", "left").withColumn(
        "status", F.when(F.col("status").isNull(), "NO_DATA")
        .when((F.col("status") == "OK") & F.col("direction_prediction").isNull(), "INSUFFICIENT_FEATURES")
        .otherwise(F.col("status")))
    if log_dir is not None:
        cols = model_columns(feats.columns)
        scored = RP.latest_row(feats).join(preds, "ticker").withColumnRenamed("ticker", "request_id")
        scored = scored.join(valid.select("request_id", "ticker"), "request_id")
        W.append_prediction_log(W.prediction_records(scored, cols, (time.time() - t0) * 1000.0), log_dir)
    return rec, rejected


def anomalies(features: DataFrame, forest: IF.Forest, k: int = 20) -> tuple[DataFrame, DataFrame]:
    """(newest k anomalies per ticker, count and share) of a stored forest over a feature table."""
    scored = staged(IF.score(forest, features.na.drop(subset=list(forest.features))), "anomalies")
    return RP.anomalies_top(scored, k), IF.anomaly_summary(scored)


def monitor(features: DataFrame, log: DataFrame, predictions: DataFrame | None = None,
            actuals: DataFrame | None = None, cfg: Config = DEFAULT, reference: DataFrame | None = None,
            rollup_dir: str | None = None) -> DataFrame:
    """Retrain decision per ticker from the three monitors (G22); ``reference`` rows take the place
    of each ticker's first 70 % where given. The feature-drift table is kept in ``rollup_dir`` for the stream."""
    res = D.feature_drift(features, cfg.monitoring, reference=reference)
    rollup = D.drift_rollup(res, len(model_columns(features.columns)))
    if rollup_dir is not None:
        rollup.write.mode("overwrite").parquet(rollup_dir)
        rollup = features.sparkSession.read.schema(rollup.schema).parquet(rollup_dir)
    acc = None
    if predictions is not None and actuals is not None:
        acc = D.latest_value(D.rolling_accuracy(predictions, actuals, cfg.monitoring), "rolling_accuracy")
    pdrift = D.prediction_drift(log, cfg.monitoring)
    return D.retrain_decision(rollup, pdrift, acc, cfg.monitoring)
