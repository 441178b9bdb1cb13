"""Drift monitoring: KS feature drift (G20, G21, W17, W19), prediction drift
(G19, W18), rolling accuracy (W15, J4) and the retrain decision (G22).

Feature drift runs for every ticker at once: the reference sample is the
first 70 % of a ticker's rows, the recent sample its last 30 rows (they may
overlap). Features are unpivoted to ``(ticker, feature, value)``, collapsed
to counts per distinct value, and the KS statistic comes from cumulative
counts in integers (exact on any engine). Only the p-value needs Python: one
Arrow-batched call per (ticker, feature) summary row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.config import MonitorConfig
from barlake.functions.ks import ks_pvalue_series
from barlake.operators.ecdf import cumulative_counts
from barlake.schemas import model_columns
from barlake.session import staged

# fixed values: retrain reason texts
MSG_FEATURE_DRIFT = "Feature drift in: "
MSG_PRED_DRIFT = "Prediction drift: %.1f%%"
MSG_ACCURACY = "Rolling accuracy %.1f%% < %.0f%%"


@F.pandas_udf(T.DoubleType())
def ks_pvalue_udf(n1, n2, h):
    return ks_pvalue_series(n1, n2, h)


def _is_temporal(df: DataFrame, col: str) -> bool:
    return dict(df.dtypes).get(col, "") in ("date", "timestamp", "timestamp_ntz")


def sample_flags(features: DataFrame, cfg: MonitorConfig = MonitorConfig(),
                 key: str = "ticker", order: str = "date") -> DataFrame:
    """Adds ``is_ref`` (first int(n * 0.7) rows) and ``is_rec`` (last 30 rows) per ticker.

    With a date order the positions come from per-(ticker, month) numbering plus
    bucket offsets and the count from an aggregate: no ticker is sorted whole in
    one task. Other order columns use per-ticker windows.
    """
    if key == "ticker" and _is_temporal(features, order):
        from barlake.plans.blocked import month_number, row_positions

        # numbering reads the rows twice (counts, then rows): build the features once
        numbered = row_positions(staged(features, "drift-features"), month_number(F.col(order)), order)
    else:
        w = Window.partitionBy(key).orderBy(order)
        numbered = features.withColumns({"_n": F.count(F.lit(1)).over(Window.partitionBy(key)),
                                         "_rn": F.row_number().over(w)})
    n, rn = F.col("_n"), F.col("_rn")
    return numbered.withColumns({
        "is_ref": rn <= F.floor(n.cast("double") * F.lit(cfg.reference_fraction)),
        "is_rec": rn > n - F.lit(cfg.drift_lookback_days),
    }).drop("_n", "_rn")


def ks_statistics(features: DataFrame, cfg: MonitorConfig = MonitorConfig(), feature_cols: list[str] | None = None,
                  key: str = "ticker", reference: DataFrame | None = None) -> DataFrame:
    """Per (ticker, feature): n_ref, n_rec, integer statistic h and D = h / (n_ref * n_rec).

    With a ``reference`` table its rows are the reference sample; otherwise the first 70 % of
    each ticker's rows. Features with fewer than 10 non-null values on either side are left out.
    """
    feature_cols = feature_cols or model_columns(features.columns)
    flagged = sample_flags(features, cfg, key)
    if reference is not None:
        both = [key, *feature_cols]
        flagged = (flagged.where("is_rec").select(*both, F.lit(False).alias("is_ref"), "is_rec")
                   .unionByName(reference.select(*both, F.lit(True).alias("is_ref"), F.lit(False).alias("is_rec"))))
    long = flagged.select(
        key, "is_ref", "is_rec",
        F.explode(F.array(*[
            F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"))
            for i, c in enumerate(feature_cols)])).alias("kv"),
    ).select(key, "is_ref", "is_rec", "kv.ordinal", "kv.feature", "kv.value").where(F.col("value").isNotNull())
    cum = cumulative_counts(long, [key, "ordinal", "feature"], "value", ["is_ref", "is_rec"])
    diff = F.abs(F.col("cum_is_ref") * F.col("tot_is_rec") - F.col("cum_is_rec") * F.col("tot_is_ref"))
    stats = cum.groupBy(key, "ordinal", "feature").agg(
        F.max(diff).alias("h"), F.first("tot_is_ref").alias("n_ref"), F.first("tot_is_rec").alias("n_rec"))
    stats = stats.where((F.col("n_ref") >= cfg.min_ks_values) & (F.col("n_rec") >= cfg.min_ks_values))
    return stats.withColumn(
        "ks_statistic", F.col("h").cast("double") / (F.col("n_ref") * F.col("n_rec")).cast("double"))


def feature_drift(features: DataFrame, cfg: MonitorConfig = MonitorConfig(), feature_cols: list[str] | None = None,
                  key: str = "ticker", reference: DataFrame | None = None) -> DataFrame:
    """KS results per (ticker, feature): statistic, p-value, drifted (p < threshold, unrounded)."""
    stats = ks_statistics(features, cfg, feature_cols, key, reference)
    p = ks_pvalue_udf(F.col("n_ref"), F.col("n_rec"), F.col("h"))
    return stats.withColumn("p_value", p).withColumn(
        "drifted", F.col("p_value") < F.lit(cfg.ks_pvalue_threshold))


def drift_rollup(results: DataFrame, total_features: int, key: str = "ticker") -> DataFrame:
    """Per ticker: total, tested, drifted feature list (feature order) and count."""
    drifted = F.when(F.col("drifted"), F.struct("ordinal", "feature"))
    return results.groupBy(key).agg(
        F.count(F.lit(1)).alias("tested_features"),
        F.array_sort(F.collect_list(drifted)).alias("_d"),
    ).select(
        key, F.lit(total_features).cast("int").alias("total_features"),
        F.col("tested_features").cast("int").alias("tested_features"),
        F.transform("_d", lambda s: s["feature"]).alias("drifted_features"),
        F.size("_d").alias("n_drifted"),
    )


def prediction_drift(log: DataFrame, cfg: MonitorConfig = MonitorConfig(),
                     order_cols: tuple[str, ...] = ("timestamp", "ticker", "event_id")) -> DataFrame:
    """UP share of the recent records (last min(30, n div 3)) vs the rest of the log
    (G19, W18; fewer than 20 records: no check, F12).

    No global window: one aggregate gives the totals, and TakeOrdered (each task keeps 30 rows)
    the newest records. The log has no file position, so order is by (timestamp, ticker, event
    id). Fewer than 20 rows: not checked.
    """
    return shift_of(log_totals(log).withColumn("newest", newest_records(log, cfg, order_cols).scalar()), cfg)


def log_totals(log: DataFrame) -> DataFrame:
    """One row of mergeable sums over log records: n, ups, n_predicted, confidence, n_confident."""
    return log.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.col("prediction").cast("double")), F.lit(0.0)).alias("ups"),
        F.count("prediction").alias("n_predicted"),
        F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("confidence"),
        F.count("confidence").alias("n_confident"))


def newest_records(log: DataFrame, cfg: MonitorConfig = MonitorConfig(),
                   order_cols: tuple[str, ...] = ("timestamp", "ticker", "event_id")) -> DataFrame:
    """One row with one array: the newest ``drift_lookback_days`` records, newest first."""
    cols = [c for c in order_cols if c in log.columns] + ["prediction"]
    top = log.select(*cols).orderBy(*[F.col(c).desc() for c in cols]).limit(cfg.drift_lookback_days)
    return top.agg(F.sort_array(F.collect_list(F.struct(*cols)), asc=False).alias("newest"))


def shift_of(state: DataFrame, cfg: MonitorConfig = MonitorConfig()) -> DataFrame:
    """The drift row of a log known by its totals and its newest records (``log_totals``, ``newest_records``)."""
    n = F.col("n")
    k = F.least(F.lit(cfg.drift_lookback_days), F.floor(n / 3)).cast("int")
    recent = F.slice("newest", 1, F.greatest(k, F.lit(1)))
    rs = F.when(k > 0, F.aggregate(recent, F.lit(0.0), lambda acc, x: acc + F.coalesce(x["prediction"].cast("double"), F.lit(0.0))))
    rn = F.when(k > 0, k).otherwise(F.lit(0))
    both = state.select(n, F.col("ups").alias("s"), rn.alias("rn"), rs.alias("rs"))
    hist = F.try_divide(F.col("s") - F.col("rs"), F.col("n") - F.col("rn"))
    rec = F.try_divide(F.col("rs"), F.col("rn"))
    shift = F.abs(rec - hist)
    enough = F.col("n") >= cfg.min_log_rows
    return both.select(
        F.col("n").cast("long").alias("n_records"),
        F.when(enough, hist).alias("historical_up_pct"),
        F.when(enough, rec).alias("recent_up_pct"),
        F.when(enough, shift).alias("shift"),
        F.lit(cfg.prediction_drift_threshold).alias("threshold"),
        F.coalesce(F.when(enough, shift > cfg.prediction_drift_threshold), F.lit(False)).alias("drifted"),
        F.when(~enough, F.lit("Not enough predictions for drift check")).alias("reason"),
    )


def rolling_accuracy(predictions: DataFrame, actuals: DataFrame, cfg: MonitorConfig = MonitorConfig(),
                     key: str = "ticker", order: str = "date", pred: str = "prediction",
                     label: str = "label") -> DataFrame:
    """Join predictions to actuals on (ticker, date) (J4); rolling share correct over
    30 rows with at least 10 (W15)."""
    j = predictions.select(key, order, pred).join(actuals.select(key, order, label), [key, order])
    return rolling_share(j.withColumn("correct", (F.col(pred) == F.col(label)).cast("int")), cfg, key, order)


def rolling_share(j: DataFrame, cfg: MonitorConfig = MonitorConfig(), key: str = "ticker", order: str = "date") -> DataFrame:
    """Rolling share of ``correct`` over joined rows, by order within the key."""
    n = cfg.rolling_accuracy_window

    def windows(df: DataFrame, keys, order_col: str) -> DataFrame:
        w = Window.partitionBy(*(keys if isinstance(keys, list) else [keys])).orderBy(order_col) \
            .rowsBetween(-(n - 1), 0)
        counted = df.withColumns({"_c": F.count("correct").over(w), "_a": F.avg("correct").over(w)})
        return counted.withColumn(
            "rolling_accuracy", F.when(F.col("_c") >= cfg.rolling_accuracy_min_periods, F.col("_a"))
        ).drop("_c", "_a")

    if key == "ticker" and _is_temporal(j, order):
        # a hot ticker is spread over row blocks with a (window - 1)-row halo
        from barlake.plans.blocked import blocked_window, month_number

        return blocked_window(j, month_number(F.col(order)), order, n - 1, 0, windows)
    return windows(j, key, order)


def latest_value(df: DataFrame, col: str, key: str = "ticker", order: str = "date") -> DataFrame:
    """Latest row's value per ticker via ``max_by`` (no sort of the group)."""
    return df.groupBy(key).agg(F.max_by(F.col(col), F.col(order)).alias(col))


def py_list_text(names: Column) -> Column:
    """Python list repr of a string array: ['a', 'b']."""
    quoted = F.transform(names, lambda x: F.concat(F.lit("'"), x, F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def retrain_decision(rollup: DataFrame, pred_drift: DataFrame | None = None,
                     accuracy: DataFrame | None = None, cfg: MonitorConfig = MonitorConfig(),
                     key: str = "ticker") -> DataFrame:
    """Per ticker: reasons (feature drift, prediction drift, low rolling accuracy) and
    the OR of them (G22). Prediction drift is one log-wide row, applied to all."""
    df = rollup
    if pred_drift is not None:
        df = df.withColumns({
            "_pd": pred_drift.select("drifted").scalar(),
            "_shift": pred_drift.select("shift").scalar(),
        })
    else:
        df = df.withColumns({"_pd": F.lit(False), "_shift": F.lit(None).cast("double")})
    if accuracy is not None:
        df = df.join(accuracy.select(key, F.col("rolling_accuracy").alias("_acc")), key, "left")
    else:
        df = df.withColumn("_acc", F.lit(None).cast("double"))
    reasons = F.array_compact(F.array(
        F.when(F.col("n_drifted") > 0, F.concat(F.lit(MSG_FEATURE_DRIFT), py_list_text(F.col("drifted_features")))),
        F.when(F.col("_pd"), F.format_string(MSG_PRED_DRIFT, F.col("_shift") * 100)),
        F.when(F.col("_acc") < cfg.min_accuracy_threshold,
               F.format_string(MSG_ACCURACY, F.col("_acc") * 100, F.lit(cfg.min_accuracy_threshold * 100))),
    ))
    return df.select(key, F.col("_acc").alias("rolling_accuracy"), reasons.alias("reasons"),
                     (F.size(reasons) > 0).alias("retrain"))
