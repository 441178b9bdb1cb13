"""Registered queries: Spark callables and their DuckDB twins.

Every query reads the driver tables (or what Spark derives from them) whole;
nothing is capped, sampled or filtered to a subset of ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.config import DEFAULT
from barlake.operators.quality import validate
from barlake.plans import sql_twins as sq
from barlake.plans.pipeline import clean_report, cleaned_bars, feature_table, preprocessed_bars
from barlake.plans.projection import (BARS_SPEC, PRE_SPEC, features_spec, spark_project,
                                      sql_project)
from barlake.session import checkpoint_dir, staged, tune
from barlake.sources.bars import bars_from_lineitem

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return run
    return deco


QUALITY_SPEC = [("ticker", "string"), ("rows", "long"), ("missing_days", "long"),
                ("n_issues", "int"), ("issues", "string")]
CLEAN_REPORT_SPEC = [("ticker", "string"), ("missing_pct", "double"), ("kept", "bool"),
                     ("volume_cap", "double"), ("n_capped", "long"), ("cleaned_rows", "long")]
FEATURES_SPEC = features_spec(DEFAULT)


@register("bars_daily", sql_project(sq.bars_sql("l_linestatus"), BARS_SPEC))
def q_bars_daily(spark, sf_dir):
    """Fixture bars: ticker = l_linestatus, one bar per ship date."""
    return spark_project(bars_from_lineitem(spark, sf_dir, "l_linestatus"), BARS_SPEC)


@register("bars_three_tickers", sql_project(sq.bars_sql("l_returnflag"), BARS_SPEC))
def q_bars_three(spark, sf_dir):
    return spark_project(bars_from_lineitem(spark, sf_dir, "l_returnflag"), BARS_SPEC)


@register("quality_report", sql_project(sq.quality_sql("l_returnflag"), QUALITY_SPEC))
def q_quality(spark, sf_dir):
    """Validation report per ticker."""
    rep = validate(bars_from_lineitem(spark, sf_dir, "l_returnflag"))
    rep = rep.select("ticker", "rows", "missing_days", F.size("issues").alias("n_issues"),
                     F.array_join("issues", " | ").alias("issues"))
    return spark_project(rep, QUALITY_SPEC)


@register("clean_report", sql_project(sq.clean_report_sql("l_returnflag"), CLEAN_REPORT_SPEC))
def q_clean_report(spark, sf_dir):
    """Missing share after fill, kept flag, volume cap, capped rows."""
    return spark_project(clean_report(bars_from_lineitem(spark, sf_dir, "l_returnflag")), CLEAN_REPORT_SPEC)


@register("clean_bars", sql_project(sq.cleaned_sql("l_returnflag"), BARS_SPEC))
def q_clean_bars(spark, sf_dir):
    """J1 + W14 + F11 + F5 + G3/X4: calendar densify, fill <= 2, sparse drop, cap."""
    return spark_project(cleaned_bars(bars_from_lineitem(spark, sf_dir, "l_returnflag")), BARS_SPEC)


@register("preprocessed", sql_project(sq.preprocessed_sql("l_returnflag"), PRE_SPEC))
def q_preprocessed(spark, sf_dir):
    """Log return and 20-row normalised volume after the warm-up drop."""
    return spark_project(preprocessed_bars(bars_from_lineitem(spark, sf_dir, "l_returnflag")), PRE_SPEC)


@register("features", sql_project(sq.features_sql("l_returnflag"), FEATURES_SPEC))
def q_features(spark, sf_dir):
    """Full feature table (RSI, MACD, Bollinger, volatility, ratios, lags, target)."""
    return spark_project(feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag")), FEATURES_SPEC)


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


# ------------------------------------------------------------------ metrics
from barlake.operators import metrics as M  # noqa: E402
from barlake.operators.split import random_split  # noqa: E402
from barlake.sources.fixtures import scored_table  # noqa: E402

RATE_SPEC = [("n", "long"), ("tn", "long"), ("fp", "long"), ("fn", "long"), ("tp", "long"),
             ("accuracy", "double"), ("precision", "double"), ("recall", "double"), ("f1", "double")]
FAIR_PAIR = ("EN", "DE")
_T = DEFAULT.training


@register("metrics_by_ticker", sql_project(sq.confusion_sql(sq.scored_sql(), "ticker"),
                                           [("ticker", "string")] + RATE_SPEC))
def q_metrics_by_ticker(spark, sf_dir):
    """Confusion counts and rates per ticker, zero_division = 0."""
    return spark_project(M.confusion_metrics(scored_table(spark, sf_dir), ["ticker"]),
                         [("ticker", "string")] + RATE_SPEC)


@register("metrics_overall", sql_project(sq.confusion_sql(sq.scored_sql(), None), RATE_SPEC))
def q_metrics_overall(spark, sf_dir):
    return spark_project(M.confusion_metrics(scored_table(spark, sf_dir)), RATE_SPEC)


@register("roc_auc_by_ticker", sql_project(sq.auc_sql(sq.scored_sql(), "ticker"),
                                           [("ticker", "string"), ("roc_auc", "double")]))
def q_auc_by_ticker(spark, sf_dir):
    """Exact rank-sum AUC with ties, per ticker."""
    return spark_project(M.roc_auc(scored_table(spark, sf_dir), ["ticker"]),
                         [("ticker", "string"), ("roc_auc", "double")])


@register("roc_auc_overall", sql_project(sq.auc_sql(sq.scored_sql(), None), [("roc_auc", "double")]))
def q_auc_overall(spark, sf_dir):
    return spark_project(M.roc_auc(scored_table(spark, sf_dir)), [("roc_auc", "double")])


BASE_SPEC = [("n", "long"), ("accuracy", "double"), ("precision", "double"), ("recall", "double"),
             ("f1", "double")]


@register("baseline_always_up", sql_project(sq.baseline_sql(sq.scored_sql(), "ticker"),
                                            [("ticker", "string")] + BASE_SPEC))
def q_baseline(spark, sf_dir):
    """Naive always-UP accuracy / precision / recall / F1 per ticker."""
    return spark_project(M.baseline_always_up(scored_table(spark, sf_dir), ["ticker"]),
                         [("ticker", "string")] + BASE_SPEC)


FAIR_SPEC = [(f"{c}_{t}", k) for t in FAIR_PAIR for c, k in
             (("accuracy", "double"), ("f1", "double"), ("n", "long"))] + [
    ("accuracy_gap", "double"), ("gap_warning", "bool")]


@register("fairness_gap", sql_project(sq.fairness_sql(sq.scored_sql(), FAIR_PAIR, _T.fairness_min_rows,
                                                      _T.fairness_gap_limit), FAIR_SPEC))
def q_fairness(spark, sf_dir):
    """Accuracy / F1 / samples of two groups (>= 50 rows) and the gap flag."""
    return spark_project(M.fairness(scored_table(spark, sf_dir), FAIR_PAIR, _T.fairness_min_rows,
                                    _T.fairness_gap_limit), FAIR_SPEC)


SPLIT_SPEC = [("split", "string"), ("n", "long"), ("n_up", "long"), ("up_share", "double")]


def _split_sql() -> str:
    inner = sq.split_sql(sq.features_sql("l_returnflag"), _T.test_size, _T.random_seed)
    return f"""SELECT split, count(*) AS n, count_if(target_direction = 1) AS n_up,
               avg(CAST(target_direction AS DOUBLE)) AS up_share FROM ({inner}) s GROUP BY split"""


@register("split_class_balance", sql_project(_split_sql(), SPLIT_SPEC))
def q_split(spark, sf_dir):
    """M1 + G9/G24: hash-stratified 80/20 split of the feature table and class balance per side."""
    ft = staged(feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag")), "features")
    return spark_project(M.class_balance(random_split(ft, _T.test_size, _T.random_seed)), SPLIT_SPEC)


# ------------------------------------------------------------------ drift
from barlake.operators import drift as D  # noqa: E402
from barlake.schemas import model_columns  # noqa: E402
from barlake.sources.fixtures import prediction_log  # noqa: E402

_MON = DEFAULT.monitoring
KS_SPEC = [("ticker", "string"), ("feature", "string"), ("ordinal", "int"), ("n_ref", "long"),
           ("n_rec", "long"), ("h", "long"), ("ks_statistic", "double")]
FEATURE_COLS = model_columns([c for c, _ in FEATURES_SPEC])


@register("ks_statistics", sql_project(sq.ks_sql(sq.features_sql("l_returnflag"), FEATURE_COLS,
                                                 _MON.reference_fraction, _MON.drift_lookback_days,
                                                 _MON.min_ks_values), KS_SPEC))
def q_ks_statistics(spark, sf_dir):
    """Two-sample KS statistic per (ticker, feature), first 70 % vs last 30 rows."""
    ft = feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag"))
    return spark_project(D.ks_statistics(ft, _MON), KS_SPEC)


_KS_SQL = sq.ks_sql(sq.features_sql("l_returnflag"), FEATURE_COLS, _MON.reference_fraction, _MON.drift_lookback_days, _MON.min_ks_values)
FD_SPEC = [("ticker", "string"), ("feature", "string"), ("ks_statistic", "d4"), ("p_value", "d4"), ("drifted", "bool")]


@register("feature_drift", sql_project(sq.feature_drift_sql(_KS_SQL, _MON.ks_pvalue_threshold), FD_SPEC))
def q_feature_drift(spark, sf_dir):
    """G20 with exact KS p-values (lattice paths; one Arrow batch over the summary rows)."""
    ft = feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag"))
    return spark_project(D.feature_drift(ft, _MON), FD_SPEC)


PD_SPEC = [("n_records", "long"), ("historical_up_pct", "double"), ("recent_up_pct", "double"),
           ("shift", "double"), ("threshold", "double"), ("drifted", "bool"), ("reason", "string")]


@register("prediction_drift", sql_project(sq.prediction_drift_sql(
    _MON.drift_lookback_days, _MON.prediction_drift_threshold, _MON.min_log_rows), PD_SPEC))
def q_prediction_drift(spark, sf_dir):
    """UP share of the last min(30, n/3) log records vs the rest."""
    return spark_project(D.prediction_drift(prediction_log(spark, sf_dir), _MON), PD_SPEC)


RA_SPEC = [("ticker", "string"), ("date", "date"), ("prediction", "int"), ("label", "int"),
           ("correct", "int"), ("rolling_accuracy", "double")]


@register("rolling_accuracy", sql_project(sq.rolling_accuracy_sql(
    _MON.rolling_accuracy_window, _MON.rolling_accuracy_min_periods), RA_SPEC))
def q_rolling_accuracy(spark, sf_dir):
    """J4 + W15: predictions joined to actuals, rolling share correct (30 rows, min 10)."""
    s = scored_table(spark, sf_dir)
    return spark_project(D.rolling_accuracy(s, s, _MON), RA_SPEC)


RETRAIN_SPEC = [("ticker", "string"), ("total_features", "int"), ("tested_features", "int"), ("n_drifted", "int"), ("drifted_features", "string"),
                ("rolling_accuracy", "double"), ("reasons", "string"), ("retrain", "bool")]


@register("retrain_decision", sql_project(sq.retrain_sql(sq.features_sql("l_returnflag"), _KS_SQL, _MON).format(total=len(FEATURE_COLS)), RETRAIN_SPEC))
def q_retrain(spark, sf_dir):
    """Drift roll-up per ticker + log prediction drift + rolling accuracy of a
    MACD-histogram sign rule against the target -> reasons and the retrain flag."""
    ft = staged(feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag")), "features")
    res = D.feature_drift(ft, _MON)
    rollup = D.drift_rollup(res, len(FEATURE_COLS))
    rule = ft.select("ticker", "date", (F.col("macd_histogram") > 0).cast("int").alias("prediction"),
                     F.col("target_direction").alias("label"))
    acc = D.latest_value(D.rolling_accuracy(rule, rule, _MON), "rolling_accuracy")
    pdrift = D.prediction_drift(prediction_log(spark, sf_dir), _MON)
    dec = D.retrain_decision(rollup, pdrift, acc, _MON)
    return spark_project(rollup.join(dec, "ticker").withColumns({
        "drifted_features": F.array_join("drifted_features", ","), "reasons": F.array_join("reasons", " | ")}), RETRAIN_SPEC)


# ------------------------------------------------------------------ sentiment
from barlake.operators import sentiment as S  # noqa: E402
from barlake.sources.fixtures import headlines  # noqa: E402

SENT_SPEC = [("ticker", "string"), ("sentiment_score", "double"), ("n_headlines", "long"),
             ("sentiment_label", "string")]


def _sent_label_sql() -> str:
    return f"""SELECT *, CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05
               THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM ({sq.headline_sentiment_sql()}) s"""


def _ticker_sentiment(spark, sf_dir, bars=None):
    """Scores of all headline tickers, or of those that have bars."""
    return S.ticker_sentiment(headlines(spark, sf_dir), S.default_lexicon(spark), bars)


@register("headline_sentiment", sql_project(_sent_label_sql(), SENT_SPEC))
def q_headline_sentiment(spark, sf_dir):
    """Lexicon-rule polarity of every whole text, mean per ticker, label."""
    s = _ticker_sentiment(spark, sf_dir)
    return spark_project(s.withColumn("sentiment_label", S.sentiment_label(F.col("sentiment_score"))), SENT_SPEC)


LS_FEATURES_SPEC = features_spec(DEFAULT)


@register("features_with_sentiment", sql_project(
    sq.features_sql("l_linestatus", DEFAULT, sq.headline_sentiment_sql()), LS_FEATURES_SPEC))
def q_features_with_sentiment(spark, sf_dir):
    """Feature table of the l_linestatus bars with the per-ticker headline score
    joined on every row (neutral 0.0 where a ticker has no news)."""
    bars = bars_from_lineitem(spark, sf_dir, "l_linestatus")
    return spark_project(feature_table(bars, DEFAULT, _ticker_sentiment(spark, sf_dir, bars)), LS_FEATURES_SPEC)


# ------------------------------------------------------------------ reports
from barlake.operators import report as RP  # noqa: E402
from barlake.plans.blocked import display_indicators_blocked  # noqa: E402
from barlake.sources.bars import lookback  # noqa: E402
from barlake.sources.fixtures import fundamentals  # noqa: E402

FUND_API_SPEC = [("ticker", "string"), ("found", "bool"), ("pe_ratio", "double"), ("eps", "double"),
                 ("market_cap", "string"), ("profit_margin", "double"), ("revenue_growth", "double"),
                 ("fifty_two_week_high", "double"), ("fifty_two_week_low", "double")]


@register("fundamentals_api", sql_project(sq.fundamentals_api_sql(), FUND_API_SPEC))
def q_fundamentals_api(spark, sf_dir):
    """Fundamentals per ticker with market-cap text; found = price present."""
    rec = RP.fundamentals_record(fundamentals(spark, sf_dir))
    return spark_project(rec.select("ticker", "found", "fundamentals.*"), FUND_API_SPEC)


FUND_DASH_SPEC = [("ticker", "string")] + [(c, "string") for c in (
    "pe_ratio", "eps", "market_cap", "profit_margin", "revenue_growth", "high_52w", "low_52w", "avg_volume")]


@register("fundamentals_dashboard", sql_project(sq.fundamentals_dashboard_sql(), FUND_DASH_SPEC))
def q_fundamentals_dashboard(spark, sf_dir):
    """Dashboard number texts."""
    return spark_project(RP.dashboard_text(fundamentals(spark, sf_dir)), FUND_DASH_SPEC)


LVP_SPEC = [("ticker", "string"), ("date", "date"), ("latest_close", "double"), ("previous_close", "double"),
            ("change", "double"), ("change_pct", "double")]


@register("latest_vs_previous", sql_project(sq.latest_vs_previous_sql(), LVP_SPEC))
def q_latest_vs_previous(spark, sf_dir):
    """Latest vs previous close per ticker (group-limited window, top 2)."""
    return spark_project(RP.latest_vs_previous(bars_from_lineitem(spark, sf_dir, "l_linestatus")), LVP_SPEC)


SIG_SPEC = [("ticker", "string"), ("date", "date"), ("rsi_14", "double"), ("macd", "ema"),
            ("macd_signal", "ema"), ("bollinger_position", "string"), ("volume_ratio", "double"),
            ("volatility_20d", "double"), ("sentiment_score", "double")]


@register("latest_signals", sql_project(sq.latest_signals_sql(), SIG_SPEC))
def q_latest_signals(spark, sf_dir):
    """Signals of each ticker's latest feature row (with headline sentiment)."""
    bars = bars_from_lineitem(spark, sf_dir, "l_linestatus")
    ft = feature_table(bars, DEFAULT, _ticker_sentiment(spark, sf_dir, bars))
    return spark_project(RP.signals(ft).select("ticker", "date", "signals.*", "sentiment_score"), SIG_SPEC)


KPI_SPEC = [("total_requests", "long"), ("up_pct", "double"), ("avg_confidence_pct", "double")]


@register("log_kpis", sql_project(sq.log_kpis_sql(), KPI_SPEC))
def q_log_kpis(spark, sf_dir):
    """Requests, UP share and mean confidence of the prediction log."""
    return spark_project(RP.log_kpis(prediction_log(spark, sf_dir)), KPI_SPEC)


@register("prediction_histogram", sql_project(sq.prediction_histogram_sql(), [("prediction", "int"), ("n", "long")]))
def q_prediction_histogram(spark, sf_dir):
    """Prediction counts per class (only when the log has more than 5 rows)."""
    return spark_project(RP.prediction_histogram(prediction_log(spark, sf_dir)), [("prediction", "int"), ("n", "long")])


DISP_SPEC = [("ticker", "string"), ("date", "date"), ("Open", "double"), ("Close", "double"),
             ("macd", "ema"), ("macd_signal", "ema"), ("macd_histogram", "ema"), ("rsi_14", "double"),
             ("bb_upper", "double"), ("bb_middle", "double"), ("bb_lower", "double"), ("is_up", "bool"),
             ("hist_pos", "bool"), ("rsi_zone", "string")]


@register("display_indicators", sql_project(sq.display_indicators_sql("l_linestatus", 12), DISP_SPEC))
def q_display(spark, sf_dir):
    """S7 + W20 + X10/X11: one-year look-back of raw bars with the display indicator set."""
    bars = lookback(bars_from_lineitem(spark, sf_dir, "l_linestatus"), "1y")
    return spark_project(display_indicators_blocked(bars), DISP_SPEC)


# ------------------------------------------------------------------ models
from barlake.operators import classifiers as C  # noqa: E402
from barlake.operators import iforest as IF  # noqa: E402


def _split_features(spark, sf_dir):
    ft = staged(feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag")), "features")
    return random_split(ft, _T.test_size, _T.random_seed)


@register("train_evaluate", None)
def q_train_evaluate(spark, sf_dir):
    """Fit RandomForest, boosted trees and
    logistic regression on the hash split; one metrics row per model (+ naive baseline)."""
    split = _split_features(spark, sf_dir)
    runs, _ = C.train_evaluate(split, _T)
    base = M.baseline_always_up(split.where(F.col("split") == "test"), label=_T.target_column)
    out = C.summary(runs, base.select("f1").scalar())
    return out.select("model", "n_train", "n_test", "tn", "fp", "fn", "tp",
                      *[F.round(c, 4).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")],
                      "beats_baseline", "best_model")


FOREST = dict(n_trees=_T.iforest_n_estimators, contamination=_T.iforest_contamination, seed=_T.iforest_random_state,
              max_samples=_T.iforest_max_samples)
ANOM_SPEC = [("n_anomalies", "long"), ("n_rows", "long"), ("anomaly_pct", "double")]
ANOM_TOP_SPEC = [("ticker", "string"), ("rn", "int"), ("date", "string"), ("close_price", "double"), ("volume", "double"),
                 ("volume_ratio", "double"), ("price_change_pct", "double"), ("total_anomalies", "long")]
NODES_SPEC = [("tree", "int"), ("node", "int"), ("depth", "int"), ("feature", "int"), ("threshold", "double"), ("size", "long")]
STORED_SPEC = [("ticker", "string"), ("n_rows", "long"), ("n_anomalies", "long"), ("top_score", "double"), ("latest_flag", "bool")]


def _anomaly_scored(spark, sf_dir):
    ft = feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag"))
    return IF.fit_predict(ft, **FOREST)


@register("anomaly_summary", sql_project(sq.anomaly_summary_sql(sq.features_sql("l_returnflag"), **FOREST), ANOM_SPEC))
def q_anomaly_summary(spark, sf_dir):
    """Isolation forest on (volume_ratio, price_change_pct) of the pooled table."""
    return spark_project(IF.anomaly_summary(_anomaly_scored(spark, sf_dir)[0]), ANOM_SPEC)


@register("anomalies_top", sql_project(sq.anomalies_top_sql(sq.features_sql("l_returnflag"), 20, **FOREST), ANOM_TOP_SPEC))
def q_anomalies_top(spark, sf_dir):
    """Newest 20 anomalies per ticker and the total per ticker."""
    return spark_project(RP.anomalies_top(_anomaly_scored(spark, sf_dir)[0], 20), ANOM_TOP_SPEC)


@register("forest_nodes", sql_project(sq.forest_nodes_sql(sq.features_sql("l_returnflag"), **FOREST), NODES_SPEC))
def q_forest_nodes(spark, sf_dir):
    """M5/K5: the node table of the forest, grown level by level."""
    ft = feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag"))
    X = staged(ft.na.drop(subset=list(IF.FEATURES)), "forest-input")
    forest = IF.fit(X, IF.FEATURES, FOREST["n_trees"], FOREST["seed"], FOREST["max_samples"])
    return spark_project(spark.createDataFrame(forest.nodes), NODES_SPEC)


@register("stored_forest", sql_project(sq.stored_anomalies_sql(sq.features_sql("l_returnflag"), **FOREST), STORED_SPEC))
def q_stored_forest(spark, sf_dir):
    """The forest is fitted, saved with its cut, loaded again, and the loaded version
    scores the feature table; scores, flags and each ticker's newest flag."""
    ft = staged(feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag")), "features")
    path = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    IF.save_forest(spark, IF.fit_predict(ft, **FOREST)[1], path, "1")
    scored = IF.score(IF.load_forest(spark, path), ft.na.drop(subset=list(IF.FEATURES)))
    out = scored.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("anomaly") == -1).alias("n_anomalies"),
                                       F.max("anomaly_score").alias("top_score"), F.max_by(F.col("anomaly") == -1, "date").alias("latest_flag"))
    return spark_project(out, STORED_SPEC)


@register("analysis_report", None)
def q_analysis(spark, sf_dir):
    """One analysis row per ticker from the latest features, the preferred
    of the three trained classifiers, the anomaly flag
    of the latest row, signals, sentiment and fundamentals."""
    bars = bars_from_lineitem(spark, sf_dir, "l_linestatus")
    ft = staged(feature_table(bars, DEFAULT, _ticker_sentiment(spark, sf_dir, bars)), "features")
    split = random_split(ft, _T.test_size, _T.random_seed)
    _, models = C.train_evaluate(split, _T)
    preds = C.score_latest(ft, models)
    scored, _ = IF.fit_predict(ft, **FOREST)
    flag = RP.latest_row(scored).select("ticker", (F.col("anomaly") == -1).alias("anomaly_flag"))
    rec = RP.analysis_record(ft, preds, flag, fundamentals(spark, sf_dir))
    return rec.select("ticker", "direction_prediction", "confidence", "anomaly_flag", "sentiment_score",
                      "signals.*", F.col("fundamentals.market_cap").alias("market_cap"), "model_used")


# ------------------------------------------------------------------ calendar, summary, metadata
from barlake.operators.cleaning import sparse_summary  # noqa: E402
from barlake.operators.quality import missing_days, run_metadata  # noqa: E402
from barlake.sources.bars import bars_from_events  # noqa: E402


@register("missing_days", sql_project(sq.missing_days_sql("l_returnflag"), [("ticker", "string"), ("date", "date")]))
def q_missing_days(spark, sf_dir):
    """Each missing trading day as a row (calendar left_anti bars)."""
    return spark_project(missing_days(bars_from_lineitem(spark, sf_dir, "l_returnflag")),
                         [("ticker", "string"), ("date", "date")])


SUMMARY_SPEC = [("ticker", "string"), ("status", "string"), ("cleaned_rows", "long"), ("feature_rows", "long")]


@register("job_summary", sql_project(sq.job_summary_sql(), SUMMARY_SPEC))
def q_job_summary(spark, sf_dir):
    """OK / DROPPED / FAILED per requested ticker with cleaned and feature row counts.

    Requested tickers are every line status and return flag; both bar families
    come from one lineitem scan and one aggregate, and one ticker exchange
    serves all five."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    requested = li.select(F.explode(F.array("l_returnflag", "l_linestatus")).alias("ticker")).distinct()
    bars = bars_from_lineitem(spark, sf_dir, ["l_returnflag", "l_linestatus"])
    rep = clean_report(bars)
    counts = feature_table(bars).groupBy("ticker").agg(F.count(F.lit(1)).alias("feature_rows"))
    out = sparse_summary(rep, requested).join(counts, "ticker", "left").withColumn(
        "feature_rows", F.coalesce("feature_rows", F.lit(0)))
    return spark_project(out, SUMMARY_SPEC)


META_COLS = ["Open", "High", "Low", "Close", "Adj Close", "Volume", "log_return", "volume_normalised"]
META_SPEC = [("ticker", "string"), ("row_count", "long"), ("columns", "string")] + [
    (f"nulls_{c}", "long") for c in META_COLS] + [("validation_issues", "string")]


@register("run_metadata", sql_project(sq.run_metadata_sql("l_linestatus"), META_SPEC))
def q_run_metadata(spark, sf_dir):
    """Run metadata of the preprocessed table (row count, columns, null counts,
    validation issues), flattened for comparison."""
    bars = bars_from_lineitem(spark, sf_dir, "l_linestatus")
    meta = run_metadata(preprocessed_bars(bars), validate(bars), "1995-01-01", "2002-01-01")
    out = meta.select("ticker", "row_count", F.array_join("columns", ",").alias("columns"),
                      *[F.col("null_counts")[c].alias(f"nulls_{c}") for c in META_COLS],
                      F.array_join("validation_issues", " | ").alias("validation_issues"))
    return spark_project(out, META_SPEC)


HOURLY_SPEC = [("ticker", "string"), ("bucket", "string"), ("Open", "double"), ("High", "double"),
               ("Low", "double"), ("Close", "double"), ("Adj Close", "double"), ("Volume", "double")]


@register("bars_hourly", sql_project(
    sq.hourly_bars_sql().replace("date_trunc('hour', ts) AS bucket",
                                 "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') AS bucket"),
    HOURLY_SPEC))
def q_bars_hourly(spark, sf_dir):
    """Hourly bar variant from events (first / last by (ts, event_id), count as volume)."""
    b = bars_from_events(spark, sf_dir).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:00:00"))
    return spark_project(b, HOURLY_SPEC)


# ------------------------------------------------------------------ blocked layout
from dataclasses import replace as _replace  # noqa: E402

from barlake.config import LayoutConfig  # noqa: E402

# Small blocks so the fixture's ~1,785-row series really spans several blocks
# (the halo of ~730 rows then reaches over more than one block).
BLOCKED = _replace(DEFAULT, layout=LayoutConfig(block_rows=512))


@register("features_blocked", sql_project(sq.features_sql("l_returnflag"), FEATURES_SPEC))
def q_features_blocked(spark, sf_dir):
    """D4 in the blocked layout: every ticker cut into 512-row blocks with halos, so
    one hot ticker spreads over many tasks; same result as ``features``."""
    return spark_project(feature_table(bars_from_lineitem(spark, sf_dir, "l_returnflag"), BLOCKED), FEATURES_SPEC)


# ------------------------------------------------------------------ streaming ingest
from barlake.streaming import prediction_stream as PS  # noqa: E402

INGEST_SPEC = [("timestamp", "string"), ("ticker", "string"), ("prediction", "int"),
               ("confidence", "double"), ("latency_ms", "double")]


@register("log_stream_ingest", sql_project(sq.prediction_log_sql(), INGEST_SPEC))
def q_log_stream_ingest(spark, sf_dir):
    """P1 + K4 + S6: the events-derived prediction log is appended as JSON lines under the
    shared checkpoint folder, then a file stream (availableNow, with its own checkpoint)
    ingests every record exactly once into a parquet table, which is returned."""
    base = f"{checkpoint_dir(spark)}/log-ingest-{uuid.uuid4().hex}"
    log = prediction_log(spark, sf_dir).drop("event_id")
    log.write.mode("append").json(f"{base}/logs")
    PS.ingest(spark, f"{base}/logs", f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return spark_project(spark.read.parquet(f"{base}/table"), INGEST_SPEC)


@register("clean_report_blocked", sql_project(sq.clean_report_sql("l_returnflag"), CLEAN_REPORT_SPEC))
def q_clean_report_blocked(spark, sf_dir):
    """G2/G3/G4/F11 in the blocked layout: calendar positions in 512-row blocks,
    missing share and exact volume cap from per-ticker aggregates."""
    from barlake.plans.blocked import clean_blocked_with_report

    bars = bars_from_lineitem(spark, sf_dir, "l_returnflag")
    return spark_project(clean_blocked_with_report(bars, BLOCKED, 512)[1], CLEAN_REPORT_SPEC)


# queries of sources, sinks, requests and reports
from barlake.plans import catalog_io, catalog_polarity, catalog_streams  # noqa: E402, F401
