"""Technical indicators (W3-W13) and the feature table.

All windows share ``partitionBy(ticker).orderBy(date)`` (or, in the blocked
layout, ``partitionBy(ticker, block)`` ordered by a global row index): Catalyst
groups them into a few Window nodes over the one exchange. Spark evaluates a
repeated window expression once per occurrence, so the feature stage is
staged: offset windows (lag / lead) first, then each distinct rolling
aggregate once as a column (``RollingSet``), then plain arithmetic on those
columns. The EMAs share one position column and, when their spans allow, one
block size. The feature stage runs on the preprocessed table, whose warm-up
drop must happen first, so preprocess and features stay two passes (a filter
between them, no exchange).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.config import FeatureConfig
from barlake.functions.numeric import fdiv
from barlake.functions.windows import RollingSet, rolling_mean, rolling_std, series
from barlake.operators.ema import add_emas


def _c(name: str):
    return F.col(f"`{name}`")


# ---------------------------------------------------------------- expressions

def lag_exprs(lags=(1, 3, 5), src: str = "log_return", key="ticker", order: str = "date") -> dict[str, Column]:
    w = series(key, order)
    return {f"return_lag_{k}d": F.lag(F.col(src), k).over(w) for k in lags}


# ---------------------------------------------------------------- transforms

def add_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9,
             price: str = "Close", key="ticker", order: str = "date", index: str | None = None) -> DataFrame:
    at = {"key": key, "order": order, "index": index}
    df = add_emas(df, [("_ema_fast", _c(price), fast), ("_ema_slow", _c(price), slow)], **at)
    df = df.withColumn("macd", F.col("_ema_fast") - F.col("_ema_slow")).drop("_ema_fast", "_ema_slow")
    df = add_emas(df, [("macd_signal", F.col("macd"), signal)], **at)
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))


def add_sentiment(df: DataFrame, sentiment: DataFrame | None, neutral: float = 0.0) -> DataFrame:
    """One snapshot score per ticker on every row (J3); neutral when absent.

    No broadcast hint: the feature side is already hash-partitioned by ticker,
    so the join only shuffles the (one row per ticker) score table, and AQE
    turns it into a broadcast at run time when that table is measured small.
    """
    if sentiment is None:
        return df.withColumn("sentiment_score", F.lit(float(neutral)))
    scores = sentiment.select("ticker", F.col("sentiment_score").alias("_sent"))
    cols = [c for c in df.columns if c != "sentiment_score"]
    return (df.join(scores, "ticker", "left")
            .select(*[F.col(f"`{c}`") for c in cols],
                    F.coalesce(F.col("_sent"), F.lit(float(neutral))).alias("sentiment_score")))


# fixed values: output names of the feature table, in order
FEATURE_ORDER = ["rsi", "macd", "macd_signal", "macd_histogram", "bb_upper", "bb_middle", "bb_lower",
                 "bb_position", "volatility", "volume_ratio", "sentiment_score", "lags",
                 "target_direction", "price_change_pct"]


def feature_names(cfg: FeatureConfig = FeatureConfig()) -> list[str]:
    names = []
    for f in FEATURE_ORDER:
        if f == "rsi":
            names.append(f"rsi_{cfg.rsi_period}")
        elif f == "volatility":
            names.append(f"volatility_{cfg.volatility_window}d")
        elif f == "lags":
            names += [f"return_lag_{k}d" for k in cfg.lag_periods]
        else:
            names.append(f)
    return names


def _staged_indicators(df: DataFrame, cfg: FeatureConfig, with_series_features: bool = True,
                       key="ticker", order: str = "date") -> DataFrame:
    """RSI, Bollinger, volatility, volume ratio, lags, target and price change in
    three projections: offset windows, then each distinct rolling aggregate once,
    then plain arithmetic on those columns (no window expression is repeated)."""
    # X5 keep-where-else gain / loss, X6 zero mean loss -> RSI 0, X2 abs, X25 bool -> int
    w = series(key, order)
    offsets = {"_prev": F.lag(_c("Close"), 1).over(w)}
    if with_series_features:
        offsets["_next"] = F.lead(_c("Close"), 1).over(w)
        offsets.update(lag_exprs(cfg.lag_periods, key=key, order=order))
    df = df.withColumns(offsets)
    delta = _c("Close") - F.col("_prev")
    rs = RollingSet(key, order)
    ag = rs.get("gain", "avg", F.when(delta > 0, delta).otherwise(F.lit(0.0)), cfg.rsi_period)
    al = rs.get("loss", "avg", F.when(delta < 0, -delta).otherwise(F.lit(0.0)), cfg.rsi_period)
    sma = rs.get("close", "avg", _c("Close"), cfg.bollinger_window)
    std = rs.get("close", "std", _c("Close"), cfg.bollinger_window)
    derived = {f"rsi_{cfg.rsi_period}": F.when(al == 0, F.lit(0.0)).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + ag / al))}
    upper = sma + F.lit(cfg.bollinger_std) * std
    lower = sma - F.lit(cfg.bollinger_std) * std
    derived.update({"bb_upper": upper, "bb_middle": sma, "bb_lower": lower})
    if with_series_features:
        vol = rs.get("logret", "std", F.col("log_return"), cfg.volatility_window)
        vmean = rs.get("volume", "avg", _c("Volume"), cfg.volume_ratio_window)
        derived.update({
            f"volatility_{cfg.volatility_window}d": vol,
            "volume_ratio": fdiv(_c("Volume"), vmean),
            "target_direction": F.coalesce(F.col("_next") > _c("Close"), F.lit(False)).cast("int"),
            "price_change_pct": F.abs(fdiv(_c("Close"), F.col("_prev")) - F.lit(1.0)),
        })
    df = df.withColumns(rs.columns()).withColumns(derived)
    if with_series_features:
        df = df.withColumn("bb_position", fdiv(_c("Close") - F.col("bb_lower"),
                                               F.col("bb_upper") - F.col("bb_lower")))
    return df.drop("_prev", "_next", *rs.names())


def engineer_features(pre: DataFrame, cfg: FeatureConfig = FeatureConfig(),
                      sentiment: DataFrame | None = None, key="ticker", order: str = "date",
                      index: str | None = None) -> DataFrame:
    """Feature table: preprocessed bars + 15 features + target, warm-up rows dropped.

    ``key`` / ``order`` / ``index`` let the blocked layout run the same windows
    inside ``(ticker, block)`` partitions with a global per-ticker row index.
    """
    base = list(pre.columns)
    # one per-ticker position shared by all three EMAs (and one block size when the spans allow)
    pos = index or "_pos"
    df = pre if index else pre.withColumn(pos, F.row_number().over(series(key, order)) - 1)
    df = add_emas(df, [("_ema_fast", _c("Close"), cfg.macd_fast), ("_ema_slow", _c("Close"), cfg.macd_slow)],
                  key=key, order=order, index=pos)
    df = df.withColumn("macd", F.col("_ema_fast") - F.col("_ema_slow"))
    df = add_emas(df, [("macd_signal", F.col("macd"), cfg.macd_signal)], key=key, order=order, index=pos)
    df = df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal"))
    df = _staged_indicators(df, cfg, key=key, order=order)
    df = add_sentiment(df, sentiment, cfg.sentiment_neutral_fill)
    out = base + [c for c in feature_names(cfg) if c not in base]
    data_cols = [c for c in out if not c.startswith("_")]
    return df.select(*[F.col(f"`{c}`") for c in out]).na.drop(how="any", subset=data_cols)


def display_indicators(bars: DataFrame, cfg: FeatureConfig = FeatureConfig(), key="ticker",
                       order: str = "date", index: str | None = None) -> DataFrame:
    """Display set (W20): RSI, MACD and Bollinger on uncleaned history, nothing dropped.

    Adds candle colour, histogram sign (missing as 0) and RSI zone (X10, X11).
    """
    df = add_macd(bars, cfg.macd_fast, cfg.macd_slow, cfg.macd_signal, key=key, order=order, index=index)
    df = _staged_indicators(df, cfg, with_series_features=False, key=key, order=order)
    rsi = F.col(f"rsi_{cfg.rsi_period}")
    return df.withColumns({
        "is_up": _c("Close") >= _c("Open"),
        "hist_pos": F.coalesce(F.col("macd_histogram"), F.lit(0.0)) >= 0,
        "rsi_zone": F.when(rsi > 70, "overbought").when(rsi < 30, "oversold").otherwise("neutral"),
    })
