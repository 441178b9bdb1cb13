"""Per-ticker analysis tables.

Latest / last-N rows use ``row_number() <= k`` filters, which Spark runs as a
window group limit: each task keeps k rows per ticker before the shuffle, so
a hot ticker ships k rows, not its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlake.functions.numeric import fdiv

NA = "N/A"


def top_k(df: DataFrame, k: int, key: str = "ticker", order: str = "date") -> DataFrame:
    """Newest k rows per ticker (W16), ``rn`` = 1 for the newest."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def latest_row(df: DataFrame, key: str = "ticker", order: str = "date") -> DataFrame:
    return top_k(df, 1, key, order).drop("rn")


def latest_vs_previous(df: DataFrame, price: str = "Close", key: str = "ticker",
                       order: str = "date") -> DataFrame:
    """Latest close, previous close (= latest with one row), change and change %."""
    last2 = top_k(df.select(key, order, F.col(f"`{price}`").alias("_p")), 2, key, order)
    agg = last2.groupBy(key).agg(
        F.max(F.when(F.col("rn") == 1, F.col(order))).alias("date"),
        F.max(F.when(F.col("rn") == 1, F.col("_p"))).alias("latest_close"),
        F.max(F.when(F.col("rn") == 2, F.col("_p"))).alias("_prev"),
    )
    prev = F.coalesce(F.col("_prev"), F.col("latest_close"))
    change = F.col("latest_close") - prev
    return agg.select(key, "date", "latest_close", prev.alias("previous_close"), change.alias("change"),
                      (fdiv(change, prev) * 100).alias("change_pct"))


def bollinger_label(pos: Column) -> Column:
    """> 0.8 upper, < 0.2 lower, else middle; a missing position counts as 0.5."""
    p = F.coalesce(pos, F.lit(0.5))
    return F.when(p > 0.8, "upper").when(p < 0.2, "lower").otherwise("middle")


def direction(pred: Column) -> Column:
    """UP / DOWN."""
    return F.when(pred == 1, "UP").otherwise("DOWN")


def signals(features: DataFrame, rsi_col: str = "rsi_14", vol_col: str = "volatility_20d") -> DataFrame:
    """Technical signals of each ticker's latest feature row."""
    last = latest_row(features)
    return last.select(
        "ticker", "date",
        F.struct(
            F.round(F.coalesce(F.col(rsi_col), F.lit(0.0)), 2).alias("rsi_14"),
            F.round(F.coalesce(F.col("macd"), F.lit(0.0)), 4).alias("macd"),
            F.round(F.coalesce(F.col("macd_signal"), F.lit(0.0)), 4).alias("macd_signal"),
            bollinger_label(F.col("bb_position")).alias("bollinger_position"),
            F.round(F.coalesce(F.col("volume_ratio"), F.lit(1.0)), 4).alias("volume_ratio"),
            F.round(F.coalesce(F.col(vol_col), F.lit(0.0)), 6).alias("volatility_20d"),
        ).alias("signals"),
        F.round(F.coalesce(F.col("sentiment_score"), F.lit(0.0)), 4).alias("sentiment_score"),
    )


def _fmt(pattern: str, v: Column, places: int) -> Column:
    # half-to-even at the printed place (as Python's format), applied by bround to the
    # double's shortest decimal form; Java's formatter then prints the digits as they are
    return F.format_string(pattern, F.bround(v, places))


def market_cap_text(mc: Column) -> Column:
    """>= 1e12 $x.xxT, >= 1e9 $x.xxB, other non-zero $xM, null / 0 N/A."""
    return (F.when(mc.isNull() | (mc == 0), F.lit(NA))
            .when(mc >= 1e12, _fmt("$%.2fT", mc / 1e12, 2))
            .when(mc >= 1e9, _fmt("$%.2fB", mc / 1e9, 2))
            .otherwise(_fmt("$%.0fM", mc / 1e6, 0)))


def fundamentals_record(info: DataFrame) -> DataFrame:
    """API fundamentals per ticker; ``found`` is false when the price is missing."""
    return info.select(
        "ticker",
        F.col("regularMarketPrice").isNotNull().alias("found"),
        F.struct(
            F.col("trailingPE").alias("pe_ratio"), F.col("trailingEps").alias("eps"),
            market_cap_text(F.col("marketCap")).alias("market_cap"),
            F.col("profitMargins").alias("profit_margin"), F.col("revenueGrowth").alias("revenue_growth"),
            F.col("fiftyTwoWeekHigh").alias("fifty_two_week_high"),
            F.col("fiftyTwoWeekLow").alias("fifty_two_week_low"),
        ).alias("fundamentals"),
    )


def dashboard_text(info: DataFrame) -> DataFrame:
    """Dashboard number texts (X13): cap without the N/A-for-zero case, margins in %,
    average volume in millions, other numbers with 2 places, missing N/A."""
    def txt(c: Column, kind: str) -> Column:
        if kind == "cap":
            s = (F.when(c >= 1e12, _fmt("$%.2fT", c / 1e12, 2))
                 .when(c >= 1e9, _fmt("$%.2fB", c / 1e9, 2)).otherwise(_fmt("$%.0fM", c / 1e6, 0)))
        elif kind == "pct":
            s = _fmt("%.1f%%", c * 100, 1)
        elif kind == "vol":
            s = _fmt("%.1fM", c / 1e6, 1)
        else:
            s = _fmt("%.2f", c, 2)
        return F.when(c.isNull(), F.lit(NA)).otherwise(s)

    return info.select(
        "ticker",
        txt(F.col("trailingPE"), "num").alias("pe_ratio"), txt(F.col("trailingEps"), "num").alias("eps"),
        txt(F.col("marketCap"), "cap").alias("market_cap"),
        txt(F.col("profitMargins"), "pct").alias("profit_margin"),
        txt(F.col("revenueGrowth"), "pct").alias("revenue_growth"),
        txt(F.col("fiftyTwoWeekHigh"), "num").alias("high_52w"),
        txt(F.col("fiftyTwoWeekLow"), "num").alias("low_52w"),
        txt(F.col("averageVolume"), "vol").alias("avg_volume"),
    )


def log_kpis(log: DataFrame) -> DataFrame:
    """Requests, UP share % and mean confidence % of the prediction log."""
    return log.agg(
        F.count(F.lit(1)).alias("total_requests"),
        (F.avg(F.col("prediction").cast("double")) * 100).alias("up_pct"),
        (F.avg("confidence") * 100).alias("avg_confidence_pct"),
    )


def prediction_histogram(log: DataFrame, min_rows: int = 5) -> DataFrame:
    """Counts per predicted class, only when the log has more than 5 rows."""
    n = log.select(F.count(F.lit(1))).scalar()
    return (log.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
            .where(n > min_rows))


def anomalies_top(scored: DataFrame, k: int = 20, key: str = "ticker", order: str = "date") -> DataFrame:
    """Per ticker the newest k anomalies (flag -1), newest first, with the total count."""
    flagged = scored.where(F.col("anomaly") == -1)
    total = flagged.groupBy(key).agg(F.count(F.lit(1)).alias("total_anomalies"))
    top = top_k(flagged, k, key, order).select(
        key, "rn", F.col(order).cast("string").alias("date"),
        F.round(F.coalesce(F.col("Close"), F.lit(0.0)), 2).alias("close_price"),
        F.coalesce(F.col("Volume"), F.lit(0.0)).alias("volume"),
        F.round(F.coalesce(F.col("volume_ratio"), F.lit(0.0)), 4).alias("volume_ratio"),
        F.round(F.coalesce(F.col("price_change_pct"), F.lit(0.0)), 6).alias("price_change_pct"),
    )
    return top.join(total, key)


def analysis_record(features: DataFrame, predictions: DataFrame, anomaly: DataFrame | None = None,
                    info: DataFrame | None = None, model_name: str | None = None) -> DataFrame:
    """Analysis row per ticker (J7): latest features, direction + confidence, anomaly
    flag, signals, fundamentals (null when absent), sentiment, model, date.

    predictions: (ticker, prediction, confidence[, model]) for the latest row.
    """
    sig = signals(features)
    out = sig.join(predictions, "ticker", "left")
    if anomaly is not None:
        out = out.join(anomaly.select("ticker", "anomaly_flag"), "ticker", "left")
    else:
        out = out.withColumn("anomaly_flag", F.lit(False))
    if info is not None:
        out = out.join(fundamentals_record(info).select("ticker", "fundamentals"), "ticker", "left")
    else:
        out = out.withColumn("fundamentals", F.lit(None).cast(
            "struct<pe_ratio:double,eps:double,market_cap:string,profit_margin:double,revenue_growth:double,"
            "fifty_two_week_high:double,fifty_two_week_low:double>"))
    model = F.col("model") if "model" in predictions.columns else F.lit(model_name)
    return out.select(
        "ticker", direction(F.col("prediction")).alias("direction_prediction"),
        F.round("confidence", 4).alias("confidence"),
        F.coalesce(F.col("anomaly_flag"), F.lit(False)).alias("anomaly_flag"),
        "sentiment_score", "signals", "fundamentals", model.alias("model_used"),
        F.date_format(F.current_date(), "yyyy-MM-dd").alias("analysis_date"),
    )
