"""Declared schemas and column lists shared by every transform."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: bar column names as the vendor delivers them
PRICE_COLS = ["Open", "High", "Low", "Close", "Adj Close"]
VALUE_COLS = PRICE_COLS + ["Volume"]

BARS = T.StructType(
    [T.StructField("ticker", T.StringType(), False), T.StructField("date", T.DateType(), False)]
    + [T.StructField(c, T.DoubleType(), True) for c in VALUE_COLS]
)

# fixed values: columns kept out of the model input, in the reference order
EXCLUDE_FROM_MODEL = [
    "Open", "High", "Low", "Close", "Adj Close", "Volume",
    "target_direction", "ticker", "log_return",
]

# Bookkeeping columns of ours that are never model inputs either.
INTERNAL_COLS = {"date", "run_date", "split", "anomaly", "anomaly_score"}


def model_columns(columns: list[str]) -> list[str]:
    """Feature selection by exclude list (F4), keeping table order."""
    return [c for c in columns if c not in EXCLUDE_FROM_MODEL and c not in INTERNAL_COLS]


PREDICTION_LOG = T.StructType([
    T.StructField("timestamp", T.StringType(), True),
    T.StructField("ticker", T.StringType(), True),
    T.StructField("features", T.MapType(T.StringType(), T.DoubleType()), True),
    T.StructField("prediction", T.IntegerType(), True),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("latency_ms", T.DoubleType(), True),
])

NEWS = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("news", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType(), True),
        T.StructField("content", T.StructType([T.StructField("title", T.StringType(), True)]), True),
    ])), True),
])

LEXICON = T.StructType([
    T.StructField("token", T.StringType(), False),
    T.StructField("valence", T.DoubleType(), False),
])

FUNDAMENTAL_FIELDS = [
    "trailingPE", "trailingEps", "marketCap", "profitMargins", "revenueGrowth",
    "fiftyTwoWeekHigh", "fiftyTwoWeekLow", "averageVolume", "regularMarketPrice",
]
FUNDAMENTALS = T.StructType(
    [T.StructField("ticker", T.StringType(), False)]
    + [T.StructField(c, T.DoubleType(), True) for c in FUNDAMENTAL_FIELDS]
)

SCORED = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("date", T.DateType(), True),
    T.StructField("label", T.IntegerType(), True),
    T.StructField("prediction", T.IntegerType(), True),
    T.StructField("score", T.DoubleType(), True),
])

ANALYZE_REQUEST = T.StructType([
    T.StructField("ticker", T.StringType(), True),
    T.StructField("start_date", T.StringType(), True),
    T.StructField("end_date", T.StringType(), True),
])
