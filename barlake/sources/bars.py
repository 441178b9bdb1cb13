"""Bar sources (S1, S2, S7) and the documented fixture bars built from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.functions.numeric import nan_to_null
from barlake.schemas import BARS, VALUE_COLS


def normalise_bars(df: DataFrame) -> DataFrame:
    """Upper/trim the ticker, cast values to DOUBLE and NaN to NULL."""
    return df.select(
        F.upper(F.trim(F.col("ticker"))).alias("ticker"),
        F.col("date").cast("date").alias("date"),
        *[nan_to_null(F.col(f"`{c}`").cast("double")).alias(c) for c in VALUE_COLS],
    )


def read_bars(spark: SparkSession, path: str, fmt: str = "parquet",
              tickers: list[str] | None = None, start: str | None = None,
              end: str | None = None) -> DataFrame:
    """Bar scan for tickers over ``[start, end)`` (end exclusive, as the vendor call).

    The declared schema avoids inference; the ticker/date predicates reach the
    scan as pushed filters (and partition pruning when laid out by ticker).
    """
    reader = spark.read.schema(BARS)
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.format(fmt).load(path)
    if tickers is not None:
        df = df.where(F.col("ticker").isin([t.strip().upper() for t in tickers]))
    if start is not None:
        df = df.where(F.col("date") >= F.to_date(F.lit(start)))
    if end is not None:
        df = df.where(F.col("date") < F.to_date(F.lit(end)))
    return normalise_bars(df)


def fetch_status(requested: DataFrame, bars: DataFrame) -> DataFrame:
    """Per requested ticker: FAILED when the scan returned no rows (empty fetch is an error)."""
    present = bars.select("ticker").distinct()
    req = requested.select(F.upper(F.trim("ticker")).alias("ticker")).distinct()
    return (req.join(present.withColumn("_hit", F.lit(True)), "ticker", "left")
            .select("ticker", F.when(F.col("_hit"), "OK").otherwise("FAILED").alias("fetch_status")))


def wide_to_long(wide: DataFrame, date_col: str = "date") -> DataFrame:
    """Vendor layout fix (S2): columns ``<field>|<ticker>`` to one row per (ticker, date)."""
    value_cols = [c for c in wide.columns if c != date_col]
    stacked = wide.unpivot([date_col], value_cols, "field_ticker", "value")
    parts = F.split(F.col("field_ticker"), r"\|")
    longer = stacked.select(
        F.col(date_col).cast("date").alias("date"),
        parts.getItem(1).alias("ticker"),
        parts.getItem(0).alias("field"),
        F.col("value").cast("double").alias("value"),
    )
    return normalise_bars(
        longer.groupBy("ticker", "date").pivot("field", VALUE_COLS).agg(F.first("value"))
    )


def lookback(bars: DataFrame, period: str) -> DataFrame:
    """History by look-back period (S7): 6mo / 1y / 2y / 5y before each ticker's latest bar."""
    months = {"6mo": 6, "1y": 12, "2y": 24, "5y": 60}[period]
    # latest date per ticker is an aggregate (one row per ticker), joined back
    latest = bars.groupBy("ticker").agg(F.max("date").alias("_latest"))
    return (bars.join(latest, "ticker")
            .where(F.col("date") >= F.add_months(F.col("_latest"), -months))
            .drop("_latest"))


# ----------------------------------------------------------------------------
# Fixture bars from the driver tables (FIXTURES.md section 2)
# ----------------------------------------------------------------------------

def _line_key() -> Column:
    # Ordering key for Open/Close: price and discount inside so ties carry equal values.
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    "l_extendedprice", "l_discount")


def bars_from_lineitem(spark: SparkSession, sf_dir: str,
                       ticker_col: str | list[str] = "l_linestatus") -> DataFrame:
    """Daily bars: one ticker per value of ``ticker_col`` (a column or an expression), one bar per ship date.

    A partial (map-side) aggregate per (ticker, date) before the shuffle, so a
    ticker holding a third of all line items still ships one row per task and day.
    Several ticker columns are served by one scan: each line item is exploded
    into one row per ticker column before the aggregate.
    """
    cols = [ticker_col] if isinstance(ticker_col, str) else list(ticker_col)
    ticker = F.expr(cols[0]) if len(cols) == 1 else F.explode(F.array(*cols))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        ticker.alias("ticker"), F.to_date("l_shipdate").alias("date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_extendedprice", "l_discount", "l_quantity",
    )
    k = _line_key()
    agg = li.groupBy("ticker", "date").agg(
        F.min(k).alias("_first"),
        F.max(k).alias("_last"),
        F.max("l_extendedprice").alias("High"),
        F.min("l_extendedprice").alias("Low"),
        F.sum("l_quantity").alias("Volume"),
    )
    return agg.select(
        "ticker", "date",
        F.col("_first.l_extendedprice").alias("Open"),
        "High", "Low",
        F.col("_last.l_extendedprice").alias("Close"),
        (F.col("_last.l_extendedprice") * (1 - F.col("_last.l_discount"))).alias("Adj Close"),
        "Volume",
    )


def bars_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bar variant from ``events`` (shape test): ticker = upper(left(event_type, 5))."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.upper(F.substring("event_type", 1, 5)).alias("ticker"),
        F.date_trunc("hour", "ts").alias("bucket"), "ts", "event_id", "value",
    )
    k = F.struct("ts", "event_id")
    return ev.groupBy("ticker", "bucket").agg(
        F.min_by("value", k).alias("Open"), F.max("value").alias("High"),
        F.min("value").alias("Low"), F.max_by("value", k).alias("Close"),
        F.max_by("value", k).alias("Adj Close"), F.count("*").cast("double").alias("Volume"),
    )
