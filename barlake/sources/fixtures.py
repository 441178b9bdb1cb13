"""Documented fixtures derived from the driver tables (FIXTURES.md section 2).

Everything here reads whole driver tables; global scalars (max, median) are
scalar subqueries, computed once by Spark and inlined, never a cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.operators.ecdf import exact_quantile

# fixed value: day zero for dates derived from ids in the fixtures
EPOCH = "2024-01-01"


def scored_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, label, prediction, score): label = quality, score = n_chars / max(n_chars).

    ticker = upper(lang) (four groups large enough for the fairness rule),
    date = EPOCH + doc_id days (an ordering key).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    joined = labels.join(docs, "doc_id")
    max_chars = joined.select(F.max("n_chars")).scalar()
    score = F.col("n_chars").cast("double") / max_chars.cast("double")
    return joined.select(
        F.upper("lang").alias("ticker"),
        F.date_add(F.to_date(F.lit(EPOCH)), F.col("doc_id").cast("int")).alias("date"),
        F.col("quality").cast("int").alias("label"),
        (score > 0.5).cast("int").alias("prediction"),
        score.alias("score"),
    )


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log rows from ``events``: prediction = value > median(value),
    confidence = value scaled into [0.5, 1], latency_ms = value."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    # exact median as a scalar subquery, computed over order buckets (no single-task merge)
    median = exact_quantile(ev.withColumn("_all", F.lit(0)), ["_all"], "value", 0.5).select("quantile").scalar()
    vmax = ev.select(F.max("value")).scalar()
    return ev.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.upper("event_type").alias("ticker"),
        F.create_map(F.lit("value"), F.col("value"),
                     F.lit("user_id"), F.col("user_id").cast("double")).alias("features"),
        (F.col("value") > median).cast("int").alias("prediction"),
        (F.lit(0.5) + F.lit(0.5) * F.col("value") / vmax).alias("confidence"),
        F.col("value").alias("latency_ms"),
        F.col("event_id"),
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, doc_id, title): ticker = upper of the first letter of lang (so French
    news lands on bar ticker F); the whole text is the headline."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return docs.select(F.upper(F.substring("lang", 1, 1)).alias("ticker"), "doc_id", F.col("text").alias("title"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fundamentals row per supplier: ticker from the key, figures scaled from s_acctbal.

    Market cap spans the M / B / T ranges by nation; every fifth key has no
    price (ticker not found) and every seventh a zero market cap. Scale divisors
    are coprime to 10, so no figure sits exactly on a decimal rounding tie (where
    engines print differently).
    """
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")
    letters = F.translate(F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), "0123456789", "ABCDEFGHIJ")
    scale = F.when(F.col("s_nationkey") % 3 == 0, F.lit(1e9)).when(F.col("s_nationkey") % 3 == 1, F.lit(1e6)).otherwise(F.lit(1e12))
    bal = F.col("s_acctbal")
    return s.select(
        letters.alias("ticker"),
        (bal / 97.0).alias("trailingPE"),
        (bal / 971.0).alias("trailingEps"),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit(0.0)).otherwise(F.abs(bal) * scale / 997.0).alias("marketCap"),
        (bal / 9973.0).alias("profitMargins"),
        (bal / 19997.0).alias("revenueGrowth"),
        (F.abs(bal) / 7.0 + 1).alias("fiftyTwoWeekHigh"),
        (F.abs(bal) / 13.0).alias("fiftyTwoWeekLow"),
        (F.abs(bal) * 997.0 / 3.0).alias("averageVolume"),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit(None).cast("double")).otherwise(F.abs(bal) / 17.0).alias("regularMarketPrice"),
    )
