"""Request tables: ticker normalisation and checks (F1-F3), cache misses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed value: ticker pattern
TICKER_PATTERN = "^[A-Z]{1,5}$"
MSG_TICKER = "ticker is not one to five letters A-Z"
MSG_DATES = "start_date and end_date must be dates like 2024-01-31"
MSG_END_FUTURE = "the range ends after today"
MSG_END_ORDER = "the range is empty: its end is not after its start"


def normalise_ticker(c: Column) -> Column:
    return F.upper(F.trim(c))


def check_requests(req: DataFrame, today: Column | None = None) -> DataFrame:
    """Per request: ``request_id``, normalised ticker, parsed dates, ``valid`` and ``reason``.

    Rules: ticker matches the pattern; both dates parse as yyyy-MM-dd (X18); end not after
    today; end after start. A missing or unreadable date is a reason, never an error. Without a
    ``request_id`` column the id is the request's own text plus its number among equal ones.
    """
    today = today if today is not None else F.current_date()
    t = normalise_ticker(F.col("ticker"))
    start = F.try_to_date(F.col("start_date"), "yyyy-MM-dd")
    end = F.try_to_date(F.col("end_date"), "yyyy-MM-dd")
    if "request_id" not in req.columns:
        same = ["ticker", "start_date", "end_date"]
        text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in same])
        number = F.row_number().over(Window.partitionBy(*same).orderBy(F.lit(0)))
        req = req.withColumn("request_id", F.concat_ws("#", text, number.cast("string")))
    reason = (F.when(~F.coalesce(t.rlike(TICKER_PATTERN), F.lit(False)), F.lit(MSG_TICKER))
              .when(start.isNull() | end.isNull(), F.lit(MSG_DATES))
              .when(end > today, F.lit(MSG_END_FUTURE))
              .when(end <= start, F.lit(MSG_END_ORDER)))
    return req.select("request_id", t.alias("ticker"), start.alias("start"), end.alias("end"), reason.alias("reason")) \
        .withColumn("valid", F.col("reason").isNull())


def missing_tickers(requested: DataFrame, existing: DataFrame) -> DataFrame:
    """Requested tickers without stored features (J6): ``left_anti`` on ticker."""
    req = requested.select(normalise_ticker(F.col("ticker")).alias("ticker")).distinct()
    return req.join(existing.select("ticker").distinct(), "ticker", "left_anti")
