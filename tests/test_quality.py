import datetime as dt

from barlake.functions.calendar import weekdays_between
from barlake.operators.quality import profile, validate
from conftest import make_bars, weekdays

import pandas as pd
from pyspark.sql import functions as F


def test_weekdays_between_closed_form(spark):
    pairs = [(dt.date(2024, 1, 1) + dt.timedelta(days=a), dt.date(2024, 1, 1) + dt.timedelta(days=a + b))
             for a in range(8) for b in range(0, 30, 3)]
    df = spark.createDataFrame(pairs, "a date, b date").withColumn("n", weekdays_between(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r["n"] == len(pd.bdate_range(r["a"], r["b"]))


def test_bad_prices_report(spark):
    days = weekdays("2024-01-01", 10)
    rows = [
        ("BAD", days[0], None, 11.0, 9.0, 10.0, 10.0, 100.0),
        ("BAD", days[1], -1.0, 11.0, 9.0, 10.0, 4.0, 100.0),     # negative open, Adj/Close 0.4
        ("BAD", days[2], 10.0, 11.0, 9.0, 10.0, 16.0, 0.0),      # ratio 1.6, zero volume
        ("BAD", days[3], 10.0, 11.0, 9.0, 0.0, 5.0, 100.0),      # Close 0 -> +Inf ratio
        ("BAD", days[4], 10.0, 11.0, 9.0, 0.0, 0.0, 100.0),      # 0/0 ignored
        ("BAD", days[6], 10.0, 11.0, 9.0, 10.0, 10.0, 100.0),    # days[5] missing
    ]
    r = validate(make_bars(spark, rows)).first()
    assert r["rows"] == 6
    assert r["issues"] == [
        "1 missing trading day(s) found",
        "Open has 1 null(s)",
        "Open has 1 negative value(s)",
        "Volume is zero on 1 trading day(s)",
        "Adj Close / Close ratio is extreme on 3 day(s) — possible bad split adjustment",
    ]


def test_profile(spark):
    days = weekdays("2024-01-01", 3)
    rows = [("P", d, 1.0, None, 1.0, 1.0, 1.0, 1.0) for d in days]
    p = profile(make_bars(spark, rows)).first()
    assert p["row_count"] == 3 and p["null_counts"]["High"] == 3 and p["dtypes"]["Close"] == "float64"
