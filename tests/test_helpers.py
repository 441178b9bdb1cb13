"""Small helpers not covered elsewhere."""
import datetime as dt

from pyspark.sql import functions as F

from barlake.operators.classifiers import importances_table
from barlake.operators.sentiment import sentiment_label
from barlake.operators.split import random_split, time_split
from barlake.sinks.writers import append_training_runs
from barlake.sources.bars import bars_from_events, fetch_status
from barlake.sources.tables import with_parsed_time
from conftest import SF001, make_bars, weekdays


def test_fetch_status(spark):
    bars = make_bars(spark, [("AAA", d, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for d in weekdays("2024-01-01", 3)])
    req = spark.createDataFrame([(" aaa",), ("ZZZ",)], "ticker string")
    got = {r["ticker"]: r["fetch_status"] for r in fetch_status(req, bars).collect()}
    assert got == {"AAA": "OK", "ZZZ": "FAILED"}


def test_splits(spark):
    df = spark.createDataFrame([("T", dt.date(2024, 1, 1) + dt.timedelta(days=i), i % 2) for i in range(100)],
                               "ticker string, date date, target_direction int")
    ts = {r["split"]: r["count"] for r in time_split(df, 0.2).groupBy("split").count().collect()}
    assert ts == {"train": 80, "test": 20}
    last_train = time_split(df, 0.2).where("split = 'train'").agg(F.max("date")).first()[0]
    first_test = time_split(df, 0.2).where("split = 'test'").agg(F.min("date")).first()[0]
    assert last_train < first_test
    rs = random_split(df, 0.2, 42)
    assert rs.count() == 100 and set(r["split"] for r in rs.collect()) == {"train", "test"}
    assert rs.collect() == random_split(df, 0.2, 42).collect()        # deterministic


def test_training_runs_sink_and_importances(spark, tmp_path):
    runs = spark.createDataFrame([("RandomForest", 0.7, {"rsi_14": 0.4, "macd": 0.6})],
                                 "model string, f1 double, importances map<string,double>")
    append_training_runs(runs, str(tmp_path / "runs"))
    append_training_runs(runs, str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))
    assert stored.count() == 2 and "run_timestamp" in stored.columns
    imps = {r["feature"]: r["importance"] for r in importances_table(runs).collect()}
    assert imps == {"rsi_14": 0.4, "macd": 0.6}


def test_time_parse_label_and_hourly_bars(spark):
    log = spark.createDataFrame([("2024-01-02T03:04:05.123456",)], "timestamp string")
    assert with_parsed_time(log).first()["ts"] == dt.datetime(2024, 1, 2, 3, 4, 5, 123456)
    labels = spark.createDataFrame([(0.06,), (-0.06,), (0.05,)], "s double").select(
        sentiment_label(F.col("s")).alias("l")).collect()
    assert [r["l"] for r in labels] == ["positive", "negative", "neutral"]
    hourly = bars_from_events(spark, SF001)
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    assert hourly.agg(F.sum("Volume")).first()[0] == ev.count()
    assert hourly.where(F.col("High") < F.col("Low")).count() == 0


def test_ks_is_one_method_at_every_size():
    """Against a count of paths row by row, and without a step at 10,000 values."""
    import math

    from barlake.functions.ks import ks_pvalue

    def plain(n1, n2, h):
        n = [[0] * (n2 + 1) for _ in range(n1 + 1)]
        for i in range(n1 + 1):
            for j in range(n2 + 1):
                if abs(i * n2 - j * n1) < h:
                    n[i][j] = 1 if i == j == 0 else (n[i - 1][j] if i else 0) + (n[i][j - 1] if j else 0)
        return 1 - n[n1][n2] / math.comb(n1 + n2, n2)

    for n1, n2 in ((40, 30), (7, 7), (1, 5), (90, 30)):
        for h in range(1, n1 * n2 + 1, max(1, n1 * n2 // 17)):
            assert abs(ks_pvalue(n1, n2, h) - plain(n1, n2, h)) < 1e-10
    a, b = (ks_pvalue(n, 30, int(0.2 * n * 30)) for n in (10_000, 10_001))
    assert abs(a - b) < 2e-4 and ks_pvalue(1_000_000, 30, 6_000_000) > 0.15


def test_requests_bad_dates_and_ids(spark):
    from barlake.operators.requests import MSG_DATES, check_requests

    req = spark.createDataFrame([("aapl ", "2024-01-01", "2024-02-01"), ("AAPL", "2024-03-01", "2024-04-01"), ("X", "2020-13-45", "2024-01-01"),
                                 ("X", None, "2024-01-01"), ("TOOLONG", "2024-01-01", "2024-02-01"), ("X", "2024-02-01", "2024-02-01"),
                                 ("AAPL", "2024-03-01", "2024-04-01")], "ticker string, start_date string, end_date string")
    rows = check_requests(req).collect()
    assert len({r.request_id for r in rows}) == 7
    assert sum(r.valid for r in rows) == 3 and sum(r.reason == MSG_DATES for r in rows) == 2


def test_duplicate_dates_do_not_hide_gaps(spark):
    from barlake.operators.quality import missing_days, validate

    days = weekdays("2024-01-01", 10)
    rows = [("A", d, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for d in days if d != days[4]]
    bars = make_bars(spark, rows + rows[:3])
    r = validate(bars).first()
    assert r.missing_days == missing_days(bars).count() == 1 and r.rows == 12 and len(r.issues) == 1


def test_build_touches_only_its_own_tickers(spark, tmp_path):
    from barlake.plans import jobs
    from barlake.sources.tables import load_feature_data

    rng = __import__("random").Random(3)
    days = weekdays("2020-01-01", 260)

    def series(name, every):
        return [(name, d, c := 50 + rng.random(), c + 1, c - 1, c, c, 100.0 + rng.random() * 50) for i, d in enumerate(days) if i % every == 0]

    out = str(tmp_path / "store")
    feel = spark.createDataFrame([("BBB", 0.6), ("CCC", 0.6)], "ticker string, sentiment_score double")
    first = make_bars(spark, series("AAA", 1) + series("BBB", 1) + series("CCC", 1))
    jobs.build(first, out, "2020-01-01", "2021-01-01", sentiment=feel, run_date="2024-01-01")
    again = make_bars(spark, series("AAA", 1) + series("CCC", 9))
    summary = {r.ticker: r for r in jobs.build(again, out, "2020-01-01", "2021-01-01", run_date="2024-01-02").collect()}
    stored = load_feature_data(spark, f"{out}/features")
    assert stored.where("ticker = 'BBB'").select("sentiment_score").distinct().collect()[0][0] == 0.6
    assert summary["CCC"].status == "DROPPED" and summary["CCC"].feature_rows == 0 and summary["AAA"].feature_rows > 0
    asked = spark.createDataFrame([("aaa",)], "ticker string")
    for save in (False, True):
        got = jobs.features_for(spark, asked, f"{out}/features", again, save=save)
        assert [r.ticker for r in got.select("ticker").distinct().collect()] == ["AAA"]


def test_split_has_exact_shares_per_label(spark):
    from pyspark.sql import functions as F

    from barlake.operators.split import random_split, shares

    rows = [(f"T{i % 5}", i, None if i % 97 == 0 else i % 3 // 2) for i in range(3001)]
    df = spark.createDataFrame(rows, "ticker string, date int, target_direction int")
    out = random_split(df, 0.2, 7)
    got = {(r["target_direction"], r["split"]): r["count"] for r in out.groupBy("target_direction", "split").count().collect()}
    sizes = {k: sum(1 for r in rows if r[2] == k) for k in (None, 0, 1)}
    quota = shares(sizes, 0.2)
    assert sum(quota.values()) == 601 and all(abs(quota[k] - 0.2 * sizes[k]) <= 1 for k in sizes)
    assert {k: got[k, "test"] for k in sizes} == quota and out.count() == 3001
    again = random_split(df.repartition(7), 0.2, 7)
    assert out.exceptAll(again).count() == 0
    assert random_split(df.limit(0)).count() == 0
    whole = random_split(df, 0.5, 7, label=None)
    assert whole.where("split = 'test'").count() == 1501
