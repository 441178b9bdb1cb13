"""Blocked layout equals the per-ticker layout (rows and rounded values)."""
from dataclasses import replace

import numpy as np

from barlake.config import DEFAULT, LayoutConfig
from barlake.operators.cleaning import clean_with_report, preprocess
from barlake.operators.indicators import engineer_features
from barlake.plans.blocked import copies, feature_halo, position_date
from barlake.plans.pipeline import feature_table
from barlake.plans.projection import features_spec, spark_project
from barlake.sources.bars import bars_from_lineitem
from conftest import SF001, make_bars, weekdays

from pyspark.sql import functions as F


def blocked(rows):
    return replace(DEFAULT, layout=LayoutConfig(block_rows=rows))


def whole_tickers(bars):
    """The same operators in windows over whole tickers."""
    return engineer_features(preprocess(clean_with_report(bars)[0]))


def same(a, b):
    return a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_copies_and_positions(spark):
    df = spark.range(0, 12).select(F.col("id").alias("i"))
    got = {r["i"]: sorted((c["b"], c["own"]) for c in r["c"])
           for r in df.select("i", copies(F.col("i"), 4, 5, 1).alias("c")).collect()}
    assert got[0] == [(0, True), (1, False)]
    assert got[3] == [(0, True), (1, False), (2, False)]
    assert got[4] == [(0, False), (1, True), (2, False)]
    d = spark.createDataFrame([(p,) for p in range(15)], "p int").select(
        position_date(F.to_date(F.lit("2024-01-03")), F.col("p")).alias("d")).collect()
    assert [r["d"] for r in d] == weekdays("2024-01-03", 15)
    assert feature_halo() > 26


def test_blocked_equals_per_ticker_on_fixture(spark):
    bars = bars_from_lineitem(spark, SF001, "l_linestatus")
    spec = features_spec(DEFAULT)
    a = spark_project(whole_tickers(bars), spec)
    b = spark_project(feature_table(bars, blocked(97)), spec)
    assert same(a, b)


def test_blocked_hot_ticker_with_gaps(spark):
    rng = np.random.default_rng(11)
    days = weekdays("2000-01-03", 1500)
    rows = []
    for i, d in enumerate(days):                       # hot ticker: long series, a few gaps
        if i % 97 in (5, 6, 7) or i % 211 == 3:
            continue
        c = float(50 + 10 * np.sin(i / 30) + rng.normal())
        rows.append(("HOT", d, c, c + 1, c - 1, c, c * 0.99, float(rng.integers(100, 1000))))
    for i, d in enumerate(days[:120]):                 # small ticker
        c = float(20 + rng.normal())
        rows.append(("SML", d, c, c + 1, c - 1, c, c, 100.0 + i))
    bars = make_bars(spark, rows)
    spec = features_spec(DEFAULT)
    assert same(spark_project(whole_tickers(bars), spec), spark_project(feature_table(bars, blocked(256)), spec))


def test_build_job_does_not_depend_on_block_rows(spark, tmp_path):
    from barlake.plans import jobs
    from barlake.sources.tables import load_feature_data

    bars = bars_from_lineitem(spark, SF001, "l_linestatus")
    spec = features_spec(DEFAULT)
    jobs.build(bars, str(tmp_path / "a"), "1995-01-01", "2002-01-01")
    jobs.build(bars, str(tmp_path / "b"), "1995-01-01", "2002-01-01", blocked(300))
    a = spark_project(load_feature_data(spark, str(tmp_path / "a/features")), spec)
    b = spark_project(load_feature_data(spark, str(tmp_path / "b/features")), spec)
    assert a.count() == 3395 and same(a, b)


def test_blocked_clean_report_equals_per_ticker(spark):
    from barlake.plans.blocked import clean_blocked_with_report

    for key in ("l_linestatus", "l_returnflag"):      # kept tickers and dropped tickers
        bars = bars_from_lineitem(spark, SF001, key)
        spec = [("ticker", "string"), ("missing_pct", "double"), ("kept", "bool"), ("volume_cap", "double"),
                ("n_capped", "long"), ("cleaned_rows", "long")]
        a = spark_project(clean_with_report(bars)[1], spec)
        b = spark_project(clean_blocked_with_report(bars, DEFAULT, 200)[1], spec)
        assert same(a, b)



def test_display_indicators_in_blocks(spark):
    from barlake.operators.indicators import display_indicators
    from barlake.plans.blocked import display_indicators_blocked

    bars = bars_from_lineitem(spark, SF001, "l_linestatus")
    pick = lambda df: df.select("ticker", "date", "is_up", "hist_pos", "rsi_zone",
                                *[F.round(c, 5).alias(c) for c in ("rsi_14", "macd", "macd_signal", "bb_upper", "bb_lower")])
    assert same(pick(display_indicators(bars)), pick(display_indicators_blocked(bars, blocked(150))))
