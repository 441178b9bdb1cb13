"""Series transforms: EMA, RSI, Bollinger, fill, calendar, warm-ups, target."""
import math

import numpy as np
from pyspark.sql import functions as F

from barlake.operators.cleaning import clean_with_report, densify, preprocess
from barlake.operators.ema import add_emas, block_size
from barlake.operators.indicators import display_indicators, engineer_features
from barlake.plans.pipeline import feature_table
from barlake.sources.bars import bars_from_lineitem
from conftest import SF001, make_bars, series_bars, weekdays


def ema_ref(x, span):
    a = 2.0 / (span + 1)
    y = np.empty(len(x))
    y[0] = x[0]
    for i in range(1, len(x)):
        y[i] = (1 - a) * y[i - 1] + a * x[i]
    return y


def test_ema_matches_recursion_across_blocks(spark):
    rng = np.random.default_rng(7)
    n = 2 * block_size(1 - 2 / 10) + 50          # span 9: three blocks, two carries
    x = np.cumsum(rng.normal(0, 1, n)) + 100
    rows = [("A", i, float(v)) for i, v in enumerate(x)] + [("B", i, float(-v)) for i, v in enumerate(x[:500])]
    df = spark.createDataFrame(rows, "ticker string, date int, x double")
    out = add_emas(df, [("e9", "x", 9), ("e26", "x", 26)]).orderBy("ticker", "date").toPandas()
    a = out[out.ticker == "A"]
    assert np.max(np.abs(a.e9.to_numpy() - ema_ref(x, 9))) < 1e-9
    assert np.max(np.abs(a.e26.to_numpy() - ema_ref(x, 26))) < 1e-9
    b = out[out.ticker == "B"]
    assert np.max(np.abs(b.e9.to_numpy() - ema_ref(-x[:500], 9))) < 1e-9


def test_rsi_flat_and_all_gain_are_zero(spark):
    flat = series_bars(spark, "FLAT", [10.0] * 60)
    gain = series_bars(spark, "GAIN", [10.0 + i for i in range(60)])
    df = display_indicators(flat.unionByName(gain)).withColumnRenamed("rsi_14", "rsi").orderBy("ticker", "date").toPandas()
    for t in ("FLAT", "GAIN"):
        r = df[df.ticker == t].rsi.to_numpy()
        assert all(v is None or (isinstance(v, float) and math.isnan(v)) for v in r[:13])
        assert np.allclose(r[13:].astype(float), 0.0)


def test_flat_series_has_no_features(spark):
    # band width 0 -> position 0/0 -> every row dropped
    flat = series_bars(spark, "FLAT", [10.0] * 60, volume=[100.0] * 60)
    assert feature_table(flat).count() == 0


def test_fill_limit_weekend_and_gap(spark):
    days = weekdays("2024-01-01", 80)
    keep = [d for i, d in enumerate(days) if i not in (40, 41, 42)]     # gap of three weekdays
    sat = days[10] + __import__("datetime").timedelta(days=(5 - days[10].weekday()))
    rows = [("GAP", d, 10.0 + i, 11.0 + i, 9.0 + i, 10.0 + i, 10.0 + i, 100.0 + i) for i, d in enumerate(keep)]
    rows.append(("GAP", sat, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0))
    bars = make_bars(spark, rows)
    dense = densify(bars).where(F.col("ticker") == "GAP")
    assert dense.where(F.weekday("date") >= 5).count() == 0
    assert dense.count() == 80
    cleaned, rep = clean_with_report(bars)
    assert cleaned.count() == 79          # two filled, the third missing row dropped
    r = rep.first()
    assert r["kept"] and abs(r["missing_pct"] - 1 / 80) < 1e-12


def test_sparse_ticker_dropped(spark):
    days = weekdays("2024-01-01", 100)
    keep = [d for i, d in enumerate(days) if not (20 <= i < 30 or 50 <= i < 60 or 70 <= i < 80)]
    rows = [("SPRS", d, 10.0, 11.0, 9.0, 10.0 + i % 3, 10.0, 100.0) for i, d in enumerate(keep)]
    cleaned, rep = clean_with_report(make_bars(spark, rows))
    assert cleaned.count() == 0
    assert rep.first()["kept"] is False


def test_short_series_warmups(spark):
    rng = np.random.default_rng(3)
    for n, expect in ((38, 0), (39, 1)):
        closes = list(100 + np.cumsum(rng.normal(0, 1, n)))
        bars = series_bars(spark, "S", closes)
        assert feature_table(bars).count() == expect


def test_last_row_target_zero_and_rows(spark):
    closes = [10.0 + i for i in range(80)]            # always rising
    ft = feature_table(series_bars(spark, "UP", closes)).orderBy("date").toPandas()
    assert len(ft) == 80 - 38
    assert ft.target_direction.iloc[-1] == 0
    assert (ft.target_direction.iloc[:-1] == 1).all()


def test_fixture_row_counts(spark):
    bars = bars_from_lineitem(spark, SF001, "l_linestatus")
    cleaned, _ = clean_with_report(bars)
    got = {r["ticker"]: r["count"] for r in cleaned.groupBy("ticker").count().collect()}
    assert got == {"F": 1729, "O": 1742}
    ft = engineer_features(preprocess(cleaned))
    got = {r["ticker"]: r["count"] for r in ft.groupBy("ticker").count().collect()}
    assert got == {"F": 1691, "O": 1704}


def test_band_position_property(spark):
    bars = bars_from_lineitem(spark, SF001, "l_linestatus")
    ft = feature_table(bars)
    inside = (F.col("Close") >= F.col("bb_lower")) & (F.col("Close") <= F.col("bb_upper"))
    pos_ok = (F.col("bb_position") >= 0) & (F.col("bb_position") <= 1)
    assert ft.where(inside != pos_ok).count() == 0
