import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlake.config import MonitorConfig
from barlake.functions.ks import ks_pvalue
from barlake.operators import drift as D
from barlake.operators import metrics as M


def brute_ks_p(n1, n2, h):
    total = outside = 0
    for ref_pos in itertools.combinations(range(n1 + n2), n1):
        s = set(ref_pos)
        i = j = 0
        worst = 0
        for k in range(n1 + n2):
            if k in s:
                i += 1
            else:
                j += 1
            worst = max(worst, abs(i * n2 - j * n1))
        total += 1
        outside += worst >= h
    return outside / total


@pytest.mark.parametrize("n1,n2", [(4, 6), (5, 5), (7, 4), (3, 8)])
def test_ks_pvalue_exact(n1, n2):
    for h in range(1, n1 * n2 + 1, max(1, n1 * n2 // 7)):
        assert abs(ks_pvalue(n1, n2, h) - brute_ks_p(n1, n2, h)) < 1e-12


def test_ks_statistic_ties_and_guard(spark):
    # ticker T: 40 rows; reference = first 28, recent = last 30 (overlapping)
    vals = [float(i % 5) for i in range(40)]
    rows = [("T", i, v, 1.0) for i, v in enumerate(vals)]
    df = spark.createDataFrame(rows, "ticker string, date int, x double, constant double")
    st = {r["feature"]: r for r in D.ks_statistics(df, MonitorConfig(), ["x", "constant"]).collect()}
    ref, rec = vals[:28], vals[10:]
    grid = sorted(set(vals))
    d = max(abs(sum(v <= g for v in ref) / 28 - sum(v <= g for v in rec) / 30) for g in grid)
    assert st["x"]["n_ref"] == 28 and st["x"]["n_rec"] == 30
    assert abs(st["x"]["ks_statistic"] - d) < 1e-12
    assert st["constant"]["ks_statistic"] == 0.0
    short = spark.createDataFrame([("S", i, float(i)) for i in range(9)], "ticker string, date int, x double")
    assert D.ks_statistics(short, MonitorConfig(), ["x"]).count() == 0


def test_prediction_drift_guard(spark):
    for n, checked in ((19, False), (20, True)):
        rows = [(f"2024-01-01T00:00:{i:02d}", "AAA", int(i >= n - 6), 0.9) for i in range(n)]
        log = spark.createDataFrame(rows, "timestamp string, ticker string, prediction int, confidence double")
        r = D.prediction_drift(log, MonitorConfig()).first()
        assert (r["shift"] is not None) == checked
        if checked:
            k = min(30, n // 3)
            rec = sum(int(i >= n - 6) for i in range(n - k, n)) / k
            hist = sum(int(i >= n - 6) for i in range(n - k)) / (n - k)
            assert abs(r["shift"] - abs(rec - hist)) < 1e-12 and r["drifted"] == (abs(rec - hist) > 0.15)


def test_auc_brute_force_and_symmetry(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(size=300) + y, 1)          # ties on purpose
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double")
    pos, neg = s[y == 1], s[y == 0]
    brute = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    auc = M.roc_auc(df).first()["roc_auc"]
    assert abs(auc - brute) < 1e-12
    flipped = M.roc_auc(df.withColumn("score", -F.col("score"))).first()["roc_auc"]
    assert abs(auc + flipped - 1) < 1e-12


def test_confusion_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    r = M.confusion_metrics(df).first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0 and r["accuracy"] == 1.0


def test_retrain_reasons(spark):
    rollup = spark.createDataFrame([("A", 16, 16, ["rsi_14", "macd"], 2), ("B", 16, 16, [], 0)],
                                   "ticker string, total_features int, tested_features int, "
                                   "drifted_features array<string>, n_drifted int")
    acc = spark.createDataFrame([("B", 0.5)], "ticker string, rolling_accuracy double")
    out = {r["ticker"]: r for r in D.retrain_decision(rollup, None, acc).collect()}
    assert out["A"]["reasons"] == ["Feature drift in: ['rsi_14', 'macd']"] and out["A"]["retrain"]
    assert out["B"]["reasons"] == ["Rolling accuracy 50.0% < 55%"]


def test_exact_quantile_matches_percentile(spark):
    from barlake.operators.ecdf import exact_quantile

    rng = np.random.default_rng(2)
    rows = [("A", float(x)) for x in rng.integers(0, 50, 1000)] + \
           [("B", float(x)) for x in rng.normal(size=333)] + [("C", 7.0)] + [("D", 1.0), ("D", -2.0)]
    df = spark.createDataFrame(rows, "ticker string, v double")
    for p in (0.0, 0.25, 0.5, 0.99, 1.0):
        got = {r["ticker"]: r["quantile"] for r in exact_quantile(df, ["ticker"], "v", p).collect()}
        ref = {r["ticker"]: r["q"] for r in df.groupBy("ticker").agg(F.percentile("v", F.lit(p)).alias("q")).collect()}
        assert set(got) == set(ref)
        for t in ref:
            assert abs(got[t] - ref[t]) <= 1e-12 * max(1.0, abs(ref[t])), (p, t, got[t], ref[t])
