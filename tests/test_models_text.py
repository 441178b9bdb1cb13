import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from barlake.operators import iforest as IF
from barlake.operators import report as RP
from barlake.operators.classifiers import train_evaluate
from barlake.operators.requests import check_requests
from barlake.operators.sentiment import (headline_scores, news_titles, short_title, ticker_sentiment,
                                         tokens)
from barlake.operators.split import random_split
from barlake.config import TrainConfig
from barlake.plans.pipeline import feature_table
from barlake.schemas import LEXICON, NEWS
from barlake.sources.bars import bars_from_lineitem
from conftest import SF001


def test_iforest_flags_contamination_share(spark):
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(2000, 2))
    df = spark.createDataFrame([(f"T{i % 3}", i, float(a), float(b)) for i, (a, b) in enumerate(pts)],
                               "ticker string, date int, volume_ratio double, price_change_pct double")
    scored, forest = IF.fit_predict(df, n_trees=50, contamination=0.05)
    share = scored.agg(F.avg((F.col("anomaly") == -1).cast("double"))).first()[0]
    assert 0.04 <= share <= 0.06
    # far-away points score higher than the centre, missing features have no score
    far = spark.createDataFrame([("X", 0, 8.0, 8.0), ("X", 1, 0.0, 0.0), ("X", 2, None, 0.0)],
                                "ticker string, date int, volume_ratio double, price_change_pct double")
    s = IF.score(forest, far).orderBy("date").collect()
    assert s[0]["anomaly_score"] > s[1]["anomaly_score"] and s[0]["anomaly"] == -1 and s[1]["anomaly"] == 1
    assert s[2]["anomaly_score"] is None and s[2]["anomaly"] == 1


def plain_forest_scores(nodes, rows, n_trees, psi):
    """Scores by walking the node rows one by one."""
    at = {(r.tree, r.node): r for r in nodes.itertuples()}
    out = []
    for x in rows:
        total = 0
        for t in range(n_trees):
            n = at[t, 0]
            while n.feature >= 0:
                n = at[t, 2 * n.node + 1 + (x[n.feature] >= n.threshold)]
            total += round((n.depth + IF.c_factor(n.size)) * IF.UNIT)
        out.append(2.0 ** (-total / (n_trees * IF.UNIT) / IF.c_factor(psi)))
    return out


def test_forest_tables_are_a_tree_and_score_like_the_walk(spark, tmp_path):
    rng = np.random.default_rng(5)
    pts = np.round(rng.normal(size=(300, 2)), 6).tolist() + [[1.0, 1.0]] * 40  # repeated rows make leaves that can't split
    df = spark.createDataFrame([("T", i, a, b) for i, (a, b) in enumerate(pts)],
                               "ticker string, date int, volume_ratio double, price_change_pct double")
    scored, forest = IF.fit_predict(df, n_trees=7, contamination=0.1, max_samples=64)
    nodes = forest.nodes
    at = {(r.tree, r.node): r for r in nodes.itertuples()}
    assert len(at) == len(nodes) and {t for t, _ in at} == set(range(7)) and all(at[t, 0].size == 64 for t in range(7))
    for (t, n), r in at.items():
        if r.feature >= 0:
            assert at[t, 2 * n + 1].size + at[t, 2 * n + 2].size == r.size if (t, 2 * n + 1) in at else at[t, 2 * n + 2].size == r.size
        else:
            assert r.size == 1 or r.depth == 6 or r.size > 1
    got = [r["anomaly_score"] for r in scored.orderBy("date").collect()]
    assert np.allclose(got, plain_forest_scores(nodes, pts, 7, 64))

    path = str(tmp_path / "forest")
    assert IF.load_forest(spark, path) is None
    IF.save_forest(spark, forest, path, "20240101")
    IF.save_forest(spark, forest, path, "20240102")
    again = IF.load_forest(spark, path)
    assert again.version == "20240102" and again.cut == forest.cut and again.features == forest.features
    same = IF.score(again, df).orderBy("date").collect()
    assert [r["anomaly"] for r in same] == [r["anomaly"] for r in scored.orderBy("date").collect()]
    assert IF.load_forest(spark, path, "20240101").nodes.equals(forest.nodes)


def test_forest_of_few_or_no_rows(spark, tmp_path):
    schema = "ticker string, date int, volume_ratio double, price_change_pct double"
    scored, forest = IF.fit_predict(spark.createDataFrame([], schema))
    assert scored.collect() == [] and forest.psi == 0 and len(forest.nodes) == 0
    IF.save_forest(spark, forest, str(tmp_path / "f"), "1")
    assert IF.load_forest(spark, str(tmp_path / "f")).cut == float("inf")
    one = IF.fit_predict(spark.createDataFrame([("A", 1, 1.0, 2.0)], schema))[0].first()
    assert one["anomaly_score"] == 0.5 and one["anomaly"] == 1


def test_train_and_quality_band(spark):
    ft = feature_table(bars_from_lineitem(spark, SF001, "l_linestatus"))
    cfg = TrainConfig(rf_n_estimators=20, gbt_n_estimators=5, lr_max_iter=100)
    runs, models = train_evaluate(random_split(ft), cfg)
    rows = {r["model"]: r for r in runs.collect()}
    assert set(rows) == {"RandomForest", "XGBoost", "LogisticRegression"}
    for r in rows.values():
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == r["n_test"]
        assert 0.5 <= r["roc_auc"] <= 1.0
    assert len(rows["RandomForest"]["importances"]) == 16


def test_news_title_fallback_and_first_n(spark):
    news = spark.createDataFrame([("AAA", [
        {"title": "outer only", "content": None},
        {"title": "ignored", "content": {"title": "nested title"}},
        {"title": "outer kept?", "content": {"title": None}},
        {"title": "", "content": None},
    ])], NEWS)
    assert [r["title"] for r in news_titles(news).orderBy("pos").collect()] == ["outer only", "nested title"]
    assert news_titles(news, first_n=1).count() == 1


def test_polarity_rules(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0)], LEXICON)
    df = spark.createDataFrame([(1, "good"), (2, "not good"), (3, "very good"), (4, "bad bad"), (5, "")],
                               "doc_id int, title string")
    out = {r["doc_id"]: r["compound"] for r in headline_scores(df, lex).collect()}
    assert abs(out[1] - 2 / (4 + 15) ** 0.5) < 1e-12
    assert out[2] < 0 and abs(out[2] + 1.48 / (1.48 ** 2 + 15) ** 0.5) < 1e-12
    assert abs(out[3] - 2.293 / (2.293 ** 2 + 15) ** 0.5) < 1e-12
    assert out[4] < -0.7 and out[5] == 0.0
    mixed = spark.createDataFrame([("Good", 2.0), ("good", 1.0), ("BAD", -2.0)] + [(f"w{i}", 1.0) for i in range(100_000)], LEXICON)
    per = ticker_sentiment(df.withColumn("ticker", F.lit("T")), mixed).first()
    assert per["n_headlines"] == 5 and abs(per["sentiment_score"] - sum(out.values()) / 5) < 1e-12
    t = spark.createDataFrame([("x" * 81,)], "t string").select(short_title(F.col("t")).alias("s")).first()["s"]
    assert t == "x" * 80 + "..."


def test_text_formats(spark):
    df = spark.createDataFrame([(2.5e12,), (3.456e9,), (12.4e6,), (0.0,), (None,)], "mc double")
    got = [r[0] for r in df.select(RP.market_cap_text(F.col("mc"))).collect()]
    assert got == ["$2.50T", "$3.46B", "$12M", "N/A", "N/A"]


def test_request_checks(spark):
    today = dt.date.today()
    req = spark.createDataFrame([
        (" aapl ", "2024-01-01", "2024-06-01"),
        ("TOOLONG", "2024-01-01", "2024-06-01"),
        ("MSFT", "2024-06-01", "2024-01-01"),
        ("MSFT", "2024-01-01", (today + dt.timedelta(days=3)).isoformat()),
    ], "ticker string, start_date string, end_date string")
    out = check_requests(req).collect()
    assert out[0]["ticker"] == "AAPL" and out[0]["valid"]
    assert [r["valid"] for r in out[1:]] == [False, False, False]


def test_latest_vs_previous_single_row(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 2), 10.0)], "ticker string, date date, Close double")
    r = RP.latest_vs_previous(df).first()
    assert r["previous_close"] == 10.0 and r["change"] == 0.0


def test_tokens_whole_text(spark):
    text = "word " * 5000 + "good"
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.size(tokens(F.col("t")))).first()[0] == 5001


def test_wide_to_long_and_lookback(spark):
    from barlake.sources.bars import lookback, wide_to_long

    wide = spark.createDataFrame([
        (dt.date(2024, 1, 2), 1.0, 2.0, 0.5, 1.5, 1.4, 100.0, 10.0, 11.0, 9.0, 10.5, 10.4, 7.0),
        (dt.date(2025, 1, 2), 1.1, 2.1, 0.6, 1.6, 1.5, 101.0, 10.1, 11.1, 9.1, 10.6, 10.5, 8.0),
    ], "date date, `Open|aapl` double, `High|aapl` double, `Low|aapl` double, `Close|aapl` double, "
       "`Adj Close|aapl` double, `Volume|aapl` double, `Open|MSFT` double, `High|MSFT` double, "
       "`Low|MSFT` double, `Close|MSFT` double, `Adj Close|MSFT` double, `Volume|MSFT` double")
    long = wide_to_long(wide)
    rows = {(r["ticker"], r["date"]): r for r in long.collect()}
    assert len(rows) == 4 and rows[("AAPL", dt.date(2024, 1, 2))]["Close"] == 1.5
    assert rows[("MSFT", dt.date(2025, 1, 2))]["Volume"] == 8.0
    assert lookback(long, "6mo").count() == 2 and lookback(long, "2y").count() == 4


def test_models_saved_loaded_side_by_side(spark, tmp_path):
    from barlake.operators.classifiers import (display_name, load_models, score_latest, side_by_side)

    ft = feature_table(bars_from_lineitem(spark, SF001, "l_linestatus"))
    cfg = TrainConfig(rf_n_estimators=5, gbt_n_estimators=3, lr_max_iter=50)
    train_evaluate(random_split(ft), cfg, names=["RandomForest", "LogisticRegression"],
                   models_dir=str(tmp_path / "models"))
    models = load_models(spark, str(tmp_path / "models"))
    assert set(models) == {"RandomForest", "LogisticRegression"}
    latest = score_latest(ft, models).collect()
    assert {r["model"] for r in latest} == {"RandomForest"} and len(latest) == 2
    both = side_by_side(RP.latest_row(ft), models).collect()
    assert all(r["pred_RandomForest"] in (0, 1) and r["pred_LogisticRegression"] in (0, 1) for r in both)
    names = spark.createDataFrame([("LogisticRegression",)], "m string").select(display_name("m")).first()[0]
    assert names == "Logistic Regression"


def test_analysis_report_trains_every_model(spark, monkeypatch):
    from barlake.operators import classifiers
    from barlake.plans import catalog

    class Asked(Exception):
        pass

    def asked(split, cfg=None, names=None, **options):
        raise Asked(names)

    monkeypatch.setattr(classifiers, "train_evaluate", asked)
    try:
        catalog.q_analysis(spark, SF001)
    except Asked as e:
        assert e.args[0] is None or set(e.args[0]) == set(classifiers.MODEL_PREFERENCE)
    else:
        raise AssertionError("no model was trained")
