"""Streams with state: equal to the batch operators, whatever the order of arrival, replays and lost state."""

import datetime as dt
import json
import os
import random
import shutil

from pyspark.sql import functions as F

from barlake.config import DEFAULT
from barlake.operators import drift as D
from barlake.operators import report as RP
from barlake.sources.tables import read_prediction_log
from barlake.streaming import prediction_stream as PS

CFG = DEFAULT.monitoring


def _log_files(folder, parts, seed):
    rng = random.Random(seed)
    rows = [{"timestamp": f"2024-01-{1 + i // 60:02d}T00:00:{i % 60:02d}", "ticker": rng.choice("AB"), "features": {"x": 1.0},
             "prediction": rng.choice([0, 1, 1, None] if i < 150 else [0, 0, 1]), "confidence": rng.random(), "latency_ms": 1.0}
            for i in range(200)]
    rng.shuffle(rows)
    return [(os.path.join(folder, f"part{k}.jsonl"), rows[k::parts]) for k in range(parts)]


def _deliver(path, rows):
    with open(path, "w") as f:
        f.write("".join(json.dumps(r) + "\n" for r in rows))


def _report(spark, folder):
    return spark.read.parquet(folder).orderBy(F.col("epoch_id").desc()).first()


def test_monitor_state_equals_the_whole_log(spark, tmp_path):
    log, d = tmp_path / "log", str(tmp_path)
    log.mkdir()
    spark.createDataFrame([("A", ["x"], 1), ("B", [], 0)], "ticker string, drifted_features array<string>, n_drifted int") \
        .write.parquet(f"{d}/rollup")
    run = lambda: PS.monitor(spark, str(log), f"{d}/table", f"{d}/mon", f"{d}/ck", rollup_dir=f"{d}/rollup").awaitTermination()
    for k, (path, rows) in enumerate(_log_files(str(log), 4, 5)):
        if k == 3:  # lost state is rebuilt from the stored records
            shutil.rmtree(f"{d}/mon_state")
        _deliver(path, rows)
        run()
        whole = read_prediction_log(spark, str(log))
        got, kpis = _report(spark, f"{d}/mon"), RP.log_kpis(whole).first()
        drift = D.prediction_drift(whole, CFG, PS.LOG_ORDER).first()
        assert got.total_requests == kpis.total_requests == whole.count()
        assert abs(got.up_pct - kpis.up_pct) < 1e-9 and abs(got.avg_confidence_pct - kpis.avg_confidence_pct) < 1e-9
        assert (got["shift"] is None) == (drift["shift"] is None) and abs(got["shift"] - drift["shift"]) < 1e-9
        assert got.drifted == drift.drifted
        decided = spark.read.parquet(PS.epoch(f"{d}/mon_decisions", got.epoch_id)).orderBy("ticker").collect()
        assert [r.retrain for r in decided] == [True, drift.drifted]
    assert len([f for f in os.listdir(f"{d}/mon_state") if f.startswith("epoch_id=")]) <= 2


def test_replayed_batch_changes_nothing(spark, tmp_path):
    """A batch that failed after its writes runs again: its commit is taken back, the result stays."""
    log, d = tmp_path / "log", str(tmp_path)
    log.mkdir()
    for path, rows in _log_files(str(log), 3, 9):
        _deliver(path, rows)
        PS.monitor(spark, str(log), f"{d}/table", f"{d}/mon", f"{d}/ck").awaitTermination()
    before = _report(spark, f"{d}/mon")
    last = max(int(f) for f in os.listdir(f"{d}/ck/commits") if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{d}/ck/commits/{name}"):
            os.remove(f"{d}/ck/commits/{name}")
    PS.monitor(spark, str(log), f"{d}/table", f"{d}/mon", f"{d}/ck").awaitTermination()
    again = _report(spark, f"{d}/mon")
    assert again.evaluated_at > before.evaluated_at  # it did run again
    skip = "evaluated_at"
    assert {k: v for k, v in again.asDict().items() if k != skip} == {k: v for k, v in before.asDict().items() if k != skip}
    assert spark.read.parquet(f"{d}/table").count() == 200


def test_outcome_stream_equals_batch_join(spark, tmp_path):
    """Late rows on both sides meet their partners; rows beyond the watermark don't."""
    rng, d = random.Random(3), str(tmp_path)
    start = dt.date(2020, 1, 1)
    rows = [(t, start + dt.timedelta(days=k), rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(120) for t in ("A", "B")]
    slices = lambda i: min(i // 40, 2)
    early = lambda r, m: slices((r[1] - start).days + (20 if r[1].day % m == 0 else 0))
    lost = ("Z", start, 1, 1)
    for k in range(3):
        preds = [r[:3] for r in rows if early(r, 3) == k] + ([lost[:3]] if k == 0 else [])
        acts = [(r[0], r[1], r[3]) for r in rows if early(r, 4) == k] + ([(lost[0], lost[1], lost[3])] if k == 2 else [])
        spark.createDataFrame(preds, PS.OUTCOME_SIDES["prediction"]).write.mode("append").parquet(f"{d}/p")
        spark.createDataFrame(acts, PS.OUTCOME_SIDES["label"]).write.mode("append").parquet(f"{d}/a")
        PS.outcomes(spark, f"{d}/p", f"{d}/a", f"{d}/t", f"{d}/s", f"{d}/ck").awaitTermination()
    table = spark.read.parquet(f"{d}/t").drop("epoch_id")
    whole = D.rolling_accuracy(spark.read.parquet(f"{d}/p"), spark.read.parquet(f"{d}/a"), CFG).where("ticker <> 'Z'")
    key = lambda r: (r.ticker, r.date)
    got = sorted(D.rolling_share(table, CFG).select(*whole.columns).collect(), key=key)
    assert got == sorted(whole.collect(), key=key) and len(got) == len(rows)
    latest = {r.ticker: r.rolling_accuracy for r in D.latest_value(whole, "rolling_accuracy").collect()}
    state = {r.ticker: r.rolling_accuracy for r in PS.newest_accuracy(spark, f"{d}/s", CFG).collect()}
    assert set(state) == {"A", "B"} and all(abs(state[t] - latest[t]) < 1e-12 for t in state)
