import json
import os

from pyspark.sql import functions as F

from barlake.config import DEFAULT
from barlake.plans import jobs
from barlake.sources.bars import bars_from_lineitem
from barlake.sources.tables import load_feature_data, load_latest_raw, read_prediction_log
from barlake.streaming import prediction_stream as PS
from conftest import SF001


def test_build_job_and_cache(spark, tmp_path):
    bars = bars_from_lineitem(spark, SF001, "l_returnflag").unionByName(
        bars_from_lineitem(spark, SF001, "l_linestatus"))
    req = spark.createDataFrame([("F",), ("O",), ("A",), ("ZZZ",)], "ticker string")
    out = str(tmp_path / "store")
    summary = {r["ticker"]: r for r in jobs.build(bars, out, "1995-01-01", "2002-01-01", requested=req).collect()}
    assert summary["F"]["status"] == "OK" and summary["F"]["feature_rows"] == 1691
    assert summary["A"]["status"] == "DROPPED" and summary["ZZZ"]["status"] == "FAILED"
    # rerun the same day: dynamic overwrite keeps one version per ticker
    jobs.build(bars, out, "1995-01-01", "2002-01-01", run_date="2030-01-01")
    raw = load_latest_raw(spark, f"{out}/raw")
    assert raw.select("run_date").distinct().count() == 1
    assert load_feature_data(spark, f"{out}/features", "f").count() == 1691
    got = jobs.features_for(spark, spark.createDataFrame([("O",)], "ticker string"), f"{out}/features", bars)
    assert got.count() == 1704


def test_log_read_and_stream(spark, tmp_path):
    log_dir = tmp_path / "logs"
    log_dir.mkdir()
    for part in range(3):
        with open(log_dir / f"part{part}.jsonl", "w") as f:
            for i in range(10):
                rec = {"timestamp": f"2024-01-0{part + 1}T00:00:{i:02d}", "ticker": "AAA",
                       "features": {"rsi_14": 50.0}, "prediction": int(part == 2), "confidence": 0.7,
                       "latency_ms": 1.5}
                f.write(json.dumps(rec) + "\n")
            f.write("\n")
    assert read_prediction_log(spark, str(log_dir)).count() == 30
    assert read_prediction_log(spark, str(tmp_path / "absent")).count() == 0
    q = PS.ingest(spark, str(log_dir), str(tmp_path / "table"), str(tmp_path / "ck1"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "table")).count() == 30
    q = PS.monitor(spark, str(log_dir), str(tmp_path / "t2"), str(tmp_path / "mon"), str(tmp_path / "ck2"))
    q.awaitTermination()
    mon = spark.read.parquet(str(tmp_path / "mon")).orderBy(F.col("epoch_id").desc()).first()
    assert mon["total_requests"] == 30 and mon["drifted"] is True


def test_cli_jobs(spark, tmp_path):
    from barlake import __main__ as cli
    from barlake.config import TrainConfig
    from barlake.operators.classifiers import train_evaluate
    from barlake.operators.split import random_split

    d = str(tmp_path)
    bars_from_lineitem(spark, SF001, "l_linestatus").write.partitionBy("ticker").parquet(f"{d}/bars")
    spark.createDataFrame([("f", "1996-01-01", "2001-06-01"), ("O", "1996-01-01", "2001-06-01"),
                           ("BAD1", "2000-01-01", "2001-01-01")],
                          "ticker string, start_date string, end_date string").write.json(f"{d}/requests")
    cli.main(["build", "--bars", f"{d}/bars", "--out", f"{d}/store", "--start", "1995-01-01", "--end", "2002-01-01"])
    summary = {r["ticker"]: r for r in spark.read.parquet(f"{d}/store/summary").collect()}
    assert summary["F"]["feature_rows"] == 1691
    feats = spark.read.parquet(f"{d}/store/features")
    train_evaluate(random_split(feats), TrainConfig(lr_max_iter=50), names=["LogisticRegression"],
                   models_dir=f"{d}/models")
    cli.main(["analyze", "--requests", f"{d}/requests", "--bars", f"{d}/bars", "--models", f"{d}/models",
              "--log", f"{d}/log", "--out", f"{d}/analysis"])
    rows = {r["ticker"]: r for r in spark.read.parquet(f"{d}/analysis/analysis").collect()}
    assert set(rows) == {"F", "O"} and rows["F"]["model_used"] == "LogisticRegression"
    assert rows["F"]["direction_prediction"] in ("UP", "DOWN") and rows["F"]["status"] == "OK"
    assert [r["ticker"] for r in spark.read.parquet(f"{d}/analysis/rejected").collect()] == ["BAD1"]
    log = read_prediction_log(spark, f"{d}/log")
    assert log.count() == 2 and len(log.first()["features"]) == 5
    cli.main(["monitor", "--features", f"{d}/store/features", "--log", f"{d}/log", "--rollup", f"{d}/rollup", "--out", f"{d}/monitor"])
    assert spark.read.parquet(f"{d}/monitor").count() == 2
    spark.createDataFrame([], PS.OUTCOME_SIDES["prediction"]).write.parquet(f"{d}/preds")
    spark.createDataFrame([], PS.OUTCOME_SIDES["label"]).write.parquet(f"{d}/actuals")
    cli.main(["outcomes", "--predictions", f"{d}/preds", "--actuals", f"{d}/actuals", "--table", f"{d}/joined",
              "--accuracy", f"{d}/accuracy", "--checkpoint", f"{d}/ck-outcomes"])
    cli.main(["watch", "--log", f"{d}/log", "--table", f"{d}/watched", "--out", f"{d}/watch", "--checkpoint", f"{d}/ck-watch",
              "--rollup", f"{d}/rollup", "--accuracy", f"{d}/accuracy"])
    assert spark.read.parquet(f"{d}/watch").first()["total_requests"] == 2
    assert spark.read.parquet(f"{d}/watch_decisions").count() == 2
    cli.main(["ingest", "--log", f"{d}/log", "--table", f"{d}/log_table", "--checkpoint", f"{d}/ck"])
    assert spark.read.parquet(f"{d}/log_table").count() == 2
