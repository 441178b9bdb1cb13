"""Job entry points for ``spark-submit`` (or ``python -m barlake``).

  build    bars table -> quality report, versioned raw, metadata, feature store, job summary
  train    feature store -> training runs table + saved models + anomaly model + fairness of the best model
  analyze  request table (ticker, start_date, end_date) -> analysis rows (+ log append)
  anomalies  feature store + stored forest -> newest anomalies per ticker, count and share
  monitor  feature store + prediction log (+ predictions and actuals, reference sample) -> retrain decision per ticker
  ingest   prediction log folder -> parquet table (file stream, availableNow)
  watch    prediction log stream -> monitor row per batch (+ retrain decisions with a drift roll-up)
  outcomes  streams of predictions and actuals -> joined rows and rolling accuracy state per ticker

Paths are folders readable by the cluster (parquet unless noted). The session
comes from spark-submit; nothing here sets a master.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from barlake.config import DEFAULT
from barlake.session import release, tune


def _session() -> SparkSession:
    return tune(SparkSession.builder.appName("barlake").getOrCreate())


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="barlake")
    sub = ap.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build")
    b.add_argument("--bars", required=True)
    b.add_argument("--out", required=True)
    b.add_argument("--tickers", nargs="*")
    b.add_argument("--start", default=DEFAULT.data.default_start_date)
    b.add_argument("--end", default=DEFAULT.data.default_end_date)
    b.add_argument("--news")
    b.add_argument("--lexicon")
    t = sub.add_parser("train")
    t.add_argument("--features", required=True)
    t.add_argument("--out", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("--requests", required=True)
    a.add_argument("--bars", required=True)
    a.add_argument("--models", required=True)
    a.add_argument("--fundamentals")
    a.add_argument("--news")
    a.add_argument("--lexicon")
    a.add_argument("--log")
    a.add_argument("--out", required=True)
    n = sub.add_parser("anomalies")
    n.add_argument("--features", required=True)
    n.add_argument("--models", required=True)
    n.add_argument("--out", required=True)
    m = sub.add_parser("monitor")
    m.add_argument("--features", required=True)
    m.add_argument("--log", required=True)
    m.add_argument("--predictions")
    m.add_argument("--actuals")
    m.add_argument("--reference")
    m.add_argument("--rollup", help="folder that keeps the drift table which watch reads")
    m.add_argument("--out", required=True)
    g = sub.add_parser("ingest")
    g.add_argument("--log", required=True)
    g.add_argument("--table", required=True)
    g.add_argument("--checkpoint", required=True)
    s = sub.add_parser("watch")
    s.add_argument("--log", required=True)
    s.add_argument("--table", required=True)
    s.add_argument("--out", required=True)
    s.add_argument("--checkpoint", required=True)
    s.add_argument("--rollup")
    s.add_argument("--accuracy")
    o = sub.add_parser("outcomes")
    o.add_argument("--predictions", required=True)
    o.add_argument("--actuals", required=True)
    o.add_argument("--table", required=True)
    o.add_argument("--accuracy", required=True)
    o.add_argument("--checkpoint", required=True)
    o.add_argument("--late", default="45 days")
    for stream in (s, o):
        stream.add_argument("--keep-running", action="store_true", help="a batch every 30 seconds instead of one drained run")
    args = ap.parse_args(argv)
    spark = _session()

    if args.cmd == "build":
        from barlake.operators.sentiment import news_titles, ticker_sentiment
        from barlake.plans import jobs
        from barlake.schemas import NEWS
        from barlake.sources.bars import read_bars

        bars = read_bars(spark, args.bars, tickers=args.tickers, start=args.start, end=args.end)
        sentiment = None
        if args.news and args.lexicon:
            news = spark.read.schema(NEWS).json(args.news)
            sentiment = ticker_sentiment(news_titles(news), spark.read.parquet(args.lexicon))
        requested = (spark.createDataFrame([(t,) for t in args.tickers], "ticker string")
                     if args.tickers else None)
        summary = jobs.build(bars, args.out, args.start, args.end, DEFAULT, sentiment, requested=requested)
        summary.write.mode("overwrite").parquet(f"{args.out}/summary")
    elif args.cmd == "train":
        from barlake.operators import iforest as IF
        from barlake.operators.classifiers import best_fairness, summary, train_evaluate
        from barlake.operators.metrics import baseline_always_up
        from barlake.operators.split import random_split
        from barlake.sinks.writers import append_training_runs
        from barlake.sources.tables import load_feature_data

        tc = DEFAULT.training
        split = random_split(load_feature_data(spark, args.features), tc.test_size, tc.random_seed)
        runs, models = train_evaluate(split, tc, models_dir=f"{args.out}/models")
        base = baseline_always_up(split.where(F.col("split") == "test"), label=tc.target_column)
        append_training_runs(summary(runs, base.select("f1").scalar()), f"{args.out}/training_runs")
        best_fairness(runs, models, load_feature_data(spark, args.features), tc).write.mode("overwrite").parquet(f"{args.out}/fairness")
        t0 = time.time()
        scored, forest = IF.fit_predict(load_feature_data(spark, args.features), n_trees=tc.iforest_n_estimators,
                                        contamination=tc.iforest_contamination, seed=tc.iforest_random_state,
                                        max_samples=tc.iforest_max_samples)
        IF.save_forest(spark, forest, f"{args.out}/models/isolation_forest", time.strftime("%Y%m%dT%H%M%S", time.gmtime()))
        append_training_runs(IF.training_run(scored, forest, tc, time.time() - t0), f"{args.out}/training_runs")
    elif args.cmd == "analyze":
        from barlake.operators.classifiers import load_models
        from barlake.operators.iforest import load_forest
        from barlake.operators.sentiment import news_titles, ticker_sentiment
        from barlake.plans import jobs
        from barlake.schemas import ANALYZE_REQUEST, FUNDAMENTALS, NEWS
        from barlake.sources.bars import read_bars

        req = spark.read.schema(ANALYZE_REQUEST).json(args.requests)
        info = spark.read.schema(FUNDAMENTALS).parquet(args.fundamentals) if args.fundamentals else None
        sentiment = None
        if args.news and args.lexicon:
            news = spark.read.schema(NEWS).json(args.news)
            sentiment = ticker_sentiment(news_titles(news), spark.read.parquet(args.lexicon))
        forest = load_forest(spark, f"{args.models}/isolation_forest")
        rec, rejected = jobs.analyze(spark, req, read_bars(spark, args.bars), load_models(spark, args.models),
                                     forest=forest, info=info, sentiment=sentiment, log_dir=args.log)
        rec.write.mode("overwrite").parquet(f"{args.out}/analysis")
        rejected.write.mode("overwrite").parquet(f"{args.out}/rejected")
    elif args.cmd == "anomalies":
        from barlake.operators.iforest import load_forest
        from barlake.plans import jobs
        from barlake.sources.tables import load_feature_data

        forest = load_forest(spark, f"{args.models}/isolation_forest")
        if forest is None:
            raise SystemExit(f"no anomaly model under {args.models}")
        top, share = jobs.anomalies(load_feature_data(spark, args.features), forest)
        top.write.mode("overwrite").parquet(f"{args.out}/anomalies")
        share.write.mode("overwrite").parquet(f"{args.out}/summary")
    elif args.cmd == "monitor":
        from barlake.plans import jobs
        from barlake.sources.tables import load_feature_data, read_prediction_log

        table = lambda path: spark.read.parquet(path) if path else None
        out = jobs.monitor(load_feature_data(spark, args.features), read_prediction_log(spark, args.log),
                           predictions=table(args.predictions), actuals=table(args.actuals), reference=table(args.reference),
                           rollup_dir=args.rollup)
        out.write.mode("overwrite").parquet(args.out)
    elif args.cmd == "ingest":
        from barlake.streaming import prediction_stream as PS

        PS.ingest(spark, args.log, args.table, args.checkpoint).awaitTermination()
    elif args.cmd == "watch":
        from barlake.streaming import prediction_stream as PS

        PS.monitor(spark, args.log, args.table, args.out, args.checkpoint, DEFAULT.monitoring, not args.keep_running,
                   rollup_dir=args.rollup, accuracy_dir=args.accuracy).awaitTermination()
    elif args.cmd == "outcomes":
        from barlake.streaming import prediction_stream as PS

        PS.outcomes(spark, args.predictions, args.actuals, args.table, args.accuracy, args.checkpoint, args.late,
                    DEFAULT.monitoring, not args.keep_running).awaitTermination()
    release(spark)


if __name__ == "__main__":
    main()
