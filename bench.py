"""Bench: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Each query is materialised in full through the ``noop`` sink (no driver
collect); a small warm-up query runs first so JVM start-up is not charged to q1.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barlake.plans.catalog import queries  # noqa: E402
from barlake.session import local_session, release  # noqa: E402

HEADLINE = [
    "bars_daily", "quality_report", "clean_bars", "features", "features_with_sentiment",
    "ks_statistics", "feature_drift", "roc_auc_by_ticker", "metrics_by_ticker", "split_class_balance",
    "headline_sentiment", "prediction_drift", "rolling_accuracy", "latest_signals",
    "display_indicators", "anomaly_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="barlake-bench")
    q = queries()
    q["log_kpis"](spark, sf_dir).collect()  # warm-up
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        q[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        spark.catalog.clearCache()  # no query may read what another has kept
        release(spark)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(m.group(1)) if m else sf_dir,
    }))


if __name__ == "__main__":
    main()
