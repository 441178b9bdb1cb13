"""Isolation forest (M5, M6, G18): Liu, Ting & Zhou (2008), psi = min(256, n).

The forest is a relational model: one row per node, grown, stored and scored as tables.

1. *Sample.* Each (row, tree) pair is kept with probability 2 * psi / n, decided by hashes of
   the row's key; one hash per row selects candidates first. Per tree the psi smallest hashes
   are kept (a row_number over about 2 * psi rows a tree, whatever n is).
2. *Growth.* All trees grow level by level in window functions over the sample, which is dealt
   by tree once: bounds and sizes of every (tree, node), then a split feature and threshold
   drawn from hashes of (tree, node). A node's children are 2 * node + 1 and 2 * node + 2. Any
   engine with md5 grows the same forest (the oracle does).
3. *Scores.* A row's path lengths are integers (``UNIT`` per level), so their sum over trees
   doesn't depend on an order; score = 2 ** (-E[h] / c(psi)). The node table (trees x (2 ** 9 - 1)
   rows at most) is shipped to an Arrow UDF that walks all trees on whole batches.
4. *Cut.* The (1 - contamination) quantile of the training scores, exact over order buckets;
   rows above it are -1 (anomaly), others 1.

Features enter at ``PLACES`` decimals, so that no split hangs on the last bits of a running sum.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.operators.ecdf import exact_quantile
from barlake.operators.split import unit_of
from barlake.session import staged
from barlake.sources.tables import path_exists

EULER = 0.5772156649015329
FEATURES = ("volume_ratio", "price_change_pct")
PLACES = 6
UNIT = 1_000_000
NODE_SCHEMA = "tree int, node int, depth int, feature int, threshold double, size long"


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def max_depth(psi: int) -> int:
    return int(math.ceil(math.log2(max(psi, 2))))


@dataclass(frozen=True)
class Forest:
    """Node rows (bounded by the parameters), psi, the score cut and the input columns."""
    nodes: pd.DataFrame
    psi: int
    n_trees: int
    features: tuple[str, ...] = FEATURES
    cut: float | None = None
    version: str | None = None


def _vector(features: tuple[str, ...]) -> list[Column]:
    return [F.round(F.col(f"`{c}`").cast("double"), PLACES) for c in features]


def sample_trees(X: DataFrame, key: Column, n_trees: int, psi: int, n_rows: int, seed: int) -> DataFrame:
    """(row, tree) pairs with inclusion probability 2 * psi / n per pair, then the psi smallest hashes per tree.

    One hash per row first keeps only candidates (rate n_trees * 2 * psi / n, at most every
    row); per-tree hashes run on candidates only, with the rate divided back out.
    """
    pair_rate, cand_rate = sample_rates(n_trees, psi, n_rows)
    cand = X.withColumn("_key", key).where(unit_of(F.lit(seed), F.lit(-1), F.col("_key")) < cand_rate)
    trees = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: unit_of(F.lit(seed), t, F.col("_key")) < pair_rate / cand_rate)
    pairs = cand.select("*", F.explode(trees).alias("tree"))
    pairs = pairs.withColumn("_u", unit_of(F.lit(seed + 1), F.col("tree"), F.col("_key")))
    w = Window.partitionBy("tree").orderBy("_u", "_key")
    return pairs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= psi).drop("_r", "_u", "_key")


def sample_rates(n_trees: int, psi: int, n_rows: int) -> tuple[float, float]:
    pair_rate = min(1.0, 2.0 * max(psi, 1) / max(n_rows, 1))
    return pair_rate, min(1.0, pair_rate * n_trees)


def grow(sample: DataFrame, n_features: int, psi: int, seed: int) -> DataFrame:
    """Node rows of all trees over ``sample`` (tree, x): every level is one window over (tree, node)."""
    rows = sample.select("tree", "x", F.lit(0).alias("node"), F.lit(True).alias("open"), F.array().cast(
        "array<struct<node:int,depth:int,feature:int,threshold:double,size:bigint>>").alias("path"))
    inside = Window.partitionBy("tree", "node")
    for depth in range(max_depth(psi) + 1):
        bounds = {"_n": F.count(F.lit(1)).over(inside)}
        for i in range(n_features):
            bounds |= {f"_lo{i}": F.min(F.col("x")[i]).over(inside), f"_hi{i}": F.max(F.col("x")[i]).over(inside)}
        rows = rows.withColumns(bounds)
        usable = F.array_compact(F.array(*[F.when(F.col(f"_hi{i}") > F.col(f"_lo{i}"), F.lit(i)) for i in range(n_features)]))
        splits = F.col("open") & (F.col("_n") > 1) & (F.size(usable) > 0) & F.lit(depth < max_depth(psi))
        draw = lambda what: unit_of(F.lit(seed), F.lit(what), F.col("tree"), F.col("node"))
        rows = rows.withColumn("_f", F.when(splits, F.get(usable, F.floor(draw("feature") * F.size(usable)).cast("int"))).otherwise(-1))
        at = lambda side: F.get(F.array(*[F.col(f"_{side}{i}") for i in range(n_features)]), F.col("_f"))
        rows = rows.withColumn("_t", F.when(F.col("_f") >= 0, at("lo") + draw("threshold") * (at("hi") - at("lo"))).otherwise(0.0))
        entry = F.struct("node", F.lit(depth).alias("depth"), F.col("_f").alias("feature"), F.col("_t").alias("threshold"), F.col("_n").alias("size"))
        down = 2 * F.col("node") + 1 + (F.get("x", F.col("_f")) >= F.col("_t")).cast("int")
        rows = rows.select("tree", "x", F.when(F.col("_f") >= 0, down).otherwise(F.col("node")).alias("node"), (F.col("_f") >= 0).alias("open"),
                           F.when(F.col("open"), F.concat("path", F.array(entry))).otherwise(F.col("path")).alias("path"))
    each = rows.select("tree", F.explode("path").alias("p")).select("tree", "p.*")
    return each.groupBy("tree", "node").agg(*[F.any_value(c).alias(c) for c in ("depth", "feature", "threshold", "size")])


def fit(X: DataFrame, features: tuple[str, ...] = FEATURES, n_trees: int = 100, seed: int = 42,
        max_samples: int = 256, key_cols: tuple[str, ...] = ("ticker", "date")) -> Forest:
    """The forest of the rows of ``X`` (features present), without a cut. ``key_cols`` identify a row."""
    features = tuple(features)
    n = X.count()
    psi = int(min(max_samples, n))
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in key_cols])
    rows = X.select(*key_cols, F.array(*_vector(features)).alias("x"))
    sample = sample_trees(rows, key, n_trees, psi, n, seed).select("tree", "x").repartition("tree")
    nodes = grow(sample, len(features), psi, seed)
    # the parameters bound it: n_trees * (2 * max_samples - 1) nodes at most
    table = nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    return Forest(table, psi, n_trees, features)


def path_udf(forest: Forest):
    """Arrow UDF (*features) -> sum of the path lengths over all trees, in units."""
    width = int(forest.nodes["node"].max()) + 1 if len(forest.nodes) else 1
    feat = np.full((forest.n_trees, width), -1, np.int64)
    thr = np.zeros((forest.n_trees, width))
    units = np.zeros((forest.n_trees, width), np.int64)
    for r in forest.nodes.itertuples(index=False):
        feat[r.tree, r.node], thr[r.tree, r.node] = r.feature, r.threshold
        units[r.tree, r.node] = round((r.depth + c_factor(r.size)) * UNIT)

    @F.pandas_udf(T.LongType())
    def path(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype="float64") for c in cols])
        total = np.zeros(len(X), np.int64)
        for t in range(len(feat)):
            node, going = np.zeros(len(X), np.int64), np.arange(len(X))
            while len(going):
                f = feat[t, node[going]]
                going, f = going[f >= 0], f[f >= 0]
                node[going] = 2 * node[going] + 1 + (X[going, f] >= thr[t, node[going]])
            total += units[t, node]
        return pd.Series(total)

    return path


def score(forest: Forest, df: DataFrame) -> DataFrame:
    """``df`` with ``anomaly_score`` in (0, 1] (null where a feature is missing) and, if the forest
    has a cut, ``anomaly`` (-1 / 1)."""
    norm = c_factor(forest.psi)
    missing = F.lit(False)
    for c in forest.features:
        missing = missing | F.col(f"`{c}`").isNull()
    total = path_udf(forest)(*[F.coalesce(v, F.lit(0.0)) for v in _vector(forest.features)])
    value = F.pow(F.lit(2.0), -(total / F.lit(float(forest.n_trees * UNIT))) / F.lit(norm)) if norm > 0 else F.lit(0.5)
    out = df.withColumn("anomaly_score", F.when(~missing, value))
    return out if forest.cut is None else flagged(out, forest.cut)


def flagged(scored: DataFrame, cut: float) -> DataFrame:
    return scored.withColumn("anomaly", F.when(F.col("anomaly_score") > cut, -1).otherwise(1))


def fit_predict(df: DataFrame, features: tuple[str, ...] = FEATURES, n_trees: int = 100, contamination: float = 0.05,
                seed: int = 42, key_cols: tuple[str, ...] = ("ticker", "date"), max_samples: int = 256) -> tuple[DataFrame, Forest]:
    """Fit on the whole pooled table (rows with the features present) and flag it.
    The input vector is (volume_ratio, price_change_pct) (F16).

    Returns (df + anomaly_score + anomaly (-1 / 1), forest with its cut). The scored rows are one
    table in the shared folder: nothing stays cached, and a lost executor repeats no scoring.
    """
    features = tuple(features)
    X = staged(df.na.drop(subset=list(features)), "forest-input")
    forest = fit(X, features, n_trees, seed, max_samples, key_cols)
    scored = staged(score(forest, X), "forest-scores")
    found = exact_quantile(scored.withColumn("_all", F.lit(0)), ["_all"], "anomaly_score", 1.0 - contamination).collect()
    cut = float(found[0]["quantile"]) if found else float("inf")
    return flagged(scored, cut), Forest(forest.nodes, forest.psi, n_trees, features, cut)


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Count and percentage of anomalies."""
    return scored.agg(
        F.count_if(F.col("anomaly") == -1).alias("n_anomalies"),
        F.count(F.lit(1)).alias("n_rows"),
        F.round(100.0 * F.avg((F.col("anomaly") == -1).cast("double")), 2).alias("anomaly_pct"),
    )


def training_run(scored: DataFrame, forest: Forest, cfg, seconds: float) -> DataFrame:
    """Training-run record of the anomaly model (K6): rows, parameters, flagged rows and share."""
    s = anomaly_summary(scored).first()
    params = {"n_estimators": cfg.iforest_n_estimators, "contamination": cfg.iforest_contamination, "max_samples": forest.psi,
              "random_state": cfg.iforest_random_state, "n_anomalies": s["n_anomalies"], "anomaly_pct": s["anomaly_pct"], "cut": forest.cut}
    row = [("IsolationForest", s["n_rows"], round(seconds, 3), {k: str(v) for k, v in params.items()})]
    return scored.sparkSession.createDataFrame(row, "model string, n_train long, training_time_seconds double, params map<string,string>")


# ------------------------------------------------------------------ the stored model

_HEADER = "version string, psi int, n_trees int, features array<string>, cut double"


def save_forest(spark: SparkSession, forest: Forest, path: str, version: str) -> None:
    """Node rows under ``version``, then the header row that publishes them (K5). A run that
    dies before the header leaves no version; saving a version again replaces it."""
    nodes = spark.createDataFrame(forest.nodes[[x.split()[0] for x in NODE_SCHEMA.split(", ")]], NODE_SCHEMA)
    nodes.write.mode("overwrite").parquet(f"{path}/nodes/version={version}")
    head = [(version, forest.psi, forest.n_trees, list(forest.features), forest.cut)]
    spark.createDataFrame(head, _HEADER).coalesce(1).write.mode("overwrite").parquet(f"{path}/headers/version={version}")


def load_forest(spark: SparkSession, path: str, version: str | None = None) -> Forest | None:
    """The newest published version (or the named one); None where there is none."""
    if not path_exists(spark, f"{path}/headers"):
        return None
    heads = spark.read.schema(_HEADER).parquet(f"{path}/headers")
    if version is not None:
        heads = heads.where(F.col("version") == version)
    head = heads.orderBy(F.desc("version")).limit(1).collect()
    if not head:
        return None
    h = head[0]
    nodes = spark.read.schema(NODE_SCHEMA).parquet(f"{path}/nodes/version={h['version']}").toPandas()
    return Forest(nodes.sort_values(["tree", "node"]).reset_index(drop=True), h["psi"], h["n_trees"], tuple(h["features"]),
                  h["cut"], h["version"])
