"""Fitted classifiers as tables (M2-M4, M7, K5): trees and coefficients as rows, scored by joins.

``export`` turns a fitted pipeline into rows (one per tree node, or one per coefficient), and
``score_rows`` scores feature rows with them: tree models by one join per level on (tree, node),
linear ones by a weighted sum. Class and probability equal the library's own transform, so any
SQL engine can serve or audit a model without its library.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = ("kind string, tree int, node int, feature int, threshold double, left int, right int, value double, weight double, "
          "feature_name string")



def export(model: PipelineModel, names: list[str], path: str) -> DataFrame:
    """Rows of a fitted pipeline. Trees are read from the model's own files (saved under ``path``), so nodes
    never pass the driver: trees x 2 ** (depth + 1) rows at most, by the parameters."""
    last = model.stages[-1]
    spark = SparkSession.active()
    if isinstance(last, LogisticRegressionModel):
        rows = [("linear", 0, k, k, None, -1, -1, float(c), 1.0, names[k]) for k, c in enumerate(last.coefficients.toArray())]
        rows.append(("linear", 0, len(rows), -1, None, -1, -1, float(last.intercept), 1.0, None))
        return spark.createDataFrame(rows, SCHEMA)
    kinds = {RandomForestClassificationModel: "forest", GBTClassificationModel: "boosted"}
    if type(last) not in kinds:
        raise TypeError(f"no table form of {type(last).__name__}")
    kind = kinds[type(last)]
    last.write().overwrite().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    weight = F.get(F.array(*[F.lit(float(w)) for w in last.treeWeights]), F.col("treeID"))  # one number per tree
    leaf = F.col("leftChild") < 0
    up = F.get("impurityStats", F.lit(1)) / F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return n.select(
        F.lit(kind).alias("kind"), F.col("treeID").alias("tree"), F.col("id").alias("node"),
        F.when(leaf, -1).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"), F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"), F.when(leaf, up if kind == "forest" else F.col("prediction")).alias("value"),
        weight.alias("weight"), F.when(~leaf, F.get(F.array(*[F.lit(c) for c in names]), F.col("split.featureIndex"))).alias("feature_name"))


def score_rows(nodes: DataFrame, rows: DataFrame, names: list[str], keys: list[str], max_depth: int) -> DataFrame:
    """keys, prediction, score (probability of class 1), confidence. ``nodes`` is one exported model, ``max_depth`` its
    depth; features must be present. The node table is bounded by the model's parameters, so it is broadcast."""
    x = F.array(*[F.col(f"`{c}`").cast("double") for c in names])
    kind = nodes.select(F.max("kind")).first()[0]
    points = rows.select(*keys, x.alias("x"))
    if kind == "linear":
        table = nodes.agg(F.array_sort(F.collect_list(F.struct("node", "feature", "value"))).alias("w"))  # one row, bounded by the features
        terms = points.join(F.broadcast(table), F.lit(True))
        total = F.aggregate("w", F.lit(0.0), lambda acc, w: acc + w["value"] * F.when(w["feature"] < 0, 1.0).otherwise(F.get("x", w["feature"])))
        return _decided(terms.select(*keys, (1.0 / (1.0 + F.exp(-total))).alias("score")), keys)
    trees = nodes.agg(F.max("tree")).first()[0] + 1
    walk = points.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(0))
    at = F.broadcast(nodes.select("tree", "node", "feature", "threshold", "left", "right"))
    for _ in range(max_depth):
        down = F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        walk = walk.join(at, ["tree", "node"]).select(*keys, "x", "tree", F.when(F.col("feature") < 0, F.col("node")).otherwise(down).alias("node"))
    leaves = walk.join(F.broadcast(nodes.select("tree", "node", "value", "weight")), ["tree", "node"])
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("tree", (F.col("value") * F.col("weight")).alias("v")))), F.lit(0.0),
                        lambda acc, t: acc + t["v"])  # in tree order: one value per tree
    sums = leaves.groupBy(*keys).agg(total.alias("total"))
    score = F.col("total") / trees if kind == "forest" else 1.0 / (1.0 + F.exp(-2.0 * F.col("total")))
    return _decided(sums.select(*keys, score.alias("score")), keys)


def _decided(scored: DataFrame, keys: list[str]) -> DataFrame:
    p: Column = F.col("score")
    return scored.select(*keys, (p > 0.5).cast("int").alias("prediction"), p.alias("score"), F.greatest(p, 1 - p).alias("confidence"))
