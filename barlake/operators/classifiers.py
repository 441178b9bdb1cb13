"""Direction classifiers on MLlib.

The train / evaluate loop runs over estimators on one persisted split; each
evaluation is one aggregate job over the scored test set. Parameters map
from the configuration: the logistic objective matches C * sum(loss) +
||w||^2 / 2 after dividing by C * n (regParam = 1 / (C * n_train), no
internal standardization).
"""

from __future__ import annotations

import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.config import TrainConfig
from barlake.operators import metrics as M
from barlake.schemas import model_columns
from barlake.session import staged

# fixed values: model names and the serving preference order
MODEL_PREFERENCE = ["XGBoost", "RandomForest", "LogisticRegression"]
FEATURES_VEC = "features_vec"


def assembler(feature_cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=feature_cols, outputCol=FEATURES_VEC, handleInvalid="keep")


def estimators(cfg: TrainConfig, n_train: int, label: str) -> dict:
    common = dict(labelCol=label, featuresCol=FEATURES_VEC)
    return {
        "RandomForest": RandomForestClassifier(
            numTrees=cfg.rf_n_estimators, maxDepth=cfg.rf_max_depth,
            minInstancesPerNode=cfg.rf_min_samples_leaf, featureSubsetStrategy="sqrt",
            seed=cfg.random_seed, **common),
        "XGBoost": GBTClassifier(
            maxIter=cfg.gbt_n_estimators, maxDepth=cfg.gbt_max_depth, stepSize=cfg.gbt_learning_rate,
            subsamplingRate=cfg.gbt_subsample, featureSubsetStrategy=str(cfg.gbt_colsample),
            lossType="logistic", seed=cfg.random_seed, **common),
        "LogisticRegression": LogisticRegression(
            regParam=1.0 / (cfg.lr_c * max(n_train, 1)), elasticNetParam=0.0, standardization=False,
            maxIter=cfg.lr_max_iter, **common),
    }


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Class prediction, P(up) and confidence = max class probability (M7)."""
    out = model.transform(df)
    if "probability" in out.columns:
        prob = vector_to_array(F.col("probability"))
        out = out.withColumns({"score": prob[1], "confidence": F.array_max(prob)})
    else:
        out = out.withColumns({"score": F.col("rawPrediction"), "confidence": F.lit(0.5)})
    return out.withColumn("prediction", F.col("prediction").cast("int"))


def train_evaluate(split: DataFrame, cfg: TrainConfig = TrainConfig(), names: list[str] | None = None,
                   feature_cols: list[str] | None = None, models_dir: str | None = None
                   ) -> tuple[DataFrame, dict[str, PipelineModel]]:
    """Fit each estimator on the train side, evaluate on the test side.

    Returns (training_runs table, fitted models). One metrics row per model:
    confusion counts, accuracy, precision, recall, F1, ROC-AUC, train seconds,
    inference ms per row, importances map, params map (K6).
    """
    spark = split.sparkSession
    label = cfg.target_column
    feature_cols = feature_cols or model_columns(split.columns)
    split = staged(split, "split")  # every fit and evaluation reads it
    train = split.where(F.col("split") == "train")
    test = split.where(F.col("split") == "test")
    n_train = train.count()
    n_test = test.count()
    ests = estimators(cfg, n_train, label)
    names = names or ["RandomForest", "XGBoost", "LogisticRegression"]
    rows, models = [], {}
    for ordinal, name in enumerate(names):
        pipe = Pipeline(stages=[assembler(feature_cols), ests[name]])
        t0 = time.time()
        model = pipe.fit(train)
        train_s = time.time() - t0
        scored = score(model, test).select(F.col(label).alias("label"), "prediction", "score")
        t1 = time.time()
        scored = staged(scored, "test-scores")
        infer_ms = (time.time() - t1) / max(n_test, 1) * 1000.0
        m = M.confusion_metrics(scored).first().asDict()
        auc = M.roc_auc(scored).first()["roc_auc"]
        est = model.stages[-1]
        imps = {}
        if hasattr(est, "featureImportances"):
            imps = dict(zip(feature_cols, [float(x) for x in est.featureImportances.toArray()]))
        params = {p.name: str(v) for p, v in ests[name].extractParamMap().items()
                  if p.name not in ("labelCol", "featuresCol", "predictionCol", "probabilityCol", "rawPredictionCol")}
        if models_dir:
            model.write().overwrite().save(f"{models_dir}/{name}")
        models[name] = model
        rows.append({
            "model": name, "ordinal": ordinal, "n_train": n_train, "n_test": n_test,
            **{k: m[k] for k in ("tn", "fp", "fn", "tp")},
            **{k: float(m[k]) for k in ("accuracy", "precision", "recall", "f1")},
            "roc_auc": float(auc) if auc is not None else None,
            "training_time_seconds": round(train_s, 3), "inference_ms_per_row": round(infer_ms, 4),
            "importances": imps, "params": params,
        })
    schema = ("model string, ordinal int, n_train long, n_test long, tn long, fp long, fn long, tp long, "
              "accuracy double, precision double, recall double, f1 double, roc_auc double, "
              "training_time_seconds double, inference_ms_per_row double, "
              "importances map<string,double>, params map<string,string>")
    return spark.createDataFrame(rows, schema), models


def best_fairness(runs: DataFrame, models: dict[str, PipelineModel], table: DataFrame, cfg: TrainConfig = TrainConfig()) -> DataFrame:
    """Accuracy gap between the two named tickers of the best model by F1, over the whole table."""
    best = M.best_by_f1(runs).first()["best_model"]
    scored = score(models[best], table.where(F.col("ticker").isin(list(cfg.fairness_tickers)))).select(
        "ticker", F.col(cfg.target_column).alias("label"), "prediction")
    gap = M.fairness(scored, cfg.fairness_tickers, cfg.fairness_min_rows, cfg.fairness_gap_limit)
    return gap.withColumn("model", F.lit(best))


def summary(runs: DataFrame, baseline_f1) -> DataFrame:
    """Training runs + beats-baseline flag (G17) + best model by F1."""
    best = M.best_by_f1(runs)
    return M.beats_baseline(runs, baseline_f1).withColumn("best_model", best.select("best_model").scalar())


def load_models(spark: SparkSession, models_dir: str, names: list[str] | None = None) -> dict[str, PipelineModel]:
    """Load the saved models that exist, skip the absent ones."""
    out = {}
    jvm_fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names or MODEL_PREFERENCE:
        path = jvm_fs.Path(f"{models_dir}/{name}")
        if path.getFileSystem(conf).exists(path):
            out[name] = PipelineModel.load(f"{models_dir}/{name}")
    return out


def choose_model(models: dict) -> str:
    """First present model in preference order (M8)."""
    for name in MODEL_PREFERENCE:
        if name in models:
            return name
    raise ValueError("no classifier available")


def score_latest(features: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Score each ticker's newest feature row with the preferred model."""
    from barlake.operators.report import latest_row

    name = choose_model(models)
    scored = score(models[name], latest_row(features))
    return scored.select("ticker", "prediction", "confidence", F.lit(name).alias("model"))


def importances_table(runs: DataFrame) -> DataFrame:
    """Feature importances as rows (M9)."""
    return runs.select("model", F.explode("importances").alias("feature", "importance"))


def display_name(name) -> F.Column:
    """Model display name: 'LogisticRegression' -> 'Logistic Regression' etc.."""
    c = F.col(name) if isinstance(name, str) else name
    return F.replace(F.replace(c, F.lit("RandomForest"), F.lit("Random Forest")),
                     F.lit("LogisticRegression"), F.lit("Logistic Regression"))


def side_by_side(rows: DataFrame, models: dict[str, PipelineModel]) -> DataFrame:
    """Every model's prediction and confidence for the same rows, as
    ``pred_<model>`` / ``conf_<model>`` columns (J8): one transform per model, chained."""
    out = rows
    for name in MODEL_PREFERENCE:
        if name not in models:
            continue
        scored = score(models[name], out)
        out = scored.select(*out.columns, F.col("prediction").alias(f"pred_{name}"),
                            F.col("confidence").alias(f"conf_{name}"))
    return out
