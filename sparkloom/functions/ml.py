"""Scoring and evaluation on pyspark.ml models."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator, ClusteringEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, MaxAbsScaler, MinMaxScaler, RobustScaler, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.errors import UnsupportedError

SCALERS = {"standard": lambda: StandardScaler(withMean=True), "minmax": MinMaxScaler, "robust": RobustScaler, "maxabs": MaxAbsScaler}


def estimator(kind: str, **params: Any):
    """An estimator by a plain name."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R

    table = {
        "kmeans": KMeans, "bisecting_kmeans": BisectingKMeans, "logistic": C.LogisticRegression, "random_forest_classifier": C.RandomForestClassifier, "decision_tree_classifier": C.DecisionTreeClassifier, "gbt_classifier": C.GBTClassifier, "linear_svc": C.LinearSVC,
        "linear": R.LinearRegression, "random_forest_regressor": R.RandomForestRegressor, "decision_tree_regressor": R.DecisionTreeRegressor, "gbt_regressor": R.GBTRegressor,
    }
    if kind not in table:
        raise UnsupportedError(f"model {kind!r}")
    return table[kind](featuresCol="features", **params)


def fit(df: DataFrame, features: list[str], kind: str, scaler: str | None = None, pca: int | None = None, **params: Any) -> PipelineModel:
    """Fit a pipeline of assembler, scaler, PCA and model."""
    stages: list = [VectorAssembler(inputCols=features, outputCol="raw_features", handleInvalid="skip")]
    at = "raw_features"
    if scaler:
        stages.append(SCALERS[scaler]().setInputCol(at).setOutputCol("scaled"))
        at = "scaled"
    if pca:
        stages.append(PCA(k=pca, inputCol=at, outputCol="reduced"))
        at = "reduced"
    return Pipeline(stages=[*stages, estimator(kind, **params).setFeaturesCol(at)]).fit(df)


def score(df: DataFrame, s: dict) -> DataFrame:
    """Apply a model given as an object or a folder; vectors come out as arrays."""
    model = s["model"] if not isinstance(s["model"], str) else PipelineModel.load(s["model"])
    out = model.transform(df).drop("raw_features", "scaled", "reduced", "rawPrediction")
    return out.withColumn("probability", vector_to_array("probability")) if "probability" in out.columns else out


def evaluate(df: DataFrame, s: dict) -> DataFrame:
    """``(metric, value)`` of a scored table."""
    kind = s.get("kind", "regression")
    table = {"regression": (RegressionEvaluator, ["rmse", "mae", "r2"]), "multiclass": (MulticlassClassificationEvaluator, ["accuracy", "f1"]), "binary": (BinaryClassificationEvaluator, ["areaUnderROC"]), "clustering": (ClusteringEvaluator, ["silhouette"])}
    cls, names = table[kind]
    rows = []
    for n in names:
        e = cls(metricName=n)
        if kind != "clustering":
            e = e.setLabelCol(s["label"])
        rows.append((n, float(e.evaluate(df))))
    return df.sparkSession.createDataFrame(rows, "metric string, value double").withColumn("value", F.round("value", 8))
