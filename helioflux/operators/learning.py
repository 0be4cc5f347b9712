"""Forecast models on window features, their selection, and calibration of their probabilities.

Models are Spark's own, and ``network``'s, and fit on the cluster. Rows are (date, t, y, features.., and dense and flux_end if there);
classes weigh the same in all of them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import skill
from .features import NAMES
from .network import Network

SEED = 42
#: Fewer out-of-fold positives than this are calibrated by a sigmoid, fewer than LEAST_POSITIVE by the training rows' own
PLATT_BELOW, LEAST_POSITIVE = 100, 5


def _forest(trees: int, depth: int, leaf: int) -> Callable[[int, int], RandomForestClassifier]:
    return lambda rows, n: RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="sqrt", maxBins=64, seed=SEED)


#: By name: an estimator for so many rows and features
CANDIDATES: dict[str, Callable] = {
    "forest": _forest(400, 8, 3),
    "forest_shallow": _forest(200, 3, 15),
    "logistic": lambda rows, n: LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", regParam=1 / (0.5 * max(rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=200),
    "boosted": lambda rows, n: GBTClassifier(featuresCol="x", labelCol="y", weightCol="weight", maxIter=300, maxDepth=4, stepSize=0.05, seed=SEED),
    "perceptron": lambda rows, n: Network(layers=[n, 32, 16, 1], seed=SEED),
}


def fitted(train: DataFrame, kind: str, names: tuple[str, ...] = NAMES, **params) -> PipelineModel:
    """Standardised features (population deviations) and the model; ``params`` override the estimator's."""
    train = train.withColumn("y", F.col("y").cast("double"))
    n, positive = train.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    share = min(max(positive / max(n, 1), 1e-6), 1 - 1e-6)
    train = train.withColumn("weight", F.when(F.col("y") == 1, 0.5 / share).otherwise(0.5 / (1 - share)))
    scale = math.sqrt(n / (n - 1)) if n > 1 else 1.0
    shape = [VectorAssembler(inputCols=list(names), outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_std", withMean=True), ElementwiseProduct(inputCol="_std", outputCol="x", scalingVec=Vectors.dense([scale] * len(names)))]
    model = CANDIDATES[kind](n, len(names))
    if isinstance(model, RandomForestClassifier):
        # Forests count classes by the largest label; a logistic model that is told of two takes rows of one for the second's.
        train = train.withColumn("y", F.col("y").alias("y", metadata={"ml_attr": {"type": "nominal", "name": "y", "vals": ["0", "1"]}}))
    return Pipeline(stages=[*shape, model.setParams(**params) if params else model]).fit(train)


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with prob."""
    out = model.transform(rows).withColumn("prob", vector_to_array("probability")[1])
    return out.select(*rows.columns, "prob")


def forecast(rows: DataFrame, kind: str, names: tuple[str, ...] = NAMES, **params) -> DataFrame:
    """The last dates' rows with prob, by a model fitted on the dates before."""
    parts = skill.time_split(rows)
    return scored(fitted(parts.where("part = 'train'"), kind, names, **params), parts.where("part = 'test'").drop("part"))


def out_of_fold(train: DataFrame, kind: str, n_folds: int = 5, embargo_s: float = 5400.0, names: tuple[str, ...] = NAMES, **params) -> DataFrame:
    """(fold, test_date and the row's columns, prob): each date scored by a model of the dates before it.

    One model a fold; the folds are few by design, and each fit runs on the cluster.
    """
    rows = skill.folds(train, n_folds, embargo_s)
    out = None
    for fold in sorted(r["fold"] for r in rows.select("fold").distinct().collect()):
        own = rows.where(F.col("fold") == fold)
        part = scored(fitted(own.where("part = 'train'"), kind, names, **params), own.where("part = 'test'"))
        out = part if out is None else out.unionByName(part)
    return rows.where("part = 'test'").limit(0).withColumn("prob", F.lit(None).cast("double")) if out is None else out


def _logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(clipped / (1 - clipped))


class Calibrator:
    """Maps prob to calibrated; fitted on honest probabilities (prob, y). Method "none" leaves prob as it is, but for its ends."""

    def __init__(self, rows: DataFrame, method: str) -> None:
        self.method, self.model = method, None
        if method == "none":
            return
        rows = rows.select(F.col("y").cast("double").alias("label"), "prob")
        if method == "platt":
            z = VectorAssembler(inputCols=["_z"], outputCol="_zv").transform(rows.withColumn("_z", _logit(F.col("prob"))))
            self.model = LogisticRegression(featuresCol="_zv", regParam=1 / (1e6 * max(rows.count(), 1)), standardization=False, maxIter=200).fit(z)
        else:
            self.model = IsotonicRegression(featuresCol="prob").fit(rows)

    @classmethod
    def of(cls, method: str, model: LogisticRegressionModel | IsotonicRegressionModel | None) -> Calibrator:
        """One that is fitted already."""
        out = cls.__new__(cls)
        out.method, out.model = method, model
        return out

    def transform(self, rows: DataFrame) -> DataFrame:
        """rows with calibrated, within [1e-6, 1 - 1e-6]."""
        if self.method == "none":
            return rows.withColumn("calibrated", F.least(F.greatest("prob", F.lit(1e-6)), F.lit(1 - 1e-6)))
        if self.method == "platt":
            a, b = float(self.model.coefficients[0]), float(self.model.intercept)
            value = 1 / (1 + F.exp(-(a * _logit(F.col("prob")) + b)))
            return rows.withColumn("calibrated", value)
        out = self.model.transform(rows)
        return out.withColumn("calibrated", F.least(F.greatest("prediction", F.lit(1e-6)), F.lit(1 - 1e-6))).select(*rows.columns, "calibrated")


def calibrator(oof: DataFrame, own: DataFrame | None = None) -> Calibrator:
    """A sigmoid for few positives, isotonic steps for many; without LEAST_POSITIVE out of fold, a sigmoid of ``own``.

    Without any row out of fold (no fold may be usable) and without ``own``, nothing is known: probabilities stay.
    """
    rows, positive = oof.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if positive < LEAST_POSITIVE and own is not None:
        return Calibrator(own, "platt")
    if not rows:
        return Calibrator(oof, "none")
    return Calibrator(oof, "platt" if positive < PLATT_BELOW else "isotonic")


def trained(rows: DataFrame, kinds: tuple[str, ...] = tuple(CANDIDATES), names: tuple[str, ...] = NAMES, params: dict[str, dict] | None = None) -> tuple[PipelineModel, Calibrator, DataFrame, DataFrame]:
    """The selected model, its calibrator, the table of candidates (model, ordinal, tss, auc) and the test rows with prob and calibrated.

    Selected by ``skill.selected`` against the persistence baseline on the last dates.
    """
    params = params or {}
    parts = skill.time_split(rows)
    train, test = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")
    models = {k: fitted(train, k, names, **params.get(k, {})) for k in kinds}
    table = None
    for i, (k, model) in enumerate(models.items()):
        own = skill.report(scored(model, test)).select(F.lit(k).alias("model"), F.lit(i).alias("ordinal"), "tss", "auc")
        table = own if table is None else table.unionByName(own)
    simple = skill.contingency(test.withColumn("prob", skill.persistence(F.col("flux_end"))), 0.5).first()["tss"]
    best = skill.selected(table, simple).first()["model"]
    oof = out_of_fold(train, best, names=names, **params.get(best, {}))
    mapped = calibrator(oof, scored(models[best], train))
    return models[best], mapped, table, mapped.transform(scored(models[best], test))


def importance(model: PipelineModel, names: tuple[str, ...] = NAMES, top: int = 15) -> DataFrame:
    """(rank, feature, importance) of a forest or boosted trees: a report of the first ``top``."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(names, values, strict=True), key=lambda r: -r[1])[:top]
    return SparkSession.active().createDataFrame([(i + 1, n, float(v)) for i, (n, v) in enumerate(rows)], "rank int, feature string, importance double")


def operating_point(best: DataFrame, objective: str, model: str, n_features: int) -> DataFrame:
    """One row, json: threshold, objective, all_thresholds, model_name, n_features; best is skill.best_thresholds."""
    thresholds = F.create_map(*[x for c in best.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    whole = F.struct(F.col(f"`{objective}`").alias("threshold"), F.lit(objective).alias("objective"), thresholds.alias("all_thresholds"), F.lit(model).alias("model_name"), F.lit(n_features).alias("n_features"))
    return best.select(F.to_json(whole).alias("json"))


def saved(model: PipelineModel, mapped: Calibrator, point: DataFrame, folder: str, names: tuple[str, ...] = NAMES) -> None:
    """Writes the model, its calibrator, operating point and feature names below a folder; nothing is overwritten."""
    model.write().save(f"{folder}/model")
    if mapped.model is not None:
        mapped.model.write().save(f"{folder}/calibrator")
    SparkSession.active().createDataFrame([(json.dumps(mapped.method),)], "method string").write.mode("errorifexists").text(f"{folder}/calibrator_method")
    point.write.mode("errorifexists").text(f"{folder}/operating_point")
    SparkSession.active().createDataFrame([(json.dumps(list(names)),)], "names string").write.mode("errorifexists").text(f"{folder}/feature_names")


@dataclass(frozen=True)
class Forecaster:
    """A model as it was saved: its calibrator, operating point and feature names."""

    model: PipelineModel
    calibrator: Calibrator
    point: dict
    names: tuple[str, ...]

    @property
    def threshold(self) -> float:
        return float(self.point["threshold"])

    def scored(self, rows: DataFrame) -> DataFrame:
        """rows with prob as calibrated, and alarm; rows may be a stream."""
        raw = scored(self.model, rows)
        out = self.calibrator.transform(raw).withColumn("prob", F.col("calibrated"))
        return out.select(*rows.columns, "prob", (F.col("prob") >= self.threshold).alias("alarm"))


def loaded(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES) -> Forecaster:
    """What ``saved`` wrote; raises if the model was made of other features."""
    point = json.loads(spark.read.text(f"{folder}/operating_point").first()[0])
    kept = json.loads(spark.read.text(f"{folder}/feature_names").first()[0])
    if kept != list(names):
        raise ValueError(f"the model has {len(kept)} features, other than the {len(names)} asked for")
    method = json.loads(spark.read.text(f"{folder}/calibrator_method").first()[0])
    kind = {"platt": LogisticRegressionModel, "isotonic": IsotonicRegressionModel}.get(method)
    return Forecaster(PipelineModel.load(f"{folder}/model"), Calibrator.of(method, kind.load(f"{folder}/calibrator") if kind else None), point, names)
