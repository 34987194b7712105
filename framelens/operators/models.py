"""Classifier registry on Spark ML.

Where Spark ML has no class of the wanted kind, the substitute is named at the builder. Trees are limited to depth
30 by Spark, and balanced weights are taken over the whole training side instead of per bootstrap sample.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier)
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from framelens.operators import boosting, knn
from framelens.operators.boosting import BoostedFit
from framelens.operators.scoring import complete_probabilities
from framelens.operators.series import stage
from framelens.operators.split import balanced_weight, class_counts

SEED = 42


def label_codec(train: DataFrame, label: str = "label") -> tuple[StringIndexerModel, IndexToString]:
    """Encoder of the sorted label list and its decoder."""
    model = StringIndexer(inputCol=label, outputCol="label_code", stringOrderType="alphabetAsc").fit(train)
    return model, IndexToString(inputCol="label_code", outputCol="decoded", labels=model.labels)


#: Rows whose random features a worker holds at once.
LIFTED_ROWS = 512


class RandomFourier(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a Gaussian kernel (Rahimi and Recht, 2007)."""

    gamma = Param(Params._dummy(), "gamma", "kernel coefficient", TypeConverters.toFloat)
    width = Param(Params._dummy(), "width", "number of features", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed of the projection", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol=None, outputCol=None, gamma=1.0, width=256, seed=SEED):
        super().__init__()
        self._setDefault(gamma=1.0, width=256, seed=SEED)
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, df: DataFrame) -> DataFrame:
        gamma, width, seed = (self.getOrDefault(p) for p in (self.gamma, self.width, self.seed))

        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # once per worker, by input width

        def lift(vec: pd.Series) -> pd.Series:
            x = np.vstack(vec.to_numpy())
            if x.shape[1] not in drawn:
                draw = np.random.default_rng(seed)
                w = draw.normal(0.0, math.sqrt(2.0 * gamma), (x.shape[1], width))
                drawn[x.shape[1]] = w, draw.uniform(0.0, 2.0 * math.pi, width)
            w, shift = drawn[x.shape[1]]
            return pd.Series(list(math.sqrt(2.0 / width) * np.cos(x @ w + shift)))

        @F.pandas_udf("array<double>")
        def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            # Features take many times the room of their rows, so they are made and passed on for a few rows at a time.
            for vec in batches:
                for lo in range(0, len(vec), LIFTED_ROWS):
                    yield lift(vec.iloc[lo:lo + LIFTED_ROWS])

        return df.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


# --- fitted models -------------------------------------------------------------------------------------------

def _write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    spark.range(1).select(F.lit(json.dumps(meta)).alias("value")).coalesce(1).write.mode("overwrite").text(path + "/meta")


def _read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path + "/meta").first()[0])


def _named(df: DataFrame, classes: list[str], shares: Column) -> DataFrame:
    return df.withColumns({f"prob_{c}": F.get(shares, F.lit(i)) for i, c in enumerate(classes)})


@dataclass
class PipelineFit:
    """A fitted Spark ML pipeline; ``output`` tells how class probabilities are obtained."""

    model: PipelineModel
    features: list[str]
    classes: list[str]
    output: str

    def predict(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(df)
        chosen = F.get(F.array(*[F.lit(c) for c in self.classes]), F.col("prediction").cast("int"))
        out = out.withColumn("predicted_label", chosen)
        if self.output == "probability":
            out = _named(out.withColumn("_p", vector_to_array("probability")), self.classes, F.col("_p"))
        else:
            out = out.withColumns({f"prob_{c}": F.when(F.col("predicted_label") == c, 1.0).otherwise(0.0) for c in self.classes})
        added = ["predicted_label", *[f"prob_{c}" for c in self.classes]]
        return complete_probabilities(out.select(*[c for c in df.columns if c not in added], *added))

    def importances(self) -> list[float] | None:
        last = self.model.stages[-1]
        parts = last.models if hasattr(last, "models") else [last]
        if all(hasattr(m, "featureImportances") for m in parts):
            return list(np.mean([m.featureImportances.toArray() for m in parts], axis=0))
        if any(isinstance(s, RandomFourier) for s in self.model.stages):
            return None
        if hasattr(last, "coefficientMatrix") and not hasattr(last, "models"):
            return list(np.abs(last.coefficientMatrix.toArray()).mean(axis=0))
        return list(np.mean([np.abs(m.coefficients.toArray()) for m in parts], axis=0))

    def save(self, spark: SparkSession, path: str, extra: dict) -> None:
        self.model.write().overwrite().save(path + "/model")
        _write_meta(spark, path, {"kind": "pipeline", "features": self.features, "classes": self.classes,
                                  "output": self.output, **extra})


@dataclass
class NeighbourFit:
    """Stored training vectors; prediction is an exact distributed search."""

    train: DataFrame
    features: list[str]
    classes: list[str]
    k: int

    def predict(self, df: DataFrame) -> DataFrame:
        named = stage(df.withColumn("_id", F.monotonically_increasing_id()))
        base, rows = knn.standardize(self.train, [named], self.features)
        near = stage(knn.nearest_neighbours(
            rows.select(F.col("_id").alias("id"), knn.vector(self.features).alias("vec")),
            base.select("id", knn.vector(self.features).alias("vec")), self.k))
        labels = self.train.select(F.col("id").alias("train_id"), "label")
        shares = knn.vote(near, labels)
        weight = lambda c: F.coalesce(F.max(F.when(F.col("label") == c, F.col("share"))), F.lit(0.0))
        wide = shares.groupBy("query_id").agg(*[weight(c).alias(f"prob_{c}") for c in self.classes])
        chosen = knn.classify(near, labels)
        out = named.join(wide, F.col("_id") == F.col("query_id")).drop("query_id").join(
            chosen, F.col("_id") == F.col("query_id")).drop("query_id", "_id")
        return complete_probabilities(out)

    def importances(self) -> None:
        return None

    def save(self, spark: SparkSession, path: str, extra: dict) -> None:
        self.train.write.mode("overwrite").parquet(path + "/train")
        _write_meta(spark, path, {"kind": "neighbours", "features": self.features, "classes": self.classes,
                                  "k": self.k, **extra})


Fit = PipelineFit | BoostedFit | NeighbourFit


def load_bundle(spark: SparkSession, path: str) -> tuple[Fit, dict]:
    meta = _read_meta(spark, path)
    f, c = meta["features"], meta["classes"]
    if meta["kind"] == "pipeline":
        return PipelineFit(PipelineModel.load(path + "/model"), f, c, meta["output"]), meta
    if meta["kind"] == "boost":
        return BoostedFit(boosting.Boost(**meta["spec"]), meta["cuts"], BoostedFit.read_rounds(spark, path), f, c), meta
    return NeighbourFit(spark.read.parquet(path + "/train"), f, c, meta["k"]), meta


# --- builders ------------------------------------------------------------------------------------------------

#: Training rows per partition; an iterative fit of a small side would spend its time on starting tasks. Boosting, whose
#: levels are jobs of their own, takes larger partitions.
ROWS_PER_PARTITION, ROWS_PER_BOOST = 10_000, 50_000


@dataclass(frozen=True)
class Prepared:
    """Training rows with encoded labels and weights."""

    rows: DataFrame
    features: list[str]
    classes: list[str]
    n: int


def prepare(train: DataFrame, features: list[str], weighted: bool) -> Prepared:
    counts = class_counts(train)
    classes = sorted(counts)
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("label")) - 1
    weight = balanced_weight(counts) if weighted else F.lit(1.0)
    rows = train.select(*[F.col(f).cast("double").alias(f) for f in features], "label",
                        code.cast("double").alias("code"), weight.alias("weight"))
    n = sum(counts.values())
    # Written once for all passes of the fit, in partitions sized to the number of rows.
    held = stage(rows.repartition(max(1, -(-n // ROWS_PER_PARTITION))))
    return Prepared(held, features, classes, n)


def _pipeline(p: Prepared, estimator, output: str, scaled: bool = False, between: list | None = None) -> PipelineFit:
    assemble = VectorAssembler(inputCols=p.features, outputCol="_raw" if scaled else "_features", handleInvalid="error")
    stages = [assemble]
    if scaled:
        stages.append(StandardScaler(inputCol="_raw", outputCol="_scaled" if between else "_features", withMean=True, withStd=True))
    stages += [*(between or []), estimator]
    return PipelineFit(Pipeline(stages=stages).fit(p.rows), p.features, p.classes, output)


COMMON = {"featuresCol": "_features", "labelCol": "code", "weightCol": "weight"}


def _forest(p: Prepared, o: dict) -> PipelineFit:
    # The node of each row is kept, as walking every tree from its root for every group of nodes costs more.
    return _pipeline(p, RandomForestClassifier(**COMMON, seed=SEED, cacheNodeIds=True, **o), "probability")


def _tree_model(p: Prepared, o: dict) -> PipelineFit:
    return _pipeline(p, DecisionTreeClassifier(**COMMON, seed=SEED, **o), "probability")


def _logistic(p: Prepared, o: dict) -> PipelineFit:
    fit = LogisticRegression(**COMMON, family="multinomial", regParam=1.0 / p.n, standardization=False, **o)
    return _pipeline(p, fit, "probability", scaled=True)


def _svm(p: Prepared, o: dict, between: list | None = None) -> PipelineFit:
    one = LinearSVC(featuresCol="_features", labelCol="code", regParam=1.0 / p.n, standardization=False, **o)
    return _pipeline(p, OneVsRest(classifier=one, **COMMON, parallelism=3), "vote", scaled=True, between=between)


def _kernel_svm(p: Prepared, o: dict) -> PipelineFit:
    """Gaussian kernel through random Fourier features; scaled inputs have unit variance, so gamma is 1/features."""
    o = dict(o)
    width = o.pop("width")
    lift = RandomFourier(inputCol="_scaled", outputCol="_features", gamma=1.0 / len(p.features), width=width)
    return _svm(p, o, [lift])


def _neighbours(p: Prepared, o: dict) -> NeighbourFit:
    kept = stage(p.rows.select(*p.features, "label").withColumn("id", F.monotonically_increasing_id()))
    return NeighbourFit(kept, p.features, p.classes, o["k"])


def boosted(prepared: list[tuple[Prepared, dict]]) -> list[BoostedFit]:
    """Boosted models, all grown together."""
    sides: dict[int, boosting.Side] = {}
    wanted = []
    for p, o in prepared:
        side = sides.setdefault(id(p), boosting.Side(p.rows.coalesce(max(1, -(-p.n // ROWS_PER_BOOST))), p.features, p.n))
        wanted.append((side, boosting.Boost(classes=len(p.classes), seed=SEED, **o)))
    fits = boosting.boost(wanted)
    for fit, (p, _) in zip(fits, prepared):
        fit.classes = p.classes
    return fits


def boost_one(p: Prepared, o: dict) -> BoostedFit:
    return boosted([(p, o)])[0]


@dataclass(frozen=True)
class ModelSpec:
    key: str
    label: str
    build: Callable[[Prepared, dict], Fit]
    options: dict
    weighted: bool = True


# The ten models with their settings.
REGISTRY = {m.key: m for m in (
    ModelSpec("random_forest", "Random Forest", _forest, {"numTrees": 300, "maxDepth": 30}),
    ModelSpec("extra_trees", "Extra Trees", _forest,
              {"numTrees": 400, "maxDepth": 30, "bootstrap": False, "featureSubsetStrategy": "sqrt", "maxBins": 16}),
    ModelSpec("gradient_boosting", "Gradient Boosting", boost_one, {"kind": "residual", "rounds": 100, "depth": 3, "rate": 0.1}),
    ModelSpec("decision_tree", "Decision Tree", _tree_model, {"maxDepth": 30}),
    ModelSpec("adaboost", "AdaBoost", boost_one, {"kind": "samme", "rounds": 300, "depth": 2, "rate": 0.05}),
    ModelSpec("logistic_regression", "Logistic Regression", _logistic, {"maxIter": 4000}),
    ModelSpec("linear_svm", "Linear SVM", _svm, {"maxIter": 6000}),
    ModelSpec("rbf_svm", "RBF SVM", _kernel_svm, {"maxIter": 1000, "width": 256}),
    ModelSpec("knn", "KNN", _neighbours, {"k": 7}, weighted=False),
    ModelSpec("xgboost", "XGBoost", boost_one,
              {"kind": "newton", "rounds": 400, "depth": 6, "rate": 0.05, "penalty": 1.0, "least": 1.0, "rows": 0.9, "columns": 0.9},
              weighted=False),
)}


def resolve_models(names: str | list[str] = "all") -> list[str]:
    """``all``, a comma list, or a list; an unknown name is an error."""
    wanted = list(REGISTRY) if names == "all" else names.split(",") if isinstance(names, str) else list(names)
    wanted = [w.strip() for w in wanted]
    unknown = [w for w in wanted if w not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown model: {', '.join(unknown)}")
    return wanted


def train_model(key: str, train: DataFrame, features: list[str], options: dict | None = None) -> Fit:
    spec = REGISTRY[resolve_models(key)[0]]
    return spec.build(prepare(train, features, spec.weighted), {**spec.options, **(options or {})})


def feature_importance(spark: SparkSession, fit: Fit) -> DataFrame | None:
    """Importance per feature, largest first; one row per feature."""
    values = fit.importances()
    if values is None:
        return None
    rows = [(f, float(v)) for f, v in zip(fit.features, values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
