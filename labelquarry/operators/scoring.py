"""Classifiers behind one protocol: ``fit(labeled)`` gives a model, ``score(objects)`` adds ``score``.

Scores lie in [−1, 1]; the sign is the class and the size the certainty (the margin classifier
is unbounded). Training sets are small; objects are scored where they lie, without a shuffle.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
from pyspark.ml.classification import (
    LinearSVC,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelquarry.functions.numbers import probability_to_score, sign_class

# Model settings.
FOREST_TREES = 100
FOREST_DEPTH = 10
HIDDEN_UNITS = 32
NETWORK_ITERATIONS = 1000
NETWORK_TOLERANCE = 1e-5
SVM_C = 1.0


class Model(Protocol):
    def score(self, objects: DataFrame) -> DataFrame: ...


class Scorer(Protocol):
    def fit(self, labeled: DataFrame) -> Model: ...


def _vector(features: str) -> Column:
    return array_to_vector(F.col(features).cast("array<double>"))


class LinearScorer:
    """A fixed linear rule, clamped to [−1, 1]. Fails on rows with another number of features; null features score null."""

    def __init__(self, weights: list[float], bias: float = 0.0, features: str = "features"):
        self.weights, self.bias, self.features = weights, bias, features

    def fit(self, labeled: DataFrame) -> "LinearScorer":
        return self

    def column(self) -> Column:
        total = F.lit(float(self.bias))
        for i, w in enumerate(self.weights):
            total = total + F.get(self.features, i).cast("double") * float(w)
        size = F.size(F.col(self.features))
        wrong = F.raise_error(F.concat(F.lit(f"the rule has {len(self.weights)} weights; features: "), size.cast("string"))).cast("double")
        clamped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total))
        return F.when(F.col(self.features).isNull(), F.lit(None)).when(size == len(self.weights), clamped).otherwise(wrong)

    def score(self, objects: DataFrame) -> DataFrame:
        return objects.withColumn("score", self.column())


class _ProbabilityModel:
    def __init__(self, model, features: str):
        self.model, self.features = model, features

    def score(self, objects: DataFrame) -> DataFrame:
        scored = self.model.transform(objects.withColumn("_v", _vector(self.features)))
        return scored.select(
            *objects.columns, probability_to_score(vector_to_array("probability")[1]).alias("score")
        )


def _training_frame(labeled: DataFrame, features: str) -> DataFrame:
    """Binary training rows; ignored ones (label 0) do not take part."""
    return labeled.where(F.col("label") != 0).select(
        _vector(features).alias("_v"), (F.col("label") == 1).cast("double").alias("_y")
    )


class RandomForestScorer:
    """A forest of 100 trees of depth 10 with ⌊√D⌋ features per split; score 2p − 1."""

    def __init__(self, seed: int = 0, features: str = "features"):
        self.seed, self.features = seed, features

    def fit(self, labeled: DataFrame) -> Model:
        forest = RandomForestClassifier(
            featuresCol="_v", labelCol="_y", rawPredictionCol="_raw", predictionCol="_pred",
            numTrees=FOREST_TREES, maxDepth=FOREST_DEPTH, featureSubsetStrategy="sqrt", seed=self.seed,
        )
        return _ProbabilityModel(forest.fit(_training_frame(labeled, self.features)), self.features)


class NetworkScorer:
    """A network with one hidden layer; the input width is taken from the data."""

    def __init__(self, seed: int = 0, features: str = "features", iterations: int = NETWORK_ITERATIONS):
        self.seed, self.features, self.iterations = seed, features, iterations

    def fit(self, labeled: DataFrame) -> Model:
        width = labeled.select(F.size(self.features)).first()[0]
        net = MultilayerPerceptronClassifier(
            featuresCol="_v", labelCol="_y", rawPredictionCol="_raw", predictionCol="_pred",
            layers=[width, HIDDEN_UNITS, 2], maxIter=self.iterations, tol=NETWORK_TOLERANCE, seed=self.seed,
        )
        return _ProbabilityModel(net.fit(_training_frame(labeled, self.features)), self.features)


class _MarginModel:
    def __init__(self, model, lift, features: str):
        self.model, self.lift, self.features = model, lift, features

    def score(self, objects: DataFrame) -> DataFrame:
        lifted = objects.withColumn("_v", array_to_vector(self.lift(F.col(self.features))))
        scored = self.model.transform(lifted)
        return scored.select(*objects.columns, vector_to_array("_raw")[1].alias("score"))


class RbfMarginScorer:
    """Margin classifier with an RBF kernel of γ = 1/D, through random Fourier features.

    Spark ML has linear margins only, so the kernel is approximated; ``components`` sets how closely.
    """

    def __init__(self, seed: int = 0, features: str = "features", components: int = 256):
        self.seed, self.features, self.components = seed, features, components

    def _lift(self, width: int):
        rng = np.random.default_rng(self.seed)
        directions = rng.normal(scale=np.sqrt(2.0 / width), size=(width, self.components))
        phases = rng.uniform(0, 2 * np.pi, self.components)
        norm = np.sqrt(2.0 / self.components)

        @F.pandas_udf("array<double>")
        def lift(features):
            matrix = np.stack(features.to_numpy()).astype("float64")
            return _rows(norm * np.cos(matrix @ directions + phases))

        return lift

    def fit(self, labeled: DataFrame) -> Model:
        width = labeled.select(F.size(self.features)).first()[0]
        lift = self._lift(width)
        rows = labeled.where(F.col("label") != 0).select(
            array_to_vector(lift(F.col(self.features))).alias("_v"),
            (F.col("label") == 1).cast("double").alias("_y"),
        )
        count = rows.count()
        svm = LinearSVC(
            featuresCol="_v", labelCol="_y", rawPredictionCol="_raw", predictionCol="_pred",
            regParam=1.0 / (SVM_C * max(count, 1)), maxIter=200, standardization=False,
        )
        return _MarginModel(svm.fit(rows), lift, self.features)


def _rows(matrix):
    import pandas as pd

    return pd.Series(list(matrix))


def classify(df: DataFrame, tie_positive: bool = True) -> DataFrame:
    return df.withColumn("predicted", sign_class(F.col("score"), tie_positive))


def class_priors(labeled: DataFrame) -> DataFrame:
    """Share of each class among the rows that are not ignored."""
    counts = labeled.where("label <> 0").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("prior", F.col("n") / total)


def insample_accuracy(labeled: DataFrame, scorer: Scorer) -> DataFrame:
    """Share of training rows the fitted model gets right."""
    used = labeled.where("label <> 0")
    scored = classify(scorer.fit(used).score(used))
    return scored.agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))
