"""Candidate classifiers and their search spaces."""

from __future__ import annotations

import random
from collections.abc import Callable
from typing import Any

from pyspark.ml import Estimator, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Candidate order, scaling and the ranges parameters are drawn from.
CANDIDATES = ("logistic_regression", "ridge_logistic_regression", "random_forest", "xgboost")
SCALED = ("logistic_regression", "ridge_logistic_regression")
LINEAR = SCALED
BOOSTED = ("xgboost",)
SEARCH_ITERATIONS = 8
MAX_ITERATIONS = 2000
CLASS_WEIGHTS = (None, "balanced")
# Spark's own limit of the depth of a tree, which stands for an unlimited one.
DEEPEST = 30

Draw = Callable[[random.Random], dict[str, Any]]

SPACES: dict[str, Draw] = {
    "logistic_regression": lambda r: {
        "C": r.uniform(0.05, 8.05),
        "class_weight": r.choice(CLASS_WEIGHTS),
    },
    "ridge_logistic_regression": lambda r: {
        "C": r.uniform(0.05, 5.05),
        "class_weight": r.choice(CLASS_WEIGHTS),
    },
    "random_forest": lambda r: {
        "n_estimators": r.randrange(150, 450),
        "max_depth": r.choice((3, 4, 5, 8, None)),
        "min_samples_leaf": r.randrange(2, 12),
        "class_weight": r.choice(CLASS_WEIGHTS),
    },
    "xgboost": lambda r: {
        "n_estimators": r.randrange(80, 260),
        "max_depth": r.randrange(2, 5),
        "learning_rate": r.uniform(0.025, 0.175),
        "subsample": r.uniform(0.65, 0.95),
        "colsample": r.uniform(0.65, 0.95),
    },
}


def sample_params(
    name: str, n_iter: int = SEARCH_ITERATIONS, seed: int = 42, deepest: int = DEEPEST
) -> list[dict]:
    """Parameter sets of the random search, the same for the same seed.

    ``deepest`` takes the place of an unlimited depth and is what the sets report.
    """
    draw = random.Random(seed)
    drawn = [SPACES[name](draw) for _ in range(n_iter)]
    return [
        {k: deepest if k == "max_depth" and v is None else v for k, v in params.items()}
        for params in drawn
    ]


def build_estimator(name: str, params: dict[str, Any], seed: int = 42) -> Estimator:
    """Classifier of ``pyspark.ml`` over ``features``, ``default`` and ``weight``."""
    if name == "random_forest":
        return RandomForestClassifier(
            featuresCol="features",
            labelCol="default",
            weightCol="weight",
            numTrees=params["n_estimators"],
            maxDepth=params["max_depth"] or DEEPEST,
            minInstancesPerNode=params["min_samples_leaf"],
            bootstrap=params.get("bootstrap", True),
            featureSubsetStrategy="sqrt",
            seed=seed,
        )
    raise ValueError(f"Unknown candidate '{name}'. Known candidates: {', '.join(CANDIDATES)}")


class ClassProbabilities(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Add the array ``probs`` and drop the vectors of the classifier."""

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.withColumn("probs", vector_to_array(F.col("probability"))).drop(*_VECTORS)


_VECTORS = ("features", "rawPrediction", "probability", "prediction")
