"""Shared logistic fits against Spark's own, one at a time."""

import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from obligor.operators import logistic

PARAMS = [{"C": 0.5}, {"C": 20.0}, {"C": 3.0, "max_iter": 500}]


def frame(spark, seed, n, classes):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x = [rng.gauss(0, 1), rng.gauss(1, 2), float(rng.random() < 0.3), 0.0]
        x.append(1.0 - x[2])
        y = int(x[0] + x[2] + rng.gauss(0, 1) > 0.4) + (classes > 2 and rng.random() < 0.3)
        sparse = Vectors.sparse(5, [(k, v) for k, v in enumerate(x) if v])
        rows.append((i, Vectors.dense(x) if i % 2 else sparse, int(y)))
    return spark.createDataFrame(rows, ["id", "features", "y"]).repartition(3)


def sizes(df):
    return {r["y"]: r["count"] for r in df.groupBy("y").count().collect()}


def weights_of(df):
    held = sizes(df)
    total = sum(held.values())
    return [dict.fromkeys(held, 1.0), {k: total / (len(held) * n) for k, n in held.items()}, dict.fromkeys(held, 1.0)]


def probabilities(df, model):
    return np.array([r.probability.toArray() for r in model.transform(df).orderBy("id").select("probability").collect()])


@pytest.mark.parametrize("classes", [2, 3])
def test_equal_to_separate_fits(spark, classes, monkeypatch):
    parts = [frame(spark, 1, 220, classes), frame(spark, 2, 160, classes)]
    weights = [weights_of(p) for p in parts]
    fits = logistic.fit_all(parts, PARAMS, weights, classes, "y")
    assert sorted(fits) == [(p, s) for p in range(2) for s in range(3)]
    for (part, at), found in fits.items():
        df, held = parts[part], weights[part][at]
        weight = F.create_map(*[F.lit(v) for pair in held.items() for v in pair])[F.col("y")]
        own = LogisticRegression(
            labelCol="y", weightCol="w", standardization=False, maxIter=1000, tol=1e-12,
            regParam=1 / (PARAMS[at]["C"] * df.count()), family="multinomial" if classes > 2 else "binomial",
        ).fit(df.withColumn("w", weight))
        ours = logistic.LogisticModel(model=found.to_json())
        assert np.allclose(probabilities(df, ours), probabilities(df, own), atol=2e-5)
        if classes == 2:
            assert np.allclose(found.weights[0][:-1], own.coefficients.toArray(), atol=2e-4)
    monkeypatch.setattr(logistic, "DRIVER_BYTES", 0)
    monkeypatch.setattr(logistic, "STATE_BYTES", 1)
    monkeypatch.setattr(logistic, "CROSSED_WIDTH", 2)
    again = logistic.fit_all(parts[:1], PARAMS[:2], weights, classes, "y")
    for key, found in again.items():
        assert np.allclose(probabilities(parts[0], logistic.LogisticModel(model=found.to_json())),
                           probabilities(parts[0], logistic.LogisticModel(model=fits[key].to_json())), atol=1e-5)


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(2)
    x, labels, of_class = rng.normal(size=(30, 4)), rng.integers(0, 3, 30), np.array([1.0, 0.5, 2.0])
    row, column = np.repeat(np.arange(30), 4), np.tile(np.arange(4), 30)
    for margins, y in ((3, labels), (1, labels % 2)):
        point = rng.normal(size=(margins, 5))
        found = logistic.judged(point, y, row, column, x.ravel(), of_class)
        for at in range(point.size):
            near = []
            for d in (1e-5, -1e-5):
                moved = point.copy().ravel()
                moved[at] += d
                near.append(logistic.judged(moved.reshape(point.shape), y, row, column, x.ravel(), of_class)[0])
            assert found[1 + at] == pytest.approx((near[0] - near[1]) / 2e-5, rel=1e-4, abs=1e-6)


def test_number_of_passes_is_that_of_the_slowest_fit(spark, monkeypatch):
    df = frame(spark, 3, 120, 2)
    passes = []
    gathered = logistic._gathered
    monkeypatch.setattr(logistic, "_gathered", lambda *a: passes.append(1) or gathered(*a))
    alone = []
    for at in range(2):
        logistic.fit_all([df], PARAMS[at : at + 1], [weights_of(df)[at:]], 2, "y")
        alone.append(len(passes))
        passes.clear()
    logistic.fit_all([df, df, df], PARAMS[:2], [weights_of(df)] * 3, 2, "y")
    assert len(passes) <= max(alone) + 1 <= 20


def test_empty_vectors_and_a_missing_part(spark):
    rows = [(0, Vectors.sparse(3, []), 0), (1, Vectors.dense([0.0, 0.0, 0.0]), 1), (2, Vectors.sparse(3, [(1, 2.0)]), 1)]
    df = spark.createDataFrame(rows, ["id", "features", "y"])
    found = logistic.fit_all([df], [{"C": 1.0}], [[{0: 1.0, 1: 1.0}]], 2, "y")[0, 0]
    got = probabilities(df, logistic.LogisticModel(model=found.to_json()))
    assert got[0] == pytest.approx(got[1]) and got[2][1] > got[0][1]
    with pytest.raises(ValueError):
        logistic.fit_all([df, df.where("id < 0")], [{"C": 1.0}], [[{0: 1.0, 1: 1.0}]] * 2, 2, "y")


def test_two_classes_take_few_passes_and_the_curvature_is_that_of_the_loss(spark, monkeypatch):
    """Newton's steps: related columns and very different scales cost no extra passes."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        x = [rng.gauss(0, 1), rng.gauss(0, 30), float(rng.random() < 0.3)]
        x += [x[0] + 0.05 * rng.gauss(0, 1), 1.0 - x[2], rng.random() ** 8]
        rows.append((i, Vectors.dense(x), int(x[0] + 0.05 * x[1] + 3 * x[5] + rng.gauss(0, 0.6) > 0.8)))
    df = spark.createDataFrame(rows, ["id", "features", "y"]).repartition(3)
    passes = []
    gathered = logistic._gathered
    monkeypatch.setattr(logistic, "_gathered", lambda *a: passes.append(1) or gathered(*a))
    logistic.fit_all([df], [{"C": 50.0}], [[dict.fromkeys((0, 1), 1.0)]], 2, "y")
    assert len(passes) <= 11
    x, labels, of_class = np.random.default_rng(5).normal(size=(30, 3)), np.arange(30) % 2, np.array([1.0, 2.0])
    row, column = np.repeat(np.arange(30), 3), np.tile(np.arange(3), 30)
    point = np.array([[0.3, -0.2, 0.5, 0.1]])
    found = logistic.judged_whole(point, labels, x, of_class, True)
    assert np.allclose(found[:5], logistic.judged(point, labels, row, column, x.ravel(), of_class))
    for at in range(4):
        step = np.zeros((1, 4))
        step[0, at] = 1e-5
        near = [logistic.judged_whole(point + d * step, labels, x, of_class, False)[1:] for d in (1, -1)]
        assert np.allclose(found[5:].reshape(4, 4)[at], (near[0] - near[1]) / 2e-5, rtol=1e-4, atol=1e-6)
