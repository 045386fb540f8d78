"""Rows stored once for the encoders of all folds, against the vectors of each fold."""

import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from obligor import session
from obligor.operators import logistic, packing, shared_rows
from obligor.operators.encoding import encode
from obligor.plans import training

PARAMS = [{"C": 2.0, "class_weight": None}, {"C": 0.3, "class_weight": "balanced"}]


@pytest.fixture(scope="module")
def prepared(spark):
    rng, rows = random.Random(3), []
    for i in range(360):
        amount = None if rng.random() < 0.1 else float(rng.randrange(50)) ** 4
        flag = rng.choice(["Y", "N", None])
        grade = rng.choice(["low", "medium", "high"])
        product = rng.choice(["a", "b", None]) if i else "once"
        owns = rng.choice([0, 1, None])
        y = int((grade == "high") + (flag == "Y") + rng.random() > 1.1)
        rows.append((i, amount, float(rng.randrange(6)), flag, grade, product, owns, y))
    names = "row_id int, amount double, visits double, flag string, risk_grade string, product string, owns int, default int"
    df = spark.createDataFrame(rows, names).repartition(3)
    return training.prepare(df, training.TrainConfig(folds=3, candidates=["logistic_regression"]))


@pytest.fixture(scope="module")
def states(prepared):
    return training.fit_states(prepared)


def matrices(store, key, scaled):
    view = store.view(key, scaled)
    for row in store.blocks().collect():
        block = shared_rows.Block.of(row.asDict())
        if key is None or block.part != key:
            yield view.matrix(block.numbers, block.codes, block.rows)


@pytest.mark.parametrize("scaled", [True, False])
def test_a_view_is_the_matrix_of_the_vectors(prepared, states, scaled):
    for key, fitted in states.items():
        rows = prepared.train if key is None else prepared.train.where(F.col("fold") != key)
        vectors = PipelineModel(fitted.stages).transform(encode(rows, fitted.state, scaled))
        want = sorted(r["features"].toArray().tolist() for r in vectors.select("features").collect())
        found = np.concatenate([m.T for m in matrices(fitted.rows, key, scaled)])
        assert (found[:, -1] == 1).all()
        assert sorted(found[:, :-1].tolist()) == want


def test_shared_fits_are_those_of_vectors_and_write_none(prepared, states, monkeypatch):
    folds = [0, 1, 2]
    parts = [prepared.train.where(F.col("fold") != k) for k in folds]
    fitted = [states[k] for k in folds]
    monkeypatch.setattr(training, "_shared_rows", lambda *a: None)
    old = training.shared_fits(prepared, "logistic_regression", PARAMS, parts, fitted)
    monkeypatch.undo()
    for f in fitted:
        f.stored.clear()
    new = training.shared_fits(prepared, "logistic_regression", PARAMS, parts, fitted)
    assert not any(f.stored for f in fitted)
    monkeypatch.setattr(logistic, "WARM_ROWS", 0)
    monkeypatch.setattr(shared_rows, "LOTS", 2)
    fitted[0].rows.drop()
    warm = training.shared_fits(prepared, "logistic_regression", PARAMS, parts, fitted)
    known = session._scratch_paths[prepared.train.sparkSession.sparkContext.applicationId]
    assert not any("few-rows" in path for path in known)
    for at, stages in old.items():
        assert np.allclose(new[at][0].fitted.weights, stages[0].fitted.weights, atol=1e-5)
        assert np.allclose(warm[at][0].fitted.weights, stages[0].fitted.weights, atol=1e-5)


def test_linear_scores_are_those_of_the_vectors(prepared, states):
    fitted = training.fit_rows(prepared, prepared.train)
    model = training.fit_model(prepared, "logistic_regression", PARAMS[0], prepared.train, fitted)
    odd = prepared.test.unionByName(prepared.test.withColumn("product", F.lit("new")).withColumn("flag", F.lit("?")))
    seen = training.predictor(model)(odd)
    assert not any(n in seen._jdf.queryExecution().optimizedPlan().toString() for n in ("features", "VectorUDT"))
    want = model.transform(odd).select("row_id", "product", "probs")
    assert sorted(map(str, seen.select("row_id", "product", "probs").collect())) == sorted(map(str, want.collect()))


def test_all_sets_of_a_fold_are_scored_from_one_encoding(prepared, states):
    for f in states.values():
        f.stored.clear()
    oof = training.out_of_fold(prepared, "logistic_regression", PARAMS, states)
    assert oof.groupBy("param_set").count().orderBy("param_set").collect() == [(0, 288), (1, 288)]
    assert not any(f.stored for f in states.values())
    assert oof.groupBy("param_set", "row_id").count().where("count > 1").count() == 0


TREES = {"n_estimators": 6, "max_depth": 3, "learning_rate": 0.3, "subsample": 0.8, "colsample": 1.0}


@pytest.mark.parametrize("classes", [2, 3])
def test_boosted_trees_of_shared_rows_are_those_of_vectors(prepared, states, monkeypatch, classes):
    """Without vectors on disk, which grow with the folds."""
    train = prepared.train
    if classes == 3:
        train = train.withColumn("default", F.when(F.col("visits") > 3, 2).otherwise(F.col("default")))
    sizes = {r["default"]: r["count"] for r in train.groupBy("default").count().collect()}
    of = training.Prepared(**{**vars(prepared), "train": train, "sizes": sizes})
    fitted = [f for f in training.fit_states(of).values()]
    parts = [train if f.key is None else train.where(F.col("fold") != f.key) for f in fitted]
    new = training.shared_fits(of, "xgboost", [TREES], parts, fitted)
    assert not any(f.stored for f in fitted)
    monkeypatch.setattr(training, "_shared_rows", lambda *a: None)
    old = training.shared_fits(of, "xgboost", [TREES], parts, fitted)
    for at, stages in old.items():
        rows = fitted[at[0]].vectors("fitted", parts[at[0]], False, "row_id")
        a, b = (
            [r["p"] for r in PipelineModel(s).transform(rows).orderBy("row_id").select(F.col("probs")[1].alias("p")).collect()]
            for s in (stages, new[at])
        )
        assert np.allclose(a, b, atol=1e-9)


def test_large_forests_are_fitted_one_by_one_and_leave_no_vectors(prepared, states, monkeypatch):
    name, sets = "random_forest", [{"n_estimators": 3, "max_depth": 3, "min_samples_leaf": 2, "class_weight": None}]
    monkeypatch.setattr(training, "FOREST_BYTES", 1)
    running, most = [0], [0]
    real = training.fit_classifier

    def counted(*a):
        running[0] += 1
        most[0] = max(most[0], running[0])
        try:
            return real(*a)
        finally:
            running[0] -= 1

    monkeypatch.setattr(training, "fit_classifier", counted)
    oof, whole = training._searched(prepared, name, sets, states, True)
    assert most == [1] and whole and oof.count() == 288
    assert not any(f.stored for f in states.values())
    assert training._forests_at_once([{"n_estimators": 200}], 10**9) == 1


def test_scores_that_are_missing_are_left_out_where_scores_are_packed(spark):
    names = "_f int, _r int, _class int, hit boolean, score double"
    rows = [(0, 0, 0, True, 0.9), (0, 0, 0, False, 0.1), (0, 0, 0, True, None), (0, 0, 0, False, None), (0, 0, 0, True, 0.05)]
    found = packing.packed_auc(spark.createDataFrame(rows, names), {}).first()
    assert (found["roc_auc"], found["positives"]) == (0.5, 2)
    assert packing.packed_auc(spark.createDataFrame(rows[2:4], names), {}).count() == 0
