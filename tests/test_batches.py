import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from obligor.operators import boosting, explain, logistic
from obligor.plans import training
from obligor.session import NO_BATCH_BYTES, unmeasured_batches

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def limit(spark):
    yield lambda: spark.conf.get(LIMIT, None)
    spark.conf.unset(LIMIT)


@pytest.fixture
def loans(spark):
    rows = spark.range(600).select(
        F.col("id").alias("row_id"),
        (F.col("id") * 37 % 101).cast("double").alias("amount"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"),
    )
    risk = F.col("amount") + F.when(F.col("kind") == "a", 30).otherwise(0)
    return rows.withColumn("default", (risk + F.col("row_id") % 17 > 70).cast("int"))


def test_the_limit_is_lifted_and_comes_back(spark, limit):
    with unmeasured_batches(spark):
        with unmeasured_batches(spark):
            assert limit() == NO_BATCH_BYTES
        assert limit() == NO_BATCH_BYTES
    assert limit() is None


def test_a_limit_of_the_user_is_kept(spark, limit):
    spark.conf.set(LIMIT, "4096")
    with unmeasured_batches(spark):
        assert limit() == "4096"
    assert limit() == "4096"


def test_the_limit_comes_back_after_an_error(spark, limit):
    with pytest.raises(ValueError), unmeasured_batches(spark):
        raise ValueError
    assert limit() is None


def vectors(spark):
    rows = [(i, i % 2, Vectors.dense([float(i % 7), 1.0])) for i in range(40)]
    return spark.createDataFrame(rows, ["row_id", "default", "features"])


@pytest.mark.parametrize("fit", ["boost", "fit_all"])
def test_rows_are_packed_without_measuring_them_and_blocks_are_measured(spark, limit, monkeypatch, fit):
    module = boosting if fit == "boost" else logistic
    seen = {"_packed": [], "_summed": []}
    for name, calls in seen.items():
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real, calls=calls: calls.append(limit()) or real(*a))
    if fit == "boost":
        params = {"n_estimators": 1, "max_depth": 1, "learning_rate": 0.1, "subsample": 1.0, "colsample": 1.0}
        boosting.boost([vectors(spark)], [params], 2, F.col("row_id"), "default")
    else:
        logistic.fit_all([vectors(spark)], [{"C": 1.0}], [[{0: 1.0, 1: 1.0}]], 2, "default")
    assert seen["_packed"] == [NO_BATCH_BYTES]
    assert set(seen["_summed"]) == {None}


def test_permuted_scores_are_packed_without_measuring_them(spark, limit, monkeypatch):
    seen, real = [], explain.packed_auc
    monkeypatch.setattr(explain, "packed_auc", lambda *a: seen.append(limit()) or real(*a))
    rows = spark.range(40).select("id", (F.col("id") % 2).alias("y"), F.col("id").cast("double").alias("x"))

    def predict(df):
        p = F.col("x") / 40
        return df.withColumn("probs", F.array(1 - p, p))

    explain.permutation_importance(rows, predict, "y", ["x"], "id", repeats=2)
    assert seen == [NO_BATCH_BYTES]


SETS = {
    "logistic_regression": {"C": 1.0, "class_weight": None},
    "random_forest": {"n_estimators": 3, "max_depth": 3, "min_samples_leaf": 2, "class_weight": None},
    "xgboost": {"n_estimators": 4, "max_depth": 2, "learning_rate": 0.3, "subsample": 0.8, "colsample": 1.0},
}


@pytest.mark.parametrize("name", SETS)
def test_a_single_set_is_fitted_on_all_rows_beside_its_folds(spark, loans, monkeypatch, name):
    config = training.TrainConfig(folds=3, candidates=[name], space={name: [SETS[name]]})
    prepared = training.prepare(loans, config)
    states = training.fit_states(prepared)
    alone = training.fit_model(prepared, name, SETS[name], prepared.train, states[None])
    calls, real = [], training.shared_fits
    monkeypatch.setattr(training, "shared_fits", lambda *a: calls.append(len(a[3])) or real(*a))
    _, model, _ = training.run_candidate(prepared, name, states)
    assert calls == ([] if name == "random_forest" else [4])

    def scores(of):
        rows = training.predictor(of)(prepared.test).select("row_id", F.col("probs")[1].alias("p"))
        return {r["row_id"]: r["p"] for r in rows.collect()}

    assert scores(model) == pytest.approx(scores(alone), abs=1e-9)
