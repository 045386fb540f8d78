import itertools

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from obligor.operators import explain
from obligor.session import pin

FEATURES = ["a", "b", "c"]


def predict(df):
    """Known model: strong in a, an interaction of a and b, nothing in c."""
    p = 0.1 + 0.5 * F.col("a") + 0.2 * F.col("a") * F.col("b")
    return df.withColumn("probs", F.array(1 - p, p))


def known(a, b):
    return 0.1 + 0.5 * a + 0.2 * a * b


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    data = [(i, *map(float, draw.random(3).round(3))) for i in range(120)]
    data = [(i, a, b, c, int(known(a, b) > 0.4)) for i, a, b, c in data]
    return pin(spark.createDataFrame(data, "id bigint, a double, b double, c double, y int"))


def test_permutation_importance_finds_the_driver(rows):
    out = explain.permutation_importance(rows, predict, "y", FEATURES, "id", repeats=5).collect()
    assert [r["feature"] for r in out] == ["a", "b", "c"]
    assert out[0]["importance_mean"] > 0.2
    assert out[2]["importance_mean"] == pytest.approx(0.0) and out[2]["importance_std"] == pytest.approx(0.0)


def test_permutation_is_reproducible(rows):
    def once(df):
        out = explain.permutation_importance(df, predict, "y", FEATURES, "id", repeats=3)
        return {r["feature"]: r["importance_mean"] for r in out.collect()}

    assert once(rows) == pytest.approx(once(rows.repartition(5)))


def test_index_maps_are_permutations():
    for n in (1, 2, 12, 97):
        for step, shift in explain._rotations(n, 4, 1):
            assert sorted((step * i + shift) % n for i in range(n)) == list(range(n))


def test_partial_dependence_matches_brute_force(rows):
    local = rows.toPandas()
    out = explain.partial_dependence(rows, predict, ["a", "missing", "b"]).toPandas()
    assert set(out["feature"]) == {"a", "b"}
    grid = np.linspace(*np.quantile(local["a"], [0.05, 0.95]), 100)
    mine = out[out["feature"] == "a"].sort_values("grid_value")
    assert np.allclose(mine["grid_value"], grid)
    assert np.allclose(mine["average"], [known(g, local["b"]).mean() for g in grid])


def test_short_value_lists_are_their_own_grid(spark):
    df = spark.range(50).select((F.col("id") % 4).alias("a"))
    assert explain.dependence_grid(df, "a") == [0.0, 1.0, 2.0, 3.0]


def test_shapley_values_match_all_orders(rows):
    sample = rows.where("id < 6")
    local = sample.orderBy("id").toPandas()
    # Three features and their reversals: enough orders make the sampled mean close.
    out = explain.shapley_values(sample, predict, FEATURES, "id", orders=60).toPandas()
    got = out.pivot(index="id", columns="feature", values="shapley")
    mean = np.mean([known(a, b) for a, b in zip(local["a"], local["b"], strict=True)])
    for _, row in local.iterrows():
        total = known(row["a"], row["b"]) - mean
        assert got.loc[row["id"]].sum() == pytest.approx(total)
        exact = dict.fromkeys(FEATURES, 0.0)
        for order in itertools.permutations(FEATURES):
            for back in local.itertuples():
                point = {"a": back.a, "b": back.b, "c": back.c}
                for name in order:
                    before = known(point["a"], point["b"])
                    point[name] = row[name]
                    exact[name] += (known(point["a"], point["b"]) - before) / (6 * len(local))
        for name in FEATURES:
            assert got.loc[row["id"], name] == pytest.approx(exact[name], abs=0.01)


def test_summary_orders_by_size(rows):
    values = explain.shapley_values(rows, predict, FEATURES, "id", rows=10)
    out = explain.shapley_summary(values, 2).collect()
    assert [r["feature"] for r in out] == ["a", "b"]
    assert values.select("id").distinct().count() == 10


def with_features(df, names):
    return df.withColumn("features", array_to_vector(F.array(*names)))


def test_sparse_walks_give_the_dense_values(rows):
    sample = rows.where("id < 12").withColumn("c", (F.col("id") % 3 == 0).cast("double"))

    def of_vector(df):
        slots = vector_to_array("features")
        return predict(df.withColumns({c: slots[k] for k, c in enumerate(FEATURES)}))

    dense = explain.shapley_values(sample, predict, FEATURES, "id", seed=3)
    sparse = explain.shapley_of_vectors(with_features(sample, FEATURES), of_vector, FEATURES, "id", seed=3)
    want = {(r["id"], r["feature"]): r["shapley"] for r in dense.collect()}
    got = {(r["id"], r["feature"]): r["shapley"] for r in sparse.collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_walks_do_not_follow_the_number_of_categories(spark):
    width, n = 2500, 30
    rows = [(i, Vectors.sparse(width, [(0, float(i)), (1 + i * 80, 1.0)])) for i in range(n)]
    df = spark.createDataFrame(rows, ["id", "features"])
    seen = []

    def of_vector(df):
        points = pin(df)
        seen.append(points.count())
        first = F.get(F.unwrap_udt("features")["values"], 0) / 100
        return points.withColumn("probs", F.array(1 - first, first))

    names = [f"c{k}" for k in range(width)]
    out = explain.shapley_of_vectors(df, of_vector, names, "id")
    sums = {r["id"]: r["s"] for r in out.groupBy("id").agg(F.sum("shapley").alias("s")).collect()}
    assert out.count() == n * width and seen[0] <= 8 * n * n * 4
    assert len(sums) == n
