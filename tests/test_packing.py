import numpy as np
import pytest
from pyspark.sql import functions as F

from obligor import session
from obligor.operators import explain
from obligor.operators.packing import packed_auc


def pairs_auc(hits, scores):
    """Share of ordered pairs, ties half; NaN is the largest score."""
    up, down = ([s for h, s in zip(hits, scores, strict=True) if h == side] for side in (True, False))
    if not up or not down:
        return None
    big = [[float("inf") if s != s else s for s in part] for part in (up, down)]
    return np.mean([(a > b) + (a == b) / 2 for a in big[0] for b in big[1]])


@pytest.mark.parametrize("edges", [{}, {(0, 0): [0.2, 0.5], (1, 0): [0.5, float("nan")]}])
def test_auc_of_keys_matches_brute_force(spark, edges):
    draw = np.random.default_rng(5)
    rows = []
    for f, r in ((0, 0), (0, 1), (1, 0), (70_000, 2)):
        scores = draw.random(60).round(1)
        scores[:6] = [float("nan"), float("nan"), 0.0, 0.0, 1e-300, 0.5]
        rows += [(f, r, 0, bool(h), float(s)) for h, s in zip(draw.random(60) < 0.4, scores, strict=True)]
    rows += [(2, 0, 0, True, 0.1), (2, 0, 0, True, 0.3)]
    df = spark.createDataFrame(rows, "_f int, _r int, _class int, hit boolean, score double").repartition(3)
    out = {(o["_f"], o["_r"]): o for o in packed_auc(df, edges, pack_rows=7).collect()}
    for f, r in {(x[0], x[1]) for x in rows}:
        mine = [x for x in rows if x[:2] == (f, r)]
        want = pairs_auc([x[3] for x in mine], [x[4] for x in mine])
        assert out[f, r]["roc_auc"] == (want if want is None else pytest.approx(want))
        assert out[f, r]["positives"] == sum(x[3] for x in mine)


def predict(df):
    p = 0.1 + 0.5 * F.col("a") + 0.2 * F.col("a") * F.col("b")
    return df.withColumn("probs", F.array(1 - p, p))


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(2)
    data = [(i, *map(float, draw.random(2).round(2))) for i in range(150)]
    return spark.createDataFrame([(*d, int(d[1] > 0.4)) for d in data], "id bigint, a double, b double, y int")


def test_importance_shuffles_no_table_of_scores(spark, rows):
    """Distinct scores were written and shuffled again, one row each."""
    held = session._scratch_paths.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    explain.permutation_importance(rows, predict, "y", ["a", "b"], "id", repeats=2).collect()
    assert not [p for p in held[before:] if "/scores-" in p]


def test_cells_do_not_change_importance(rows):
    whole, cut = (
        explain.permutation_importance(rows, predict, "y", ["a", "b"], "id", repeats=3, **more).collect()
        for more in ({}, {"cell_rows": 20})
    )
    assert [r["feature"] for r in whole] == [r["feature"] for r in cut]
    for one, other in zip(whole, cut, strict=True):
        assert one["importance_mean"] == pytest.approx(other["importance_mean"], abs=1e-12)
        assert one["importance_std"] == pytest.approx(other["importance_std"], abs=1e-12)


def test_importance_of_three_classes(rows):
    """The base score of the classes, each against the rest, weighted by their rows."""

    def thirds(df):
        a = F.col("a")
        return df.withColumn("probs", F.array(1 - a, a * (1 - F.col("b")), a * F.col("b")))

    classes = rows.withColumn("y", F.when(F.col("a") > 0.7, 2).when(F.col("a") > 0.3, 1).otherwise(0))
    out = {r["feature"]: r for r in explain.permutation_importance(classes, thirds, "y", ["a", "b"], "id", 3, 4).collect()}
    local = thirds(classes).toPandas()
    base = sum(
        (local["y"] == k).mean() * pairs_auc(local["y"] == k, [p[k] for p in local["probs"]]) for k in range(3)
    )
    # Permuted scores of ``a`` know nothing of the class, so about half of the pairs are in order.
    assert out["a"]["importance_mean"] == pytest.approx(base - 0.5, abs=0.1)
    assert abs(out["b"]["importance_mean"]) < 0.2
