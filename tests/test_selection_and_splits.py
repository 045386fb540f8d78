import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from obligor.operators import encoding, running, selection, splitting, weights
from obligor.session import pin

SMALL = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def values_of(spark, groups):
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    return pin(spark.createDataFrame(rows, "g string, v double"))


@SMALL
@given(
    st.lists(
        st.one_of(
            st.floats(-1e300, 1e300, allow_nan=False),
            st.sampled_from([0.0, 1.0, 1e-9, 1e200]),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_order_statistics_match_sorting(spark, numbers):
    ordered = sorted(numbers)
    ranks = sorted({0, len(ordered) // 3, len(ordered) // 2, len(ordered) - 1})
    hits = selection.order_statistics(
        values_of(spark, {"a": numbers}), {"a": ranks}, exact_rows=4, bins=4
    )
    for rank in ranks:
        hit = hits["a", rank]
        assert hit.value == ordered[rank]
        assert hit.below == sum(v < ordered[rank] for v in ordered)
        assert hit.ties == sum(v == ordered[rank] for v in ordered)


def test_one_value_holding_most_rows(spark):
    numbers = [0.5] * 900 + [i / 100 for i in range(100)]
    hits = selection.order_statistics(
        values_of(spark, {"a": numbers}), {"a": [0, 500, 999]}, exact_rows=10, bins=8
    )
    assert hits["a", 500].value == 0.5 and hits["a", 500].ties == 901
    assert hits["a", 0].value == 0.0 and hits["a", 999].value == 0.99


def test_ranks_outside_a_group_are_refused(spark):
    with pytest.raises(ValueError):
        selection.order_statistics(values_of(spark, {"a": [1, 2]}), {"a": [2]})
    with pytest.raises(ValueError):
        selection.order_statistics(values_of(spark, {"a": [1, 2]}), {"b": [0]})


def test_quantiles_match_numpy(spark):
    draw = np.random.default_rng(3)
    groups = {"n": draw.normal(size=301), "e": np.exp(draw.normal(size=250) * 3), "one": [4.0]}
    points = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    for limits in ({}, {"exact_rows": 20, "bins": 8}):
        got = selection.quantiles(values_of(spark, groups), points, **limits)
        for name, numbers in groups.items():
            assert got[name] == pytest.approx(list(np.quantile(numbers, points)), rel=1e-12)


def test_long_ids_beyond_double_precision(spark):
    base = 2**60
    df = spark.range(1000).select(F.lit("a").alias("g"), (F.col("id") + base).alias("v"))
    hits = selection.order_statistics(pin(df), {"a": [0, 123, 999]}, exact_rows=5, bins=4)
    assert [hits["a", r].value for r in (0, 123, 999)] == [base, base + 123, base + 999]


@pytest.mark.parametrize("limits", [{}, {"exact_rows": 8, "bins": 4}])
def test_cuts_break_ties_by_id(spark, limits):
    rows = pin(
        spark.range(300).select(
            F.lit("a").alias("g"), (F.col("id") % 3).cast("double").alias("v"), "id"
        )
    )
    ordered = sorted((i % 3, i) for i in range(300))
    cuts = selection.rank_cuts(rows, {"a": [0, 50, 99, 150, 298]}, **limits)
    for rank in (0, 50, 99, 150, 298):
        after = selection.after_cut(F.col("v"), F.col("id"), cuts["a", rank])
        kept = {r["id"] for r in rows.where(~after).collect()}
        assert kept == {i for _, i in ordered[: rank + 1]}


@pytest.mark.parametrize("window_rows", [10_000, 40])
def test_running_totals(spark, window_rows):
    draw = np.random.default_rng(1)
    data = [(int(k), float(v), int(w)) for k, v, w in zip(
        draw.integers(0, 3, 400), draw.random(400).round(4), draw.integers(0, 5, 400), strict=True
    )]
    data = list({(k, v): (k, v, w) for k, v, w in data}.values())
    table = pin(spark.createDataFrame(data, "k int, v double, w bigint"))
    out = running.running_totals(table, ["k"], "v", ["w"], True, window_rows).collect()
    for row in out:
        assert row["w_before"] == sum(w for k, v, w in data if k == row["k"] and v > row["v"])
    assert len(out) == len(data)


def test_dense_index_follows_the_order(spark):
    df = spark.range(500).select((F.col("id") * 7 % 500).alias("x"))
    rows = running.dense_index(df, [F.desc("x")]).collect()
    assert {(r["x"], r["row_index"]) for r in rows} == {(499 - i, i) for i in range(500)}


def test_largest_remainder():
    assert splitting.largest_remainder({0: 10, 1: 5}, 3) == {0: 2, 1: 1}
    assert sum(splitting.largest_remainder({0: 7, 1: 7, 2: 7}, 10).values()) == 10
    assert splitting.quotas_of_test_part({0: 700, 1: 300}, 0.2) == {0: 140, 1: 60}
    with pytest.raises(ValueError):
        splitting.quotas_of_test_part({0: 10, 1: 1}, 0.2)


def test_fold_sizes_deal_sorted_rows_round_robin():
    sizes, k = {0: 7, 1: 4, 2: 3}, 3
    dealt = {c: [0] * k for c in sizes}
    for at, c in enumerate([c for c, n in sizes.items() for _ in range(n)]):
        dealt[c][at % k] += 1
    assert splitting.fold_sizes(sizes, k) == dealt


def labelled(spark, n=500):
    return spark.range(n).select(
        F.concat(F.lit("id-"), F.col("id").cast("string")).alias("id"),
        (F.pmod(F.xxhash64("id"), F.lit(10)) < 3).cast("int").alias("y"),
    )


def test_split_is_exact_stratified_and_stable(spark):
    df = pin(labelled(spark))
    sizes = splitting.class_sizes(df, "y")
    out = splitting.stratified_split(df, "y", "id")
    got = {(r["y"], r["split"]): r["n"] for r in out.groupBy("y", "split").agg(F.count("*").alias("n")).collect()}
    quotas = splitting.quotas_of_test_part(sizes, 0.2)
    assert {c: got[c, "test"] for c in sizes} == quotas
    assert sum(quotas.values()) == math.ceil(0.2 * 500)
    again = splitting.stratified_split(df.repartition(7), "y", "id")
    assert out.exceptAll(again).count() == 0
    other = splitting.stratified_split(df, "y", "id", seed=7)
    assert out.exceptAll(other).count() > 0


def test_folds_are_exact(spark):
    df = pin(labelled(spark, 333))
    sizes = splitting.class_sizes(df, "y")
    out = splitting.stratified_folds(df, "y", "id", 4)
    got = {(r["y"], r["fold"]): r["n"] for r in out.groupBy("y", "fold").agg(F.count("*").alias("n")).collect()}
    want = splitting.fold_sizes(sizes, 4)
    assert got == {(c, f): n for c, ns in want.items() for f, n in enumerate(ns)}


def test_split_with_equal_keys_falls_back_to_ids(spark):
    df = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("y"))
    out = splitting.stratified_split(pin(df), "y", "id", key=F.lit(1).cast("bigint"))
    test = {r["id"] for r in out.where("split = 'test'").collect()}
    assert test == set(range(20))


def test_applying_a_split_needs_no_shuffle(spark):
    df = pin(labelled(spark))
    plan = splitting.stratified_split(df, "y", "id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_too_many_folds(spark):
    with pytest.raises(ValueError):
        splitting.stratified_folds(labelled(spark, 20), "y", "id", 100)


def test_fixed_sample(spark):
    df = spark.range(200)
    first = {r["id"] for r in splitting.fixed_sample(df, "id").collect()}
    second = {r["id"] for r in splitting.fixed_sample(df.repartition(5), "id").collect()}
    assert first == second and len(first) == 50
    assert splitting.fixed_sample(spark.range(9), "id").count() == 9


def test_balanced_weights(spark):
    df = spark.createDataFrame([(0,)] * 6 + [(1,)] * 2, "y int")
    rows = weights.with_weight(df, "y", True).distinct().collect()
    assert {(r["y"], r["weight"]) for r in rows} == {(0, 8 / 12), (1, 2.0)}
    assert weights.with_weight(df, "y", False).agg(F.sum("weight")).first()[0] == 8.0


def test_class_sizes_refuse_missing_codes(spark):
    with pytest.raises(ValueError):
        splitting.class_sizes(spark.createDataFrame([(None,), (1,)], "y int"), "y")


def test_long_category_lists_need_no_join(spark):
    from obligor.operators.profile import SchemaProfile

    df = spark.range(6000).select("id", F.concat(F.lit("c"), (F.col("id") % 2500).cast("string")).alias("city"))
    state = encoding.fit_encoder(df, SchemaProfile(categorical=["city"]), {})
    unseen = df.withColumn("city", F.when(F.col("id") == 0, "new").otherwise(F.col("city")))
    encoded = encoding.encode(unseen, state, False)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    order = {v: i for i, v in enumerate(sorted({f"c{i}" for i in range(2500)}))}
    for row in encoded.select("id", "city", "cat__city").collect():
        assert row["cat__city"] == order.get(row["city"], 2500)


def test_ranks_refuse_nan(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", float("nan"))], "g string, v double")
    with pytest.raises(ValueError, match="NaN"):
        selection.order_statistics(df, {"g": [0]})
    assert selection.column_quantiles(df, ["v"], [0.5]) == {"v": [1.0]}


def test_wide_spans_take_no_more_scans(spark, monkeypatch):
    """Values over fifteen powers of ten: one sketch and one count leave few rows."""
    rng = random.Random(9)
    numbers = [10 ** rng.uniform(0, 15) for _ in range(40_000)] + [7.0] * 20_000
    df = pin(values_of(spark, {"a": numbers}))
    sketched, binned = [], []
    own = selection._sketched
    monkeypatch.setattr(selection, "_sketched", lambda *a: sketched.append(1) or own(*a))
    monkeypatch.setattr(selection, "_refine", lambda *a: binned.append(1))
    ranks = [10, 20_000, 30_000, 30_001, 59_000]
    hits = selection.order_statistics(df, {"a": ranks}, exact_rows=1000)
    want = sorted(numbers)
    assert [hits["a", r].value for r in ranks] == [want[r] for r in ranks]
    assert len(sketched) == 1 and not binned


def test_a_missed_rank_is_found_by_bins(spark, monkeypatch):
    numbers = [float(i * i % 9973) for i in range(5000)]
    monkeypatch.setattr(selection, "SKETCH_ERROR", 0.0)
    hits = selection.order_statistics(pin(values_of(spark, {"a": numbers})), {"a": [0, 2500, 4999]}, exact_rows=20)
    assert [hits["a", r].value for r in (0, 2500, 4999)] == [sorted(numbers)[r] for r in (0, 2500, 4999)]


@pytest.mark.parametrize("exact_rows", [5, 60, 10**6])
def test_quantiles_of_all_folds_from_rows_as_they_are(spark, exact_rows, monkeypatch):
    """Each pass reads a row once for all columns and folds; nothing is spread out but the brackets."""
    rng = random.Random(exact_rows)
    rows = [
        (
            i % 4,
            rng.choice([None, float("nan"), rng.lognormvariate(0, 4), rng.gauss(0, 1), rng.gauss(0, 1)]),
            rng.choice([None, 3, 3, 3, 4, 9]),
            rng.choice([-0.0, 0.0, 1.5]),
            None,
        )
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "fold int, a double, b int, c double, d double").repartition(3)
    names, points = ["a", "b", "c", "d"], [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    groups = [(k, c) for k in (None, 0, 1, 2, 3) for c in names]
    fills = {(k, c): v for k in (None, 1) for c, v in (("a", 0.25), ("b", 3.0))}
    spread = []
    explode = selection.F.explode
    monkeypatch.setattr(selection.F, "explode", lambda x: spread.append(x) or explode(x))
    plain = selection.fold_quantiles(df, groups, points, "fold", exact_rows=exact_rows)
    assert len(spread) <= 3  # only after the brackets are known, for twenty of them at a time
    imputed = selection.fold_quantiles(df, list(fills), points, "fold", fills, exact_rows)
    for found, filled in ((plain, {}), (imputed, fills)):
        for k, c in groups if not filled else filled:
            at = 1 + names.index(c)
            held = [r[at] for r in rows if k is None or r[0] != k]
            known = [filled.get((k, c)) if v is None or v != v else float(v) for v in held]
            known = [v for v in known if v is not None]
            if known:
                assert np.allclose(found[k, c], np.quantile(known, points), rtol=1e-12, atol=1e-12), (k, c)
            else:
                assert (k, c) not in found
