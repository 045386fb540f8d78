"""Statistics of all folds in shared jobs against one fit per fold."""

import random

import pytest
from pyspark.sql import functions as F

from obligor.operators import encoding
from obligor.operators.profile import profile_schema


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(4), []
    for i in range(300):
        out.append((
            i, i % 3, rng.gauss(1e6, 3.0) if i % 7 else None, rng.lognormvariate(0, 4) if i % 5 else float("nan"),
            rng.choice([0.1, 0.1, 0.1]) if i % 3 else rng.random(), rng.choice(["low", "medium", "high", None]),
            rng.choice(["x", "y", "z", None]) if i % 3 else "only in fold 0", rng.choice(["Y", "N"]), rng.choice([1, 2, 2, None]),
            5.0 if i % 3 == 1 else None,
        ))
    return spark.createDataFrame(
        out, "row_id long, fold int, close double, heavy double, flat double, risk_grade string, kind string,"
        " flag string, code int, fold_one double",
    )


def close(a, b):
    assert a.keys() == b.keys()
    for c in a:
        assert a[c] == pytest.approx(b[c], rel=1e-9, abs=1e-9)


def test_equal_to_one_fit_per_fold(spark, rows):
    profile, orders = profile_schema(rows.drop("fold"), "row_id")
    states = encoding.fit_encoders(rows, profile, orders, "fold", [0, 1, 2])
    assert list(states) == [None, 0, 1, 2] and any(s.clips for s in states.values())
    for fold, state in states.items():
        kept = rows if fold is None else rows.where(F.col("fold") != fold)
        alone = encoding.fit_encoder(kept, profile, orders)
        for name in ("numeric", "boolean", "ordinal", "categorical", "modes", "values", "orders", "sizes"):
            assert getattr(state, name) == getattr(alone, name), name
        for name in ("fills", "clips", "scales"):
            close(getattr(state, name), getattr(alone, name))
    assert "fold_one" not in states[1].numeric and "only in fold 0" not in states[0].values["kind"]


def test_long_lists_of_all_folds(spark, rows):
    """Lists that go to the table give the same codes as lists in the model, fold by fold."""
    profile, orders = profile_schema(rows.drop("fold"), "row_id")
    assert "kind" in profile.categorical
    listed = encoding.fit_encoders(rows, profile, orders, "fold", [0, 1, 2])
    stored = encoding.fit_encoders(rows, profile, orders, "fold", [0, 1, 2], max_categories=2)
    for fold, state in stored.items():
        assert "kind" in state.hot and not state.values["kind"]
        assert (state.sizes, state.modes, state.boolean) == (listed[fold].sizes, listed[fold].modes, listed[fold].boolean)
        want = encoding.encode(rows, listed[fold], False)
        got = encoding.encode(rows, state, False)
        assert got.columns == want.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_jobs_do_not_grow_with_the_folds(spark, rows):
    profile, orders = profile_schema(rows.drop("fold"), "row_id")
    jobs = []
    for folds in (2, 6):
        dealt = rows.withColumn("fold", F.col("row_id") % folds)
        spark.sparkContext.setJobGroup(f"folds-{folds}", "statistics")
        for state in encoding.fit_encoders(dealt, profile, orders, "fold", range(folds)).values():
            encoding.vector_stages(spark, state)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"folds-{folds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2, jobs


def test_central_sums_add_up():
    rng = random.Random(2)
    values = [rng.lognormvariate(3, 2) for _ in range(90)]

    def part(v):
        n, mean = len(v), sum(v) / len(v)
        m2, m3 = (sum((x - mean) ** p for x in v) / n for p in (2, 3))
        return encoding.Part.of(n, mean, m2, m3 / m2**1.5 if m2 else None, min(v), max(v))

    whole = part(values).moments()
    added = (part(values[:1]) + part(values[1:40]) + encoding.Part() + part(values[40:])).moments()
    assert added.mean == pytest.approx(whole.mean) and added.deviation == pytest.approx(whole.deviation)
    assert added.skew == pytest.approx(whole.skew)
    assert (part([0.1] * 3) + part([0.1] * 7)).moments() == encoding.Moments(pytest.approx(0.1), 1.0, 0.0)
