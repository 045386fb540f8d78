"""Boosted trees against a plain version that looks at every row for every cut."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from obligor.operators import boosting

PARAMS = [
    {"n_estimators": 4, "max_depth": 2, "learning_rate": 0.3, "subsample": 1.0, "colsample": 1.0},
    {"n_estimators": 3, "max_depth": 3, "learning_rate": 0.2, "subsample": 0.7, "colsample": 0.6},
]


def rows_of(seed, n, classes):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x = [rng.choice([0.0, 0.0, -2.0, 1.5, 3.0]), float(rng.randrange(12)), 0.0, float(rng.random() < 0.2), rng.choice([5.0, 7.0])]
        out.append((i, x, int(x[0] + x[1] / 3 + rng.random() * 2 > 2) + (classes > 2 and x[3] > 0)))
    return out


def frame(spark, rows, parts=3):
    data = [(i, Vectors.dense(x) if i % 2 else Vectors.sparse(len(x), [(k, v) for k, v in enumerate(x) if v]), y) for i, x, y in rows]
    return spark.createDataFrame(data, ["id", "features", "y"]).repartition(parts)


def fit(df, classes, params=PARAMS, **options):
    parts = df if isinstance(df, list) else [df]
    return boosting.boost(parts, params, classes, F.col("id"), "y", **options)


def plain(x, y, key, params, classes, seed=42):
    """Margins of all rows after all rounds, by trying every value of every column."""
    k = classes if classes > 2 else 1
    share = np.bincount(y, minlength=classes) / len(y)
    margins = np.repeat((np.log(share) if k > 1 else np.log(share[1:] / share[:1]))[:, None], len(y), axis=1)
    for turn in range(params["n_estimators"]):
        g, h = boosting.slopes(margins, y, np.ones(len(y)))
        kept = boosting.sampled(key, params["subsample"], seed, turn)
        step = np.zeros_like(margins)
        for own in range(k):
            allowed = boosting.drawn_columns(x.shape[1], params["colsample"], seed, turn, own)

            def grow(rows, depth, own=own, allowed=allowed):
                used = rows & kept
                all_g, all_h = g[own][used].sum(), h[own][used].sum()
                step[own][rows] = -params["learning_rate"] * all_g / (all_h + 1)
                best = (1e-6, None)
                for column in np.flatnonzero(allowed) if depth else ():
                    for value in np.unique(np.append(x[:, column], 0.0)):
                        left = used & (x[:, column] <= value)
                        lg, lh = g[own][left].sum(), h[own][left].sum()
                        if min(lh, all_h - lh) < 1:
                            continue
                        gain = lg**2 / (lh + 1) + (all_g - lg) ** 2 / (all_h - lh + 1) - all_g**2 / (all_h + 1)
                        if gain > best[0] + 1e-9:
                            best = (gain, (column, value))
                if best[1]:
                    under = x[:, best[1][0]] <= best[1][1]
                    grow(rows & under, depth - 1)
                    grow(rows & ~under, depth - 1)

            grow(np.ones(len(y), bool), params["max_depth"])
        margins = margins + step
    return boosting.chances(margins)


def predicted(spark, df, model):
    out = boosting.BoostedTreesModel(model=model.to_json()).transform(df).select("id", "probability")
    return np.array([r.probability.toArray() for r in out.orderBy("id").collect()]).T


@pytest.mark.parametrize("classes", [2, 3])
def test_against_the_plain_version(spark, classes):
    rows = rows_of(1, 300, classes)
    df = frame(spark, rows)
    keys = np.array([r.k for r in df.orderBy("id").select(F.xxhash64("id").alias("k")).collect()]).astype(np.int64).view(np.uint64)
    x, y = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    models = fit(df, classes)
    for at, params in enumerate(PARAMS):
        want = plain(x, y, keys, params, classes)
        assert np.allclose(predicted(spark, df, models[0, at]), want, atol=1e-9)


def test_shared_passes_shuffles_and_partitions_change_nothing(spark, monkeypatch):
    one, two = frame(spark, rows_of(2, 200, 2)), frame(spark, rows_of(3, 150, 2))
    together = fit([one, two], 2)
    assert fit(one, 2, PARAMS[1:])[0, 0].to_json() == together[0, 1].to_json()
    assert [len(t.rounds) for t in together.values()] == [4, 3, 4, 3]
    monkeypatch.setattr(boosting, "DRIVER_BYTES", 0)
    monkeypatch.setattr(boosting, "CHUNK_BINS", 4)
    monkeypatch.setattr(boosting, "REWRITE_ROUNDS", 2)
    apart = fit([one, two], 2)
    for at, model in together.items():
        df = one if at[0] == 0 else two
        assert np.allclose(predicted(spark, df, model), predicted(spark, df, apart[at]), atol=1e-12)
    other = fit([one.repartition(7), two.repartition(1)], 2)
    assert np.allclose(predicted(spark, two, other[1, 0]), predicted(spark, two, together[1, 0]), atol=1e-9)


def test_a_column_without_use_and_a_single_class(spark):
    rows = [(i, [0.0, 2.0], 0) for i in range(20)]
    model = fit(frame(spark, rows), 2, PARAMS[:1])[0, 0]
    assert all(len(t.left) == 1 for trees in model.rounds for t in trees)
    assert predicted(spark, frame(spark, rows), model)[1].max() < 1e-3
    with pytest.raises(ValueError):
        fit([frame(spark, rows), frame(spark, rows).where("id < 0")], 2)


def test_sketch_ranks():
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 6, 200_000), np.full(100_000, 3.0)])
    rng.shuffle(values)
    sketch = boosting.Sketch()
    for part in np.array_split(values, 60):
        sketch.add(part)
    held, counts = sketch.summary()
    assert counts.sum() == values.size and held.size <= boosting.SKETCH_VALUES
    assert np.isin(held, values).all()
    true = np.searchsorted(np.sort(values), held, "right")
    assert np.abs(true - np.cumsum(counts))[counts < 50_000].max() < 0.005 * values.size
    cuts = boosting.cut_points(sketch.summary())
    share = np.diff(np.searchsorted(np.sort(values), cuts)) / values.size
    assert cuts.size <= boosting.MAX_BINS + 1 and np.sort(share)[-2] < 0.02


def test_few_values_are_cut_exactly():
    sketch = boosting.Sketch()
    for _ in range(9):
        sketch.add(np.repeat([-1.0, 2.0, 7.0], [1000, 1, 5]))
    assert boosting.cut_points(sketch.summary()).tolist() == [-1.0, 0.0, 2.0]
    assert boosting.cut_points((np.array([-3.0, -1.0]), np.array([1, 1]))).tolist() == [-3.0, -1.0]


def test_sampled_share():
    keys = np.random.default_rng(1).integers(0, 2**63, 50_000).astype(np.uint64)
    first, second = (boosting.sampled(keys, 0.7, 42, turn) for turn in (0, 1))
    assert abs(first.mean() - 0.7) < 0.01 and abs((first & second).mean() - 0.49) < 0.01


def test_filled_columns_take_two_bytes_a_row(spark, monkeypatch):
    """Whole columns give the trees that entries give, in a fraction of their bytes."""
    df = frame(spark, rows_of(8, 400, 2))
    sizes, found = [], []
    written = boosting.batch_of

    def counted(rows, schema):
        if schema == boosting._BLOCKS:
            sizes.append(sum(len(v) for v in rows[0][5:9]) / rows[0][1])
        return written(rows, schema)

    for share in (boosting.DENSE_SHARE, 2.0):
        monkeypatch.setattr(boosting, "DENSE_SHARE", share)
        found.append({at: m.to_json() for at, m in fit(df, 2).items()})
    assert found[0] == found[1]
    monkeypatch.setattr(boosting, "batch_of", counted)
    monkeypatch.setattr(boosting, "DENSE_SHARE", 0.25)
    vector = df.select(F.unwrap_udt("features").alias("vector")).toArrow()["vector"].combine_chunks()
    fields = {n: pa.array([v] * len(vector), t) for n, v, t in (("part", 0, pa.int32()), ("label", 0, pa.int32()), ("weight", 1.0, pa.float64()), ("key", 1, pa.int64()))}
    batch = pa.RecordBatch.from_pydict({**fields, "vector": vector if isinstance(vector, pa.Array) else vector.chunk(0)})
    layout = boosting.Layout(5, {0: np.array([-2.0, 0.0, 1.5]), 1: np.arange(11.0), 3: np.array([0.0]), 4: np.array([0.0, 5.0])})
    list(boosting._packed({0: layout}, {0: 1}, 1)([batch]))
    # Three of five columns are filled; the old entries took eight bytes for each filled value, over sixteen a row.
    assert sizes and max(sizes) < 10


def test_a_walk_over_cuts_ends_where_levels_end(monkeypatch):
    rng = np.random.default_rng(4)
    tree, columns = boosting.Tree(), rng.integers(0, 9, (3, 500))
    opened = [0]
    for depth in range(3):
        opened = [c for node in opened for c in tree.split(node, int(rng.integers(3)), int(rng.integers(9)), 0.0, (1.0, 2.0))]
        tree.depth = depth + 1
    near = tree.place(lambda c: columns[c], tree.cut, 500)
    monkeypatch.setattr(boosting, "FEW_CUTS", 0)
    assert (near == tree.place(lambda c: columns[c], tree.cut, 500)).all()


def test_blocks_are_read_once_and_lost_ones_again_with_the_same_trees(spark, monkeypatch):
    df = frame(spark, rows_of(5, 200, 2))
    want = {at: m.to_json() for at, m in fit(df.coalesce(1), 2).items()}
    made, reads, real = [], [], boosting.Stored.at
    seen = spark.sparkContext.accumulator(0)

    def at(spark, path):
        blocks = real(spark, path)

        def counted(rows):
            for row in rows:
                seen.add(1)
                yield row

        blocks.kept = blocks.kept.mapPartitions(counted).persist()
        made.append(blocks)
        return blocks

    monkeypatch.setattr(boosting.Stored, "at", at)
    assert {at: m.to_json() for at, m in fit(df.coalesce(1), 2).items()} == want
    assert len(made) == 1 and seen.value == 1  # one block, read by the first pass only
    monkeypatch.setattr(boosting, "REWRITE_ROUNDS", 1)
    cuts = boosting.Pass.cuts

    def lost(self, blocks):
        blocks.kept.unpersist()
        reads.append(blocks.renewed)
        return cuts(self, blocks)

    monkeypatch.setattr(boosting.Pass, "cuts", lost)
    monkeypatch.setattr(boosting, "WRITTEN", 2)
    again = fit(df.coalesce(1), 2)
    assert max(reads) == 1 and len(made) > 2
    for key, model in again.items():
        assert np.allclose(predicted(spark, df, model), predicted(spark, df, boosting.Boosted.from_json(want[key])), atol=1e-12)


def test_columns_that_a_tree_may_not_use_are_not_summed():
    cuts = {0: np.arange(4.0), 1: np.arange(4.0)}
    layout = boosting.Layout(2, cuts)
    codes = np.array([[0, 1, 2, 3], [3, 2, 1, 0]], "<u2")
    row = {"part": 0, "rows": 4, "labels": b"", "weights": b"", "keys": b"", "dense": np.array([0, 1], "<i4").tobytes(),
           "codes": codes.tobytes(), "entry_rows": b"", "entry_bins": b"", "ends": np.zeros(2, "<i8").tobytes(), "margins": b""}
    block = boosting.Block(row, layout, 1)
    slot, ones = np.zeros(4, np.int64), np.ones(4)
    both = block.histogram(slot, 1, (ones,), np.array([True, True]))
    first = block.histogram(slot, 1, (ones,), np.array([True, False]))
    assert (first[:, :, :5] == both[:, :, :5]).all() and (first[:, :, -1] == 4).all()
    assert both[:, :, 5:10].any() and not first[:, :, 5:10].any()
