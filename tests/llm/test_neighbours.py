import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from obligor.llm import neighbours
from obligor.llm.queries import op10_nearest


def brute(rows, step, k=5):
    """Exact neighbours of (id, vector) rows by plain Python."""
    held = {}
    for i, vector in rows:
        ok = i is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector)
        if ok and (i not in held or vector < held[i]):
            held[i] = vector
    out = []
    for q, x in held.items():
        if q % step == 0:
            scored = []
            for i, y in held.items():
                if i != q and len(x) == len(y):
                    dot = sum(a * b for a, b in zip(x, y, strict=True))
                    score = dot / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))
                    scored.append((-max(-1.0, min(1.0, score)), i))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def run(spark, rows, step, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("id") % step == 0, **options).collect()
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got)


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


@pytest.mark.parametrize("block_rows", [13, 100, 4096])
def test_matches_brute_force_with_ties_and_copies(spark, block_rows):
    rng = np.random.default_rng(8)
    vectors = rng.integers(-2, 3, (160, 6)).astype(float).tolist() + rng.normal(size=(100, 6)).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500 + i, vectors[0]) for i in range(40)]
    same(run(spark, rows, 7, block_rows=block_rows), brute(rows, 7))


def test_vectors_that_take_no_part_and_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (2, [1.0, 1.0]), (4, None), (6, [0.0, 0.0]), (8, [float("nan"), 1.0])]
    rows += [(10, [None, 1.0]), (12, [float("inf"), 1.0]), (14, []), (None, [1.0, 0.0]), (3, [1.0, 2.0, 3.0])]
    rows += [(2, [1.0, 1.0]), (2, [0.5, 1.0]), (5, [1e-160, 1e-160]), (7, [1e160, -1e160])]
    got = run(spark, rows, 2)
    assert [g[:3] for g in got] == [(0, 1, 5), (0, 2, 7), (0, 3, 2), (2, 1, 5), (2, 2, 0), (2, 3, 7)]
    assert got[0][3] == pytest.approx(math.sqrt(0.5)) and got[2][3] == pytest.approx(1 / math.sqrt(5))


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, id int, vector string")
    assert neighbours.nearest(df, F.col("id") == 0).collect() == []
    df = spark.createDataFrame([(0, [1.0], 9, "x"), (1, [2.0], 9, "y")], df.schema)
    assert [tuple(r) for r in neighbours.nearest(df, F.col("id") == 0).collect()] == [(0, 1, 1, 1.0)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(200, 48)), rng.normal(size=(300, 48)) * rng.lognormal(size=(300, 1)) * 50
    (qa, sa, na, ea), (qb, sb, _, eb) = neighbours._rounded(a), neighbours._rounded(b)
    near = (qa.astype(float) @ qb.T.astype(float)) * sa[:, None] * sb
    true = (a / np.linalg.norm(a, axis=1)[:, None]) @ (b / np.linalg.norm(b, axis=1)[:, None]).T
    assert (np.abs(near - true) <= ea[:, None] + na[:, None] * eb + 1e-9).all()


def test_query(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in op10_nearest(spark, sf_dir).collect())
    same(got, brute(rows, 50))
