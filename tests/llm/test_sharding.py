import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from obligor.llm import sharding
from obligor.llm.queries import op7_hilbert_shards



def cells():
    return [
        sharding.by_category(F.col("lang")),
        sharding.by_category(F.col("source")),
        sharding.by_magnitude(F.col("n_chars")),
    ]


def check(got, rows):
    assert len(got) == len(rows)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert {r.law for r in got} <= {"rows"} and {r.grown_shard for r in got} <= {None}
    counts = [0] * 8
    for r in got:
        counts[r.shard] += 1
    assert max(counts) - min(counts) <= 1
    for shard in range(8):
        own = [r for r in got if r.shard == shard]
        assert sorted(r.slot for r in own) == list(range(counts[shard]))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    keys = [(r.curve, r.doc_id is not None, r.doc_id or 0) for r in ordered]
    assert keys == sorted(keys)


@pytest.mark.parametrize("dimensions,bits", [(2, 3), (3, 3), (3, 4)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    path = sorted(product(range(1 << bits), repeat=dimensions), key=lambda p: sharding.hilbert_index(p, bits))
    assert sorted(sharding.hilbert_index(p, bits) for p in path) == list(range(len(path)))
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in zip(path, path[1:], strict=False))


def test_odd_rows(odd, odd_rows):
    check(sharding.hilbert_shards(odd, cells()).collect(), odd_rows)


def test_empty_and_tiny_tables(spark, empty):
    assert sharding.hilbert_shards(empty, cells()).collect() == []
    rows = [(5, "a"), (6, None)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    check(sharding.hilbert_shards(df, cells()).collect(), rows)


def test_magnitudes(spark):
    values = [None, -4, 0, 1, 2, 3, 4, 255, 256, 1 << 40]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r[0] for r in df.select(sharding.by_magnitude(F.col("v"))).collect()]
    assert got == [0, 0, 0, 1, 2, 2, 3, 8, 9, 15]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(op7_hilbert_shards(spark, sf_dir).collect(), [(r.doc_id, r.text) for r in docs])
