import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from obligor.llm import quality
from obligor.llm.queries import labels_of, op9_quality_sample


def test_weights_follow_the_two_models(spark, odd, odd_rows, labels):
    marks = quality.target_labels(labels)
    ratio = quality.fit(odd, marks)
    raw, target = np.ones(quality.BUCKETS), np.zeros(quality.BUCKETS)
    good = {r.doc_id for r in marks.collect() if r.label == 1}
    for doc_id, text in odd_rows:
        buckets, _ = quality._features([(text or "").encode()])
        raw += np.bincount(buckets.ravel(), minlength=quality.BUCKETS)
        if doc_id in good:
            target += np.bincount(buckets.ravel(), minlength=quality.BUCKETS)
    shape, added = raw / raw.sum(), quality.SMOOTHING * quality.BUCKETS
    want = np.log((target + added * shape) / (target.sum() + added)) - np.log(shape)
    assert ratio == pytest.approx(want)
    keys, _, _ = quality.resample(odd, marks)
    texts = dict(odd_rows)
    for row in keys.where("doc_id < 30 and doc_id <> 3").collect():
        buckets, sizes = quality._features([texts[row.doc_id].encode()])
        score = quality.LENGTH * ratio[buckets].sum() / (4 * sizes[0] + quality.PRIOR)
        assert row.log_weight == pytest.approx(score)


def test_top_k_is_exact_and_keep_agrees(odd, labels):
    marks = quality.target_labels(labels)
    for k in (0, 1, 7, 10_000):
        keys, _, least = quality.resample(odd, marks, k)
        values = sorted((r.key for r in keys.collect()), reverse=True)
        drawn = [r.key for r in quality.sample(odd, marks, k).collect()]
        assert sorted(drawn, reverse=True) == [v for v in values if k and v >= values[min(k, len(values)) - 1]]
        kept = quality.keep(odd, marks, k)
        assert kept.columns == odd.columns and kept.count() == len(drawn)


def test_noise_is_gumbel_and_repeatable(spark):
    noise = [r[0] for r in spark.range(20_000).select(quality.gumbel(F.col("id"))).collect()]
    again = [r[0] for r in spark.range(20_000).repartition(3).select("id", quality.gumbel(F.col("id"))).orderBy("id").drop("id").collect()]
    assert noise == again
    assert abs(np.mean(noise) - 0.5772) < 0.05 and abs(np.var(noise) - math.pi**2 / 6) < 0.1


def test_junk_is_left_out(spark, words):
    rng = random.Random(4)
    rows, marks = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(5, 100))
        if i % 5 == 0:
            text = [[w.upper() + "!!" for w in text], [text[0]] * 60, [w + "***" for w in text]][i // 5 % 3]
        rows.append((i, " ".join(text)))
        if i % 2 == 0:
            marks.append((i, int(i % 5 != 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    kept = {r.doc_id for r in quality.sample(df, quality.target_labels(labels)).collect()}
    wrong = [i for i, _ in rows if (i in kept) != (i % 5 != 0)]
    assert len(wrong) <= 6


def test_empty_tables(odd, empty, labels, no_labels):
    assert quality.sample(empty, quality.target_labels(labels)).collect() == []
    assert quality.keep(empty, quality.target_labels(labels)).collect() == []
    assert quality.keep(odd, quality.target_labels(no_labels)).columns == odd.columns


def test_query_keeps_good_documents(spark, sf_dir):
    kept = {r.doc_id for r in op9_quality_sample(spark, sf_dir).collect()}
    marks = labels_of(spark, sf_dir).collect()
    good = [r.doc_id for r in marks if r.quality == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
