import random
import zlib

import numpy as np
import pytest

from obligor.llm import toxicity
from obligor.llm.queries import op4_toxicity
from obligor.llm.sampling import labelled


@pytest.fixture(scope="module")
def marked(spark, words):
    """Prose in which label 1 holds a few words of one family."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        text = rng.choices(words, k=rng.randint(5, 120))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(1 + len(text) // 40):
                text[rng.randrange(len(text))] = rng.choice(["grobnik", "grobnikal", "Grobnika!"])
        rows.append((i, " ".join(text), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df, {i: t for i, _, t in rows}


def test_held_out_accuracy_and_misspellings(marked):
    df, truth = marked
    model = toxicity.fit(df, toxicity.training_labels(df.select("doc_id", "toxic")))
    got = toxicity.scored(df, model).collect()
    held = [row for row in got if row.held_out]
    assert {row.doc_id for row in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(row.predicted == truth[row.doc_id] for row in held) >= 0.97 * len(held)
    assert all(row.predicted == (row.score >= 0.3) for row in got)
    unseen = toxicity.score_texts([b"grobnikk", b"plain"], model.table, model.bias)
    assert unseen[0] > 0.3 > unseen[1]


def test_odd_rows(odd, odd_rows, labels):
    model = toxicity.fit(odd, toxicity.training_labels(labels))
    got = toxicity.scored(odd, model).collect()
    assert len(got) == len(odd_rows)
    assert all(0 <= row.score <= 1 and row.predicted in (0, 1) for row in got)
    empties = {row.score for row in got if row.doc_id in (100, 101, 102)}
    assert len(empties) == 1
    kept = toxicity.keep(odd, model)
    assert kept.columns == odd.columns
    assert kept.count() == sum(row.predicted == 0 for row in got)


def test_without_labels_and_with_one_kind(spark, odd, no_labels, empty, labels):
    model = toxicity.fit(odd, no_labels)
    assert {row.score for row in toxicity.scored(odd, model).collect()} == {0.5}
    ones = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {row.predicted for row in toxicity.scored(odd, toxicity.fit(odd, ones)).collect()} == {1}
    assert toxicity.scored(empty, toxicity.fit(empty, labels)).collect() == []


def test_training_is_repeatable_and_ignores_rows_order(marked):
    df, _ = marked
    marks = df.select("doc_id", "toxic")
    first, second = toxicity.fit(df, marks, rows=40), toxicity.fit(df.repartition(5), marks, rows=40)
    assert np.array_equal(first.table, second.table) and first.bias == second.bias


def test_subwords_are_those_of_each_word_alone():
    words = [b"a", b"grob", "süß".encode(), b"x" * 30]
    buckets, counts = toxicity.subwords(words)
    assert counts.tolist() == [sum(max(0, len(w) + 3 - n) for n in toxicity.GRAMS) + 1 for w in words]
    parts = np.split(buckets, np.cumsum(counts)[:-1])
    for word, part in zip(words, parts, strict=True):
        assert sorted(part) == sorted(toxicity.subwords([word])[0])


def test_labels_are_bounded_and_clean(labels):
    rows = labelled(labels, "toxic", 3).collect()
    assert sorted(row.label for row in rows) == [0, 0, 0, 1, 1, 1]
    assert {row.doc_id: row.label for row in labelled(labels, "toxic", 1000).collect()}[6] == 1


def test_query(spark, sf_dir):
    got = op4_toxicity(spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
