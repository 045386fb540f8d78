import random
import zlib

import numpy as np
import pytest

from obligor.llm import language_id
from obligor.llm.queries import op11_language_id

COLUMNS = "doc_id long, text string, lang string, lang_pred string, score string, hash string, place int"
ENDINGS = {"aa": ["ba", "bo"], "ab": ["ba", "bi"], "ac": ["be", "bo"], "xx": ["kz", "kt"], "xy": ["kz", "kp"], "zz": ["uw"]}
GROUPS = {"aa": "a", "ab": "a", "ac": "a", "xx": "x", "xy": "x"}


def rows_of(count, rng, words):
    out = []
    for i in range(count):
        lang = rng.choice(sorted(ENDINGS))
        text = [rng.choice(words)[:3] + rng.choice(ENDINGS[lang]) for _ in range(rng.randint(4, 60))]
        out.append((i, " ".join(text).title() + rng.choice([".", " 42!", ""]), lang))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, la, "p", "s", "h", 1) for i, t, la in rows], COLUMNS)


@pytest.fixture(scope="module")
def rows(words):
    return rows_of(600, random.Random(8), words)


@pytest.fixture(scope="module")
def model(spark, rows):
    return language_id.fit(language_id.training_rows(frame(spark, rows)), GROUPS, most=100)


def test_held_out_accuracy(spark, rows, model):
    assert model.members == {"a": ["aa", "ab", "ac"], "x": ["xx", "xy"], "zz": ["zz"]}
    truth = {i: la for i, _, la in rows}
    got = language_id.predicted(frame(spark, rows), model).collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def duel(names, pairs, margins):
    """Winner of all pairs, and its mean chance."""
    wins, sums, odds = (dict.fromkeys(names, 0.0) for _ in range(3))
    for (first, second), margin in zip(pairs, margins, strict=True):
        wins[first if margin >= 0 else second] += 1
        for name, own in ((first, margin), (second, -margin)):
            sums[name] += own
            odds[name] += 1 / (1 + np.exp(-own))
    best = max(names, key=lambda n: (wins[n], sums[n]))
    return best, odds[best] / (len(names) - 1) if pairs else 1.0


def test_the_family_is_decided_first(rows, model):
    """The plain way: first the families, then the pairs inside the family that won."""
    texts = [t for _, t, _ in rows[:80]]
    names, scores = model.predict(texts)
    for text, name, score in zip(texts, names, scores, strict=True):
        held = np.sqrt(language_id.counts(text))
        margins = held / np.linalg.norm(held) @ model.matrix[:-1] + model.matrix[-1]
        split = len(model.family_pairs)
        family, share = duel(sorted(model.members), model.family_pairs, margins[:split])
        inside = [(p, m) for p, m in zip(model.pairs, margins[split:], strict=True) if p[0] in model.members[family]]
        language, own = duel(model.members[family], [p for p, _ in inside], [m for _, m in inside])
        assert name == language and score == pytest.approx(share * own, abs=1e-4)


def test_machine_reaches_the_optimum():
    """No change of the weights lowers the loss that the machine minimises by half a percent."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(60, 5)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    sides = np.where(rows[:, 0] + 0.3 * rng.normal(size=60) > 0.2, 1, -1)
    weight = np.where(sides > 0, 60 / (2 * (sides > 0).sum()), 60 / (2 * (sides < 0).sum())) * language_id.COST

    def loss(w):
        return 0.5 * w @ w + (weight * np.maximum(0, 1 - sides * (rows @ w[:-1] + w[-1]))).sum()

    found = language_id.separate(rows, sides).astype(np.float64)
    for _ in range(300):
        assert loss(found) <= 1.005 * loss(found + rng.normal(size=6) * rng.choice([1e-2, 0.1, 1]))


def test_fit_ignores_order_and_copies(spark, rows, model):
    again = frame(spark, rows + rows[:50] + rows[:50]).repartition(9)
    other = language_id.fit(language_id.training_rows(again), GROUPS, most=100)
    assert np.array_equal(other.matrix, model.matrix)


def test_odd_rows(odd, odd_rows, spark, model):
    got = language_id.predicted(odd, model).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.doc_id in (100, 101, 102):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    digits = frame(spark, [(1, "12 34 --", None), (2, "漢字", None), (None, "Baba", None)])
    assert [r.lang_pred == "und" for r in language_id.predicted(digits, model).collect()] == [True, False, False]
    assert all(not r.held_out for r in got if r.doc_id is None)
    # All rows have one language: nothing is left to decide.
    single = language_id.fit(language_id.training_rows(odd))
    assert {(r.lang_pred, r.score) for r in language_id.predicted(odd, single).collect()} == {("en", 1.0), ("und", 0.0)}


def test_nothing_to_learn_from(spark, odd, empty):
    model = language_id.fit(language_id.training_rows(empty))
    assert {(r.lang_pred, r.score) for r in language_id.predicted(odd, model).collect()} == {("und", 0.0)}
    assert language_id.predicted(empty, model).collect() == []


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = op11_language_id(spark, sf_dir).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and set(truth) == {r.doc_id for r in got}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
