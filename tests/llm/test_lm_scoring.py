import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obligor.llm import lm_scoring
from obligor.llm.queries import op2_lm_score

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), "\n"]


def fold(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def base_scores(rows):
    counts = Counter(w for i, t in rows if fold(i) not in (None, 2) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, {
        (i, t): (sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), sum(counts[w] > 0 for w in tokens(t)))
        for i, t in rows
    }


def check(got, rows):
    n, base = base_scores(rows)
    by = {}
    for i, t in rows:
        by.setdefault(i, (base[i, t], t))
    assert len(got) == len(rows)
    for row in got:
        if row.doc_id is None:
            assert row.held_out is False
            continue
        (score, known), text = by[row.doc_id]
        assert row.held_out == (fold(row.doc_id) == 2)
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens(text)), known, n)
        assert row.base_score == pytest.approx(score, rel=1e-9, abs=1e-9)
        assert math.isfinite(row.score) and row.score < 0


def test_base_score_on_odd_rows(odd, odd_rows):
    check(lm_scoring.score(odd).collect(), odd_rows)


def test_empty_table(empty):
    assert lm_scoring.score(empty).collect() == []


def test_nothing_to_learn_from(spark):
    held = next(i for i in range(100) if fold(i) == 2)
    row = lm_scoring.score(spark.createDataFrame([(held, "one two")], "doc_id long, text string")).first()
    assert (row.train_tokens, row.base_score, row.n_known) == (0, 0.0, 0)
    assert row.score < -5


def window_counts(texts):
    """By number of the text: bytes before, the last one first, and the byte to come."""
    out = []
    for text in texts:
        whole = b"\n" * lm_scoring.ORDERS + text
        ends = range(lm_scoring.ORDERS, len(whole))
        out.append(Counter((whole[at - lm_scoring.ORDERS : at][::-1], whole[at]) for at in ends))
    return out


def opened(key):
    data = int(key).to_bytes(lm_scoring.ORDERS + 1, "big")
    return data[:-1], data[-1]


def test_windows_do_not_cross_texts_and_long_texts_are_cut_whole():
    texts = [lm_scoring.canonical(text) for text in (b"Ab  c", b"", b"x" * 50)]
    want = Counter({(i, w): n for i, own in enumerate(window_counts(texts)) for w, n in own.items()})
    for size in (7, 1000):
        got = Counter()
        for keys, owners in lm_scoring.window_parts(texts, size):
            got.update((i, opened(k)) for i, k in zip(owners.tolist(), keys, strict=True))
        assert got == want


def packed(df):
    return lm_scoring.pack(df.withColumn("learnt", F.expr("doc_id IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % 7 <> 2")))


def test_window_counts_are_exact(odd, odd_rows):
    got = Counter()
    for row in lm_scoring.bucketed(packed(odd.repartition(3)), 5).collect():
        keys, counts = lm_scoring._risen(row["keys"]), lm_scoring._from_numbers(row["counts"])
        got.update({opened(k): n for k, n in zip(keys, counts.tolist(), strict=True)})
    texts = [lm_scoring.canonical((t or "").encode()) for i, t in odd_rows if fold(i) not in (None, 2)]
    assert +got == sum(window_counts(texts), Counter())


def counted(code):
    """Zeros and ones that a code stands for, exact up to 16."""
    return int(code) >> 8, int(code) & 255


def test_counts_of_contexts_by_brute_force(spark, odd, odd_rows):
    windows = lm_scoring.bucketed(packed(odd), 5)
    tables = lm_scoring.count_tables(windows)
    texts = [lm_scoring.canonical((t or "").encode()) for i, t in odd_rows if fold(i) not in (None, 2)]
    seen = Counter()
    for (before, byte), n in sum(window_counts(texts), Counter()).items():
        for order in range(lm_scoring.ORDERS + 1):
            for bit in range(8):
                seen[before[:order], (256 | byte) >> (8 - bit), byte >> (7 - bit) & 1] += n
    for row in windows.collect():
        keys, counts = lm_scoring._risen(row["keys"]), lm_scoring._from_numbers(row["counts"])
        longer = lm_scoring.long_counts(keys, counts)
        for at in range(0, keys.size, 7):
            before, byte = opened(keys[at])
            for order in range(lm_scoring.ORDERS + 1):
                for bit in range(8):
                    node = (256 | byte) >> (8 - bit)
                    if order > lm_scoring.SHARED:
                        got = longer[order - lm_scoring.SHARED - 1, bit, at]
                    else:
                        slot = lm_scoring._slot(keys[at : at + 1], np.array([node]), order)
                        got = tables[order][slot][0]
                    want = [seen[before[:order], node, came] for came in (0, 1)]
                    assert [min(n, 17) for n in counted(got)] == [min(n, 17) for n in want]


def plain_score(mixer, longer, key, at):
    """The model's rule for one window, bit by bit, without numpy's vectors."""
    before, byte = opened(key)
    letters = next((j for j, b in enumerate(before) if b in (32, 10)), lm_scoring.ORDERS)
    total = 0.0
    for bit in range(8):
        node, came, longest, odds = (256 | byte) >> (8 - bit), byte >> (7 - bit) & 1, 0, []
        for order in range(lm_scoring.ORDERS + 1):
            if order > lm_scoring.SHARED:
                code = int(longer[order - lm_scoring.SHARED - 1, bit, at])
            else:
                context = int.from_bytes(before[:order], "big") if order else 0
                code = int(mixer.tables[order][context << 8 | node])
            zeros, ones = (n if n <= 16 else 16 * 2 ** ((n - 16) / 8) for n in counted(code))
            odds.append(math.log(ones + lm_scoring.PRIOR) - math.log(zeros + lm_scoring.PRIOR))
            longest = order if code else longest
        first = mixer.weights[longest * 256 + node]
        second = mixer.weights[(lm_scoring.ORDERS + 1) * 256 + letters * 256 + node]
        mixed = sum(o * (a + b) for o, a, b in zip(odds, first, second, strict=True))
        mixed = max(-16.0, min(16.0, mixed))
        cell = round((max(-8.0, min(8.0, mixed)) + 8) * 2)
        refined = mixer.seen[1][node, cell] / (mixer.seen[0][node, cell] + mixer.seen[1][node, cell])
        one = max(1e-6, min(1 - 1e-6, (1 / (1 + math.exp(-mixed)) + refined) / 2))
        total += math.log10(one if came else 1 - one)
    return total


def test_scores_by_brute_force_and_chances_sum_to_one(spark, odd):
    windows = lm_scoring.bucketed(packed(odd), 5)
    mixer = lm_scoring.learn(windows, lm_scoring.count_tables(windows))
    row = max(windows.collect(), key=lambda row: len(row["keys"]))
    keys, counts = lm_scoring._risen(row["keys"]), lm_scoring._from_numbers(row["counts"])
    longer = lm_scoring.long_counts(keys, counts)
    got = mixer.score(keys, longer)
    for at in range(0, keys.size, max(1, keys.size // 50)):
        assert got[at] == pytest.approx(plain_score(mixer, longer, keys[at], at), abs=1e-4)
    for key in keys[:: max(1, keys.size // 3)]:
        context = key >> np.uint64(8) << np.uint64(8)
        every = context | np.arange(256, dtype=np.uint64)
        both = np.union1d(keys, every)
        total = np.zeros(both.size, np.int64)
        total[np.searchsorted(both, keys)] = counts
        scores = mixer.score(both, lm_scoring.long_counts(both, total))
        assert (10 ** scores[np.searchsorted(both, every)]).sum() == pytest.approx(1)


def test_lookup_finds_every_window():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 56, 300_000).astype(np.uint64))
    lookup = lm_scoring.Lookup(keys[::-1], np.arange(keys.size)[::-1])
    assert (lookup.of(keys) == np.arange(keys.size)).all()


def test_scores_do_not_depend_on_partitions_or_blocks(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    results = []
    try:
        for partitions, inputs, size in ((4, 1, 16_000_000), (16, 7, 30_000)):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", size)
            rows = lm_scoring.score(docs.repartition(inputs)).collect()
            results.append({row.doc_id: row.score for row in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held[0])
        spark.conf.set("spark.sql.adaptive.enabled", held[1])
    assert results[0] == results[1]


def test_query_learns_the_language(spark, sf_dir):
    got = op2_lm_score(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(got, [(row.doc_id, row.text) for row in docs])
    held = [row for row in got if row.held_out]
    bits = -math.log2(10) * sum(row.score for row in held)
    size = {row.doc_id: len(lm_scoring.canonical(row.text.encode())) for row in docs}
    assert bits / sum(size[row.doc_id] for row in held) < 3.2


def test_few_windows_are_searched_and_all_are_found(monkeypatch):
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 56, 300_000).astype(np.uint64))
    steps = np.arange(keys.size) * 3
    searched, real = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest: searched.append(np.size(v)) or real(a, v, *rest))
    monkeypatch.setattr(lm_scoring, "_PLACE_BITS", 20)
    monkeypatch.setattr(lm_scoring, "_SECOND_BITS", 18, raising=False)
    order = np.random.default_rng(4).permutation(keys.size)
    lookup = lm_scoring.Lookup(keys[order], steps[order])
    assert (lookup.of(keys) == steps).all()
    assert sum(searched) < 0.02 * keys.size
    # Places that are far too few still leave every window its own score.
    monkeypatch.setattr(lm_scoring, "_PLACE_BITS", 3)
    monkeypatch.setattr(lm_scoring, "_SECOND_BITS", 2, raising=False)
    assert (lm_scoring.Lookup(keys, steps).of(keys[::-1]) == steps[::-1]).all()


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_windows_are_listed_alike_however_many_are_sorted_at_a_time(monkeypatch, most):
    monkeypatch.setattr(lm_scoring, "_SORTED", most)
    texts = [lm_scoring.canonical(t) for t in (b"one two one two", b"", b"two three", b"one two")]
    learnt = np.array([True, False, False, True])
    want: dict = {}
    for text, own in zip(texts, learnt, strict=True):
        for key in lm_scoring._windows([lm_scoring._PAD + text], [0])[0].tolist():
            want[key] = want.get(key, 0) + int(own)
    keys, counts = lm_scoring.listed(texts, learnt)
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
    assert (np.diff(keys.astype(np.int64)) > 0).all()
