import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obligor.llm import periodic_runs
from obligor.llm.queries import op12_periodic_runs
from pyspark.sql import functions as F


def brute(words, least=periodic_runs.LEAST_WORDS):
    """Every stretch of equal neighbours at every distance; the smallest distance wins."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in found.items())


def without(words, runs):
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in dropped)


def check(texts):
    got = list(periodic_runs.find([" ".join(t).encode() for t in texts]))
    assert len(got) == len(texts)
    for words, (runs, collapsed) in zip(texts, got, strict=True):
        want = brute(words)
        assert sorted(map(tuple, runs.tolist())) == want
        assert [tuple(r) for r in runs.tolist()] == sorted(want, key=lambda r: (r[0], r[2]))
        assert collapsed.decode() == without(words, want)


def periodic(rng, alphabet):
    """Stretches of repeated pieces, some inside others, with a few words exchanged."""
    out = []
    for _ in range(rng.randint(0, 8)):
        piece = [rng.choice(alphabet) for _ in range(rng.randint(1, 40))]
        out += (piece * rng.randint(1, 6))[: rng.randint(1, 300)] * rng.choice([1, 1, 2])
    for _ in range(rng.randint(0, 3)):
        if out:
            out[rng.randrange(len(out))] = rng.choice(alphabet)
    return out


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnopqrst"])
def test_against_every_distance(letters):
    rng = random.Random(len(letters))
    check([periodic(rng, letters) for _ in range(40)])
    check([[rng.choice(letters) for _ in range(rng.randint(0, 200))] for _ in range(40)])


def test_small_turns_and_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "TURN", 50)
    monkeypatch.setattr(periodic_runs, "BLOCK_WORDS", 120)
    rng = random.Random(2)
    check([periodic(rng, "abcd") for _ in range(30)])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90), max_size=4))
def test_any_small_texts(texts):
    check(texts)


def test_extensions_are_those_of_plain_comparison():
    rng = random.Random(4)
    words = np.array([rng.randrange(2) for _ in range(300)] * 3 + [9])
    pairs = [(rng.randrange(len(words)), rng.randrange(len(words))) for _ in range(4000)]
    i, j = np.array([(a, b) for a, b in pairs if a != b]).T
    got = periodic_runs.Extensions(words).of(i, j)
    for a, b, n in zip(i, j, got, strict=True):
        k = 0
        while max(a, b) + k < len(words) and words[a + k] == words[b + k]:
            k += 1
        assert n == k


def test_cover_reaches_every_pair():
    members = set(periodic_runs.COVER)
    for i in range(periodic_runs.PERIOD):
        for j in range(periodic_runs.PERIOD):
            shift = periodic_runs._SHIFTS[i, j]
            assert (i + shift) % periodic_runs.PERIOD in members and (j + shift) % periodic_runs.PERIOD in members


def expected(doc_id, text):
    """The query's row by the words of its definition."""
    words = (text or "").encode().split()
    n = len(words)
    hashed = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if hashed % 10 == 0 and n:
        g = hashed // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    by_start = sorted(runs, key=lambda r: (r[0], r[2]))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in by_start)
    kept = without([w.decode() for w in words], runs)
    return (
        doc_id, len(runs), best[0], best[1], best[2],
        1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    short = {r.doc_id: r.text for r in docs if len((r.text or "").split()) < 1500}
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(docs) and len(short) > 0.9 * len(docs)
    assert {i: got[i] for i in short} == {i: expected(i, t) for i, t in short.items()}
    assert sum(r[1] > 0 for r in got.values()) >= len(got) // 20


def test_odd_rows(spark, tmp_path, odd, odd_rows):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(repr, (tuple(r) for r in op12_periodic_runs(spark, str(tmp_path)).collect())))
    assert got == sorted(repr(expected(i, t)) for i, t in odd_rows)


def test_empty_table(spark, empty):
    assert empty.select(periodic_runs.runs(F.col("text")).alias("of")).collect() == []
