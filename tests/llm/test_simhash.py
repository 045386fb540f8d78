import random
import re

import numpy as np
import pytest
import xxhash

from obligor.llm import simhash
from obligor.llm.components import UnionFind, roots
from obligor.llm.queries import op3_simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected(rows, radius=4):
    prints = [fingerprint(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in groups.items()}
    return sorted(
        ((d is None, d or 0, format(prints[i], "016x"), smallest[find(i)]) for i, (d, _) in enumerate(rows)), key=str
    )


def as_rows(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def near_rows(words):
    """Chains of near copies: each changes a few words of the one before."""
    rng = random.Random(5)
    rows = []
    for base in range(6):
        text = rng.choices(words, k=150)
        for _ in range(25):
            rows.append((1000 - len(rows), " ".join(text)))
            text = list(text)
            text[rng.randrange(len(text))] = rng.choice(words)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile_rows", [7, 40, 32_768])
def test_components_match_brute_force(spark, near_rows, tile_rows):
    df = spark.createDataFrame(near_rows, "doc_id long, text string")
    want = expected(near_rows)
    assert len({w[3] for w in want}) < len(near_rows)
    assert as_rows(simhash.near_duplicates(df, tile_rows=tile_rows)) == want


def test_odd_rows(odd, odd_rows):
    assert as_rows(simhash.near_duplicates(odd)) == expected(odd_rows)


def test_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.keep_first(empty).collect() == []


def test_keep_first_keeps_one_id_of_each_group(odd, odd_rows):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    want = expected(odd_rows)
    stay = {d for missing, d, _, c in want if not missing and d == c}
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in ids if i is not None} == stay
    assert ids.count(None) == sum(1 for i, _ in odd_rows if i is None)


def test_tile_links_are_exact():
    rng = np.random.default_rng(0)
    left = rng.integers(0, 2**63, 300, dtype=np.uint64)
    right = np.concatenate([left[:50] ^ np.uint64(0b10110), left[50:90] ^ np.uint64(0x1F), rng.integers(0, 2**63, 200, dtype=np.uint64)])
    got = {(int(i), int(j)) for a, b in simhash.tile_links(left, right, 4) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(300) for j in range(right.size) if (int(left[i]) ^ int(right[j])).bit_count() <= 4}
    assert got == want and len(want) >= 50


def test_roots_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(1, 1), (7, 8), (8, 7)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.root for r in roots(df).collect()}
    want = {i: 100 for i in range(100, 161)} | {k: 5 for k in [5, *range(200, 260)]} | {7: 7, 8: 7}
    assert got == want


def test_union_find_forest():
    joined = UnionFind()
    joined.join_all(np.array([3, 4, 9, 2]), np.array([4, 5, 9, 5]))
    src, dst = joined.edges()
    assert sorted(zip(src.tolist(), dst.tolist(), strict=True)) == [(3, 2), (4, 2), (5, 2)]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert as_rows(op3_simhash(spark, sf_dir)) == expected([(r.doc_id, r.text) for r in docs])
