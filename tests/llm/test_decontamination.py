import random

import pytest

from obligor.llm import decontamination as d
from obligor.llm.queries import op8_decontamination


@pytest.fixture(scope="module")
def bench(spark, words):
    rng = random.Random(21)
    own = ["".join(rng.choice("ghjkpqvwxyz") for _ in range(6)) for _ in range(400)]
    items = []
    for i in range(40):
        body = rng.choices(own, k=rng.randint(10, 40)) + rng.choices(words, k=10)
        rng.shuffle(body)
        items.append((i, " ".join(body[:-6]) + ". " + " ".join(body[-6:]).title() + "."))
    items.append((40, " ".join(rng.choices(own, k=300)) + "."))  # longer than a passage
    return items


def frame(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def hits(spark, rows, items):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.item_id) for r in d.contaminated(df, frame(spark, items)).collect()}


def test_verbatim_paraphrased_and_clean(spark, bench, words):
    rng = random.Random(22)
    rows, want = [], set()
    for i, text in bench:
        before, after = (" ".join(rng.choices(words, k=rng.randint(0, 200))) for _ in range(2))
        rows.append((i, f"{before} {text.upper()} {after}"))
        body = text.split()
        for _ in range(len(body) // 7):
            body[rng.randrange(len(body))] = rng.choice(words)
        rows.append((100 + i, f"{before} {', '.join(body)} {after}"))
        want |= {(i, i), (100 + i, i)}
        rows.append((200 + i, f"{before} {after}"))
        rows.append((300 + i, f"{before} {' '.join(text.split()[: len(text.split()) // 3])} {after}"))
    assert hits(spark, rows, bench) == want


def test_slices_find_the_same(spark, bench, monkeypatch):
    rows = [(i, text) for i, text in bench]
    whole = hits(spark, rows, bench)
    monkeypatch.setattr(d, "SLICE_ITEMS", 15)
    assert hits(spark, rows, bench) == whole == {(i, i) for i, _ in bench}


def test_lcs_matches_the_table():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 12))]
        b = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(0, 12))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert d.lcs(d.bits_of(a), b) == table[-1][-1]


def test_odd_rows_and_clean(spark, odd, odd_rows, bench):
    text = dict(odd_rows)[5] + " " + dict(odd_rows)[6]
    items = [*bench[:3], (50, text), (51, text), (52, None), (53, ""), (54, "too short"), (None, bench[3][1])]
    df = odd.union(odd.limit(1).selectExpr("900L", f"'{bench[0][1]} x'", *odd.columns[2:]))
    found = d.contaminated(df, frame(spark, items)).collect()
    assert (900, 0) in {(r.doc_id, r.item_id) for r in found}
    kept = d.clean(df, frame(spark, items))
    assert kept.columns == odd.columns
    bad = {r.doc_id for r in found}
    assert kept.count() == sum(1 for r in df.select("doc_id").collect() if r.doc_id not in bad or r.doc_id is None)


def test_empty_tables(spark, odd, empty, bench):
    assert d.contaminated(empty, frame(spark, bench)).collect() == []
    assert d.contaminated(odd, frame(spark, [])).collect() == []
    assert d.clean(odd, frame(spark, [])).count() == odd.count()


def test_query(spark, sf_dir):
    got = {(r.doc_id, r.item_id) for r in op8_decontamination(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    want = set()
    for doc in docs:
        whole = b" %s " % b" ".join(d.plain_words(doc.text.encode()))
        for item in items:
            if b" %s " % b" ".join(d.plain_words(item.text.encode())) in whole:
                want.add((doc.doc_id, item.item_id))
    assert want and got == want


def test_verbatim_item_of_common_words_among_rare_ones(spark):
    rng = random.Random(31)
    common = [f"w{i}" for i in range(40)]
    text = " ".join(rng.sample(common, 9))
    rows = [(i, " ".join(rng.choices(common, k=60))) for i in range(300)]
    rare = [f"r{i}" for i in range(200)]
    rows.append((1000, " ".join([*rare[:100], text, *rare[100:]])))
    assert (1000, 1) in hits(spark, rows, [(1, text)])


def test_repeats_and_common_words_do_not_lengthen_a_passage(spark):
    """The latent route alone: no run of the item is whole."""
    rng = random.Random(32)
    body = [f"q{i}" for i in range(10)]
    filler = [f"f{i}" for i in range(6)]
    changed = [w for i, q in enumerate(body) for w in ([q, "f0"] if i % 3 == 2 else [q])]
    rows = [(i, " ".join(rng.choices(filler, k=64))) for i in range(2000)]
    around = rng.choices(filler, k=200)
    rows.append((5000, " ".join([*around[:100], *changed, *around[100:]])))
    items = [(7, " ".join(body))]
    piece = d.prepared(
        spark,
        spark.createDataFrame(rows, "doc_id long, text string"),
        d.Slice(items),
    )
    assert piece.others.min() < 0.1 < piece.others.max()
    assert hits(spark, rows, items) == {(5000, 7)}


def test_directions_keep_every_item(spark):
    """One odd item of frequent words among many that point the same way."""
    rng = random.Random(33)
    shared = [f"s{i}" for i in range(12)]
    items = [(i, " ".join(shared)) for i in range(100)]
    items.append((500, " ".join(f"z{i}" for i in range(8))))
    rows = [(i, " ".join(rng.choices([f"z{i}" for i in range(8)], k=30))) for i in range(50)]
    piece = d.Slice(items)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, d._RANK = d._RANK, 1
    try:
        piece = d.prepared(spark, docs, piece)
    finally:
        d._RANK = old
    for k in range(len(piece.passages)):
        whole = (piece.vector(k) ** 2).sum()
        assert (piece.latent[k] ** 2).sum() >= 0.99 * whole


def test_short_items_are_found_whole(spark, words):
    rng = random.Random(34)
    short = "What is the capital city of France?"
    items = [(1, short), (2, "Yes."), (3, "?!"), (4, short), (5, "of france today")]
    filler = " ".join(rng.choices(words, k=90))
    rows = [
        (10, f"{filler} what is the Capital city, of FRANCE {filler}"),
        (11, f"{filler} what is the capital of france"),
        (12, f"oh yes {filler}"),
        (13, "what is the capital city of"),
        (14, "France? Yesterday"),
        (15, short),
        (15, short),
        (None, None),
    ]
    want = {(10, 1), (10, 4), (12, 2), (15, 1), (15, 4)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = d.contaminated(df, frame(spark, items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == want and len(found) == 7
    assert {(r.overlap, r.answer_overlap) for r in found} == {(1.0, 1.0)}
    long = (6, " ".join(f"n{i}" for i in range(20)))
    assert hits(spark, [*rows, (16, long[1])], [*items, long]) == want | {(16, 6)}
