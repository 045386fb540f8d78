import random
from itertools import permutations

import pytest

from obligor.llm import filter_audit
from obligor.llm.queries import op13_filter_audit
from pyspark.sql import functions as F

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def by_hand(rows, marks):
    """Apply the filters one after another to lists of rows (id, text, part)."""
    good = {i for i, q, _ in marks if q == 1}
    toxic = {i for i, _, t in marks if t == 1}

    def fails(row):
        i, text, _ = row
        text = text or ""
        words = text.encode().split()
        same = [j for j, other, _ in rows if (other or "") == text and j is not None]
        return {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": i is not None and any(j < i for j in same),
        }

    judged = [(row, fails(row)) for row in rows]
    out = {}
    for part in {row[2] or "" for row in rows}:
        mine = [(row, f) for row, f in judged if (row[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, letter in enumerate(order, 1):
                lost = [x for x in left if x[1][letter]]
                redundant = sum(f[letter] for _, f in gone)
                left = [x for x in left if not x[1][letter]]
                gone += lost
                total[letter] += len(lost)
                out[part, "".join(order), step] = [
                    len(left), len(lost), redundant,
                    sum(f[letter] and sum(f.values()) == 1 for _, f in mine),
                    sum(row[0] in good for row, _ in lost), sum(row[0] in toxic for row, _ in lost),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(total[order[step - 1]])
    return out


def frame(spark, rows):
    full = [(i, t, p, "x", 1) for i, t, p in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, digest string, a int")


def got(df, marks):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in filter_audit.audit(df, marks, F.col("lang")).collect()}


@pytest.fixture(scope="module")
def rows(words):
    rng = random.Random(5)
    out = []
    for i in range(150):
        kind = rng.randrange(5)
        text = rng.sample(words, rng.choice([20, 120])) if kind else rng.choices(words[:60], k=130)
        if kind == 1:
            text = [w.upper() for w in text[:30]] + text[30:]
        if kind == 2:
            text.append(rng.choice("#$%&*|"))
        out.append((i, " ".join(text), rng.choice(["aa", "bb", None])))
    out += [(200 + k, out[k % 7][1], rng.choice(["aa", "cc"])) for k in range(60)]
    out += [(9, out[9][1], out[9][2]), (9, out[9][1], "zz"), (None, out[3][1], "aa"), (None, out[3][1], "aa"), (None, "only here", None)]
    out += [(300, None, "aa"), (301, "", "bb"), (302, " \t\n", "bb"), (303, "Ä" * 70_000 + " É", "aa"), (304, "\x1c A\x85b", "aa")]
    rng.shuffle(out)
    return out


def test_against_filters_applied_one_by_one(spark, rows):
    marks = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 220, 3)] + [(6, 0, 1), (6, 1, 0), (None, 1, 1), (3, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    clean = [m for m in marks if m[0] is not None]
    assert got(frame(spark, rows).repartition(7), labels) == by_hand(rows, clean)


def test_empty_tables(spark, rows, no_labels):
    assert got(frame(spark, []), no_labels) == {}
    plain = got(frame(spark, rows[:10]), no_labels)
    assert all(v[4] == v[5] == 0 for v in plain.values()) and len(plain) % 600 == 0


def test_query(spark, sf_dir):
    out = op13_filter_audit(spark, sf_dir)
    languages = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang").distinct().count()
    assert out.count() == 600 * languages
    # Orders differ in what each filter takes, not in what is left.
    last = out.where("step = 5").groupBy("part").agg(F.countDistinct("kept").alias("n"))
    assert {row.n for row in last.collect()} == {1}
