import hashlib
import textwrap

import pytest

from obligor.llm import licenses
from obligor.llm.license_texts import LICENCES, SPELLINGS


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {row.doc_id: row for row in licenses.license_scan(df).collect()}


def test_every_known_text_is_found_in_other_dress(spark):
    texts = []
    for _, text in LICENCES:
        changed = "\n".join(f"  * {line.upper()} " for line in text.split("\n")).replace('"', "''")
        texts.append(f"/* Copyright (c) 2020, 2021 Some Body\n(C) another\n * All Rights Reserved.\n{changed}\n*/")
    got = scan(spark, texts)
    assert [got[i].license_id for i in range(len(texts))] == [name for name, _ in LICENCES]


def test_spellings_and_near_misses(spark):
    mit = dict(LICENCES)["MIT"]
    bsd = dict(LICENCES)["BSD-3-Clause"]
    texts = [
        mit.replace("NONINFRINGEMENT", "NON-INFRINGEMENT").replace("sublicense", "sub-licence"),
        bsd.replace("copyright holder", "copyright owner").replace("COPYRIGHT HOLDER", "Copyright Owner"),
        mit + " And more.",
        mit.replace("free of charge", "for a fee"),
    ]
    got = scan(spark, texts)
    assert [got[i].license_id for i in range(4)] == ["MIT", "BSD-3-Clause", None, None]


def test_notices_in_lines(spark):
    text = "Prose.\n  Released under the MIT licence!\nmore\nLicensed under CC BY-NC 4.0.\nReleased under the MIT License."
    assert scan(spark, [text])[0].notices == "CC-BY-NC-4.0,MIT"


def test_odd_rows(odd, odd_rows, empty):
    got = licenses.license_scan(odd).collect()
    assert len(got) == len(odd_rows)
    nothing = hashlib.sha256(b"").hexdigest()
    assert {row.digest for row in got if row.doc_id in (100, 101, 102)} == {nothing}
    assert all(row.license_id is None and row.notices == "" for row in got)
    assert licenses.license_scan(empty).collect() == []


def test_plan_has_no_shuffle_and_no_python(odd):
    plan = licenses.license_scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Exchange hash", "SortMergeJoin"))


@pytest.mark.parametrize("pair", SPELLINGS)
def test_spellings_are_settled(pair):
    assert pair[0] != pair[1] and pair[1] not in {old for old, _ in SPELLINGS}


def test_wrapping_does_not_matter(spark):
    texts, want = [], []
    for name, text in LICENCES:
        for width in [*range(30, 125), 100_000]:
            texts.append("\n".join(textwrap.wrap(" ".join(text.split()), width, break_long_words=False)))
            want.append(name)
    got = scan(spark, texts)
    assert [got[i].license_id for i in range(len(texts))] == want


NOTICES = [
    "Copyright (c) 2020 X.",
    "Copyright (c) 1998-2020 Foo, Inc. All rights reserved.",
    "Copyright 2020 Some Body.",
    "(c) 2020 Some Body.",
    "Copyright Some Body and others.",
]


def test_notice_and_licence_on_one_line(spark):
    bodies = [(name, " ".join(text.split())) for name, text in LICENCES if len(text) > 200]
    pairs = [(name, f"{notice} {body}") for name, body in bodies for notice in NOTICES]
    got = scan(spark, [text for _, text in pairs])
    assert [got[i].license_id for i in range(len(pairs))] == [name for name, _ in pairs]


def test_notices_on_their_own_lines(spark):
    mit = dict(LICENCES)["MIT"]
    lines = [*NOTICES, "Copyright 2020 John Q. Public and the other authors of it", "Copyright (C) 2020 Foo Inc. and its affiliates and all other authors"]
    got = scan(spark, [f"{line}\n\n{mit}" for line in lines])
    assert [got[i].license_id for i in range(len(lines))] == ["MIT"] * len(lines)
