import random

import pytest

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, score string,"
    " `label` string, `key` string, kept_id long, bad_id long, `print` string, ids string, part int"
)


def docs_of(spark, rows):
    """Documents with extra columns whose names operators use for themselves."""
    full = [(i, t, "en", f"src{k % 3}", len(t or ""), "s", "l", "k", 7, 8, "p", "i", 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abdeilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(300)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null ids, null, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    prose = [" ".join(rng.choices(words, k=rng.randint(1, 80))) for _ in range(30)]
    rows = list(enumerate(prose))
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "x" * 70_000), (104, " ".join(words) * 40)]
    rows += [(105, prose[0]), (106, prose[0]), (3, prose[3]), (3, prose[3]), (None, prose[4]), (None, None)]
    rows += [(107, "Ünïcødé ﬀ İ \x00 \x1c ՘ 漢字 😀"), (108, "\n".join(["same line"] * 50))]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return docs_of(spark, odd_rows)


@pytest.fixture(scope="session")
def empty(spark):
    return docs_of(spark, []).limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(30)]
    rows += [(None, 1, 1), (5, None, None), (6, 0, 1), (6, 1, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
