"""Filter interaction audit: what each of five filters removes, in every order of them.

Each text is measured once, in one pass over Arrow batches. From then on only narrow rows
move: copies of a text are found by its SHA-256, so "identical to the text of a smaller
id" is a minimum per digest, combined before the shuffle; a text that a third of all rows share
costs one row per task. What reaches the audit is a contingency table of at most 32
cells per part. Its counts are reshaped to a 2x2x2x2x2 tensor (axis per filter, 0 passes, 1
fails); for every filter and every set of earlier ones an einsum contracts each axis with a
selector of pass, fail or all. The 120 orders only pick from those 5 x 16 contractions.

Parts are contracted where they are: a task holds one part's 32 cells at a time.

Defined results: a null text is empty; a null part is the empty string. A row without an id
is no document with a smaller id and has none above it, so it never fails E and makes none
fail; it has no labels. Rows that repeat an id count each, and do not fail E
against each other. A document whose labels differ counts as 1. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations, product
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obligor.llm.words import texts_of

FILTERS = "ABCDE"
#: Fewest words.
LEAST_WORDS = 100
#: Smallest share of distinct words, in percent.
LEAST_DISTINCT = 80
#: Largest share of capital letters, in percent.
MOST_CAPITALS = 10
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SYMBOLS = re.compile(rb"[#$%&*|]")
#: Rows without an id are dealt over this many keys where rows are brought together by id.
_SALTS = 1024

MEASURED = T.StructType(
    [T.StructField("digest", T.BinaryType()), *(T.StructField(f, T.IntegerType()) for f in "abcd")]
)
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long,"
    " unique_fails long, good_lost long, toxic_lost long, shapley long"
)


def measure(text: bytes, points: int) -> tuple[bytes, int, int, int, int]:
    """Digest of a text, and whether it fails A, B, C and D."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        hashlib.sha256(text).digest(),
        int(len(words) < LEAST_WORDS),
        int(100 * len(set(words)) < LEAST_DISTINCT * len(words)),
        int(100 * capitals > MOST_CAPITALS * points),
        int(_SYMBOLS.search(text) is not None),
    )


@F.arrow_udf(MEASURED)
def _measured(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in columns:
        points = pc.fill_null(pc.utf8_length(column), 0).to_pylist()
        rows = [measure(text, n) for text, n in zip(texts_of(column), points, strict=True)]
        digests, *fails = zip(*rows, strict=True) if rows else [[]] * 5
        arrays = [pa.array(digests, pa.binary()), *(pa.array(f, pa.int32()) for f in fails)]
        yield pa.StructArray.from_arrays(arrays, names=["digest", "a", "b", "c", "d"])


def cells(
    df: DataFrame,
    labels: DataFrame,
    part: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(part, a, b, c, d, e, n, good, toxic): documents per part and set of failed filters."""
    flags = ["a", "b", "c", "d"]
    rows = df.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(part.cast("string"), F.lit("")).alias("part"),
        _measured(F.col(f"`{text_col}`")).alias("of"),
    ).select("id", "part", "of.*")
    # Repeated rows meet here, so that below an id has one row per text and part.
    rows = rows.groupBy("id", "part", "digest", *flags).agg(F.count(F.lit(1)).alias("rows"))
    # Rows without an id find no label; the salt deals them over the tasks.
    salt = F.when(F.col("id").isNull(), F.abs(F.hash("digest", "part")) % _SALTS).otherwise(0)
    marked = (
        labels.where(F.col(f"`{id_col}`").isNotNull())
        .groupBy(F.col(f"`{id_col}`").alias("id"))
        .agg(
            F.max((F.col("quality") == 1).cast("int")).alias("good"),
            F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
        )
        .withColumn("salt", F.lit(0))
    )
    rows = rows.withColumn("salt", salt).join(marked, ["id", "salt"], "left")
    groups = rows.groupBy(
        "digest", "part", *flags, F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    ).agg(
        F.sum("rows").alias("rows"),
        F.sum(F.when(F.col("id").isNull(), F.col("rows")).otherwise(0)).alias("nameless"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "rows"))).alias("least"),
    )
    # A digest has at most four rows per part by now.
    lowest = F.expr("min(least.id) OVER (PARTITION BY digest)")
    first = F.col("nameless") + F.when(F.col("least.id") == lowest, F.col("least.rows")).otherwise(0)
    both = groups.withColumn("first", first).select(
        "part", *flags, "good", "toxic", F.explode(F.array(
            F.struct(F.lit(0).alias("e"), F.col("first").alias("n")),
            F.struct(F.lit(1).alias("e"), (F.col("rows") - F.col("first")).alias("n")),
        )).alias("dealt"),
    )
    n = F.col("dealt.n")
    return both.groupBy("part", *flags, F.col("dealt.e").alias("e")).agg(
        F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic")
    )


# Selectors of an axis: those that pass, those that fail, all.
_SELECT = {"pass": np.array([1, 0]), "fail": np.array([0, 1]), "all": np.array([1, 1])}


def contract(tensor: np.ndarray, chosen: dict[int, str]) -> np.ndarray:
    """Sum of ``tensor`` (quantities x 2x2x2x2x2) over the cells chosen; other axes take all."""
    axes = [_SELECT[chosen.get(k, "all")] for k in range(len(FILTERS))]
    return np.einsum("qabcde,a,b,c,d,e->q", tensor, *axes)


def audit_part(part: str, tensor: np.ndarray) -> pd.DataFrame:
    """All orders and steps of one part; ``tensor`` holds counts of rows, good and toxic ones."""
    size = len(FILTERS)
    own, failing = {}, {}
    for k in range(size):
        failing[k] = contract(tensor, {k: "fail"})[0]
        others = [j for j in range(size) if j != k]
        for taken in product((False, True), repeat=size - 1):
            earlier = frozenset(j for j, t in zip(others, taken, strict=True) if t)
            own[k, earlier] = contract(tensor, {**dict.fromkeys(earlier, "pass"), k: "fail"})
    alone = {k: own[k, frozenset(j for j in range(size) if j != k)][0] for k in range(size)}
    # A set of s earlier filters precedes the filter in s! (4 - s)! of the orders.
    shapley = {
        k: sum(
            factorial(len(earlier)) * factorial(size - 1 - len(earlier)) * lost[0]
            for (j, earlier), lost in own.items()
            if j == k
        )
        for k in range(size)
    }
    rows = []
    for order in permutations(range(size)):
        left = int(tensor[0].sum())
        for step, k in enumerate(order, start=1):
            lost, good, toxic = (int(v) for v in own[k, frozenset(order[: step - 1])])
            left -= lost
            rows.append((
                part, "".join(FILTERS[j] for j in order), step, left, lost,
                int(failing[k]) - lost, int(alone[k]), good, toxic, int(shapley[k]),
            ))
    return pd.DataFrame(rows, columns=[name.split()[0] for name in AUDIT.split(", ")])


def _tensor(counts: pd.DataFrame) -> np.ndarray:
    tensor = np.zeros((3, *[2] * len(FILTERS)), np.int64)
    where = tuple(counts[f].to_numpy() for f in FILTERS.lower())
    for q, name in enumerate(("n", "good", "toxic")):
        tensor[(q, *where)] = counts[name].to_numpy()
    return tensor


def audit(df: DataFrame, labels: DataFrame, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per part, order of the filters and step, see ``AUDIT``.

    ``labels`` has the id and the columns quality and toxic.
    """

    def orders(group: pd.DataFrame) -> pd.DataFrame:
        return audit_part(group["part"].iloc[0], _tensor(group))

    return cells(df, labels, part, id_col, text_col).groupBy("part").applyInPandas(orders, AUDIT)
