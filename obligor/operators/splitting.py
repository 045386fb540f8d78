"""Exact stratified splits and folds without sorting the table.

Rows are ordered inside each class by a pseudo-random key. A split only needs the key
at a few ranks of each class; once these are selected, assigning rows is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obligor.operators.selection import (
    MAX_GROUPS,
    Cut,
    Extent,
    after_cut,
    group_extents,
    numeric_id,
    rank_cuts,
)
from obligor.session import col


def shuffle_key(id_col: str, seed: int) -> Column:
    """Pseudo-random order of any id type."""
    return F.xxhash64(F.lit(seed), col(id_col))


def portable_key(id_col: str, seed: int) -> Column:
    """Pseudo-random order of integer ids by plain arithmetic, for checks in other engines."""
    base = F.pmod(col(id_col), F.lit(2147483648).cast("bigint"))
    return F.pmod(base * F.lit(2654435761) + F.lit(seed), F.lit(4294967296).cast("bigint"))


def largest_remainder(counts: Mapping[int, int], draws: int) -> dict[int, int]:
    """Share ``draws`` among classes in proportion to their counts."""
    total = sum(counts.values())
    exact = {c: n * draws / total for c, n in counts.items()}
    quota = {c: math.floor(x) for c, x in exact.items()}
    open_seats = draws - sum(quota.values())
    for c in sorted(counts, key=lambda c: (quota[c] - exact[c], c))[:open_seats]:
        quota[c] += 1
    return quota


def class_sizes(df: DataFrame, target: str) -> dict[int, int]:
    """Rows per class code; refuses a column that is no class label before listing it."""
    counts = df.groupBy(col(target).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows = counts.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS or any(r["y"] is None for r in rows):
        raise ValueError(f"'{target}' holds NULLs or more than {MAX_GROUPS} classes.")
    return {r["y"]: r["n"] for r in sorted(rows, key=lambda r: r["y"])}


class _Ordered:
    """Rows in key order inside their class, and the class sizes, from one scan."""

    def __init__(self, df: DataFrame, target: str, id_col: str, key: Column) -> None:
        self.target, self.key, self.row_id = target, key, numeric_id(df, id_col)
        self.rows = df.select(
            col(target).cast("string").alias("g"), key.alias("v"), self.row_id.alias("id")
        )
        self.extents: dict[str, Extent] = group_extents(self.rows)
        if None in self.extents:
            raise ValueError(f"'{target}' holds NULLs.")
        sizes = {int(g): extent.rows for g, extent in self.extents.items()}
        self.sizes = dict(sorted(sizes.items()))

    def cuts(self, ranks: Mapping[int, list[int]]) -> dict[tuple[int, int], Cut]:
        """Cut after each given rank of each class; ranks below zero cut nothing off."""
        usable = {str(c): [r for r in wanted if r >= 0] for c, wanted in ranks.items()}
        found = rank_cuts(self.rows, usable, self.extents)
        return {(int(g), rank): cut for (g, rank), cut in found.items()}

    def test_part(self, quotas: Mapping[int, int], cuts: Mapping[tuple[int, int], Cut]) -> Column:
        part = F.lit("train")
        for c, quota in quotas.items():
            if quota:
                first = ~after_cut(self.key, self.row_id, cuts[c, quota - 1])
                part = F.when((col(self.target) == c) & first, "test").otherwise(part)
        return part

    def fold(self, ends: Mapping[int, list[int]], cuts: Mapping[tuple[int, int], Cut]) -> Column:
        """Number of fold ends passed; ``ends`` are ranks just behind a fold."""
        fold = F.lit(None).cast("int")
        for c, stops in ends.items():
            place = F.lit(0)
            for end in stops[:-1]:
                cut = cuts.get((c, end - 1))
                passed = after_cut(self.key, self.row_id, cut).cast("int") if cut else F.lit(1)
                place = place + passed
            fold = F.when(col(self.target) == c, place).otherwise(fold)
        return fold


def quotas_of_test_part(sizes: Mapping[int, int], test_size: float) -> dict[int, int]:
    """Test rows per class; the total is exactly the rounded-up share."""
    if min(sizes.values()) < 2:
        raise ValueError("Every class needs at least two rows for a stratified split.")
    total = sum(sizes.values())
    draws = math.ceil(test_size * total)
    if draws < len(sizes) or total - draws < len(sizes):
        raise ValueError("Both parts of a stratified split need one row per class.")
    train = largest_remainder(sizes, total - draws)
    return {c: sizes[c] - train[c] for c in sizes}


def split_column(
    df: DataFrame,
    target: str,
    id_col: str,
    test_size: float = 0.2,
    seed: int = 42,
    key: Column | None = None,
) -> Column:
    """'test' or 'train' as an expression over the id and target columns.

    Only these two columns of ``df`` are read; the expression then fits any table that
    has them.
    """
    ordered = _Ordered(df, target, id_col, shuffle_key(id_col, seed) if key is None else key)
    quotas = quotas_of_test_part(ordered.sizes, test_size)
    return ordered.test_part(quotas, ordered.cuts({c: [q - 1] for c, q in quotas.items()}))


def split_and_fold_columns(
    df: DataFrame,
    target: str,
    id_col: str,
    test_size: float,
    k: int,
    seed: int = 42,
    key: Column | None = None,
) -> tuple[Column, Column, dict[int, int]]:
    """Split and fold expressions and the training rows per class.

    Test rows come first in key order, so the fold ends of the training rows are ranks
    of the same order and one selection serves both. Folds of test rows mean nothing.
    """
    ordered = _Ordered(df, target, id_col, shuffle_key(id_col, seed) if key is None else key)
    quotas = quotas_of_test_part(ordered.sizes, test_size)
    train = {c: n - quotas[c] for c, n in ordered.sizes.items()}
    ends = {
        c: [quotas[c] + end for end in stops] for c, stops in fold_ends(train, k).items()
    }
    ranks = {c: [quotas[c] - 1, *(end - 1 for end in ends[c][:-1])] for c in train}
    cuts = ordered.cuts(ranks)
    return ordered.test_part(quotas, cuts), ordered.fold(ends, cuts), train


def stratified_split(
    df: DataFrame,
    target: str,
    id_col: str,
    test_size: float = 0.2,
    seed: int = 42,
    key: Column | None = None,
    output: str = "split",
) -> DataFrame:
    """Add ``split``: exact class-proportional 'test' and 'train' parts."""
    return df.withColumn(output, split_column(df, target, id_col, test_size, seed, key))


def fold_sizes(sizes: Mapping[int, int], k: int) -> dict[int, list[int]]:
    """Rows per class and fold when class-sorted rows are dealt round robin."""
    result, start = {}, 0
    for c, n in sizes.items():
        result[c] = [(start + n - f + k - 1) // k - (start - f + k - 1) // k for f in range(k)]
        start += n
    return result


def fold_ends(sizes: Mapping[int, int], k: int) -> dict[int, list[int]]:
    """Rank just behind each fold of each class."""
    if k < 2 or k > max(sizes.values()):
        raise ValueError(f"{k} folds do not fit the class sizes {sizes}.")
    return {c: list(accumulate(counts)) for c, counts in fold_sizes(sizes, k).items()}


def fold_column(
    df: DataFrame,
    target: str,
    id_col: str,
    k: int = 5,
    seed: int = 42,
    key: Column | None = None,
) -> Column:
    """Fold number in 0..k-1 as an expression over the id and target columns."""
    ordered = _Ordered(df, target, id_col, shuffle_key(id_col, seed) if key is None else key)
    ends = fold_ends(ordered.sizes, k)
    cuts = ordered.cuts({c: [end - 1 for end in stops[:-1]] for c, stops in ends.items()})
    return ordered.fold(ends, cuts)


def stratified_folds(
    df: DataFrame,
    target: str,
    id_col: str,
    k: int = 5,
    seed: int = 42,
    key: Column | None = None,
    output: str = "fold",
) -> DataFrame:
    """Add ``fold`` in 0..k-1 with exact counts per class and fold."""
    return df.withColumn(output, fold_column(df, target, id_col, k, seed, key))


def fixed_sample(
    df: DataFrame, id_col: str, size: int = 50, seed: int = 42, key: Column | None = None
) -> DataFrame:
    """The same ``size`` rows on every run: a bounded top-k by hash."""
    key = shuffle_key(id_col, seed) if key is None else key
    return df.orderBy(key, col(id_col)).limit(size)
