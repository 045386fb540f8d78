"""Finding and encoding classification targets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.operators.profile import as_text, distinct_estimates, value_counts
from obligor.session import col

# Class limits and the wording of the preview.
MIN_CLASSES = 2
MAX_CLASSES = 20
ALREADY_BINARY = "already 0/1 (assumes 1 = positive/default outcome)"
DEFAULT_FOLDS = 5


def target_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, values) of the columns that can be a target, values in text order.

    A sketch first rules out columns with far too many values, so that only short value
    lists are shuffled; the limit itself is checked on exact counts.
    """
    estimates = distinct_estimates(df, columns)
    short = [c for c in columns if estimates[c] <= 2 * MAX_CLASSES]
    if not short:
        empty = "column string, classes bigint, values array<string>"
        return df.sparkSession.createDataFrame([], empty)
    counts = value_counts(df, short)
    fit = (
        counts.groupBy("column")
        .agg(F.count(F.lit(1)).alias("classes"))
        .where(F.col("classes").between(MIN_CLASSES, MAX_CLASSES))
    )
    listed = counts.join(fit, "column").groupBy("column", "classes")
    return listed.agg(F.array_sort(F.collect_list("value")).alias("values"))


def target_candidates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, classes, encoding): every possible target and how it would be coded."""
    values = F.col("values")
    pair = F.concat(
        F.lit("'"), values[0], F.lit("' / '"), values[1], F.lit("' — you'll choose which is positive")
    )
    listing = F.array_join(
        F.transform(
            values, lambda v, i: F.concat(F.lit("'"), v, F.lit("' → "), i.cast("string"))
        ),
        ", ",
    )
    binary = values == F.array(F.lit("0"), F.lit("1"))
    return target_values(df, columns).select(
        "column",
        "classes",
        F.when(binary, ALREADY_BINARY).when(F.col("classes") == 2, pair).otherwise(listing).alias(
            "encoding"
        ),
    )


def class_codes(df: DataFrame, target: str, positive: str | None = None) -> dict[str, int]:
    """Text value to class code.

    Two values other than 0 and 1 need ``positive``; three or more are numbered in
    text order, so "10" comes before "2".
    """
    rows = (
        df.where(col(target).isNotNull())
        .select(as_text(df, target).alias("value"))
        .distinct()
        .limit(MAX_CLASSES + 1)
        .collect()
    )
    values = sorted(r["value"] for r in rows)
    if not MIN_CLASSES <= len(values) <= MAX_CLASSES:
        raise ValueError(f"'{target}' needs {MIN_CLASSES} to {MAX_CLASSES} distinct values.")
    if values == ["0", "1"]:
        return {"0": 0, "1": 1}
    if len(values) == 2:
        if positive not in values:
            raise ValueError(f"Name the positive value of '{target}': one of {values}.")
        return {value: int(value == positive) for value in values}
    return {value: code for code, value in enumerate(values)}


def encode_target(
    df: DataFrame, target: str, codes: dict[str, int], output: str = "default"
) -> DataFrame:
    """Replace the target by its code; a NULL or unlisted value has none and is NULL."""
    code = None
    value = as_text(df, target)
    for label, number in codes.items():
        code = F.when(value == label, number) if code is None else code.when(value == label, number)
    kept = [col(c) for c in df.columns if c != target]
    return df.select(*kept, code.cast("int").alias(output))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.where(col(target).isNotNull()).groupBy(col(target).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def fold_limits(df: DataFrame, target: str) -> DataFrame:
    """One row: most folds the rarest class allows, and the default."""
    most = F.greatest(F.lit(2).cast("bigint"), F.min("rows"))
    return class_counts(df, target).agg(
        most.alias("max_folds"),
        F.least(F.lit(DEFAULT_FOLDS).cast("bigint"), most).alias("default_folds"),
    )
