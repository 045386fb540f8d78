"""Cutoff-dependent metrics: confusion counts, precision, recall, F1, best cutoff."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obligor.session import col

# The searched cutoffs, 181 even steps from 0.05 to 0.95.
FIRST, LAST, STEPS = 0.05, 0.95, 181
GRID = [FIRST + i * ((LAST - FIRST) / (STEPS - 1)) for i in range(STEPS - 1)] + [LAST]


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio_or_zero(2 * tp, 2 * tp + fp + fn)


def threshold_counts(
    df: DataFrame, y: str, score: str, threshold: Column, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, tp, fp, fn, tn) where score >= threshold predicts default."""
    hit, flagged = col(y) == 1, col(score) >= threshold
    return df.groupBy(*keys).agg(
        F.count_if(hit & flagged).alias("tp"),
        F.count_if(~hit & flagged).alias("fp"),
        F.count_if(hit & ~flagged).alias("fn"),
        F.count_if(~hit & ~flagged).alias("tn"),
    )


def with_rates(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns(
        {
            "precision": ratio_or_zero(tp, tp + fp),
            "recall": ratio_or_zero(tp, tp + fn),
            "f1": f1_of(tp, fp, fn),
        }
    )


def threshold_metrics(
    df: DataFrame, y: str, score: str, threshold: float, keys: Sequence[str] = ()
) -> DataFrame:
    """Counts, precision, recall and F1 at a given cutoff; an empty ratio is zero."""
    return with_rates(threshold_counts(df, y, score, F.lit(threshold), keys)).withColumn(
        "threshold", F.lit(float(threshold))
    )


def f1_by_threshold(
    df: DataFrame, y: str, score: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, step, threshold, f1) for every cutoff of the grid, from one pass.

    A row only adds to the count of cutoffs at or below its score (found by binary
    search), so the data shrinks to at most 182 rows per key before any shuffle.
    """
    usable = df.where(col(score).isNotNull() & col(y).isNotNull())
    narrow = usable.select(
        *[col(k) for k in keys], col(y).alias("_y"), col(score).cast("double").alias("_score")
    )
    slots = Bucketizer(
        splits=[-float("inf"), *GRID, float("inf")], inputCol="_score", outputCol="_passed"
    )
    hit = (F.col("_y") == 1).cast("bigint")
    counts = (
        slots.transform(narrow)
        .groupBy(*keys, F.col("_passed").cast("int").alias("passed"))
        .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    )
    # Every cutoff needs a row: add empty counts for all of them.
    steps = F.explode(F.sequence(F.lit(0), F.lit(STEPS)))
    holders = counts.select(*keys).distinct() if keys else df.sparkSession.range(1)
    empty = holders.select(
        *keys, steps.alias("passed"), F.lit(0).alias("pos"), F.lit(0).alias("neg")
    )
    full = (
        counts.unionByName(empty)
        .groupBy(*keys, "passed")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    above = Window.partitionBy(*keys).orderBy(F.desc("passed"))
    everything = Window.partitionBy(*keys)
    cumulative = full.select(
        *keys,
        (F.col("passed") - 1).alias("step"),
        F.sum("pos").over(above).alias("tp"),
        F.sum("neg").over(above).alias("fp"),
        F.sum("pos").over(everything).alias("positives"),
    ).where("step >= 0")
    tp, fp = F.col("tp"), F.col("fp")
    grid = F.array(*[F.lit(t) for t in GRID])
    return cumulative.select(
        *keys,
        "step",
        grid[F.col("step")].alias("threshold"),
        f1_of(tp, fp, F.col("positives") - tp).alias("f1"),
    )


def best_threshold(
    df: DataFrame, y: str, score: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, threshold, f1): highest F1, the lowest cutoff on a tie."""
    ranked = F.struct(F.col("f1"), -F.col("step"))
    return f1_by_threshold(df, y, score, keys).groupBy(*keys).agg(
        F.max_by("threshold", ranked).alias("threshold"), F.max("f1").alias("f1")
    )


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, actual, predicted, rows) on the full grid of labels seen on either side."""
    counts = df.groupBy(
        *keys,
        col(actual).cast("int").alias("actual"),
        col(predicted).cast("int").alias("predicted"),
    ).agg(F.count(F.lit(1)).alias("rows"))
    # Labels are class codes, so the list and its square are small.
    labels = counts.groupBy(*keys).agg(
        F.array_sort(F.array_union(F.collect_set("actual"), F.collect_set("predicted"))).alias("l")
    )
    grid = labels.select(*keys, F.explode("l").alias("actual"), "l").select(
        *keys, "actual", F.explode("l").alias("predicted")
    )
    return grid.join(counts, [*keys, "actual", "predicted"], "left").select(
        *keys, "actual", "predicted", F.coalesce("rows", F.lit(0)).alias("rows")
    )
