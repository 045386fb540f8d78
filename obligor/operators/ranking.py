"""Exact ranking metrics and curves over (y, score).

Everything starts from one table with the positives and negatives per distinct score,
so ties need no special care, and from running totals over that table. ``keys`` lets
one job measure many folds, classes or permutations at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obligor.operators.running import WINDOW_ROWS, running_totals
from obligor.session import col, pin, small_table


def score_counts(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, score, pos, neg), one row per distinct score; hot scores combine map-side."""
    hit = (col(y) == 1).cast("bigint")
    return (
        df.where(col(score).isNotNull() & col(y).isNotNull())
        .groupBy(*keys, (col(score).cast("double") + F.lit(0.0)).alias("score"))
        .agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    )


def curve(
    df: DataFrame,
    y: str,
    score: str,
    keys: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Cumulative true and false positives at every distinct score, highest first.

    Columns: keys, score, pos, neg, pos_before, neg_before, tp, fp, positives, negatives.
    """
    counts = pin(score_counts(df, y, score, keys), "scores")
    totals = counts.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")
    )
    placed = running_totals(counts, keys, "score", ["pos", "neg"], True, window_rows)
    placed = placed.withColumns(
        {"tp": F.col("pos_before") + F.col("pos"), "fp": F.col("neg_before") + F.col("neg")}
    )
    if keys:
        # One row per key: a curve's keys are models, folds, classes or (feature, repeat).
        return placed.join(F.broadcast(totals), list(keys))
    total = totals.first()
    return placed.withColumns(
        {c: F.lit(total[c]).cast("bigint") for c in ("positives", "negatives")}
    )


def _precision(tp: Column, fp: Column) -> Column:
    """Precision of a cutoff, one where nothing is selected."""
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))


def ranking_metrics(
    df: DataFrame,
    y: str,
    score: str,
    keys: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """One row per key: roc_auc, pr_auc, ks_statistic, gini, pr_curve_auc, positives, negatives.

    With a single class ROC AUC, KS and Gini are NULL.
    """
    c = {n: F.col(n) for n in ("pos", "neg", "pos_before", "neg_before", "tp", "fp")}
    positives, negatives = F.col("positives"), F.col("negatives")
    pairs = c["neg"] * (c["pos_before"] + c["pos"] / 2)
    tpr, fpr = F.try_divide(c["tp"], positives), F.try_divide(c["fp"], negatives)
    gained = F.try_divide(c["pos"], positives)
    here = _precision(c["tp"], c["fp"])
    earlier = _precision(c["pos_before"], c["neg_before"])
    sums = curve(df, y, score, keys, window_rows).groupBy(*keys).agg(
        F.first("positives").alias("positives"),
        F.first("negatives").alias("negatives"),
        F.sum(pairs).alias("pairs"),
        F.max(tpr - fpr).alias("gap"),
        F.sum(gained * here).alias("ap"),
        F.sum(gained * (here + earlier) / 2).alias("trapezoid"),
    )
    auc = F.try_divide(F.col("pairs"), positives.cast("double") * negatives.cast("double"))
    return sums.select(
        *[col(k) for k in keys],
        auc.alias("roc_auc"),
        F.coalesce("ap", F.lit(0.0)).alias("pr_auc"),
        F.greatest(F.col("gap"), F.when(F.col("gap").isNotNull(), F.lit(0.0))).alias("ks_statistic"),
        (2 * auc - 1).alias("gini"),
        # Without positives recall is one everywhere, down to the end point (0, 1).
        F.coalesce("trapezoid", F.lit(0.5)).alias("pr_curve_auc"),
        "positives",
        "negatives",
    )


def roc_points(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, fpr, tpr) at every distinct score, starting at (inf, 0, 0)."""
    points = curve(df, y, score, keys)
    start = points.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold")) if keys else None
    if start is None:
        start = small_table(df.sparkSession, [(float("inf"),)], "threshold double")
    start = start.select(*keys, "threshold", F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(
        points.select(
            *keys,
            F.col("score").alias("threshold"),
            F.try_divide("fp", "negatives").alias("fpr"),
            F.try_divide("tp", "positives").alias("tpr"),
        )
    )


def pr_points(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, precision, recall) plus the closing point (NULL, 1, 0)."""
    points = curve(df, y, score, keys)
    nothing = F.lit(None).cast("double").alias("threshold")
    end = points.groupBy(*keys).agg(nothing) if keys else None
    if end is None:
        end = small_table(df.sparkSession, [(None,)], "threshold double")
    end = end.select(*keys, "threshold", F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.select(
        *keys,
        F.col("score").alias("threshold"),
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        F.coalesce(F.try_divide("tp", "positives"), F.lit(1.0)).alias("recall"),
    ).unionByName(end)
