"""Metric bundles for binary and multi-class classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.functions.probabilities import squared_error, squared_error_multi, top_class
from obligor.operators.ranking import ranking_metrics
from obligor.operators.thresholds import (
    best_threshold,
    confusion_matrix,
    ratio_or_zero,
    threshold_counts,
    with_rates,
)
from obligor.session import col, pin


def binary_metrics(
    df: DataFrame,
    y: str,
    score: str,
    threshold: float | None = None,
) -> DataFrame:
    """One row with all binary metrics and confusion counts.

    Without a cutoff the best one on this very data is used; held-out results should
    pass one learned elsewhere.
    """
    narrow = pin(df.select(col(y).alias("y"), col(score).cast("double").alias("score")), "scored")
    if threshold is None:
        threshold = best_threshold(narrow, "y", "score").first()["threshold"]
    ranked = ranking_metrics(narrow, "y", "score")
    cut = with_rates(threshold_counts(narrow, "y", "score", F.lit(threshold)))
    # Both sides are a single row.
    return (
        ranked.withColumn("_one", F.lit(1))
        .join(F.broadcast(cut.withColumn("_one", F.lit(1))), "_one")
        .select(
            "roc_auc",
            "pr_auc",
            "ks_statistic",
            "gini",
            "precision",
            "recall",
            "f1",
            F.lit(float(threshold)).alias("threshold"),
            "pr_curve_auc",
            "tn",
            "fp",
            "fn",
            "tp",
        )
    )


def class_rates(df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, label, support, precision, recall, f1) per label seen on either side."""
    cells = confusion_matrix(df, actual, predicted, keys)
    right = F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0)
    by_actual = cells.groupBy(*keys, F.col("actual").alias("label")).agg(
        F.sum("rows").alias("support"), F.sum(right).alias("tp")
    )
    by_predicted = cells.groupBy(*keys, F.col("predicted").alias("label")).agg(
        F.sum("rows").alias("flagged")
    )
    tp = F.col("tp")
    return by_actual.join(by_predicted, [*keys, "label"]).select(
        *keys,
        "label",
        "support",
        tp.alias("correct"),
        ratio_or_zero(tp, F.col("flagged")).alias("precision"),
        ratio_or_zero(tp, F.col("support")).alias("recall"),
        ratio_or_zero(2 * tp, F.col("flagged") + F.col("support")).alias("f1"),
    )


def macro_metrics(
    df: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, accuracy, precision, recall, f1) with unweighted class means."""
    return class_rates(df, actual, predicted, keys).groupBy(*keys).agg(
        F.try_divide(F.sum("correct"), F.sum("support")).alias("accuracy"),
        *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")],
    )


def weighted_ovr_auc(df: DataFrame, y: str, probs: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, roc_auc): one-vs-rest AUC per class, weighted by prevalence."""
    rows = df.select(*[col(k) for k in keys], col(y).alias("_y"), F.posexplode(col(probs)))
    flagged = rows.select(
        *[col(k) for k in keys],
        F.col("pos").alias("_class"),
        (F.col("_y") == F.col("pos")).cast("int").alias("_hit"),
        F.col("col").alias("_p"),
    )
    per_class = ranking_metrics(flagged, "_hit", "_p", [*keys, "_class"])
    # A class without rows makes the score undefined, as a single class does.
    return per_class.groupBy(*keys).agg(
        F.when(
            F.count_if(F.col("roc_auc").isNull()) == 0,
            F.try_divide(F.sum(F.col("roc_auc") * F.col("positives")), F.sum("positives")),
        ).alias("roc_auc")
    )


def multiclass_metrics(df: DataFrame, y: str, probs: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, roc_auc, accuracy, precision, recall, f1)."""
    narrow = pin(
        df.select(
            *[col(k) for k in keys],
            col(y).alias("y"),
            col(probs).alias("probs"),
            top_class(col(probs)).alias("predicted"),
        ),
        "scored",
    )
    auc = weighted_ovr_auc(narrow, "y", "probs", keys)
    macro = macro_metrics(narrow, "y", "predicted", keys)
    if keys:
        return auc.join(macro, list(keys))
    one = F.lit(1).alias("_one")
    return auc.select("*", one).join(F.broadcast(macro.select("*", one)), "_one").drop("_one")


def brier(df: DataFrame, y: str, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cv_test_mse): mean squared gap between outcome and probability."""
    return df.groupBy(*keys).agg(F.avg(squared_error(col(y), col(score))).alias("cv_test_mse"))


def brier_multi(df: DataFrame, y: str, probs: str, keys: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(squared_error_multi(col(y), col(probs))).alias("cv_test_mse")
    )


def fold_summary(fold_metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation over folds of the ranking metrics."""
    return fold_metrics.groupBy(*keys).agg(
        F.avg("roc_auc").alias("cv_roc_auc_mean"),
        F.stddev_pop("roc_auc").alias("cv_roc_auc_std"),
        *(
            [F.avg("pr_auc").alias("cv_pr_auc_mean")]
            if "pr_auc" in fold_metrics.columns
            else []
        ),
    )
