"""Tables that summarise an experiment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.operators.encoding import encoding_counts
from obligor.operators.explain import top_importance

# Columns of the comparison tables.
BINARY_COLUMNS = (
    "roc_auc",
    "pr_auc",
    "ks_statistic",
    "gini",
    "precision",
    "recall",
    "f1",
    "threshold",
)
MULTICLASS_COLUMNS = ("roc_auc", "accuracy", "precision", "recall", "f1")


def wide_metrics(metrics: DataFrame, names: Sequence[str]) -> DataFrame:
    """(model, one column per metric) from long (model, metric, value) rows."""
    return metrics.groupBy("model").pivot("metric", list(names)).agg(F.first("value"))


def comparison_table(metrics: DataFrame, num_classes: int = 2) -> DataFrame:
    return wide_metrics(metrics, MULTICLASS_COLUMNS if num_classes > 2 else BINARY_COLUMNS)


def leaderboard(metrics: DataFrame, num_classes: int = 2) -> DataFrame:
    """Models by cross-validated error, lowest first."""
    third = "accuracy" if num_classes > 2 else "pr_auc"
    return wide_metrics(metrics, ("cv_test_mse", "roc_auc", third)).orderBy("cv_test_mse", "model")


def champion_row(metrics: DataFrame, selection: str, order: Sequence[str]) -> DataFrame:
    """(model, value) of the best model; ties go to the earlier one in ``order``."""
    position = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    value = F.asc("value") if selection == "cv_test_mse" else F.desc("value")
    return (
        metrics.where((F.col("metric") == selection) & F.col("value").isNotNull())
        .where(~F.isnan("value"))
        .orderBy(value, position)
        .limit(1)
        .select("model", "value")
    )


def feature_report(
    report: DataFrame, missing: DataFrame, importance: DataFrame, k: int = 20
) -> DataFrame:
    """(section, position, name, value): the whole feature-engineering report.

    Sections: original, derived and dropped columns, missing rates, encoding counts and
    the most important features. Every input has at most one row per column.
    """
    from pyspark.sql.window import Window

    listed = report.where(F.col("section").isin("original", "derived", "dropped")).select(
        "section", "position", F.col("column").alias("name"), F.lit(None).cast("double").alias("value")
    )

    def ranked(df: DataFrame, section: str, name: str, value: str, *order) -> DataFrame:
        return df.select(
            F.lit(section).alias("section"),
            (F.row_number().over(Window.orderBy(*order)) - 1).alias("position"),
            F.col(name).alias("name"),
            F.col(value).cast("double").alias("value"),
        )

    return (
        listed.unionByName(
            ranked(missing, "missing", "column", "missing_rate", F.desc("missing_rate"), "column")
        )
        .unionByName(ranked(encoding_counts(report), "encoding", "kind", "columns", "kind"))
        .unionByName(
            ranked(
                top_importance(importance, k),
                "importance",
                "feature",
                "importance_mean",
                F.desc("importance_mean"),
                "feature",
            )
        )
    )
