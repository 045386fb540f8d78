"""One call from an unknown table to a compared, explained and selected model."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.functions.numeric import nan_to_null
from obligor.functions.probabilities import top_class
from obligor.operators.encoding import report_frame
from obligor.operators.lift import (
    calibration_curve,
    lift_gain_table,
    prediction_distribution,
    residuals,
)
from obligor.operators.profile import (
    detect_columns,
    infer_ordinal_mappings,
    column_facts,
    top_missing,
)
from obligor.operators.ranking import pr_points, roc_points
from obligor.operators.targets import (
    class_codes,
    encode_target,
    fold_limits,
    target_candidates,
)
from obligor.operators.thresholds import confusion_matrix
from obligor.plans.reporting import comparison_table, feature_report, leaderboard
from obligor.plans.training import (
    TARGET,
    Experiment,
    Progress,
    TrainConfig,
    train_experiment,
)
from obligor.session import col, small_table
from obligor.sources.sinks import metrics_frame


@dataclass
class Preview:
    """What the table looks like before a target is chosen."""

    columns: DataFrame
    candidates: DataFrame


@dataclass
class Analysis:
    experiment: Experiment
    class_names: dict[int, str]
    leaderboard: DataFrame
    comparison: DataFrame
    importance: DataFrame
    report: DataFrame
    tables: dict[str, DataFrame]


def preview(df: DataFrame, id_col: str) -> Preview:
    df = nan_to_null(df)
    columns = [c for c in df.columns if c != id_col]
    return Preview(detect_columns(df, id_col), target_candidates(df, columns))


def analyze(
    df: DataFrame,
    target: str,
    config: TrainConfig,
    positive: str | None = None,
    folds: int | None = None,
    progress: Progress | None = None,
) -> Analysis:
    """Encode the target, train all candidates, pick the lowest cross-validated error."""
    df = nan_to_null(df)
    codes: Mapping[str, int] = class_codes(df, target, positive)
    names = {code: label for label, code in codes.items()}
    limits = fold_limits(df, target).first()
    k = folds if folds is not None else limits["default_folds"]
    if not 2 <= k <= limits["max_folds"]:
        raise ValueError(f"Folds must be between 2 and {limits['max_folds']}.")
    known = [c for c in df.columns if c not in (config.id_col, target)]
    orders = infer_ordinal_mappings(df, None, column_facts(df, known))
    coded = encode_target(df, target, dict(codes))
    missing = coded.select(F.count_if(col(TARGET).isNull())).first()[0]
    if missing:
        raise ValueError(f"{missing} rows have no value of '{target}'.")
    experiment = train_experiment(
        coded,
        replace(config, folds=int(k), selection="cv_test_mse"),
        target_name=target,
        orders=orders,
        class_names=names,
        progress=progress,
    )
    spark = df.sparkSession
    classes = experiment.prepared.num_classes
    metrics = metrics_frame(spark, experiment.comparison)
    importance = experiment.importance
    if importance is None:
        importance = small_table(spark, [], "feature string, importance_mean double, importance_std double")
    raw = experiment.prepared.train.select(*[col(c) for c in experiment.prepared.features])
    report = feature_report(report_frame(spark, experiment.report), top_missing(raw), importance)
    scores = experiment.test_scores
    if classes == 2:
        flat = scores.withColumn("pd", F.col("probs")[1])
        tables = {
            "roc_curve": roc_points(flat, TARGET, "pd"),
            "calibration_curve": calibration_curve(flat, TARGET, "pd"),
            "lift_gain": lift_gain_table(flat, TARGET, "pd", config.id_col),
            "pr_curve": pr_points(flat, TARGET, "pd"),
            "prediction_distribution": prediction_distribution(flat, TARGET, "pd"),
            "residuals": residuals(flat, TARGET, "pd", config.id_col),
            "confusion_matrix": confusion_matrix(
                flat.withColumn("predicted", (F.col("pd") >= experiment.bundle.threshold).cast("int")),
                TARGET,
                "predicted",
            ),
        }
    else:
        labelled = scores.withColumn("predicted", top_class(F.col("probs")))
        tables = {"confusion_matrix": confusion_matrix(labelled, TARGET, "predicted")}
    if experiment.shapley is not None:
        tables["shapley"] = experiment.shapley
    if experiment.dependence is not None:
        tables["partial_dependence"] = experiment.dependence
    return Analysis(
        experiment,
        names,
        leaderboard(metrics, classes),
        comparison_table(metrics, classes),
        importance,
        report,
        tables,
    )
