"""Scoring applicants with a trained bundle, in batch or on a stream."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.functions.decisions import loose_cast, with_decision
from obligor.functions.probabilities import top_class
from obligor.session import col
from obligor.sources.bundles import ModelBundle
from obligor.sources.policy import DecisionPolicy


def with_probabilities(df: DataFrame, bundle: ModelBundle) -> DataFrame:
    """Add ``probs``; features are brought to their fitted types, absent ones are NULL."""
    typed = loose_cast(df, bundle.feature_types)
    return bundle.model.transform(typed).select(*[col(c) for c in df.columns], "probs")


def score(df: DataFrame, bundle: ModelBundle, policy: DecisionPolicy | None = None) -> DataFrame:
    """Probability of default, band, decision and confidence next to the input columns.

    The plan has no shuffle and keeps no state, so it runs on a stream unchanged. The
    learned cutoff is reported but decisions follow the policy.
    """
    scored = with_probabilities(df, bundle).withColumn("probability_default", F.col("probs")[1])
    return (
        with_decision(scored, F.col("probability_default"), policy)
        .withColumns(
            {
                "threshold": F.lit(bundle.threshold).cast("double"),
                "model_name": F.lit(bundle.model_name),
            }
        )
        .drop("probs")
    )


def _label(code, bundle: ModelBundle):
    text = code.cast("string")
    if not bundle.class_names:
        return text
    names = F.create_map(*[F.lit(x) for x in chain.from_iterable(bundle.class_names.items())])
    return F.coalesce(names[text], text)


def score_classes(df: DataFrame, bundle: ModelBundle) -> DataFrame:
    """Most probable class, its label and its probability."""
    scored = with_probabilities(df, bundle)
    code = top_class(F.col("probs"))
    return scored.select(
        *[col(c) for c in df.columns],
        code.alias("predicted"),
        _label(code, bundle).alias("predicted_label"),
        F.array_max("probs").alias("confidence"),
    )


def class_probabilities(df: DataFrame, bundle: ModelBundle, id_col: str) -> DataFrame:
    """(id, label, probability), one row per class."""
    rows = with_probabilities(df, bundle).select(col(id_col), F.posexplode("probs"))
    return rows.select(
        col(id_col), _label(F.col("pos"), bundle).alias("label"), F.col("col").alias("probability")
    )
