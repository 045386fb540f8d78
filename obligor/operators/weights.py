"""Class weights."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obligor.operators.splitting import class_sizes
from obligor.session import col


def balanced_weights(sizes: Mapping[int, int]) -> dict[int, float]:
    """n / (K * n_c): every class gets the same total weight."""
    total = sum(sizes.values())
    return {c: total / (len(sizes) * n) for c, n in sizes.items()}


def with_weight(
    df: DataFrame, target: str, balanced: bool, sizes: Mapping[int, int] | None = None
) -> DataFrame:
    """Add ``weight``: one, or the balanced class weight as a literal per class."""
    if not balanced:
        return df.withColumn("weight", F.lit(1.0))
    weight = F.lit(None).cast("double")
    for c, w in balanced_weights(sizes or class_sizes(df, target)).items():
        weight = F.when(col(target) == c, F.lit(w)).otherwise(weight)
    return df.withColumn("weight", weight)
