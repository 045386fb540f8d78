"""Expressions over an array of class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def top_class(probs: Column) -> Column:
    """Index of the first largest probability."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def squared_error(y: Column, pd: Column) -> Column:
    return F.pow(y - pd, 2)


def squared_error_multi(y: Column, probs: Column) -> Column:
    """Sum over classes of (indicator - probability) squared."""
    gaps = F.transform(
        probs, lambda p, k: F.pow(F.when(k == y, F.lit(1.0)).otherwise(F.lit(0.0)) - p, 2)
    )
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap)
