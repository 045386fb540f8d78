"""Null-safe numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obligor.session import col


def is_number(field: T.DataType) -> bool:
    return isinstance(field, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_number(f.dataType)]


def finite(value: Column) -> Column:
    """``value`` with NaN and both infinities turned into NULL."""
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def known(value: Column) -> Column:
    """A floating value with NaN, which means missing, turned into NULL."""
    return F.when(~F.isnan(value), value)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: make it NULL in every floating column (one projection)."""
    floating = [f.name for f in df.schema.fields if is_floating(f.dataType)]
    if not floating:
        return df
    return df.withColumns({c: known(col(c)) for c in floating})


def floored_ratio(top: Column, bottom: Column) -> Column:
    """top / max(|bottom|, 1); NULL when either side is NULL.

    ``greatest`` skips NULLs, so the missing denominator is guarded explicitly.
    """
    size = F.abs(bottom.cast("double"))
    return finite(top.cast("double") / F.when(size.isNotNull(), F.greatest(size, F.lit(1.0))))


def sum_of(terms: list[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total
