"""Column-name rules: normalisation and semantic lookup by pattern."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(name: str) -> str:
    """Lower-case words of ``name`` joined by single underscores."""
    return "_".join(re.findall(r"[a-z0-9]+", name.lower()))


def normalized(text: Column) -> Column:
    """The same rule for a string column."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def matches_any(name: str, patterns: Iterable[str]) -> bool:
    words = normalize_name(name)
    return any(re.search(pattern, words) is not None for pattern in patterns)


def matches(text: Column, patterns: Sequence[str]) -> Column:
    """Column form of :func:`matches_any` over names held in data."""
    return normalized(text).rlike("|".join(f"(?:{pattern})" for pattern in patterns))


def find_columns(
    columns: Iterable[str], include: Sequence[str], exclude: Sequence[str] = ()
) -> list[str]:
    """Every column, in column order, hit by ``include`` and by nothing in ``exclude``."""
    return [
        name for name in columns if matches_any(name, include) and not matches_any(name, exclude)
    ]


def find_column(
    columns: Iterable[str], include: Sequence[str], exclude: Sequence[str] = ()
) -> str | None:
    """The first hit of :func:`find_columns`, or ``None``."""
    return next(iter(find_columns(columns, include, exclude)), None)
