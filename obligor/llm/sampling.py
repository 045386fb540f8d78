"""Labelled rows in a bounded number, and the rows that a hash picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % parts


def labelled(labels: DataFrame, value: str, rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label) of at most ``rows`` documents per label 0 and 1.

    Ids come in the order of a hash, so the choice is the same in every run. A document
    whose labels differ counts as 1; null ids and labels are left out.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{value}`").cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(rows) for k in (0, 1)]
    return picked[0].union(picked[1])
