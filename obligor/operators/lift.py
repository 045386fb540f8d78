"""Score-bucket tables: lift and gain, calibration, distribution, residuals."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obligor.functions.numeric import sum_of
from obligor.operators.selection import after_cut, numeric_id, quantiles, rank_cuts
from obligor.session import col, pin


def _narrow(df: DataFrame, y: str, score: str, id_col: str | None = None) -> DataFrame:
    columns = [col(y).alias("y"), (col(score).cast("double") + F.lit(0.0)).alias("score")]
    if id_col:
        columns.append(numeric_id(df, id_col).alias("id"))
    usable = df.where(col(score).isNotNull() & col(y).isNotNull())
    return pin(usable.select(*columns), "scored")


def lift_gain_table(df: DataFrame, y: str, score: str, id_col: str, bins: int = 10) -> DataFrame:
    """(bucket, applicants, defaults, avg_pd, cumulative_defaults, gain, lift).

    Rows are ranked by falling score, then id. Bucket k ends at rank floor(k/bins*(n-1)),
    so only these few ranks are selected; no row is sorted and the bucket of a row is a
    comparison with literals.
    """
    rows = _narrow(df, y, score, id_col).withColumn("down", -F.col("score"))
    total = rows.agg(F.count("y").alias("n"), F.sum("y").alias("bad")).first()
    n, bad = total["n"], total["bad"] or 0
    ends = sorted({math.floor(k / bins * (n - 1)) for k in range(1, bins)}) if n else []
    keyed = rows.select(F.lit("all").alias("g"), F.col("down").alias("v"), "id")
    cuts = rank_cuts(keyed, {"all": ends})
    places = []
    for k in range(1, bins):
        cut = cuts.get(("all", math.floor(k / bins * (n - 1)))) if n else None
        if cut:
            places.append(after_cut(F.col("down"), F.col("id"), cut).cast("int"))
    bucket = (F.lit(1) + sum_of(places)) if places else F.lit(1)
    table = rows.groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("applicants"),
        F.sum("y").cast("bigint").alias("defaults"),
        F.avg("score").alias("avg_pd"),
    )
    so_far = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base_rate = bad / n if n else 0.0
    lift = F.col("avg_pd") / F.lit(base_rate) if base_rate else F.lit(0.0)
    return (
        table.withColumn("cumulative_defaults", F.sum("defaults").over(so_far))
        .withColumn("gain", F.col("cumulative_defaults") / F.lit(max(bad, 1)))
        .withColumn("lift", lift)
    )


def calibration_curve(df: DataFrame, y: str, score: str, bins: int = 10) -> DataFrame:
    """(bin, rows, mean_score, default_rate) over exact quantile bins, empty ones left out."""
    rows = _narrow(df, y, score)
    values = rows.select(F.lit("all").alias("g"), F.col("score").alias("v"))
    edges = quantiles(values, [k / bins for k in range(1, bins)]).get("all", [])
    passed = [(F.lit(e) < F.col("score")).cast("int") for e in edges]
    return rows.groupBy((sum_of(passed) if passed else F.lit(0)).alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("score").alias("mean_score"),
        F.avg("y").alias("default_rate"),
    )


def prediction_distribution(df: DataFrame, y: str, score: str, bins: int = 20) -> DataFrame:
    """(y, bin, low, high, rows): equal-width histogram of each class on its own range.

    The last bin is closed; a class with one value is centred in a range of width one.
    """
    rows = _narrow(df, y, score)
    extents = rows.groupBy("y").agg(F.min("score").alias("a"), F.max("score").alias("b"))
    flat = F.col("a") == F.col("b")
    extents = extents.select(
        "y",
        F.when(flat, F.col("a") - 0.5).otherwise(F.col("a")).alias("a"),
        F.when(flat, F.col("b") + 0.5).otherwise(F.col("b")).alias("b"),
    )

    def edge(k):
        inner = F.col("a") + k * ((F.col("b") - F.col("a")) / bins)
        return F.when(k == bins, F.col("b")).otherwise(inner)

    # One row per class: the number of classes bounds the broadcast.
    joined = rows.join(F.broadcast(extents), "y")
    share = (F.col("score") - F.col("a")) / (F.col("b") - F.col("a")) * bins
    joined = joined.withColumn("k", F.least(F.floor(share), F.lit(bins - 1)).cast("int"))
    # Rounding may put a score one bin off the edges that are reported.
    k = F.col("k")
    fixed = (
        F.when(F.col("score") < edge(k), k - 1)
        .when((F.col("score") >= edge(k + 1)) & (k < bins - 1), k + 1)
        .otherwise(k)
    )
    counted = joined.groupBy("y", fixed.alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
    grid = extents.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(F.broadcast(counted), ["y", "bin"], "left").select(
        "y",
        "bin",
        edge(F.col("bin")).alias("low"),
        edge(F.col("bin") + 1).alias("high"),
        F.coalesce("rows", F.lit(0)).alias("rows"),
    )


def residuals(df: DataFrame, y: str, score: str, id_col: str) -> DataFrame:
    """(id, score, residual): actual minus predicted."""
    return df.select(
        col(id_col), col(score).alias("score"), (col(y) - col(score)).alias("residual")
    )
