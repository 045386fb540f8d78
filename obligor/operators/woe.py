"""Weight-of-evidence encoding for a 0/1 target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obligor.operators.encoding import category_text
from obligor.session import col, scratch_path

# Default smoothing and the category that stands for a missing value.
SMOOTHING = 0.5
MISSING = "nan"
#: Categories of all columns, and bytes of their texts, that are looked up map-side.
LISTED, LISTED_BYTES = 1_000_000, 64_000_000
# Folder of the weight table inside a saved model.
WEIGHTS = "weights"


def category(df: DataFrame, name: str) -> Column:
    return F.coalesce(category_text(df, name), F.lit(MISSING))


def woe_table(
    df: DataFrame, columns: Sequence[str], target: str, smoothing: float = SMOOTHING
) -> DataFrame:
    """(column, value, rows, bad, woe): log of smoothed good share over bad share."""
    wide = df.select(*[category(df, c).alias(c) for c in columns], col(target).alias("_y"))
    counts = (
        wide.unpivot(["_y"], [col(c) for c in columns], "column", "value")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("_y").alias("bad"))
    )
    totals = df.agg(F.count(F.lit(1)).alias("n"), F.sum(col(target)).alias("b")).first()
    all_bad = totals["b"] + smoothing
    all_good = totals["n"] - totals["b"] + smoothing
    good_share = (F.col("rows") - F.col("bad") + smoothing) / all_good
    bad_share = (F.col("bad") + smoothing) / all_bad
    return counts.withColumn("woe", F.ln(good_share / bad_share))


def apply_woe(df: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace categories by their weight; unseen ones weigh zero.

    A table of at most ``LISTED`` rows and ``LISTED_BYTES`` of text is looked up map-side, for
    all columns at once; a longer one is joined, column by column, with no broadcast forced.
    """
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).alias("bytes")).first()
    small = size["n"] <= LISTED and (size["bytes"] or 0) <= LISTED_BYTES
    return (_looked_up if small else _joined)(df, table, columns)


def _looked_up(df: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One hash lookup per value, in the arrays of a single broadcast row."""
    if not columns:
        return df
    at = range(len(columns))
    pair = F.struct("value", "woe")
    lists = table.agg(
        *[
            F.array_sort(F.collect_list(F.when(F.col("column") == c, pair))).alias(f"_list_{i}")
            for i, c in zip(at, columns, strict=True)
        ]
    )
    values = lists.select(*[F.col(f"_list_{i}.value").alias(f"_value_{i}") for i in at]).first()
    index = StringIndexerModel.from_arrays_of_labels(
        [list(v) for v in values],
        inputCols=[f"_text_{i}" for i in at],
        outputCols=[f"_code_{i}" for i in at],
        handleInvalid="keep",
    )
    weights = lists.select(*[F.col(f"_list_{i}.woe").alias(f"_woe_{i}") for i in at])
    texts = df.withColumns({f"_text_{i}": category(df, c) for i, c in zip(at, columns, strict=True)})
    coded = index.transform(texts).crossJoin(F.broadcast(weights))  # one row
    weight = {c: F.get(f"_woe_{i}", F.col(f"_code_{i}").cast("int")) for i, c in zip(at, columns, strict=True)}
    return _weighed(coded, df.columns, weight)


def _joined(df: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A join per column. Missing values meet no row: their weight, one per column, is a literal."""
    missing = {r["column"]: r["woe"] for r in table.where(F.col("value") == MISSING).collect()}
    out, weight = df, {}
    for at, name in enumerate(columns):
        weights = table.where(F.col("column") == name).select(
            F.col("value").alias(f"_value_{at}"), F.col("woe").alias(f"_woe_{at}"), F.lit(0).alias(f"_known_{at}")
        )
        # Rows without a value would make one hot key: they are dealt over many that match nothing.
        absent = F.col(f"_text_{at}") == MISSING
        out = (
            out.withColumn(f"_text_{at}", category(df, name))
            .withColumn(f"_deal_{at}", F.when(absent, 1 + F.spark_partition_id() % 1024).otherwise(0))
            .join(
                weights,
                (F.col(f"_text_{at}") == F.col(f"_value_{at}")) & (F.col(f"_deal_{at}") == F.col(f"_known_{at}")),
                "left",
            )
        )
        weight[name] = F.when(absent, F.lit(missing.get(name))).otherwise(F.col(f"_woe_{at}"))
    return _weighed(out, df.columns, weight)


def _weighed(df: DataFrame, names: Sequence[str], weight: dict[str, Column]) -> DataFrame:
    return df.select(
        *[F.coalesce(weight[c], F.lit(0.0)).alias(c) if c in weight else col(c) for c in names]
    )


class WeightOfEvidence(Estimator):
    def __init__(self, columns: Sequence[str], target: str, smoothing: float = SMOOTHING) -> None:
        super().__init__()
        self.columns, self.target, self.smoothing = list(columns), target, smoothing

    def _fit(self, dataset: DataFrame) -> WeightOfEvidenceModel:
        path = scratch_path(dataset.sparkSession, "woe")
        woe_table(dataset, self.columns, self.target, self.smoothing).write.parquet(path)
        return WeightOfEvidenceModel(columns=self.columns, path=path)


class WeightOfEvidenceModel(Model, MLReadable, MLWritable):
    """Names its weight table, which may have any number of categories.

    Saving the stage copies the table into it, so a saved model needs no other folder.
    """

    columns = Param(Params._dummy(), "columns", "encoded columns", TypeConverters.toListString)
    path = Param(Params._dummy(), "path", "weight table", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: list[str] | None = None, path: str = "") -> None:
        super().__init__()
        self._setDefault(columns=[], path="")
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def weights(self) -> DataFrame:
        return SparkSession.active().read.parquet(self.getOrDefault(self.path))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return apply_woe(dataset, self.weights(), self.getOrDefault(self.columns))

    def write(self) -> MLWriter:
        return _WeightsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _WeightsReader(cls)


class _WeightsWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.weights().write.parquet(f"{path}/{WEIGHTS}")


class _WeightsReader(DefaultParamsReader):
    def load(self, path: str) -> WeightOfEvidenceModel:
        model = super().load(path)
        return model._set(path=f"{path}/{WEIGHTS}")
