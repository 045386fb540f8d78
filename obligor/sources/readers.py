"""Scans and target preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obligor.functions.numeric import nan_to_null
from obligor.session import col
from obligor.sources.datasets import DatasetConfig, get_dataset_config

TARGET = "default"
FILE_FORMATS = ("csv", "parquet", "json", "orc")


def read_source(spark: SparkSession, config: DatasetConfig, schema: Any = None) -> DataFrame:
    """Scan the configured table; missing floats become NULL.

    CSV types are inferred unless ``schema`` is given. Give one for large files:
    inference reads the whole input once more.
    """
    kind = config.source_type
    if kind not in (*FILE_FORMATS, "table"):
        raise ValueError(f"No reader for source type '{kind}' of '{config.name}'.")
    if config.path is None:
        raise ValueError(f"Dataset '{config.name}' has no path.")
    try:
        if kind == "table":
            return nan_to_null(spark.table(config.path))
        reader = spark.read.format(kind)
        if kind == "csv":
            reader = reader.option("header", True).option("inferSchema", schema is None)
        if schema is not None:
            reader = reader.schema(schema)
        return nan_to_null(reader.load(config.path))
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"):
            raise FileNotFoundError(
                f"Nothing to read for '{config.name}' at {config.path}."
            ) from error
        raise


def mapped_target(target: Column, mapping: Mapping[Any, int], kind: T.DataType) -> Column:
    """Look the value up in a literal map; anything absent becomes NULL."""
    pairs = [(F.lit(key).cast(kind), F.lit(code)) for key, code in mapping.items()]
    return F.create_map(*chain.from_iterable(pairs))[target]


def target_code(df: DataFrame, target: str, mapping: Mapping[Any, int] | None) -> Column:
    """Integer class code; floats are truncated, unreadable text becomes NULL."""
    kind = df.schema[target].dataType
    if mapping:
        return mapped_target(col(target), mapping, kind).cast("int")
    if isinstance(kind, T.BooleanType):
        return col(target).cast("int")
    if isinstance(kind, T.StringType):
        return F.trim(col(target)).try_cast("bigint").try_cast("int")
    return col(target).try_cast("double").try_cast("int")


def prepare_target(
    df: DataFrame,
    target: str,
    mapping: Mapping[Any, int] | None = None,
    ignored: Sequence[str] = (),
    validate: bool = True,
) -> DataFrame:
    """Replace ``target`` by the integer column ``default`` and drop ignored columns.

    With ``validate`` one aggregate counts the rows without a code and refuses them.
    """
    if target not in df.columns:
        raise ValueError(f"There is no column '{target}' to predict.")
    ignored = [name for name in ignored if name in df.columns and name != target]
    features = [c for c in df.columns if c != target and c not in ignored]
    if TARGET in features:
        raise ValueError(f"A feature is named '{TARGET}', which is kept for the target.")
    coded = df.select(*[col(c) for c in features], target_code(df, target, mapping).alias(TARGET))
    if validate:
        bad = coded.select(F.count_if(F.col(TARGET).isNull()).alias("bad")).first()["bad"]
        if bad:
            raise ValueError(f"{bad} rows of '{target}' have no integer class code.")
    return coded


def load_credit_dataset(
    spark: SparkSession, name: str, schema: Any = None
) -> tuple[DataFrame, DatasetConfig]:
    """Configured table with its ``default`` column."""
    config = get_dataset_config(name)
    frame = read_source(spark, config, schema)
    target = config.target_column
    return prepare_target(frame, target, config.target_mapping, config.ignored_columns), config
