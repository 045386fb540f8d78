"""Scoring on a stream: the batch plan behind a file source and a file sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from obligor.plans.scoring import score
from obligor.sources.bundles import ModelBundle
from obligor.sources.policy import DecisionPolicy


def read_applicant_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    pattern: str | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_stream(
    stream: DataFrame,
    bundle: ModelBundle,
    sink: str,
    checkpoint: str,
    policy: DecisionPolicy | None = None,
) -> StreamingQuery:
    """Score all files present and stop; run it again to pick up new ones.

    The checkpoint and the transactional file sink give exactly-once output.
    """
    return (
        score(stream, bundle, policy)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
