"""Training corpus from documents, in five stages.

Quality classifier, toxicity, SimHash near-dedup, benchmark decontamination, byte-level BPE.
Each stage is one operator of ``obligor.llm`` over all rows that the stage before kept; its
result is written as Parquet and read again by the next. The first four return the
columns of documents, the last one the ids and digests of every text that is left.

Labels and the benchmark are read from the table folder. Quality and toxicity models learn
from labelled rows among the stage's own documents, in the bounded numbers that the operators
document. Rows with a null text, clashing extra columns and repeated rows pass as the
operators define it; an empty table stays empty.

SQL cannot express importance resampling, trained scores, fingerprints or latent retrieval, so
there is no ``ORACLE_SQL``: the stages are tested against brute force on small tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obligor.llm import bpe, decontamination, quality, simhash, toxicity
from obligor.llm.queries import RANKS, labels_of, set_up
from obligor.session import pin

ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by importance weights towards those labelled as good."""
    return quality.keep(_batched(spark, docs), quality.target_labels(labels_of(spark, sf_dir)))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose most toxic passage is below the threshold."""
    docs = _batched(spark, docs)
    model = toxicity.fit(docs, toxicity.training_labels(labels_of(spark, sf_dir)))
    return toxicity.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return simhash.keep_first(_batched(spark, docs))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.clean(_batched(spark, docs), items)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and digests of the ids and of the text decoded from them."""
    vocabulary = bpe.share_ranks(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    both = _batched(spark, docs).select(
        "doc_id", "lang", "source", bpe.round_trip(F.col("text"), vocabulary).alias("both")
    )
    return both.select("doc_id", "lang", "source", "both.*").select(
        "doc_id",
        "lang",
        "source",
        F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _batched(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The same rows, once the session suits long texts."""
    set_up(spark)
    return docs


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir), name)
    return docs
