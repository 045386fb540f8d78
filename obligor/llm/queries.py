"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

import os
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obligor.llm import (
    bpe,
    decontamination,
    filter_audit,
    language_id,
    licenses,
    lm_scoring,
    neighbours,
    periodic_runs,
    quality,
    sharding,
    simhash,
    token_counts,
    toxicity,
)

#: The rank file and the pattern that the first operator encodes with.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: The vocabulary that tokens are counted by.
COUNTED = "byte_bpe_50k.json"


#: Texts handed to a Python worker at a time; Spark's own number suits rows of a few bytes.
BATCH_ROWS = 500


def set_up(spark: SparkSession) -> None:
    """Small batches, and this package on the path of Python workers on the same machine.

    On a cluster the package is installed or handed over with ``--py-files``.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    own = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    held = environment.get("PYTHONPATH", "")
    if own not in held.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [own, held]))


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    set_up(spark)
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every text, decode the ids again, and digest both."""
    vocabulary = bpe.share_ranks(
        spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )
    docs = documents(spark, folder, "doc_id", "text")
    both = docs.select("doc_id", bpe.round_trip(F.col("text"), vocabulary).alias("both"))
    return both.select("doc_id", "both.*").select(
        "doc_id",
        F.expr("CAST(octet_length(ids) / 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log probability of every text, by words and by the mixed bit model."""
    return lm_scoring.score(documents(spark, folder, "doc_id", "text"))


def op3_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of four-word shingles, linked at four or fewer differing bits."""
    return simhash.near_duplicates(documents(spark, folder, "doc_id", "text"))


def labels_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Chance that each whole text is toxic, learnt from the labels outside the fold."""
    docs = documents(spark, folder, "doc_id", "text")
    model = toxicity.fit(docs, toxicity.training_labels(labels_of(spark, folder)))
    return toxicity.scored(docs, model)


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licence that each whole text is, and the licences that its lines name."""
    return licenses.license_scan(documents(spark, folder, "doc_id", "text"))


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it is over the limit."""
    return token_counts.token_counts(
        documents(spark, folder, "doc_id", "text"),
        public_tokenizers.path(COUNTED),
        public_tokenizers.PATTERN,
    )


def op7_hilbert_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Eight shards of equal row counts along a curve over language, source and length."""
    docs = documents(spark, folder, "doc_id", "text", "lang", "source", "n_chars")
    cells = [
        sharding.by_category(F.col("lang")),
        sharding.by_category(F.col("source")),
        sharding.by_magnitude(F.col("n_chars")),
    ]
    return sharding.hilbert_shards(docs, cells)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, and how much of it."""
    return decontamination.contaminated(
        documents(spark, folder, "doc_id", "text"),
        spark.read.parquet(f"{folder}/benchmark.parquet"),
    )


def op9_quality_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Documents drawn by importance weights towards those labelled as good."""
    docs = documents(spark, folder, "doc_id", "text")
    return quality.sample(docs, quality.target_labels(labels_of(spark, folder)))


def op10_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    set_up(spark)
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.nearest(rows, F.col("id") % 50 == 0)


def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every text, learnt from the rows outside the fold."""
    docs = documents(spark, folder, "doc_id", "text", "lang")
    return language_id.predicted(docs, language_id.fit(language_id.training_rows(docs)))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words, the longest of each text, and the text without repetitions."""
    docs = documents(spark, folder, "doc_id", "text")
    planted = periodic_runs.rewritten(F.col("doc_id"), F.col("text"))
    found = docs.select("doc_id", periodic_runs.runs(planted).alias("of")).select("doc_id", "of.*")
    longest = F.expr(
        "array_max(transform(runs, r -> struct(r.length AS length, -r.start AS start, -r.period AS period)))"
    )
    listed = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return found.withColumn("most", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("most.start")).alias("start"),
        F.col("most.length").alias("length"),
        (-F.col("most.period")).alias("period"),
        F.expr("1000 * most.length div -most.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from each language, in every order of them."""
    docs = documents(spark, folder, "doc_id", "text", "lang")
    return filter_audit.audit(docs, labels_of(spark, folder), F.col("lang"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_lm_score": op2_lm_score,
    "op3_simhash": op3_simhash,
    "op4_toxicity": op4_toxicity,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_hilbert_shards": op7_hilbert_shards,
    "op8_decontamination": op8_decontamination,
    "op9_quality_sample": op9_quality_sample,
    "op10_nearest": op10_nearest,
    "op11_language_id": op11_language_id,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_audit": op13_filter_audit,
}
