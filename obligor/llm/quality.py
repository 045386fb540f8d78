"""Quality by importance resampling: hashed n-gram models and Gumbel top-k.

Two generative models over hashed n-grams are counted: one over documents labelled as
good (the target, at most ``LABELLED_ROWS`` of them), one over all documents (raw). The
log weight of a document is log p_target - log p_raw for a text of ``LENGTH`` n-grams like
its own: the sum over its n-grams scaled to that length, so that a small lean of a whole
language does not grow with the text, and drawn towards 0 for texts of a few words. Adding
independent Gumbel noise to the log weights and keeping the k largest draws k documents
without replacement with chances in proportion to the weights.

The n-grams of a word are the word, its first and last three bytes, and the pair it makes
with the word before; a word that repeats the one before is written as a ditto mark, so
runs of one word are common n-grams and not rare ones. Case and punctuation stay.

``target_size`` picks k as the number of documents on the good side of the cut that
parts the labelled rows best; with no labels the cut is 0.

Defined results: a null or empty text has log weight 0; noise follows the id, so rows that
share an id share it, and equal keys stand or fall together; rows without an id are drawn
like one more id; an empty table gives an empty result; other columns are carried by
``keep`` and read by nothing else.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obligor.llm.sampling import labelled
from obligor.llm.words import chunks, texts_of
from obligor.operators.selection import order_statistics
from obligor.session import pin

#: Hash buckets of n-grams.
BUCKETS = 1 << 14
#: Labelled documents per label that the target model and the cut are taken from.
LABELLED_ROWS = 20_000
#: Counts added to every bucket of the target, in the shape of the raw model.
SMOOTHING = 5.0
#: N-grams that a log weight stands for, and n-grams of weight 0 added to every text.
LENGTH, PRIOR = 200.0, 50.0
SEED = 42
_CHUNK_BYTES = 2_000_000
#: Log weights beyond this are alike when the cut is looked for, in steps of ``_STEP``.
_RANGE, _STEP = 200.0, 0.5


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (n-grams of a word, words) and the number of words of each text."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    split = [text.split() for text in texts]
    sizes = np.array([len(words) for words in split], np.int64)
    ids = np.fromiter(
        (i for words in split for i in map(number.__getitem__, words)), np.int64, int(sizes.sum())
    )
    crc = zlib.crc32
    own = np.array([(crc(w), crc(w[:3], 1), crc(w[-3:], 2)) for w in number], np.uint64)
    own = own.reshape(-1, 3)
    hashes = own[ids, 0] if ids.size else np.empty(0, np.uint64)
    before = np.roll(hashes, 1)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    before[starts] = 7
    pairs = (before * np.uint64(0x9E3779B97F4A7C15) + hashes) * np.uint64(0xBF58476D1CE4E5B9)
    same = np.zeros(ids.size, bool)
    same[1:] = ids[1:] == ids[:-1]
    same[starts] = False
    pairs = np.where(same, np.uint64(3), pairs >> np.uint64(40))
    return np.stack([*own[ids].T, pairs]).astype(np.int64) % BUCKETS, sizes


def _weights(texts: list[bytes], ratio: np.ndarray) -> np.ndarray:
    out = []
    for part in chunks(texts, _CHUNK_BYTES):
        buckets, sizes = _features(texts[part])
        values = ratio[buckets].sum(axis=0)
        document = np.repeat(np.arange(sizes.size), sizes)
        sums = np.bincount(document, values, minlength=sizes.size)
        out.append(LENGTH * sums / (len(buckets) * sizes + PRIOR))
    return np.concatenate([*out, np.empty(0)])


def fit(df: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of each bucket from (doc_id, text) rows and (doc_id, label) rows.

    ``labels`` has a bounded number of rows and is broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            texts, good = texts_of(batch.column("text")), batch.column("label").to_pylist()
            for part in chunks(texts, _CHUNK_BYTES):
                buckets, sizes = _features(texts[part])
                raw += np.bincount(buckets.ravel(), minlength=BUCKETS)
                chosen = np.repeat(np.array([x == 1 for x in good[part]], bool), sizes)
                target += np.bincount(buckets[:, chosen].ravel(), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (used, raw[used], target[used])], ["bucket", "raw", "target"]
        )

    marked = df.select("doc_id", "text").join(F.broadcast(labels), "doc_id", "left")
    counted = (
        marked.select("text", "label")
        .mapInArrow(count, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw"), F.sum("target"))
        .collect()
    )
    raw, target = np.ones(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counted:
        raw[bucket] += r
        target[bucket] = t
    shape = raw / raw.sum()
    smooth = SMOOTHING * BUCKETS * shape
    return np.log((target + smooth) / (target.sum() + SMOOTHING * BUCKETS)) - np.log(shape)


def log_weight(text: Column, ratio: np.ndarray) -> Column:
    """Log importance weight of a text. ``ratio`` has ``BUCKETS`` numbers."""

    @F.arrow_udf("double")
    def weigh(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array(_weights(texts_of(column), ratio), pa.float64())

    return weigh(text)


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise that depends on the id and the seed only."""
    uniform = (F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(2.0**52)
    return -F.log(-F.log(uniform))


def best_cut(keys: DataFrame) -> float:
    """Cut of ``key`` with the fewest labelled rows on the wrong side: the middle of the best."""
    step = F.floor(F.greatest(F.least(F.col("key"), F.lit(_RANGE)), F.lit(-_RANGE)) / _STEP)
    rows = (
        keys.where("label IS NOT NULL")
        .groupBy(step.cast("int").alias("step"))
        .agg(F.count(F.when(F.col("label") == 1, 1)), F.count(F.when(F.col("label") == 0, 1)))
        .collect()
    )
    good, bad = ({step: row[i] for step, *row in rows} for i in (0, 1))
    if not sum(good.values()) or not sum(bad.values()):
        return 0.0
    steps = range(int(-_RANGE / _STEP), int(_RANGE / _STEP) + 1)
    wrong, held = [], sum(bad.values())
    for at in steps:  # good rows below the step and bad rows from it on
        wrong.append(held)
        held += good.get(at, 0) - bad.get(at, 0)
    best = [at for at, errors in zip(steps, wrong, strict=True) if errors == min(wrong)]
    run = [at for at in best if at - best[0] == best.index(at)]
    return _STEP * (run[0] + run[-1]) / 2


def top_key(keys: DataFrame, k: int) -> float:
    """The k-th largest ``key``, exactly; infinity for k = 0."""
    rows = keys.count()
    if k <= 0 or rows == 0:
        return float("inf")
    place = max(0, rows - k)
    values = keys.select(F.lit("key").alias("g"), F.col("key").alias("v"))
    return order_statistics(values, {"key": [place]})["key", place].value


def resample(
    df: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, np.ndarray, float]:
    """Keys (doc_id, log_weight, key) of all rows, the model, and the smallest key kept.

    ``labels`` holds (doc_id, label); ``k`` defaults to the number of target-like documents.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ratio = fit(rows, labels)
    scored = rows.select("doc_id", log_weight(F.col("text"), ratio).alias("log_weight"))
    keys = scored.withColumn("key", F.col("log_weight") + gumbel(F.col("doc_id")))
    keys = pin(keys.join(F.broadcast(labels), "doc_id", "left"), "weights")
    if k is None:
        k = keys.where(F.col("key") >= best_cut(keys)).count()
    return keys.drop("label"), ratio, top_key(keys, k)


def sample(
    df: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, log_weight, key) of the rows drawn."""
    keys, _, least = resample(df, labels, k, id_col, text_col)
    return keys.where(F.col("key") >= least)


def keep(
    df: DataFrame, labels: DataFrame, k: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``df`` that are drawn, with all their columns.

    Weights are worked out again beside the texts: that moves no text through a shuffle.
    """
    _, ratio, least = resample(df, labels, k, id_col, text_col)
    key = log_weight(F.col(f"`{text_col}`"), ratio) + gumbel(F.col(f"`{id_col}`"))
    return df.where(key >= least)


def target_labels(labels: DataFrame, rows: int = LABELLED_ROWS) -> DataFrame:
    """Bounded labelled rows of the ``quality`` column."""
    return labelled(labels, "quality", rows)
