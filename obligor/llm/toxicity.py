"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the bag of its byte n-grams (with marks at both ends) and the word itself, hashed
into ``BUCKETS`` embeddings. The average over the distinct words of a passage of
``PASSAGE_WORDS`` words goes into a linear softmax over two labels; embeddings and softmax are trained jointly. A text
is as toxic as its most toxic passage, so a few words count in a text of any length, and in
training the gradient follows that passage. A misspelling shares most of its n-grams with
the word it stands for.

Training takes at most ``TRAIN_ROWS`` labelled documents per label, in one task, and
starts from seeded numbers, so it gives the same model each time. The softmax is linear in
the average, so what the embeddings say about a label is one number per bucket: that table
is all that scoring needs.

Defined results: a null or empty text gets the score of an average of nothing, the prior;
with labels of one kind or none every text gets their share (0.5 without labels); repeated
rows are scored each; other columns pass through untouched.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obligor.llm.sampling import labelled, remainder
from obligor.llm.words import chunks, texts_of, words_of

BUCKETS = 1 << 18
#: Lengths of the byte n-grams.
GRAMS = (4, 5, 6)
PASSAGE_WORDS = 4
#: Empty subwords in every average: a passage of one word says less than a full one.
PADDING = 60
DIMENSIONS = 8
TRAIN_ROWS = 2_000
EPOCHS = 12
BATCH_DOCS = 64
RATE = 4.0
SEED = 42
THRESHOLD = 0.3
_CHUNK_BYTES = 1_000_000


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words, one after another, and how many each has."""
    data = np.frombuffer(b"".join(b"<" + word + b">" for word in words), np.uint8).astype(np.uint64)
    lengths = np.array([len(word) + 2 for word in words], np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    left = np.repeat(ends, lengths) - np.arange(data.size)  # bytes from here to the word's end
    multiplier = np.uint64(0x100000001B3)
    owners, hashes = [], []
    rolling = np.zeros(data.size, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        ahead = np.zeros(data.size, np.uint64)
        ahead[: max(0, data.size - n + 1)] = data[n - 1 :]
        rolling = (rolling ^ (ahead + np.uint64(1))) * multiplier
        if n in GRAMS:
            inside = left >= n
            owners.append(word[inside])
            hashes.append(rolling[inside] ^ np.uint64(n))
    # The word itself: a sum over its bytes that depends on their places.
    spread = (data + np.uint64(1)) * _mixed(np.arange(data.size) - np.repeat(starts, lengths))
    owners.append(np.arange(len(words)))
    hashes.append(np.add.reduceat(spread, starts) if len(words) else np.empty(0, np.uint64))
    owner = np.concatenate(owners)
    bucket = (_mixed(np.concatenate(hashes)) >> np.uint64(40)).astype(np.int32) % BUCKETS
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


class Bags:
    """Words of some texts, as numbers into their distinct words, and their passages."""

    def __init__(self, texts: list[bytes]):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        split = [words_of(text) for text in texts]
        self.sizes = np.array([len(words) for words in split], np.int64)
        self.ids = np.fromiter(
            (i for words in split for i in map(number.__getitem__, words)),
            np.int64,
            int(self.sizes.sum()),
        )
        self.buckets, self.grams = subwords(list(number))
        # Passages never cross a text; the last of a text may be short.
        passages = -(-self.sizes // PASSAGE_WORDS)
        firsts = np.cumsum(self.sizes) - self.sizes
        place = np.arange(self.ids.size) - np.repeat(firsts, self.sizes)
        passage = np.repeat(np.cumsum(passages) - passages, self.sizes) + place // PASSAGE_WORDS
        self.document = np.repeat(np.arange(len(texts)), passages)
        # Each distinct word once per passage.
        keys = np.sort(passage * max(1, len(number)) + self.ids)
        keys = keys[np.flatnonzero(np.diff(keys, prepend=-1))]
        self.ids, passage = keys % max(1, len(number)), keys // max(1, len(number))
        self.starts = np.searchsorted(passage, np.arange(self.document.size))

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per bucket over the subwords of each distinct word."""
        picked = values[self.buckets]
        if not self.grams.size:
            return picked[:0]
        return np.add.reduceat(picked, np.cumsum(self.grams) - self.grams, axis=0)

    def per_passage(self, values: np.ndarray) -> np.ndarray:
        """Sum of a value per distinct word over the words of each passage."""
        if not self.starts.size:
            return values[:0]
        return np.add.reduceat(values[self.ids], self.starts, axis=0)

    def highest(self, passages: np.ndarray, empty: float) -> tuple[np.ndarray, np.ndarray]:
        """Largest value among the passages of each text, and the passage (-1: none)."""
        best = np.full(self.sizes.size, empty)
        at = np.full(self.sizes.size, -1)
        order = np.lexsort((-passages, self.document))
        owners = self.document[order]
        first = np.flatnonzero(np.diff(owners, prepend=-1))
        best[owners[first]] = passages[order[first]]
        at[owners[first]] = order[first]
        return best, at


def train(texts: list[bytes], labels: np.ndarray, share: float) -> tuple[np.ndarray, float]:
    """Logit per bucket and bias, for a corpus of which ``share`` has label 1.

    Embeddings and softmax weights follow the gradient by Adagrad, a batch at a time.
    """
    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    held_e, held_s, held_b = np.full(BUCKETS, 1e-6), np.full((DIMENSIONS, 2), 1e-6), np.full(2, 1e-6)
    order = rng.permutation(len(texts))
    batches = [order[a : a + BATCH_DOCS] for a in range(0, len(order), BATCH_DOCS)]
    prepared = [(Bags([texts[i] for i in batch]), labels[batch]) for batch in batches]
    # Both labels weigh the same; the bias is set to the corpus' share at the end.
    weight = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    for _ in range(EPOCHS):
        for bags, target in prepared:
            vectors = bags.per_word(embedding)
            count = bags.per_passage(bags.grams.astype(np.float64)) + PADDING
            mean = bags.per_passage(vectors) / count[:, None]
            logits = mean @ softmax + bias
            _, at = bags.highest(logits[:, 1] - logits[:, 0], 0.0)
            known = at >= 0
            at, target = at[known], target[known]
            if not at.size:
                continue
            chance = np.exp(logits[at] - logits[at].max(axis=1, keepdims=True))
            chance /= chance.sum(axis=1, keepdims=True)
            slope = (chance - np.eye(2)[target]) * weight[target][:, None] / at.size
            grad_s, grad_b = mean[at].T @ slope, slope.sum(axis=0)
            # Back through the average to the words of the chosen passages and their grams.
            per_passage = np.zeros((count.size, DIMENSIONS))
            per_passage[at] = slope @ softmax.T / count[at][:, None]
            sizes = np.diff(np.append(bags.starts, bags.ids.size))
            chosen = np.zeros(count.size, bool)
            chosen[at] = True
            words = np.repeat(chosen, sizes)
            passage = np.repeat(np.arange(count.size), sizes)[words]
            own = bags.ids[words]
            per_word = np.stack(
                [np.bincount(own, g, minlength=bags.grams.size) for g in per_passage[passage].T], axis=1
            )
            used = np.repeat(np.bincount(own, minlength=bags.grams.size) > 0, bags.grams)
            buckets = bags.buckets[used]
            gradient = np.repeat(per_word, bags.grams, axis=0)[used]
            touched, place = np.unique(buckets, return_inverse=True)
            grad_e = np.stack(
                [np.bincount(place, g, minlength=touched.size) for g in gradient.T], axis=1
            )
            held_e[touched] += np.square(grad_e).mean(axis=1)
            held_s += np.square(grad_s)
            held_b += np.square(grad_b)
            embedding[touched] -= RATE * grad_e / np.sqrt(held_e[touched])[:, None]
            softmax -= RATE * 0.1 * grad_s / np.sqrt(held_s)
            bias -= RATE * 0.1 * grad_b / np.sqrt(held_b)
    odds = np.log(share / (1 - share))
    return embedding @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0] + odds)


def score_texts(texts: list[bytes], table: np.ndarray, bias: float) -> np.ndarray:
    """Chance of label 1 for every text."""
    out = []
    for part in chunks(texts, _CHUNK_BYTES):
        bags = Bags(texts[part])
        count = bags.per_passage(bags.grams.astype(np.float64)) + PADDING
        mean = bags.per_passage(bags.per_word(table)) / count
        logits, at = bags.highest(mean, 0.0)
        out.append(np.where(at >= 0, logits, 0.0) + bias)
    logits = np.clip(np.concatenate([*out, np.empty(0)]), -30, 30)
    return 1 / (1 + np.exp(-logits))


class ToxicityModel:
    """Logit per bucket and bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def score(self, text: Column) -> Column:
        table, bias = self.table, self.bias

        @F.arrow_udf("double")
        def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                yield pa.array(score_texts(texts_of(column), table, bias), pa.float64())

        return scores(text)


def fit(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS
) -> ToxicityModel:
    """Train on texts of ``df`` that ``labels`` (doc_id, toxic) marks.

    At most ``rows`` documents per label are used, picked by a hash of their ids.
    """
    share = labels.where("toxic IN (0, 1)").agg(F.avg("toxic"), F.count("*")).first()
    if not share[1] or share[0] in (0.0, 1.0):
        base = 0.5 if not share[1] else min(max(share[0], 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(base / (1 - base))))
    picked = labelled(labels, "toxic", rows)
    docs = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marked = docs.join(F.broadcast(picked), "doc_id").withColumn("part", F.lit(0))

    def model(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], kind="stable")
        texts = [(text or "").encode() for text in group["text"]]
        table, bias = train(texts, group["label"].to_numpy().astype(np.int64), share[0])
        return pd.DataFrame({"model": [table.astype("<f4").tobytes()], "bias": [bias]})

    row = marked.groupBy("part").applyInPandas(model, "model binary, bias double").first()
    if row is None:
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(share[0] / (1 - share[0]))))
    return ToxicityModel(np.frombuffer(row["model"], "<f4"), row["bias"])


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Labels that may be learnt from: crc32 of the id, modulo 4, is not 2."""
    return labels.where(remainder(id_col, 4) != 2)


def scored(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per row of ``df``."""
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (remainder(id_col, 4) == 2).alias("held_out"),
        model.score(F.col(f"`{text_col}`")).alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` below the threshold, with all their columns."""
    return df.where(model.score(F.col(f"`{text_col}`")) < THRESHOLD)
