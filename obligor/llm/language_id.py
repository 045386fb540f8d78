"""Language of a text: the family first, then the languages inside it.

A text is its byte n-grams (lower case, letters only, words kept apart by one space), hashed
into ``BUCKETS``; a bucket weighs the square root of its count, and the vector has length one. Two
levels of linear support vector machines judge it, each for one pair: first pairs of
families, then pairs of languages of the family that won. The most pairs won decide, then the larger sum
of margins, then the name. Families are a parameter; a language that has none there is a
family of its own.

Each machine is one task of its own that solves the dual by coordinate steps. It learns from at most
``TRAIN_ROWS`` different texts per side, picked by a hash of the text, as vectors whose size does
not depend on that of the texts; copies of a text count once. A pair of families draws on their
languages in equal numbers. Scoring reads whole texts and needs one matrix of ``BUCKETS`` rows and a
column per pair.

Defined results: null texts and texts without a letter are ``und`` with score 0, and so is every text
if nothing was learnt; a single learnt language is given to every text that has a letter. ``score`` is
the mean of the logistic function of the winner's margins over its pairs of families, times the same
over its pairs of languages; a level with nothing to decide counts 1. Rows without an id or language
teach nothing; repeated rows get a result each; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obligor.llm.sampling import remainder
from obligor.session import pin

UNKNOWN = "und"
#: Lengths of the byte n-grams are 1 up to this.
LONGEST_GRAM = 4
BITS = 13
BUCKETS = 1 << BITS
#: Different texts that a machine learns from on either side, at most.
TRAIN_ROWS = 500
#: Bound of a row's weight in the dual, before the two sides are made to weigh the same.
COST = 10.0
SWEEPS = 60
TOLERANCE = 1e-3
SEED = 42
_FOLDS = 5

# Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro wa",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt uz",
    "indic": "bn gu hi mr ne or pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTERS = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in a whole text."""
    plain = b" ".join(text.lower().encode().translate(_LETTERS).split())
    data = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
    out = np.zeros(BUCKETS, np.int64)
    rolling = np.zeros(data.size, np.uint32)
    for n in range(1, LONGEST_GRAM + 1):
        if n > data.size:
            break
        rolling = (rolling[: data.size - n + 1] ^ (data[n - 1 :] + np.uint32(n))) * np.uint32(0x9E3779B1)
        rolling ^= rolling >> np.uint32(15)
        out += np.bincount((rolling * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS), minlength=BUCKETS)
    return out


def vectors(texts: list[str]) -> np.ndarray:
    """Square roots of the counts, to length one; the squares add up to the count of n-grams."""
    out = np.empty((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts, strict=True):
        held = counts(text)
        np.sqrt(held / held.sum(), out=row, casting="same_kind")
    return out


def separate(rows: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Weights, and the bias as the last, of the machine for rows of side +1 and -1.

    The dual of the hinge loss by coordinate steps in seeded orders, until no step is large.
    """
    width = rows.shape[1]
    weights, bias = np.zeros(width, np.float32), 0.0
    alpha = np.zeros(len(rows))
    squares = np.einsum("ij,ij->i", rows, rows) + 1.0
    # Both sides weigh the same, however few rows one has.
    limit = np.where(sides > 0, len(sides) / (2 * (sides > 0).sum()), len(sides) / (2 * (sides < 0).sum())) * COST
    rng = np.random.default_rng(SEED)
    for _ in range(SWEEPS):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            slope = sides[i] * (float(rows[i] @ weights) + bias) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), limit[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                weights += np.float32(step * sides[i]) * rows[i]
                bias += step * sides[i]
                largest = max(largest, abs(step))
        if largest < TOLERANCE:
            break
    return np.append(weights, np.float32(bias))


@dataclass
class LanguageModel:
    """Pairs of families and of languages, and the weights of each, a column a pair."""

    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    family_pairs: list[tuple[str, str]]
    matrix: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        margins = vectors(texts) @ self.matrix[:-1] + self.matrix[-1]
        split = len(self.family_pairs)
        families = sorted(self.members)
        best, score = vote(families, self.family_pairs, margins[:, :split])
        names = np.empty(len(texts), object)
        for at, family in enumerate(families):
            mine = np.flatnonzero(best == at)
            languages = self.members[family]
            own = [k for k, (a, _) in enumerate(self.pairs) if a in languages]
            inside, share = vote(languages, [self.pairs[k] for k in own], margins[mine][:, [split + k for k in own]])
            names[mine] = np.array(languages, object)[inside]
            score[mine] *= share
        return list(names), score


def vote(names: list[str], pairs: list[tuple[str, str]], margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the winning name per row, and its mean chance over its pairs."""
    won = np.zeros((len(margins), len(names)))
    total, chance = np.zeros_like(won), np.zeros_like(won)
    sure = 1 / (1 + np.exp(-np.clip(margins.astype(np.float64), -30, 30)))
    for k, (a, b) in enumerate(pairs):
        i, j = names.index(a), names.index(b)
        won[:, i] += margins[:, k] >= 0
        won[:, j] += margins[:, k] < 0
        total[:, i] += margins[:, k]
        total[:, j] -= margins[:, k]
        chance[:, i] += sure[:, k]
        chance[:, j] += 1 - sure[:, k]
    leading = won == won.max(axis=1, keepdims=True)
    best = np.where(leading, total, -np.inf).argmax(axis=1)
    if not pairs:
        return best, np.ones(len(margins))
    return best, chance[np.arange(len(best)), best] / (len(names) - 1)


def has_letter(text_col: str) -> F.Column:
    return F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))


def training_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(id, text, lang) of the rows that may be learnt from: crc32 of the id, modulo 5, is not 0."""
    kept = df.where((remainder(id_col, _FOLDS) != 0) & F.col(f"`{lang_col}`").isNotNull() & has_letter(text_col))
    return kept.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "id"), (text_col, "text"), (lang_col, "lang"))])


def _picked(rows: DataFrame, most: int) -> DataFrame:
    """(lang, hash, id, place) of at most ``most`` different texts per language, least hashes first.

    A cut of the hash that leaves about four times as many goes first, so that no window
    sees more, however many texts a language has.
    """
    texts = rows.groupBy("lang", F.xxhash64("text").alias("hash")).agg(F.min("id").alias("id"))
    texts = pin(texts, "language-texts")
    # One number per language: the cut is a projection, so nothing is dealt by language before it.
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return texts.withColumn("place", F.lit(0))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 4.0 * most / r["n"]))])
    unit = F.col("hash") / F.lit(2.0**64) + 0.5
    near = texts.where(unit <= share[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "id"))
    return near.withColumn("place", place).where(F.col("place") <= most).select("lang", "hash", "id", "place")


@F.arrow_udf(T.BinaryType())
def _packed(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The filled buckets of a text's vector and their values: a bounded size for any text."""
    for column in columns:
        out = []
        for text in column.to_pylist():
            row = vectors([text])[0]
            filled = np.flatnonzero(row).astype("<i4")
            out.append(filled.tobytes() + row[filled].astype("<f4").tobytes())
        yield pa.array(out, pa.binary())


def _unpacked(packed: list[bytes]) -> np.ndarray:
    rows = np.zeros((len(packed), BUCKETS), np.float32)
    for row, data in zip(rows, packed, strict=True):
        half = len(data) // 2
        row[np.frombuffer(data[:half], "<i4")] = np.frombuffer(data[half:], "<f4")
    return rows


def fit(rows: DataFrame, families: Mapping[str, str] = FAMILY_OF, most: int = TRAIN_ROWS) -> LanguageModel:
    """Learn from (id, text, lang), see ``training_rows``; at most ``most`` texts a side and machine."""
    spark = rows.sparkSession
    picked = pin(_picked(rows, most), "language-picks")
    languages = sorted(r["lang"] for r in picked.select("lang").distinct().collect())
    members: dict[str, list[str]] = {}
    for language in languages:
        members.setdefault(families.get(language, language), []).append(language)
    family_pairs = list(combinations(sorted(members), 2))
    pairs = [pair for family in sorted(members) for pair in combinations(members[family], 2)]
    if not family_pairs and not pairs:
        return LanguageModel(members, pairs, family_pairs, np.zeros((BUCKETS + 1, 0), np.float32))

    # (machine, language, side, texts): what each machine takes from each language.
    takes = []
    for k, (a, b) in enumerate(family_pairs):
        for side, family in ((1, a), (-1, b)):
            share = -(-most // len(members[family]))
            takes += [(k, language, side, share) for language in members[family]]
    for k, pair in enumerate(pairs, start=len(family_pairs)):
        takes += [(k, language, side, most) for language, side in zip(pair, (1, -1), strict=True)]
    plan = spark.createDataFrame(takes, "machine int, lang string, side int, texts int")

    # At most ``most`` narrow rows per language are sent to all executors.
    texts = rows.withColumn("hash", F.xxhash64("text")).join(F.broadcast(picked), ["lang", "hash", "id"])
    packed = texts.select("lang", "hash", "place", _packed("text").alias("packed"))
    packed = pin(packed.dropDuplicates(["lang", "hash"]), "language-vectors")
    dealt = packed.join(F.broadcast(plan), "lang").where("place <= texts").select("machine", "side", "hash", "packed")

    def machine(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["side", "hash"], kind="stable")
        weights = separate(_unpacked(list(group["packed"])), group["side"].to_numpy())
        return pd.DataFrame({"machine": [group["machine"].iloc[0]], "weights": [weights.astype("<f4").tobytes()]})

    learnt = dealt.groupBy("machine").applyInPandas(machine, "machine int, weights binary").collect()
    by_machine = {r["machine"]: np.frombuffer(r["weights"], "<f4") for r in learnt}
    matrix = np.stack([by_machine[k] for k in range(len(family_pairs) + len(pairs))], axis=1)
    return LanguageModel(members, pairs, family_pairs, np.ascontiguousarray(matrix))


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
#: Texts whose vectors are held at a time.
_TURN = 64


def predicted(
    df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per row of ``df``; no id: not held out."""
    known = bool(model.members)

    @F.arrow_udf(_RESULT)
    def judge(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            names: list[str] = []
            scores = [np.empty(0)]
            texts = column.to_pylist()
            for start in range(0, len(texts), _TURN):
                # A text without a letter has no n-grams; it is left out below.
                part, score = model.predict([t or "" for t in texts[start : start + _TURN]])
                names += part
                scores.append(score)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(np.concatenate(scores), pa.float64())],
                names=["lang_pred", "score"],
            )

    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(remainder(id_col, _FOLDS) == 0, F.lit(False)).alias("held_out"),
        F.when(has_letter(text_col), F.col(f"`{text_col}`")).alias("text"),
    )
    if not known:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    lettered = F.col("text").isNotNull()
    judged = rows.select("doc_id", "held_out", lettered.alias("lettered"), judge("text").alias("of"))
    return judged.select(
        "doc_id",
        "held_out",
        F.when(F.col("lettered"), F.col("of.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(F.col("lettered"), F.col("of.score")).otherwise(0.0).alias("score"),
    )
