"""Benchmark decontamination: latent semantic retrieval, then exact checks.

Words are lower-cased and cut at white space and ASCII punctuation. Passages of benchmark
items are TF-IDF vectors over their distinct words; the weights count how many passages of
all documents hold a word. A randomised SVD of these vectors, whose products are summed
by the cluster, gives the latent directions. Each document is read as half-overlapping
passages; one whose cosine to an item's passage is ``MIN_COSINE`` or more is a candidate.
Words outside the benchmark have no part in the latent space, only in a passage's length:
each distinct one once, with the weight of its bucket of ``BUCKETS``. Words that share a
bucket make the length smaller, never larger. By Cauchy and Schwarz the cosine is at most the
share of the length that benchmark words make up, so most passages need no latent vector.

A passage that holds ``RUN_WORDS`` neighbouring words of an item is a candidate whatever its
cosine, so an item that stands in a document word by word is always checked.

A candidate is checked word by word: the longest common subsequence (LCS) of the item and a
stretch of the document little longer than the item, as a share of the item. It is a hit if
that share is ``MIN_OVERLAP`` and the answer, the last sentence of the item, is there as well
(``MIN_ANSWER`` of its words), or if the share is ``SURE_OVERLAP``.

Items are handled ``SLICE_ITEMS`` at a time, in blocks of a stated query set: what is
broadcast then has a fixed size, and the rank of a slice may reach its number of items, so
that its directions keep ``KEPT_ENERGY`` of every passage of its items.

Defined results: null and empty texts match nothing; an item of fewer than ``MIN_WORDS`` words
is found where all its words stand in order without a gap; equal items each get their own rows; repeated
documents give repeated rows; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obligor.llm.words import LOWER, chunks, texts_of
from obligor.session import pin

#: Words of half a passage; passages take two neighbouring halves.
HALF_WORDS = 32
MIN_COSINE = 0.15
MIN_OVERLAP, MIN_ANSWER, SURE_OVERLAP = 0.6, 0.5, 0.8
#: Items with fewer words are looked for as they are.
MIN_WORDS = 8
#: Neighbouring words of an item that make a passage a candidate; at most ``MIN_WORDS``.
RUN_WORDS = 6
#: Counters of passages for the words outside the benchmark.
BUCKETS = 1 << 18
SLICE_ITEMS = 512
#: Share of the squared length of each item's passage that the directions keep.
KEPT_ENERGY = 0.999
_OVERSAMPLED = 8
_POWER_STEPS = 2
_SVD_PARTS = 4
#: Rank tried first.
_RANK = 256
_CHUNK_BYTES = 1_000_000
#: Words outside the benchmark whose numbers a worker remembers.
_HELD_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 20

_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = LOWER.translate(bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION)))


def plain_words(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


def answer_of(text: bytes) -> list[bytes]:
    """Words of the last sentence that has any."""
    for mark in (b"?", b"!", b"\n"):
        text = text.replace(mark, b".")
    return next((w for part in reversed(text.split(b".")) if (w := plain_words(part))), [])


def lcs(places: dict[bytes, int], words: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel steps.

    ``places`` gives each word of the pattern the bits of its places.
    """
    kept = 0
    for word in words:
        match = places.get(word, 0)
        if match:
            both = kept | match
            kept = both & ~(both - (kept << 1 | 1))
    return kept.bit_count()


def bits_of(pattern: list[bytes]) -> dict[bytes, int]:
    places: dict[bytes, int] = {}
    for i, word in enumerate(pattern):
        places[word] = places.get(word, 0) | 1 << i
    return places


@dataclass
class Item:
    """One benchmark item as its words and those of its answer."""

    item_id: int
    words: list[bytes]
    answer: list[bytes]

    def __post_init__(self) -> None:
        self.places, self.answer_places = bits_of(self.words), bits_of(self.answer)

    def overlap(self, words: list[bytes], start: int, end: int) -> tuple[float, float]:
        """Best share of the item, and of its answer there, near words start to end."""
        n = len(self.words)
        span = n + n // 4 + 2
        best = (0.0, 0.0)
        first = max(0, start - n)
        last = min(len(words), end + n)
        for at in range(first, max(first + 1, last - n // 2), max(1, n // 8)):
            part = words[at : at + span]
            share = lcs(self.places, part) / n
            if share > best[0]:
                best = (share, lcs(self.answer_places, part) / max(1, len(self.answer)))
        return best


class Numbers(dict):
    """Word numbers: benchmark words have their own, the others share ``BUCKETS`` after them."""

    def __init__(self, own: dict[bytes, int]):
        super().__init__(own)
        self.own = own

    def __missing__(self, word: bytes) -> int:
        if len(self) >= len(self.own) + _HELD_WORDS:
            self.clear()
            self.update(self.own)
        number = self[word] = len(self.own) + zlib.crc32(word) % BUCKETS
        return number


def run_keys(numbers: np.ndarray, size: int) -> np.ndarray:
    """A key of the ``size`` words from each place on; equal runs have equal keys."""
    keys = np.zeros(max(0, numbers.size - size + 1), np.uint64)
    for i in range(size):
        keys = (keys + numbers[i : i + keys.size].astype(np.uint64) + np.uint64(1)) * _MIX
    return keys


class Runs:
    """Where runs of ``size`` words belong, by their keys."""

    def __init__(self, size: int, keys: np.ndarray, owner: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.owner = size, keys[order], owner[order]
        self.sieve = np.zeros(1 << _SIEVE_BITS, bool)
        self.sieve[self._cell(keys)] = True

    @staticmethod
    def _cell(keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - _SIEVE_BITS)

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place and owner of each run among the words."""
        keys = run_keys(numbers, self.size)
        at = np.flatnonzero(self.sieve[self._cell(keys)])
        first = np.searchsorted(self.keys, keys[at], "left")
        counts = np.searchsorted(self.keys, keys[at], "right") - first
        skipped = np.repeat(np.cumsum(counts) - counts - first, counts)
        return np.repeat(at, counts), self.owner[np.arange(skipped.size) - skipped]


class Slice:
    """The items searched together: their vocabulary and, once known, their directions."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.items = []
        for item_id, text in rows:
            data = (text or "").encode()
            item = Item(item_id, plain_words(data), answer_of(data))
            if item.words:
                self.items.append(item)
        own = {w: i for i, w in enumerate(sorted({w for x in self.items for w in x.words}))}
        self.number = Numbers(own)
        self.width = len(own)
        numbers = [np.array([own[w] for w in item.words], np.int64) for item in self.items]
        #: (item, its words in one passage): long items are found by any of their passages.
        self.passages = [
            (i, np.unique(words[a : a + 2 * HALF_WORDS]))
            for i, words in enumerate(numbers)
            if words.size >= MIN_WORDS
            for a in range(0, words.size, 2 * HALF_WORDS)
        ]
        #: Words of the short items, in order; -1 after the last one.
        self.short = np.full((len(numbers), MIN_WORDS - 1), -1, np.int64)
        self.sizes = np.array([words.size for words in numbers], np.int64)
        runs: dict[int, list[tuple[np.ndarray, int]]] = {}
        for i, words in enumerate(numbers):
            size = min(words.size, RUN_WORDS)
            keys = run_keys(words, size)
            if words.size < MIN_WORDS:
                self.short[i, : words.size] = words
                keys = keys[:1]
            runs.setdefault(size, []).append((np.unique(keys), i))
        self.runs = [
            Runs(
                size,
                np.concatenate([keys for keys, _ in held]),
                np.repeat([i for _, i in held], [keys.size for keys, _ in held]),
            )
            for size, held in runs.items()
        ]
        self.weights = np.empty(0)
        #: Weights of the buckets of all other words.
        self.others = np.empty(0)
        self.directions = np.empty((0, 0), np.float32)
        self.latent = np.empty((0, 0), np.float32)

    def vector(self, passage: int) -> np.ndarray:
        out = np.zeros(self.width)
        own = self.passages[passage][1]
        out[own] = self.weights[own]
        return out

    def projected(self, directions: np.ndarray) -> np.ndarray:
        """The passages' vectors along the directions."""
        return np.stack([self.weights[own] @ directions[own] for _, own in self.passages])

    def numbered(self, texts: list[bytes]) -> Numbered:
        split = [plain_words(text) for text in texts]
        sizes = np.array([len(words) for words in split], np.int64)
        numbers = np.fromiter(
            map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum())
        )
        parts = -(-sizes // HALF_WORDS)
        place = np.arange(numbers.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        half = np.repeat(np.cumsum(parts) - parts, sizes) + place // HALF_WORDS
        return Numbered(split, sizes, numbers, parts, half)

    def halves(self, text: Numbered) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words of each half passage: half and word, by half."""
        width = self.width + BUCKETS
        pairs = np.sort(text.half * width + text.numbers)
        pairs = pairs[np.flatnonzero(np.diff(pairs, prepend=-1))]
        return pairs // width, pairs % width

    def runs_in(self, text: Numbered) -> tuple[np.ndarray, np.ndarray]:
        """(place, item) of the runs of long items and of whole short items."""
        found = [run.places(text.numbers) for run in self.runs]
        place = np.concatenate([own for own, _ in found])
        item = np.concatenate([own for _, own in found])
        if not place.size:
            return place, item
        ends = np.repeat(np.cumsum(text.sizes), text.sizes)
        kept = (self.sizes[item] >= MIN_WORDS) | (place + self.sizes[item] <= ends[place])
        place, item = place[kept], item[kept]
        numbers = np.append(text.numbers, np.full(MIN_WORDS, -2))
        equal = np.ones(place.size, bool)
        for i in range(MIN_WORDS - 1):
            word = self.short[item, i]
            equal &= (word < 0) | (word == numbers[place + i])
        return place[equal], item[equal]


@dataclass
class Numbered:
    """Texts as words and as word numbers, one text after the other."""

    split: list[list[bytes]]
    sizes: np.ndarray
    numbers: np.ndarray
    #: Half passages of each text, and the one that each word is in.
    parts: np.ndarray
    half: np.ndarray


def passage_counts(docs: DataFrame, piece: Slice) -> np.ndarray:
    """Number of half passages of all documents that hold each word, and their number."""
    size = piece.width + BUCKETS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for part in chunks(texts, _CHUNK_BYTES):
                text = piece.numbered(texts[part])
                total += np.bincount(piece.halves(text)[1], minlength=size + 1)
                total[size] += text.parts.sum()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word")
    table = rows.agg(F.sum("n").alias("n")).toArrow()  # a row per word of the slice and bucket
    counts = np.zeros(size + 1, np.int64)
    counts[table["word"].to_numpy()] = table["n"].to_numpy()
    return counts


def randomised_svd(spark: SparkSession, piece: Slice) -> np.ndarray:
    """Right singular directions of the slice's TF-IDF matrix, as columns.

    Each power step sends the current directions out and sums A'(A Q) over the parts of
    the matrix; the rank doubles until the directions keep ``KEPT_ENERGY`` of each passage.
    """
    width, items = piece.width, len(piece.passages)
    places = spark.range(0, items, 1, min(_SVD_PARTS, items))

    def product(q: np.ndarray) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(q.shape, np.float32)
            for batch in batches:
                a = np.stack([piece.vector(i) for i in batch.column(0).to_pylist()])
                total += a.T @ (a @ q.astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

        parts = places.mapInArrow(part, "part binary").collect()  # _SVD_PARTS matrices
        total = np.zeros(q.shape)
        for row in parts:
            total += np.frombuffer(row["part"], np.float32).reshape(q.shape)
        return total

    energy = np.array([np.square(piece.weights[own]).sum() for _, own in piece.passages])
    rank = min(items, width, _RANK)
    rng = np.random.default_rng(42)
    while True:
        q = rng.normal(size=(width, min(width, rank + _OVERSAMPLED)))
        for _ in range(_POWER_STEPS):
            q, _ = np.linalg.qr(product(q.astype(np.float32)))
        inner = q.T @ product(q.astype(np.float32))
        values, inner = np.linalg.eigh((inner + inner.T) / 2)
        order = np.argsort(values)[::-1][:rank]
        directions = q @ inner[:, order]
        kept = np.square(piece.projected(directions)).sum(axis=1)
        if rank >= min(items, width) or (kept >= KEPT_ENERGY * energy).all():
            return directions
        rank = min(2 * rank, items, width)


def search(docs: DataFrame, piece: Slice) -> DataFrame:
    """(doc_id, item_id, overlap, answer_overlap) of the hits of one slice."""

    items = piece.latent / np.linalg.norm(piece.latent, axis=1, keepdims=True)
    owner = np.array([i for i, _ in piece.passages], np.int64)
    scaled = (piece.directions * piece.weights[:, None]).astype(np.float32) if owner.size else None
    energy_of = np.square(np.concatenate([piece.weights, piece.others]))

    def candidates(size: int, half: np.ndarray, word: np.ndarray, follows: np.ndarray):
        """(half, item) of the passages, one half or two, that are near an item."""
        energy = np.bincount(half, energy_of[word], minlength=size)
        ours = word < piece.width
        half, word = half[ours], word[ours]
        known = np.bincount(half, energy_of[word], minlength=size)
        # The latent part of two halves is at most the sum of both lengths.
        after = np.append(follows, False)
        longest = np.sqrt(known)
        longest[after] += np.sqrt(known[1:][follows])
        both = energy.copy()
        both[after] += energy[1:][follows]
        near = np.flatnonzero(
            (longest >= MIN_COSINE * np.sqrt(both)) | (known >= MIN_COSINE**2 * energy)
        )
        wanted = np.zeros(size + 1, bool)
        wanted[near] = wanted[near + 1] = True
        picked = wanted[half]
        half, word = half[picked], word[picked]
        owned = np.flatnonzero(np.diff(half, prepend=-1))
        # Halves with most words first: the n-th words of all that have one are added at once.
        counts = np.diff(owned, append=half.size)
        order = np.argsort(-counts, kind="stable")
        owned, counts = owned[order], counts[order]
        row = np.full(size + 1, owned.size)
        row[half[owned]] = np.arange(owned.size)
        latent = np.zeros((owned.size + 1, scaled.shape[1]), np.float32)
        for n in range(int(counts.max(initial=0))):
            held = int(np.searchsorted(-counts, -n))
            latent[:held] += scaled[word[owned[:held] + n]]
        single = latent[row[near]]
        pair = single + np.where(after[near][:, None], latent[row[near + 1]], 0)
        for vectors, square in ((single, energy), (pair, both)):
            cosine = vectors @ items.T / np.sqrt(square[near])[:, None]
            at, passage = np.nonzero(cosine >= MIN_COSINE)
            yield near[at], owner[passage]

    def hits(doc_ids: list, texts: list[bytes]) -> Iterator[tuple]:
        text = piece.numbered(texts)
        document = np.repeat(np.arange(len(texts)), text.parts)
        first = np.cumsum(text.parts) - text.parts
        if not document.size:
            return
        place, item = piece.runs_in(text)
        whole = piece.sizes[item] < MIN_WORDS
        places = document[text.half[place[whole]]], item[whole]
        for d, i in np.unique(np.stack(places, axis=1), axis=0).tolist():
            yield doc_ids[d], piece.items[i].item_id, 1.0, 1.0
        near = [(text.half[place[~whole]], item[~whole])]
        if piece.passages:
            follows = document[1:] == document[:-1]
            near += candidates(document.size, *piece.halves(text), follows)
        best: dict[tuple[int, int], tuple[float, float]] = {}
        both = np.concatenate([np.stack(pair, axis=1) for pair in near])
        for a, i in np.unique(both, axis=0).tolist():
            d = int(document[a])
            if best.get((d, i), (0.0, 0.0))[0] < 1:
                start = (a - int(first[d])) * HALF_WORDS
                shares = piece.items[i].overlap(text.split[d], start, start + 2 * HALF_WORDS)
                best[d, i] = max(best.get((d, i), (0.0, 0.0)), shares)
        for (d, i), (share, answer) in best.items():
            if share >= SURE_OVERLAP or (share >= MIN_OVERLAP and answer >= MIN_ANSWER):
                yield doc_ids[d], piece.items[i].item_id, share, answer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids, texts = batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))
            found = [
                row
                for part in chunks(texts, _CHUNK_BYTES)
                for row in hits(doc_ids[part], texts[part])
            ]
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(c, t)
                    for c, t in zip(
                        columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True
                    )
                ],
                ["doc_id", "item_id", "overlap", "answer_overlap"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, item_id long, overlap double, answer_overlap double"
    )


def contaminated(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, overlap, answer_overlap) for every document that holds an item."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    items = pin(
        benchmark.select(
            F.col(f"`{item_col}`").cast("long").alias("item_id"),
            F.col(f"`{item_text_col}`").alias("text"),
        ),
        "benchmark",
    )
    slices = -(-items.count() // SLICE_ITEMS)
    out = spark.createDataFrame(
        [], "doc_id long, item_id long, overlap double, answer_overlap double"
    )
    for number in range(slices):
        piece = Slice(_slice(items, slices, number))
        if piece.items:
            out = out.union(search(docs, prepared(spark, docs, piece)))
    return out


def _slice(items: DataFrame, slices: int, number: int) -> list[tuple[int, str]]:
    """About ``SLICE_ITEMS`` items, dealt by a hash; a whole benchmark never comes at once."""
    own: Column = F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == number
    rows = items.where(own).where("text IS NOT NULL").select("item_id", "text").collect()
    return sorted(map(tuple, rows), key=lambda row: (row[0] is None, row[0] or 0, row[1]))


def prepared(spark: SparkSession, docs: DataFrame, piece: Slice) -> Slice:
    """The slice with its weights and directions; short items need none."""
    if not piece.passages:
        return piece
    counts = passage_counts(docs, piece)
    weights = np.log((counts[-1] + 2) / (counts[:-1] + 1))
    piece.weights, piece.others = weights[: piece.width], weights[piece.width :]
    directions = randomised_svd(spark, piece)
    piece.directions = directions.astype(np.float32)
    piece.latent = piece.projected(directions).astype(np.float32)
    return piece


def clean(
    df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``df`` that hold no item. Rows without an id are matched by nothing."""
    bad = contaminated(df, benchmark, id_col, text_col).select(F.col("doc_id").alias("bad_id")).distinct()
    bad = pin(bad, "contaminated")
    return df.join(bad, df[f"`{id_col}`"] == bad["bad_id"], "left_anti")
