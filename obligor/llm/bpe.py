"""Byte-level BPE: merges found by a segment tree, and the way back from ids to bytes.

Every leaf of the tree stands for a byte position of a pre-token and holds
``rank << 20 | position`` of the pair that starts there, or ``NONE``. A node holds the
minimum of its children, so the root names the pair of lowest rank, leftmost on ties.
A merge changes three leaves: the merged position, the swallowed one and the live
neighbour on the left; each update walks one path to the root.

``merge_long`` does this for one pre-token, ``BytePairCodec._merge_group`` for many of
about the same length in step, one numpy row each. A pre-token is merged once while the
worker remembers it; the memory is bounded by ``REMEMBERED`` entries and only saves time.

Defined results: a null text is encoded as an empty one; an empty text has no ids; null
ids decode to null; an id outside the vocabulary fails the job. Repeated rows and other
columns, whatever their names, pass through untouched.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obligor.llm.pretokens import Splitter, newer_characters
from obligor.llm.words import chunks, texts_of

POSITION_BITS = 20
NONE = np.int64(1) << 62
#: Pre-tokens up to this many bytes are merged in groups.
GROUPED_BYTES = 64
#: Pre-tokens that a worker keeps, about 50 MB.
REMEMBERED = 200_000
#: Bytes of text split and merged together.
CHUNK_BYTES = 2_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a ``.tiktoken`` file: base64 bytes and rank per line."""
    with open(path, "rb") as file:
        rows = (line.split() for line in file)
        return {base64.b64decode(row[0]): int(row[1]) for row in rows if row}


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token in O(n log n)."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after = [*range(1, n), -1]
    before = list(range(-1, n - 1))
    none = int(NONE)

    def key(at: int) -> int:
        if at < 0 or after[at] < 0:
            return none
        rank = ranks.get(parts[at] + parts[after[at]])
        return none if rank is None else rank << 32 | at

    tree = [none] * (2 * size)
    tree[size : size + n] = [key(i) for i in range(n)]
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(at: int, value: int) -> None:
        node = size + at
        tree[node] = value
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least

    while tree[1] != none:
        at = tree[1] & 0xFFFFFFFF
        gone = after[at]
        parts[at] += parts[gone]
        after[at] = after[gone]
        if after[gone] >= 0:
            before[after[gone]] = at
        update(gone, none)
        update(at, key(at))
        if before[at] >= 0:
            update(before[at], key(before[at]))
    ids, at = [], 0
    while at >= 0 and n:
        ids.append(ranks[parts[at]])
        at = after[at]
    return ids


class BytePairCodec:
    """Vocabulary, pattern and the pre-tokens merged so far; one per worker process."""

    def __init__(
        self,
        ranks: dict[bytes, int],
        pattern: str,
        newer: str = "",
        remembered: int = REMEMBERED,
    ):
        self.ranks = ranks
        self.split = Splitter(pattern, newer)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.size = max(ranks.values()) + 1
        pieces = [b""] * self.size
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [
            (ranks[piece[:cut]] * (self.size + 1) + ranks[piece[cut:]], rank)
            for piece, rank in ranks.items()
            for cut in range(1, len(piece))
            if piece[:cut] in ranks and piece[cut:] in ranks
        ]
        pairs.sort()
        self.pair_keys = np.array([*(p[0] for p in pairs), np.iinfo(np.int64).max], np.int64)
        self.pair_ranks = np.array([*(p[1] for p in pairs), 0], np.int64)

    def _pair_key(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf value of the pair; id ``size`` stands for the end and pairs with nothing."""
        wanted = left * (self.size + 1) + right
        found = np.searchsorted(self.pair_keys, wanted)
        return np.where(
            self.pair_keys[found] == wanted, self.pair_ranks[found] << POSITION_BITS | at, NONE
        )

    def _merge_group(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Ids of pre-tokens of at most ``size`` (a power of two) bytes, as packed integers."""
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        live = np.arange(size) < lengths[:, None]
        ids = np.full((count, size + 1), self.size, np.int64)
        ids[:, :size][live] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 2), (count, 1))
        after[np.arange(count), lengths - 1] = size
        before = np.tile(np.arange(-1, size), (count, 1))
        tree = np.full((count, 2 * size), NONE, np.int64)
        tree[:, size:] = self._pair_key(ids[:, :-1], ids[:, 1:], np.arange(size))
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(
                tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2]
            )
            level //= 2
        row = np.flatnonzero(tree[:, 1] != NONE)
        while row.size:
            top = tree[row, 1]
            at, rank = top & ((1 << POSITION_BITS) - 1), top >> POSITION_BITS
            gone = after[row, at]
            follow = after[row, gone]
            ids[row, at] = rank
            ids[row, gone] = -1
            after[row, at] = follow
            before[row, follow] = at
            left = before[row, at]
            has = left >= 0
            rows = np.concatenate([row, row, row[has]])
            nodes = np.concatenate([gone, at, left[has]]) + size
            tree[rows, nodes] = np.concatenate(
                [
                    np.full(row.size, NONE),
                    self._pair_key(rank, ids[row, follow], at),
                    self._pair_key(ids[row[has], left[has]], rank[has], left[has]),
                ]
            )
            for _ in range(size.bit_length() - 1):
                nodes >>= 1
                tree[rows, nodes] = np.minimum(tree[rows, 2 * nodes], tree[rows, 2 * nodes + 1])
            row = row[tree[row, 1] != NONE]
        kept = live & (ids[:, :size] >= 0)
        packed = ids[:, :size][kept].astype("<u4").tobytes()
        ends = 4 * np.cumsum(kept.sum(axis=1))
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of distinct pre-tokens; a piece of the vocabulary is its own id."""
        out: list[bytes | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > GROUPED_BYTES:
                out[i] = np.array(merge_long(piece, self.ranks), "<u4").tobytes()
            else:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for size, places in groups.items():
            # 4 MB of tree at a time stays near the cache.
            step = max(1, 262_144 // size)
            for start in range(0, len(places), step):
                part = places[start : start + step]
                merged = self._merge_group([pieces[i] for i in part], size)
                for i, ids in zip(part, merged, strict=True):
                    out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text."""
        if len(self.known) > self.remembered:
            self.known.clear()
        split = [self.split(text) for text in texts]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        self.known.update(zip(new, self.merge([piece.encode() for piece in new]), strict=True))
        ids_of = self.known.__getitem__
        return [b"".join(map(ids_of, pieces)) for pieces in split]

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if ids.size == 0:
            return b""
        if ids.max() >= self.size:
            raise ValueError(f"id {ids.max()} is outside the vocabulary of {self.size}")
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        if lengths.min() == 0:
            raise ValueError("an id has no bytes in the vocabulary")
        return self.flat[
            np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(ends[-1])
        ].tobytes()


_codecs: dict[str, BytePairCodec] = {}


def _codec(shared: Broadcast) -> BytePairCodec:
    """The codec of this process, kept from task to task while the vocabulary stays."""
    name, ranks, pattern, newer = shared.value
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = BytePairCodec(ranks, pattern, newer)
    return _codecs[name]


def share_ranks(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The vocabulary file, read by the driver: a file of fixed size, under 1 MB here."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast((f"{path} {pattern}", ranks, pattern, newer_characters()))


def _encode_column(codec: BytePairCodec, column: pa.Array) -> list[bytes]:
    texts = texts_of(column)
    out: list[bytes] = []
    for part in chunks(texts, CHUNK_BYTES):
        out += codec.encode([text.decode("utf-8", "replace") for text in texts[part]])
    return out


def encoded(text: Column, vocabulary: Broadcast) -> Column:
    """Ids of a text as binary, four bytes each, little-endian."""

    @F.arrow_udf("binary")
    def encode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(vocabulary)
        for column in columns:
            yield pa.array(_encode_column(codec, column), pa.binary())

    return encode(text)


def decoded(ids: Column, vocabulary: Broadcast) -> Column:
    """Bytes of packed ids as binary."""

    @F.arrow_udf("binary")
    def decode(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(vocabulary)
        for column in columns:
            yield pa.array(
                [None if x is None else codec.decode(x) for x in column.to_pylist()], pa.binary()
            )

    return decode(ids)


def round_trip(text: Column, vocabulary: Broadcast) -> Column:
    """Struct of a text's packed ids and the bytes decoded from them, by one worker."""

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def both(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(vocabulary)
        for column in columns:
            ids = _encode_column(codec, column)
            back = pa.array([codec.decode(x) for x in ids], pa.binary())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), back], ["ids", "decoded"])

    return both(text)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of integers."""

    @F.arrow_udf("array<int>")
    def unpack(column: pa.Array) -> pa.Array:
        lists = [None if x is None else np.frombuffer(x, "<i4") for x in column.to_pylist()]
        return pa.array(lists, pa.list_(pa.int32()))

    return unpack(ids)


def encode(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids"
) -> DataFrame:
    """Add the packed ids of every whole text; ``path`` names the rank file."""
    vocabulary = share_ranks(df.sparkSession, path, pattern)
    return df.withColumn(out_col, encoded(F.col(f"`{text_col}`"), vocabulary))


def decode(
    df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded"
) -> DataFrame:
    """Add the bytes that packed ids stand for."""
    vocabulary = share_ranks(df.sparkSession, path, pattern)
    return df.withColumn(out_col, decoded(F.col(f"`{ids_col}`"), vocabulary))
