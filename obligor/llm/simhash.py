"""SimHash near-duplicates: 64-bit fingerprints, compared tile by tile.

``fingerprints`` votes over the XXH64 values of word shingles. ``links`` compares the
distinct fingerprints exactly: they are ordered by population count and cut into tiles of
about ``TILE_ROWS``; two fingerprints within ``radius`` bits have population counts within
``radius``, so a pair of tiles whose ranges are further apart is never formed. Inside a
pair of tiles the same test on the counts of both halves picks the blocks whose exclusive-or
is counted. Each pair of tiles returns a spanning forest of its links, not the links, so a
group of thousands of near copies costs one row per member. ``components.roots`` joins the
forests.

The work is a fixed share of all pairs of distinct fingerprints, as the method compares
exactly; rows that share a fingerprint are one point from the start.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer
words than a shingle form one shingle; repeated rows share a class, and so do rows that share
an id; a null ``doc_id`` is ignored when the smallest id of a class is chosen, and a class
without any id has none; an empty table gives an empty result.
Only the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obligor.llm.components import UnionFind, roots
from obligor.llm.words import texts_of, words_of
from obligor.session import pin

#: Words in a shingle, seed of its hash, and differing bits that still link.
SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Distinct fingerprints in a tile: half a megabyte.
TILE_ROWS = 32_768
#: Pairs whose exclusive-or is held at a time.
_BLOCK_PAIRS = 1 << 18
#: Ids are below this number; labels of prints without an id are not.
NO_ID = 1 << 62


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    words = words_of(text)
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(whole, SEED)
    gaps = np.flatnonzero(np.frombuffer(whole, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle_words] + 1).tolist()]
    ends = [*gaps[shingle_words - 1 :].tolist(), len(whole)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(whole[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64
    )
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for start in range(0, hashes.size, 1 << 16):
        part = hashes[start : start + (1 << 16)].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > hashes.size).tolist())


def fingerprinted(text: Column, shingle_words: int = SHINGLE_WORDS) -> Column:
    """Fingerprint of a text as a signed 64-bit integer."""

    @F.arrow_udf("bigint")
    def prints(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            values = [fingerprint(text, shingle_words) for text in texts_of(column)]
            yield pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())

    return prints(text)


def _half_counts(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.bitwise_count(prints & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return np.bitwise_count(prints).astype(np.int64) - low, low


def _cells(prints: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Places of the fingerprints by the population counts of both halves."""
    high, low = _half_counts(prints)
    order = np.argsort(high * 64 + low, kind="stable")
    keys = (high * 64 + low)[order]
    cuts = np.flatnonzero(np.diff(keys)) + 1
    return [
        (int(high[part[0]]), int(low[part[0]]), part, prints[part])
        for part in np.split(order, cuts)
        if part.size
    ]


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple]:
    """Places (i, j) of the pairs within ``radius`` bits, block by block."""
    columns = _cells(right)
    sides = np.array([(high, low) for high, low, _, _ in columns]).reshape(-1, 2)
    for high, low, at, values in _cells(left):
        near = np.abs(sides - (high, low)).sum(axis=1) <= radius
        picked = [columns[c] for c in np.flatnonzero(near).tolist()]
        if not picked:
            continue
        places = np.concatenate([c[2] for c in picked])
        others = np.concatenate([c[3] for c in picked])
        step = max(1, _BLOCK_PAIRS // others.size)
        for start in range(0, values.size, step):
            block = values[start : start + step, None] ^ others
            i, j = np.nonzero(np.bitwise_count(block) <= radius)
            yield at[start + i], places[j]


def _tiles(counts: dict[int, int], tile_rows: int, radius: int) -> list[tuple]:
    """(population count, first tile, tiles, first partner, last partner) of each count.

    Tiles follow the order of population counts: small counts share a tile, large ones are
    cut by a hash. The partners of a tile are then a run of tiles.
    """
    spans: list[list[int]] = []
    places: dict[int, tuple[int, int]] = {}
    held = tile_rows
    for bits in sorted(counts):
        parts = math.ceil(counts[bits] / tile_rows)
        if held + counts[bits] <= tile_rows:
            spans[-1][1] = bits
            held += counts[bits]
            places[bits] = (len(spans) - 1, 1)
        else:
            places[bits] = (len(spans), parts)
            spans += [[bits, bits] for _ in range(parts)]
            held = counts[bits] if parts == 1 else tile_rows
    out = []
    for bits, (tile, parts) in places.items():
        low, high = spans[tile]
        near = [t for t, (a, b) in enumerate(spans) if a - high <= radius and low - b <= radius]
        out.append((bits, tile, parts, near[0], near[-1]))
    return out


def links(points: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Forest edges (src, dst) of the labels of all prints within the radius.

    ``points`` are rows (print, label), each print once. A row knows its tile and the tiles
    to meet from its population count alone: at most 65 counts come to the driver, and no
    table of tiles is joined.
    """
    bits = points.select("print", "label", F.bit_count("print").cast("int").alias("bits"))
    tiles = _tiles(dict(bits.groupBy("bits").count().collect()), tile_rows, radius)
    if not tiles:
        return points.sparkSession.createDataFrame([], "src long, dst long")

    def of_bits(field: int) -> Column:
        pairs = [F.lit(x) for row in tiles for x in (row[0], row[field])]
        return F.create_map(*pairs)[F.col("bits")]

    placed = bits.select(
        "print",
        "label",
        (of_bits(1) + F.pmod(F.xxhash64("print"), of_bits(2))).cast("int").alias("tile"),
        F.explode(F.sequence(of_bits(3), of_bits(4))).alias("partner"),
    )
    spread = placed.select(
        "print",
        "label",
        F.least("tile", "partner").alias("low"),
        F.greatest("tile", "partner").alias("high"),
        (F.col("tile") > F.col("partner")).alias("second"),
    )

    def forest(group: pd.DataFrame) -> pd.DataFrame:
        values = group["print"].to_numpy().view(np.uint64)
        labels = group["label"].to_numpy()
        second = group["second"].to_numpy()
        other = ~second if group["low"].iat[0] == group["high"].iat[0] else second
        a, b = labels[~second], labels[other]
        joined = UnionFind()
        for i, j in tile_links(values[~second], values[other], radius):
            joined.join_all(a[i], b[j])
        src, dst = joined.edges()
        return pd.DataFrame({"src": src, "dst": dst})

    return spread.groupBy("low", "high").applyInPandas(forest, "src long, dst long")


def classes(prints: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(print, component_id) of distinct fingerprints, from rows (print, doc_id).

    A print is labelled by its smallest id, so the smallest label of a component is the
    answer and no join meets a large component under one key. Without any id the label is
    the print behind ``NO_ID``; prints that differ in the two bits lost are linked anyway
    by a radius of two or more.
    """
    own = F.col("print").bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    points = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    points = pin(points.select("print", F.coalesce("first_id", own).alias("label")), "prints")
    tops = roots(pin(links(points, radius, tile_rows), "print-links"))
    smallest = F.coalesce("root", "label")
    return points.join(tops, points["label"] == tops["node"], "left").select(
        "print", F.when(smallest < NO_ID, smallest).alias("component_id")
    )


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    radius: int = RADIUS,
    tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row.

    ``component_id`` is the smallest id among all rows that chains of links reach.
    """
    rows = pin(
        df.select(
            F.col(f"`{id_col}`").cast("long").alias("doc_id"),
            fingerprinted(F.col(f"`{text_col}`"), shingle_words).alias("print"),
        ),
        "fingerprints",
    )
    found = classes(rows, radius, tile_rows)
    # A hot fingerprint is one row on the right; run-time skew handling splits the left.
    return rows.join(found, "print", "left").select(
        "doc_id",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def keep_first(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int
) -> DataFrame:
    """The rows of ``df`` whose id is the smallest of its group.

    Rows that repeat the id that stays, stay too; rows without an id are not judged.
    """
    kept = (
        near_duplicates(df, id_col, text_col, **options)
        .where("doc_id = component_id OR doc_id IS NULL")
        .select(F.col("doc_id").alias("kept_id"))
        .distinct()
    )
    return df.join(kept, df[f"`{id_col}`"].eqNullSafe(kept["kept_id"]), "left_semi")
