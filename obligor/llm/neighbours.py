"""Nearest vectors by cosine: a block matrix join with int8 products and error bounds.

Queries and candidates are dealt into blocks by a hash of their ids; a tile is a pair of
blocks. In a tile, unit vectors rounded to int8 are multiplied as matrices. With
``x = s q + e`` the error of ``s_x s_y (q_x . q_y)`` is at most ``|e_x| + |s_x q_x| |e_y|``,
so a candidate whose upper bound is below the k-th best lower bound of its query cannot be
among its k nearest. The rest are computed again in double precision from the original
vectors, and a heap keeps the k best of the tile; heaps of all tiles are merged per query.
The result is exact: recall is 1.

Vectors that are null, all zero, or hold a null or a non-finite component take no part, nor
do rows without an id; vectors are compared with those of equal length. Rows that share
an id count once, as the smallest of their vectors. Fewer candidates than k give fewer
rows; ties go to the smaller id; empty tables give empty results. Only the two named
columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors on each side of a tile.
BLOCK_ROWS = 4_096
#: Queries of a tile multiplied at once.
_STRIP_ROWS = 512
_HITS = "query_id long, vec_id long, score double"


def _matrix(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by vector length; of repeated ids the smallest vector stays."""
    by_length: dict[int, dict[int, list]] = defaultdict(dict)
    ids = table.column("id").to_pylist()
    lists = table.column("vector").combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    flat = lists.flatten().to_numpy()
    ends = np.cumsum(lengths)
    for row, length in enumerate(lengths.tolist()):
        vector = flat[ends[row] - length : ends[row]]
        held = by_length[length].get(ids[row])
        if held is None or vector.tolist() < held.tolist():
            by_length[length][ids[row]] = vector
    return {
        length: (np.array(list(rows), np.int64), np.stack(list(rows.values())))
        for length, rows in by_length.items()
    }


def _rounded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows of the unit vectors, their steps, norms and rounding errors."""
    unit = vectors / np.sqrt(np.square(vectors).sum(axis=1))[:, None]
    step = np.abs(unit).max(axis=1) / 127
    small = np.rint(unit / step[:, None]).astype(np.int8)
    near = small * step[:, None]
    return (
        small,
        step,
        np.sqrt(np.square(near).sum(axis=1)),
        np.sqrt(np.square(unit - near).sum(axis=1)),
    )


def cosines(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, summed component by component in double precision."""
    dot, square_l, square_r = (np.zeros(len(left)) for _ in range(3))
    for d in range(left.shape[1]):
        x, y = left[:, d], right[:, d]
        dot += x * y
        square_l += x * x
        square_r += y * y
    return np.clip(dot / np.sqrt(square_l * square_r), -1.0, 1.0)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which is exact, so that squares stay in range."""
    _, exponent = np.frexp(np.abs(vectors).max(axis=1))
    return np.ldexp(vectors, -exponent[:, None])


def tile_nearest(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int
) -> Iterator[tuple[int, int, float]]:
    """(query, candidate, score) of the k nearest of each query within one tile."""
    queries, vectors = _scaled(queries), _scaled(vectors)
    # Sums of products of int8 are exact in single precision up to 2**24.
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    small, step, norm, error = _rounded(vectors)
    columns = small.T.astype(exact)
    for start in range(0, len(queries), _STRIP_ROWS):
        own_ids, strip = query_ids[start : start + _STRIP_ROWS], queries[start : start + _STRIP_ROWS]
        q_small, q_step, q_norm, q_error = _rounded(strip)
        score = (q_small.astype(exact) @ columns) * q_step[:, None] * step
        slack = q_error[:, None] + q_norm[:, None] * error + 1e-9
        own = own_ids[:, None] == ids
        low = np.where(own, -np.inf, score - slack)
        if len(ids) > k:
            least = np.partition(low, -k, axis=1)[:, -k]
        else:
            least = np.full(len(strip), -np.inf)
        row, col = np.nonzero((score + slack >= least[:, None]) & ~own)
        found = np.empty(row.size)
        for a in range(0, row.size, 1 << 16):
            part = slice(a, a + (1 << 16))
            found[part] = cosines(strip[row[part]], vectors[col[part]])
        cuts = np.searchsorted(row, np.arange(len(strip) + 1))
        for q in range(len(strip)):
            part = slice(cuts[q], cuts[q + 1])
            best = heapq.nsmallest(
                k, zip((-found[part]).tolist(), ids[col[part]].tolist(), strict=True)
            )
            for negative, vec_id in best:
                yield int(own_ids[q]), vec_id, -negative


def nearest(
    df: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row with ``is_query``.

    ``is_query`` is a condition on a column named ``id``, the row's id.
    """
    rows = df.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.col(f"`{vector_col}`").cast("array<double>").alias("vector"),
    ).where(
        F.col("id").isNotNull()
        & F.exists("vector", lambda x: x != 0)
        & F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    )
    n_rows, n_queries = (
        df.select(F.col(f"`{id_col}`").alias("id"))
        .agg(F.count("*"), F.count(F.when(is_query, 1)))
        .first()
    )
    columns = max(1, math.ceil(n_rows / block_rows))
    strips = max(1, math.ceil(n_queries / block_rows))

    def block(parts: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")

    def each(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    left = rows.where(is_query).select("id", "vector", block(strips).alias("strip"), each(columns).alias("tile"))
    right = rows.select("id", "vector", each(strips).alias("strip"), block(columns).alias("tile"))

    def tile(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        hits: list[tuple[int, int, float]] = []
        if queries.num_rows and candidates.num_rows:
            known = _matrix(candidates)
            for length, (query_ids, vectors) in _matrix(queries).items():
                if length in known:
                    hits += tile_nearest(query_ids, vectors, *known[length], k)
        columns = list(zip(*hits, strict=True)) or [[], [], []]
        return pa.table(
            {
                "query_id": pa.array(columns[0], pa.int64()),
                "vec_id": pa.array(columns[1], pa.int64()),
                "score": pa.array(columns[2], pa.float64()),
            }
        )

    hits = (
        left.groupBy("strip", "tile").cogroup(right.groupBy("strip", "tile")).applyInArrow(tile, _HITS)
    )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Heaps of k rows for the queries of one partition."""
        best: defaultdict[int, list[tuple[float, int]]] = defaultdict(list)
        for batch in batches:
            for query_id, vec_id, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                heap = best[query_id]
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec_id))
                else:
                    heapq.heappushpop(heap, (score, -vec_id))
        out = [
            (query_id, rank, -vec_id, score)
            for query_id, heap in best.items()
            for rank, (score, vec_id) in enumerate(sorted(heap, reverse=True), 1)
        ]
        for start in range(0, len(out), 10_000):
            columns = list(zip(*out[start : start + 10_000], strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                ["query_id", "rank", "vec_id", "score"],
            )

    return hits.repartition("query_id").mapInArrow(
        merge, "query_id long, rank int, vec_id long, score double"
    )
