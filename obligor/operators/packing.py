"""Exact ROC AUC of many keys at once from scores that are shuffled once, as packed arrays.

A task sorts some millions of its scores, counts equal ones and sends an array for each
key, cell of scores and outcome. A cell then counts its own ordered pairs; pairs across
cells follow from their totals.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obligor.session import reach_workers

#: Columns that tell keys apart: feature, repeat, class.
KEYS = ("_f", "_r", "_class")
# Scores that a task sorts at once.
PACK_ROWS = 2_000_000

#: Rows of a block of training rows.
BLOCK_ROWS = 32_768

_PACKED = "_f int, _r int, _class int, cell int, hit boolean, scores binary, counts binary"
_CELLS = "_f int, _r int, _class int, cell int, pos bigint, neg bigint, twice double"


def floats(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<f8")


def batch_of(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [field.split() for field in schema.split(", ")]
    arrays = [pa.array([row[k] for row in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)]
    yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def packed_auc(
    df: DataFrame, edges: Mapping[tuple[int, int], Sequence[float]], pack_rows: int = PACK_ROWS
) -> DataFrame:
    """(_f, _r, _class, roc_auc, positives) of rows (_f, _r, _class, hit, score).

    ``edges`` cuts the scores of each (_f, _class) into cells, which only balances the
    work. NaN is the largest score, NULL is left out. The AUC is NULL where an outcome is missing.
    """
    reach_workers(df.sparkSession)
    cuts = {at: np.unique([x for x in e if x == x]) for at, e in edges.items()}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.column("score").null_count:
                batch = batch.filter(batch.column("score").is_valid())
            held.append(batch)
            rows += batch.num_rows
            if rows >= pack_rows:
                yield from _pack(held, cuts)
                held, rows = [], 0
        if rows:
            yield from _pack(held, cuts)

    typed = df.select(*[F.col(k).cast("int").alias(k) for k in KEYS], "hit", "score")
    sent = typed.mapInArrow(packed, _PACKED)
    cells = sent.groupBy(*KEYS, "cell").applyInArrow(_cell_pairs, _CELLS)
    higher = Window.partitionBy(*KEYS).orderBy(F.desc("cell"))
    pairs = F.col("twice") / 2 + F.col("neg").cast("double") * (F.sum("pos").over(higher) - F.col("pos"))
    positives, negatives = F.sum("pos"), F.sum("neg")
    return (
        cells.withColumn("pairs", pairs)
        .groupBy(*KEYS)
        .agg(
            F.try_divide(F.sum("pairs"), positives.cast("double") * negatives.cast("double")).alias("roc_auc"),
            positives.alias("positives"),
        )
    )


def _pack(
    batches: Sequence[pa.RecordBatch], cuts: Mapping[tuple[int, int], np.ndarray]
) -> Iterator[pa.RecordBatch]:
    """The distinct scores of each key, cell and outcome, in order, with their counts."""
    table = pa.Table.from_batches(batches)
    f, r, k, hit, score = (table[name].to_numpy() for name in (*KEYS, "hit", "score"))
    spans = int(r.max()) + 1, int(k.max()) + 1
    group = ((f.astype(np.int64) * spans[0] + r) * spans[1] + k) * 2 + hit
    # Numbers of 16 bits are sorted by radix.
    small = group.astype(np.uint16) if group.max() < 1 << 16 else group
    order = np.argsort(small, kind="stable")
    group, score = group[order], score[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    out: list[tuple] = []
    for start, end in zip(starts, [*starts[1:], len(group)], strict=True):
        key, outcome = divmod(int(group[start]), 2)
        rest, klass = divmod(key, spans[1])
        feature, repeat = divmod(rest, spans[0])
        values, counts = np.unique(score[start:end], return_counts=True)
        at = [0, *np.searchsorted(values, cuts.get((feature, klass), ())), len(values)]
        for cell, (low, high) in enumerate(zip(at, at[1:])):
            if low < high:
                out.append(
                    (feature, repeat, klass, cell, bool(outcome), values[low:high].tobytes(), counts[low:high].astype(np.int32).tobytes())
                )
    kinds = [pa.int32()] * 4 + [pa.bool_(), pa.binary(), pa.binary()]
    arrays = [pa.array(column, kind) for column, kind in zip(zip(*out), kinds, strict=True)]
    yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "cell", "hit", "scores", "counts"])


def _cell_pairs(table: pa.Table) -> pa.Table:
    """Both outcomes of a cell, and twice its pairs of a negative below a positive (ties: half)."""
    parts = [np.frombuffer(b.as_py(), np.float64) for b in table["scores"]]
    counts = np.concatenate([np.frombuffer(b.as_py(), np.int32) for b in table["counts"]]).astype(np.int64)
    hit = np.repeat(table["hit"].to_numpy(), [len(p) for p in parts])
    values, place = np.unique(np.concatenate(parts), return_inverse=True)
    # Sums of whole numbers below 2^53 are exact.
    pos, neg = (
        np.bincount(place, np.where(side, counts, 0), len(values)).astype(np.int64) for side in (hit, ~hit)
    )
    above = pos.sum() - np.cumsum(pos)
    twice = float((neg * (2 * above + pos)).sum())
    head = [table[name].slice(0, 1).combine_chunks() for name in (*KEYS, "cell")]
    sums = [pa.array([int(pos.sum())]), pa.array([int(neg.sum())]), pa.array([twice])]
    return pa.Table.from_arrays([*head, *sums], names=[*KEYS, "cell", "pos", "neg", "twice"])
