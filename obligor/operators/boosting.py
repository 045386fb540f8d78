"""Boosted trees: second-order steps over histograms, many fits in one pass.

A column is cut once, at the values of a mergeable quantile sketch; after that rows are small
integers, packed into blocks of ``BLOCK_ROWS`` that hold, column by column, the bins of all rows
in two bytes each, or of a sparse column the entries outside the bin of zero. One pass over the blocks gives every open node of every fit its
histogram of gradients and Hessians, and the driver only picks the best cut of each. All
parameter sets and all folds of a search share these passes: their number is that of the longest
fit, not the sum over the fits.

Partial histograms are summed in tasks that each own some columns of one tree. Where all of them
together are small (``DRIVER_BYTES``, checked before each pass) the driver sums them itself,
which saves a shuffle; both ways add the same numbers in the same order.

Rows carry their margins of the trees that were finished when the blocks were last written;
younger trees are evaluated in the pass. Executors keep the blocks between passes, in memory or on
their disks, which saves most of the fixed time of a pass, and renew their margins every
``REWRITE_ROUNDS`` rounds. Blocks are written again at every ``WRITTEN`` th renewal, so what a lost executor
held follows from one pass over stored blocks and fewer than ``WRITTEN`` renewals. Row sampling is a hash of the
row's key and the round: it does not depend on how rows are dealt to tasks.

Two classes grow one tree a round for the logistic loss, more classes one tree each for the
softmax loss. Margins start at the log odds of the training rows.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obligor.operators import shared_rows
from obligor.operators.packing import BLOCK_ROWS, batch_of, floats
from obligor.session import drop_scratch, reach_workers, scratch_path, unmeasured_batches

# Penalty of a leaf, least sum of Hessians of a child, least gain of a cut.
PENALTY = 1.0
LEAST_HESSIAN = 1.0
LEAST_GAIN = 1e-6
#: Bins of a column, at most.
MAX_BINS = 256
#: Values that a sketch keeps where it meets another; its rank error is 1/4096 of the rows a step.
SKETCH_VALUES = 4096
REWRITE_ROUNDS = 16
WRITTEN = 4
#: Partial histograms of one pass, all tasks together, that the driver may sum itself.
DRIVER_BYTES = 64 << 20
#: Bins of one tree that one task sums, about.
CHUNK_BINS = 8192
_SALTS = 32
_FEW = 1e-6
#: A column with more entries than this share of a block's rows is stored whole.
DENSE_SHARE = 0.25
#: Trees of up to so many cuts are looked up by the sides taken at all of them, those of up to
#: ``FEW_CUTS`` are walked cut by cut, larger ones level by level.
TABLE_CUTS = 8
FEW_CUTS = 16


# --- rows as entries ------------------------------------------------------------------


@dataclass
class Entries:
    """Non-zero values of some vectors: row, column and value of each."""

    rows: int
    row: np.ndarray
    column: np.ndarray
    value: np.ndarray


def entries_of(vectors: pa.StructArray) -> Entries:
    """Entries of vectors as Spark stores them, dense (type 1) and sparse (type 0) mixed."""
    kind = np.asarray(vectors.field("type"))
    values, indices = vectors.field("values"), vectors.field("indices")
    sizes = np.asarray(values.value_lengths().fill_null(0)).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    column = np.arange(row.size) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    column[np.repeat(kind == 0, sizes)] = np.asarray(indices.flatten())
    value = np.asarray(values.flatten(), np.float64)
    kept = np.flatnonzero(value)
    return Entries(len(sizes), row[kept], column[kept], value[kept])


def _by_column(entries: Entries) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, rows, values) for each column that has entries."""
    order = np.argsort(entries.column, kind="stable")
    columns = entries.column[order]
    starts = np.flatnonzero(np.diff(columns, prepend=-1))
    for start, end in zip(starts, np.append(starts[1:], columns.size), strict=True):
        at = order[start:end]
        yield int(columns[start]), entries.row[at], entries.value[at]


# --- cut points -----------------------------------------------------------------------


Summary = tuple[np.ndarray, np.ndarray]


def compress(values: np.ndarray, counts: np.ndarray, most: int = SKETCH_VALUES) -> Summary:
    """Distinct values in order with their counts; at most ``most`` values at even ranks."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    starts = np.flatnonzero(np.diff(values, prepend=-np.inf) != 0)
    values, counts = values[starts], np.add.reduceat(counts, starts) if starts.size else counts
    if values.size <= most:
        return values, counts
    reached = np.cumsum(counts)
    picks = np.unique(np.searchsorted(reached, reached[-1] * np.arange(1, most + 1) / most))
    picks = np.minimum(picks, values.size - 1)
    return values[picks], np.diff(reached[picks], prepend=0)


def merge(summaries: Sequence[Summary]) -> Summary:
    return compress(*(np.concatenate(part) for part in zip(*summaries, strict=True)))


class Sketch:
    """Summaries of equal weight are merged in pairs, so few steps lie behind any value."""

    def __init__(self) -> None:
        self.levels: list[Summary | None] = []

    def add(self, values: np.ndarray) -> None:
        carry = compress(values, np.ones(values.size))
        for level, held in enumerate(self.levels):
            if held is None:
                self.levels[level] = carry
                return
            carry, self.levels[level] = merge([held, carry]), None
        self.levels.append(carry)

    def summary(self) -> Summary:
        return merge([held for held in self.levels if held is not None])


def cut_points(summary: Summary, most: int = MAX_BINS) -> np.ndarray:
    """Upper ends of all bins but the last; zero, which is not stored, always is one."""
    values, counts = summary
    if values.size > most:
        values, _ = compress(values, counts, most)
    return np.unique(np.append(values, 0.0))[:-1]


_PIECES = "part int, column int, salt int, task long, numbers binary, counts binary"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: defaultdict[tuple[int, int], Sketch] = defaultdict(Sketch)
    for batch in batches:
        parts = np.asarray(batch.column("part"))
        entries = entries_of(batch.column("vector"))
        for part in np.unique(parts):
            mine = np.flatnonzero(parts[entries.row] == part)
            own = Entries(entries.rows, entries.row[mine], entries.column[mine], entries.value[mine])
            for column, _, values in _by_column(own):
                held[int(part), column].add(values)
    yield from _pieces(held)


def _pieces(held: Mapping[tuple[int, int], Sketch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    rows = [(p, c, task % _SALTS, task, *(a.astype("<f8").tobytes() for a in s.summary())) for (p, c), s in held.items()]
    return batch_of(rows, _PIECES)


def _merged(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("task")
    summary = merge([(floats(v), floats(c)) for v, c in zip(group["numbers"], group["counts"], strict=True)])
    first = group.iloc[:1].copy()
    first["numbers"], first["counts"] = [summary[0].astype("<f8").tobytes()], [summary[1].astype("<f8").tobytes()]
    return first


@dataclass
class Layout:
    """Cut points of the columns of one part, and where their bins lie in a histogram."""

    width: int
    cuts: dict[int, np.ndarray]
    offsets: np.ndarray = field(init=False)
    zeros: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        bins = np.ones(self.width, np.int64)
        self.zeros = np.zeros(self.width, np.int64)
        for column, cuts in self.cuts.items():
            bins[column] = cuts.size + 1
            self.zeros[column] = np.searchsorted(cuts, 0.0)
        self.offsets = np.concatenate([[0], np.cumsum(bins)])

    @property
    def bins(self) -> int:
        return int(self.offsets[-1])

    def chunks(self) -> list[tuple[int, int]]:
        """Ranges of columns with about ``CHUNK_BINS`` bins."""
        out, first = [], 0
        for column in range(self.width):
            if self.offsets[column + 1] - self.offsets[first] >= CHUNK_BINS or column + 1 == self.width:
                out.append((first, column + 1))
                first = column + 1
        return out


def _layouts(pieces: DataFrame, widths: Mapping[int, int]) -> dict[int, Layout]:
    for keys in (["part", "column", "salt"], ["part", "column"]):
        pieces = pieces.groupBy(*keys).applyInPandas(_merged, _PIECES)
    cuts: dict[int, dict[int, np.ndarray]] = {part: {} for part in widths}
    for row in pieces.select("part", "column", "numbers", "counts").collect():
        cuts[row["part"]][row["column"]] = cut_points((floats(row["numbers"]), floats(row["counts"])))
    return {part: Layout(width, cuts[part]) for part, width in widths.items()}


# --- blocks ---------------------------------------------------------------------------

_BLOCKS = (
    "part int, rows int, labels binary, weights binary, keys binary,"
    " dense binary, codes binary, entry_rows binary, entry_bins binary, ends binary, margins binary"
)


def _packed(layouts: Mapping[int, Layout], counts: Mapping[int, int], classes: int) -> Callable:
    """Pack rows of (part, label, weight, key, vector) into blocks with empty margins."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[int, list[pa.RecordBatch]] = defaultdict(list)
        sizes: defaultdict[int, int] = defaultdict(int)
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            for part in np.unique(parts).tolist():
                own = batch.filter(pa.array(parts == part))
                held[part].append(own)
                sizes[part] += own.num_rows
                if sizes[part] >= BLOCK_ROWS:
                    yield from batch_of([block(part, held.pop(part))], _BLOCKS)
                    sizes[part] = 0
        for part, batches_left in held.items():
            yield from batch_of([block(part, batches_left)], _BLOCKS)

    def block(part: int, batches: list[pa.RecordBatch]) -> tuple:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = {n: table.column(n).chunk(0) for n in ("label", "weight", "key", "vector")}
        plain = (np.asarray(column[n]) for n in ("label", "weight", "key"))
        return _block_row(part, layouts[part], *plain, _by_column(entries_of(column["vector"])), counts[part] * classes)

    return pack


def _block_row(
    part: int,
    layout: Layout,
    labels: np.ndarray,
    weights: np.ndarray,
    keys: np.ndarray,
    columns: Iterator[tuple[int, np.ndarray, np.ndarray]],
    margins: int,
) -> tuple:
    """A block of rows whose entries are given column by column, with ``margins`` empty ones a row."""
    size = labels.size
    rows, bins, dense, codes = [], [], [], []
    ends = np.zeros(layout.width, np.int64)
    for at, own, values in columns:
        placed = np.searchsorted(layout.cuts.get(at, np.empty(0)), values)
        other = np.flatnonzero(placed != layout.zeros[at])
        if other.size > DENSE_SHARE * size:
            whole = np.full(size, layout.zeros[at], np.uint16)
            whole[own] = placed
            dense.append(at)
            codes.append(whole)
            continue
        rows.append(own[other])
        bins.append(placed[other] + layout.offsets[at])
        ends[at] = other.size
    joined = [np.concatenate(a) if a else np.empty(0) for a in (rows, bins)]
    return (
        part,
        size,
        labels.astype("<i4").tobytes(),
        weights.astype("<f8").tobytes(),
        keys.astype("<i8").tobytes(),
        np.array(dense, "<i4").tobytes(),
        np.concatenate([*codes, np.empty(0, np.uint16)]).astype("<u2").tobytes(),
        *(a.astype("<i4").tobytes() for a in joined),
        np.cumsum(ends).astype("<i8").tobytes(),
        np.zeros(margins * size).astype("<f8").tobytes(),
    )


# --- blocks of rows that all parts share ------------------------------------------------


def _lines(matrix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(column, rows, values) of the entries of each line but the last."""
    for at, values in enumerate(matrix[:-1]):
        own = np.flatnonzero(values)
        if own.size:
            yield at, own, values[own]


def _seen(
    block: shared_rows.Block, views: Sequence[shared_rows.View], without: Sequence[int | None]
) -> Iterator[tuple[int, np.ndarray]]:
    for part, view in enumerate(views):
        if without[part] != block.part:
            yield part, view.matrix(block.numbers, block.codes, block.rows)


def _sketched_shared(views: Sequence[shared_rows.View], without: Sequence[int | None]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[tuple[int, int], Sketch] = defaultdict(Sketch)
        for block in shared_rows.blocks_in(batches):
            for part, matrix in _seen(block, views, without):
                for column, _, values in _lines(matrix):
                    held[part, column].add(values)
        yield from _pieces(held)

    return run


def _packed_shared(
    views: Sequence[shared_rows.View], without: Sequence[int | None], layouts: Mapping[int, Layout], margins: int
) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: defaultdict[int, list[tuple[np.ndarray, ...]]] = defaultdict(list)

        def block(part: int) -> Iterator[pa.RecordBatch]:
            labels, keys, matrix = (np.concatenate(a, axis=-1) for a in zip(*held.pop(part), strict=True))
            row = _block_row(part, layouts[part], labels, np.ones(labels.size), keys, _lines(matrix), margins)
            return batch_of([row], _BLOCKS)

        for rows in shared_rows.blocks_in(batches):
            for part, matrix in _seen(rows, views, without):
                held[part].append((rows.labels, rows.keys, matrix))
                if sum(labels.size for labels, *_ in held[part]) >= BLOCK_ROWS:
                    yield from block(part)
        for part in list(held):
            yield from block(part)

    return pack


class Block:
    """One packed block, with whole columns made when a tree asks for them."""

    def __init__(self, row: Mapping[str, Any], layout: Layout, classes: int):
        self.part, self.rows, self.layout = row["part"], row["rows"], layout
        self.labels = np.frombuffer(row["labels"], "<i4")
        self.weights = floats(row["weights"])
        self.keys = np.frombuffer(row["keys"], "<u8")
        codes = np.frombuffer(row["codes"], "<u2").reshape(-1, self.rows)
        self.dense = dict(zip(np.frombuffer(row["dense"], "<i4").tolist(), codes, strict=True))
        self.entry_rows = np.frombuffer(row["entry_rows"], "<i4")
        self.entry_bins = np.frombuffer(row["entry_bins"], "<i4")
        self.ends = np.frombuffer(row["ends"], "<i8")
        self.margins = floats(row["margins"]).reshape(-1, classes, self.rows)
        self._columns: dict[int, np.ndarray] = {}

    def column(self, at: int) -> np.ndarray:
        if at in self.dense:
            return self.dense[at]
        if at not in self._columns:
            out = np.full(self.rows, self.layout.zeros[at], np.int32)
            own = slice(self.ends[at - 1] if at else 0, self.ends[at])
            out[self.entry_rows[own]] = self.entry_bins[own] - self.layout.offsets[at]
            self._columns[at] = out
        return self._columns[at]

    def nodes(self, tree: Tree) -> np.ndarray:
        return tree.place(self.column, tree.cut, self.rows)

    def histogram(self, slot: np.ndarray, count: int, numbers: Sequence[np.ndarray], allowed: np.ndarray) -> np.ndarray:
        """Sums of each of ``numbers`` per slot below ``count`` and bin, those of zero left out; totals last.

        Whole columns that are not ``allowed`` are left out too.
        """
        bins = self.layout.bins
        sums = np.empty((len(numbers), count, bins + 1))
        at = slot[self.entry_rows] * bins + self.entry_bins
        for q, values in enumerate(numbers):
            each = np.bincount(at, values[self.entry_rows], (count + 1) * bins)
            sums[q, :, :-1] = each.reshape(-1, bins)[:-1]
            sums[q, :, -1] = np.bincount(slot, values, count + 1)[:-1]
        inside = np.flatnonzero(slot < count)
        if inside.size < slot.size:
            slot, numbers = slot[inside], [values[inside] for values in numbers]
        for column, codes in self.dense.items():
            if not allowed[column]:
                continue
            first, end = self.layout.offsets[column : column + 2]
            at = slot * (end - first) + (codes[inside] if inside.size < self.rows else codes)
            for q, values in enumerate(numbers):
                sums[q, :, first:end] = np.bincount(at, values, count * (end - first)).reshape(count, -1)
            sums[:, :, first + self.layout.zeros[column]] = 0.0
        return sums


@dataclass
class Stored:
    """Blocks as they were last written, and their rows as executors keep them between passes."""

    path: str
    table: DataFrame
    kept: RDD
    splits: int
    renewed: int = 0

    @staticmethod
    def at(spark: SparkSession, path: str) -> Stored:
        table = spark.read.schema(_BLOCKS).parquet(path)
        kept = table.rdd.map(lambda row: row.asDict()).persist(StorageLevel.MEMORY_AND_DISK)
        return Stored(path, table, kept, kept.getNumPartitions())

    def renew(self, renewal: Callable[[Iterator[dict]], Iterator[dict]]) -> None:
        """Keep other rows in place of those kept so far."""
        kept, old = self.kept.mapPartitions(renewal).persist(StorageLevel.MEMORY_AND_DISK), self.kept
        kept.count()
        old.unpersist()
        self.kept, self.renewed = kept, self.renewed + 1

    def written(self, spark: SparkSession) -> Stored:
        """The rows kept, stored as blocks of their own, in place of these."""
        path = scratch_path(spark, "blocks")
        names = self.table.columns
        rows = self.kept.map(lambda row: tuple(row[n] for n in names))
        spark.createDataFrame(rows, self.table.schema, verifySchema=False).write.parquet(path)
        self.drop(spark)
        return Stored.at(spark, path)

    def drop(self, spark: SparkSession) -> None:
        self.kept.unpersist()
        drop_scratch(spark, self.path)


# --- trees ----------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes in the order they were made; a leaf is its own left child and lets nothing go right."""

    column: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [np.inf])
    threshold: list[float] = field(default_factory=lambda: [np.inf])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def split(self, node: int, column: int, cut: int, threshold: float, values: tuple[float, float]) -> list[int]:
        first = len(self.left)
        self.column[node], self.cut[node], self.threshold[node], self.left[node] = column, cut, threshold, first
        for child, value in zip((first, first + 1), values, strict=True):
            self.column.append(0)
            self.cut.append(np.inf)
            self.threshold.append(np.inf)
            self.left.append(child)
            self.value.append(value)
        return [first, first + 1]

    def place(self, column_of: Callable[[int], np.ndarray], limits: Sequence[float], rows: int) -> np.ndarray:
        """Node that each row ends in; it goes right where its column is above the limit."""
        node = np.zeros(rows, np.int64)
        left = np.array(self.left)
        inner = left != np.arange(left.size)
        if not inner.any():
            return node
        split = np.flatnonzero(inner).tolist()
        if len(split) <= min(TABLE_CUTS, FEW_CUTS):
            sides = np.zeros(rows, np.uint8)
            for bit, i in enumerate(split):
                sides += (column_of(self.column[i]) > limits[i]).view(np.uint8) * np.uint8(1 << bit)
            return self._ends(split)[sides.astype(np.intp)]
        if len(split) <= FEW_CUTS:
            small, first, level = np.zeros(rows, np.int8), left.astype(np.int8), [0]
            for _ in range(self.depth):
                cuts = [i for i in level if inner[i]]
                right = np.zeros(rows, bool)
                for i in cuts:
                    right |= (small == i) & (column_of(self.column[i]) > limits[i])
                small = first[small] + right
                level = [child for i in cuts for child in (self.left[i], self.left[i] + 1)]
            return small
        used, slot = np.unique(np.array(self.column)[inner], return_inverse=True)
        place = np.zeros(left.size, np.int64)
        place[inner] = slot
        columns = np.stack([column_of(int(c)) for c in used])
        limit, each = np.array(limits), np.arange(rows)
        for _ in range(self.depth):
            node = left[node] + (columns[place[node], each] > limit[node])
        return node

    def _ends(self, split: Sequence[int]) -> np.ndarray:
        """Node of each choice of sides: bit ``b`` is set where a row goes right at node ``split[b]``."""
        sides, left = np.arange(1 << len(split)), np.array(self.left)
        bit, inner = np.zeros((2, left.size), np.int64)
        bit[split], inner[split] = np.arange(len(split)), 1
        node = np.zeros(sides.size, np.int64)
        for _ in range(self.depth):
            node = left[node] + (sides >> bit[node] & inner[node])
        return node

    def values(self) -> np.ndarray:
        return np.array(self.value)

    def facts(self) -> list:
        """Columns, thresholds, left children and values, for a saved model."""
        held = [None if np.isinf(t) else t for t in self.threshold]
        return [self.column, held, self.left, self.value, self.depth]

    @staticmethod
    def of(facts: list) -> Tree:
        columns, thresholds, left, value, depth = facts
        held = [np.inf if t is None else t for t in thresholds]
        return Tree(columns, held, held, left, value, depth)


def chances(margins: np.ndarray) -> np.ndarray:
    """Probabilities of all classes; one row of margins stands for class 1 of two."""
    if len(margins) == 1:
        odds = 1 / (1 + np.exp(-np.clip(margins[0], -500, 500)))
        return np.stack([1 - odds, odds])
    odds = np.exp(margins - margins.max(axis=0))
    return odds / odds.sum(axis=0)


def slopes(margins: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by each margin."""
    chance = chances(margins)
    if len(margins) == 1:
        p = chance[1:]
        return (p - (labels == 1)) * weights, p * (1 - p) * weights
    hit = labels == np.arange(len(margins))[:, None]
    return (chance - hit) * weights, 2 * chance * (1 - chance) * weights


def sampled(keys: np.ndarray, share: float, seed: int, turn: int) -> np.ndarray:
    """Rows of a round, by a hash of the key."""
    if share >= 1:
        return np.ones(keys.size, bool)
    mixed = keys ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xD1342543DE82EF95) % (1 << 64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return (mixed ^ (mixed >> np.uint64(33))) < np.uint64(int(share * (1 << 64)))


def drawn_columns(width: int, share: float, seed: int, turn: int, own: int) -> np.ndarray:
    """Columns that a tree may use."""
    out = np.zeros(width, bool)
    rng = np.random.default_rng([seed, turn, own])
    out[rng.permutation(width)[: max(1, int(share * width))]] = True
    return out


# --- one pass -------------------------------------------------------------------------


@dataclass
class Task:
    """What one fit asks of a pass: histograms of its open nodes, one list per class."""

    part: int
    at: int
    turn: int
    share: float
    start: np.ndarray
    young: list[list[Tree]]
    growing: list[Tree]
    open: list[list[int]]

    def margins(self, block: Block) -> np.ndarray:
        out = block.margins[self.at] + self.start[:, None]
        for trees in self.young:
            for k, tree in enumerate(trees):
                out[k] += tree.values()[block.nodes(tree)]
        return out


_SUMS = "part int, at int, own int, chunk int, task long, sums binary"


def _summed(
    tasks: Sequence[Task], columns: Mapping[tuple[int, int, int], np.ndarray], layouts: Mapping[int, Layout], classes: int, seed: int
) -> Callable:
    """Histograms of a task's blocks: (gradient, Hessian) x open node x bin, totals last."""

    def run(rows: Iterator[dict]) -> Iterator[tuple]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for row in rows:
            block = Block(row, layouts[row["part"]], classes)
            for task in (t for t in tasks if t.part == block.part):
                gradient, hessian = slopes(task.margins(block), block.labels, block.weights)
                kept = sampled(block.keys, task.share, seed, task.turn)
                for own, (tree, nodes) in enumerate(zip(task.growing, task.open, strict=True)):
                    if not nodes:
                        continue
                    slot = np.full(len(tree.left), len(nodes))
                    slot[nodes] = np.arange(len(nodes))
                    slot = np.where(kept, slot[block.nodes(tree)], len(nodes))
                    key = (task.part, task.at, own)
                    sums = block.histogram(slot, len(nodes), (gradient[own], hessian[own]), columns[key])
                    held[key] = held[key] + sums if key in held else sums
        me = TaskContext.get().partitionId()
        for (part, at, own), sums in held.items():
            layout = layouts[part]
            for chunk, (first, last) in enumerate(layout.chunks()):
                some = sums[:, :, layout.offsets[first] : layout.offsets[last]]
                data = np.concatenate([some, sums[:, :, -1:]], axis=2)
                yield part, at, own, chunk, me, data.astype("<f8").tobytes()

    return run


#: Per node: gain, column, cut, gradient and Hessian left, gradient and Hessian of the node.
_CUT = 7


def best_cuts(sums: np.ndarray, layout: Layout, first: int, last: int, allowed: np.ndarray) -> np.ndarray:
    """Best cut of each node among columns ``first`` to ``last``; gain -1 where there is none.

    ``sums`` is (2, nodes, bins of these columns + 1), without the bins of zero, totals last.
    """
    offsets = layout.offsets[first : last + 1] - layout.offsets[first]
    starts, bins = offsets[:-1], int(offsets[-1])
    totals, held = sums[:, :, -1], sums[:, :, :-1].copy()
    zero = starts + layout.zeros[first:last]
    held[:, :, zero] = totals[:, :, None] - np.add.reduceat(held, starts, axis=2)
    run = np.cumsum(held, axis=2)
    before = np.concatenate([np.zeros((*run.shape[:2], 1)), run], axis=2)[:, :, starts]
    column = np.repeat(np.arange(first, last), np.diff(offsets))
    g, h = run - before[:, :, column - first]
    all_g, all_h = totals[0][:, None], totals[1][:, None]
    gain = g * g / (h + PENALTY) + (all_g - g) ** 2 / (all_h - h + PENALTY) - all_g**2 / (all_h + PENALTY)
    fits = (h >= LEAST_HESSIAN) & (all_h - h >= LEAST_HESSIAN) & allowed[column]
    fits[:, offsets[1:] - 1] = False  # above the last cut of a column there is nothing
    gain = np.where(fits & (gain > LEAST_GAIN), gain, -1.0)
    best = gain.argmax(axis=1) if bins else np.zeros(len(totals[0]), int)
    at = (np.arange(len(best)), best)
    return np.stack(
        [gain[at], column[best], best - starts[column[best] - first], g[at], h[at], totals[0], totals[1]], axis=1
    )


_CUTS = "part int, at int, own int, chunk int, cuts binary"


class Pass:
    """All tasks of one pass over the blocks, and how their histograms are summed."""

    def __init__(self, tasks: list[Task], fits: Mapping[tuple[int, int], Fit], layouts: Mapping[int, Layout], classes: int, seed: int):
        self.tasks, self.layouts, self.classes, self.seed = tasks, layouts, classes, seed
        self.columns = {
            (t.part, t.at, own): fits[t.part, t.at].columns(own)
            for t in tasks
            for own, nodes in enumerate(t.open)
            if nodes
        }

    def bytes(self) -> int:
        return sum(16 * len(nodes) * self.layouts[t.part].bins for t in self.tasks for nodes in t.open)

    def cuts(self, blocks: Stored) -> dict[tuple[int, int, int], np.ndarray]:
        """Best cut of every open node, by (part, set, class)."""
        summed = _summed(self.tasks, self.columns, self.layouts, self.classes, self.seed)
        keys = ["part", "at", "own", "chunk"]
        if self.bytes() * blocks.splits <= DRIVER_BYTES:
            held = defaultdict(list)
            for *key, task, sums in blocks.kept.mapPartitions(summed).collect():
                held[tuple(key)].append((task, sums))
            found = [(*key, self.choose(key, [s for _, s in sorted(rows)])) for key, rows in held.items()]
        else:
            def chosen(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
                data = self.choose(key, list(group.sort_values("task")["sums"])).tobytes()
                return pd.DataFrame([(*key, data)], columns=[*keys, "cuts"])

            spark = blocks.table.sparkSession
            sums = spark.createDataFrame(blocks.kept.mapPartitions(summed), _SUMS, verifySchema=False)
            cuts = sums.groupBy(*keys).applyInPandas(chosen, _CUTS)
            found = [(*(row[k] for k in keys), floats(row["cuts"]).reshape(-1, _CUT)) for row in cuts.collect()]
        out: dict[tuple[int, int, int], np.ndarray] = {}
        for part, at, own, _, cuts in sorted(found, key=lambda row: row[:4]):
            known = out.setdefault((part, at, own), cuts)
            better = cuts[:, 0] > known[:, 0]
            out[part, at, own] = np.where(better[:, None], cuts, known)
        return out

    def choose(self, key: tuple[int, int, int, int], pieces: list[bytes]) -> np.ndarray:
        part, at, own, chunk = (int(k) for k in key)
        layout = self.layouts[part]
        first, last = layout.chunks()[chunk]
        size = layout.offsets[last] - layout.offsets[first] + 1
        total = np.zeros(len(pieces[0]) // 8)
        for piece in pieces:
            total = total + floats(piece)
        return best_cuts(total.reshape(2, -1, size), layout, first, last, self.columns[part, at, own])


# --- fits -----------------------------------------------------------------------------


@dataclass
class Fit:
    """One parameter set on one part, grown a level at a time."""

    part: int
    at: int
    params: Mapping[str, Any]
    layout: Layout
    start: np.ndarray
    seed: int
    rounds: list[list[Tree]] = field(default_factory=list)
    stored: int = 0
    growing: list[Tree] = field(default_factory=list)
    open: list[list[int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._begin()

    def _begin(self) -> None:
        self.growing = [Tree() for _ in self.start]
        self.open = [[0] for _ in self.start]

    @property
    def done(self) -> bool:
        return len(self.rounds) >= self.params["n_estimators"]

    def columns(self, own: int) -> np.ndarray:
        return drawn_columns(self.layout.width, self.params["colsample"], self.seed, len(self.rounds), own)

    def task(self) -> Task:
        young = self.rounds[self.stored :]
        share = self.params["subsample"]
        return Task(self.part, self.at, len(self.rounds), share, self.start, young, self.growing, self.open)

    def grow(self, cuts: Mapping[int, np.ndarray]) -> None:
        """Take the best cuts of the open nodes; the tree is finished at its depth."""
        rate = self.params["learning_rate"]

        def leaf(g: float, h: float) -> float:
            return float(-rate * g / (h + PENALTY))

        for own, tree in enumerate(self.growing):
            opened = []
            for node, (gain, column, cut, g, h, all_g, all_h) in zip(self.open[own], cuts.get(own, ()), strict=False):
                if node == 0:
                    tree.value[0] = leaf(all_g, all_h)
                if gain > 0:
                    threshold = self.layout.cuts[int(column)][int(cut)]
                    values = leaf(g, h), leaf(all_g - g, all_h - h)
                    opened += tree.split(node, int(column), int(cut), float(threshold), values)
            if opened:
                tree.depth += 1
            self.open[own] = opened if tree.depth < self.params["max_depth"] else []
        if not any(self.open):
            self.rounds.append(self.growing)
            self._begin()


@dataclass
class Boosted:
    """A fitted model: where margins start, and the trees of each round."""

    start: list[float]
    rounds: list[list[Tree]]

    def to_json(self) -> str:
        return json.dumps({"start": self.start, "rounds": [[t.facts() for t in trees] for trees in self.rounds]})

    @staticmethod
    def from_json(text: str) -> Boosted:
        held = json.loads(text)
        return Boosted(held["start"], [[Tree.of(f) for f in trees] for trees in held["rounds"]])

    def chances(self, entries: Entries) -> np.ndarray:
        """Probability of each class (rows) for each vector (columns)."""
        inner = {c for trees in self.rounds for t in trees for c, left, i in zip(t.column, t.left, range(len(t.left)), strict=True) if left != i}
        used = np.array(sorted(inner), np.int64)
        at = np.searchsorted(used, entries.column)
        known = np.flatnonzero(np.append(used, -1)[at] == entries.column)
        columns = np.zeros((used.size, entries.rows))
        columns[at[known], entries.row[known]] = entries.value[known]
        place = {int(c): i for i, c in enumerate(used)}
        margins = np.repeat(np.array(self.start)[:, None], entries.rows, axis=1)
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                nodes = tree.place(lambda c: columns[place[c]], tree.threshold, entries.rows)
                margins[k] += tree.values()[nodes]
        return chances(margins)


def boost(
    parts: Sequence[DataFrame],
    params: Sequence[Mapping[str, Any]],
    num_classes: int,
    key: Column,
    label: str,
    features: str = "features",
    seed: int = 42,
) -> dict[tuple[int, int], Boosted]:
    """Fit every parameter set on every part; models by (part, set).

    Parts have integer labels 0 to ``num_classes`` - 1, an optional ``weight`` and a vector;
    ``key`` tells rows apart. Parameters are n_estimators, max_depth, learning_rate,
    subsample and colsample. A part without rows is refused.
    """
    spark = parts[0].sparkSession
    reach_workers(spark)
    classes = num_classes if num_classes > 2 else 1
    rows = None
    for at, part in enumerate(parts):
        weight = F.col("weight").cast("double") if "weight" in part.columns else F.lit(1.0)
        own = part.select(
            F.lit(at).alias("part"),
            F.col(label).cast("int").alias("label"),
            weight.alias("weight"),
            F.xxhash64(key).alias("key"),
            F.unwrap_udt(features).alias("vector"),
        )
        rows = own if rows is None else rows.unionByName(own)
    facts = rows.groupBy("part", "label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("weight").alias("weight"),
        F.max(F.coalesce("vector.size", F.size("vector.values"))).alias("width"),
    ).collect()
    widths = {r["part"]: r["width"] for r in facts}
    if len(widths) < len(parts):
        raise ValueError("Boosting needs rows in every part.")
    path = scratch_path(spark, "blocks")
    # Small inputs are not dealt thinner than half a block: a pass costs a fixed time per task.
    tasks = max(1, 2 * sum(r["rows"] for r in facts) // BLOCK_ROWS)
    with unmeasured_batches(spark):
        layouts = _layouts(rows.select("part", "vector").mapInArrow(_sketched, _PIECES), widths)
        packed = rows.coalesce(tasks).mapInArrow(_packed(layouts, {p: len(params) for p in widths}, classes), _BLOCKS)
        packed.write.parquet(path)
    weights = {part: {r["label"]: r["weight"] for r in facts if r["part"] == part} for part in layouts}
    return _boosted(spark, path, layouts, weights, params, num_classes, seed)


def boost_shared(
    store: shared_rows.SharedRows,
    keys: Sequence[int | None],
    counts: Sequence[Mapping[int, int]],
    params: Sequence[Mapping[str, Any]],
    num_classes: int,
    scaled: bool,
    seed: int = 42,
) -> dict[tuple[int, int], Boosted]:
    """``boost`` for the encoders ``keys`` of rows that are stored once; ``counts`` are the rows of each class."""
    blocks = store.blocks()
    spark = blocks.sparkSession
    if any(not sum(c.values()) for c in counts):
        raise ValueError("Boosting needs rows in every part.")
    views = [store.view(key, scaled) for key in keys]
    without = [key if store.part else None for key in keys]
    path = scratch_path(spark, "blocks")
    tasks = max(1, 2 * sum(n for c in counts for n in c.values()) // BLOCK_ROWS)
    pieces = blocks.mapInArrow(_sketched_shared(views, without), _PIECES)
    layouts = _layouts(pieces, {part: view.width for part, view in enumerate(views)})
    margins = len(params) * (num_classes if num_classes > 2 else 1)
    blocks.coalesce(tasks).mapInArrow(_packed_shared(views, without, layouts, margins), _BLOCKS).write.parquet(path)
    return _boosted(spark, path, layouts, dict(enumerate(counts)), params, num_classes, seed)


def _boosted(
    spark: SparkSession,
    path: str,
    layouts: Mapping[int, Layout],
    weights: Mapping[int, Mapping[int, float]],
    params: Sequence[Mapping[str, Any]],
    num_classes: int,
    seed: int,
) -> dict[tuple[int, int], Boosted]:
    """The models of blocks that lie at ``path``; ``weights`` are those of each class of a part."""
    classes = num_classes if num_classes > 2 else 1

    def start_of(part: int) -> np.ndarray:
        total = sum(weights[part].values())
        held = np.zeros(num_classes)
        for label, weight in weights[part].items():
            held[label] = weight / total
        held = np.clip(held, _FEW, 1 - _FEW)
        return np.log(held) if classes > 1 else np.log(held[1:] / held[:1])

    fits = {
        (p, at): Fit(p, at, own, layouts[p], start_of(p), seed)
        for p in layouts
        for at, own in enumerate(params)
    }
    _grow_all(spark, path, fits, layouts, classes, seed)
    return {at: Boosted(fit.start.tolist(), fit.rounds) for at, fit in fits.items()}


def _grow_all(
    spark: SparkSession, path: str, fits: Mapping[tuple[int, int], Fit], layouts: Mapping[int, Layout], classes: int, seed: int
) -> None:
    """Pass after pass until all fits have their rounds."""
    blocks = Stored.at(spark, path)
    while live := [fit for fit in fits.values() if not fit.done]:
        cuts = Pass([f.task() for f in live], fits, layouts, classes, seed).cuts(blocks)
        for fit in live:
            fit.grow({own: cuts[fit.part, fit.at, own] for own in range(classes) if (fit.part, fit.at, own) in cuts})
        if any(len(f.rounds) - f.stored >= REWRITE_ROUNDS and not f.done for f in live):
            blocks.renew(_renewal(list(fits.values()), layouts, classes))
            if blocks.renewed == WRITTEN:
                blocks = blocks.written(spark)
    blocks.drop(spark)


def _renewal(fits: Sequence[Fit], layouts: Mapping[int, Layout], classes: int) -> Callable:
    """Blocks with the margins of all finished rounds."""
    tasks = [fit.task() for fit in fits]

    def run(rows: Iterator[dict]) -> Iterator[dict]:
        for row in rows:
            block = Block(row, layouts[row["part"]], classes)
            margins = block.margins.copy()
            for task in tasks:
                if task.part == block.part:
                    margins[task.at] = task.margins(block) - task.start[:, None]
            yield {**row, "margins": margins.astype("<f8").tobytes()}

    for fit in fits:
        fit.stored = len(fit.rounds)
    return run


class BoostedTreesModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Add the vector ``probability`` by a fitted ``Boosted``, which is kept as JSON."""

    model = Param(Params._dummy(), "model", "trees as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str = "", featuresCol: str = "features") -> None:
        super().__init__()
        self._setDefault(model="", featuresCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        reach_workers(dataset.sparkSession)
        boosted = Boosted.from_json(self.getOrDefault(self.model))

        @F.arrow_udf(T.ArrayType(T.DoubleType()))
        def probabilities(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                chance = boosted.chances(entries_of(column))
                ends = np.arange(chance.shape[1] + 1) * len(chance)
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(chance.T.ravel()))

        vector = F.unwrap_udt(self.getOrDefault(self.featuresCol))
        return dataset.withColumn("probability", array_to_vector(probabilities(vector)))
