"""Training rows stored once, as they are, and encoded for each fit where they are read.

The encoders of all folds differ in a few numbers: what fills a gap, where a column is clipped,
how it is scaled, and which categories are known. So a block holds plain numbers (NaN where one is
missing) and codes of one list per column, and a ``View`` makes the matrix that ``encode`` and
``vector_stages`` give for one encoder. No fold needs encoded rows of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from threading import Lock
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obligor.functions.numeric import known
from obligor.operators.packing import BLOCK_ROWS, batch_of, floats
from obligor.operators.encoding import EncoderState, category_text
from obligor.session import col, drop_scratch, reach_workers, scratch_path, unmeasured_batches

#: Codes of a value that no list has and of a missing one; that of value ``i`` is ``i + LISTED``.
UNKNOWN, MISSING, LISTED = 0, 1, 2
#: Blocks are dealt over so many lots; one of them is enough to begin a search near its end.
LOTS = 16

_BLOCKS = "part int, lot int, rows int, labels binary, keys binary, numbers binary, codes binary"


@dataclass(frozen=True)
class Coded:
    """A column of codes: the values that any encoder lists, compared as numbers or as text."""

    name: str
    number: bool
    values: tuple

    def positions(self, order: Sequence[str], mode: str | None, absent: float) -> np.ndarray:
        """Position in ``order`` by code; a missing value counts as the mode."""
        read = float if self.number else str
        place: dict[Any, int] = {}
        for at, value in enumerate(order):
            place.setdefault(read(value), at)
        found = [place.get(value, absent) for value in self.values]
        return np.array([absent, absent if mode is None else place.get(read(mode), absent), *found], np.float64)


@dataclass
class View:
    """How one encoder sees plain rows; lines of the matrix follow the slots of its vectors, ones come last."""

    numeric: list[tuple[int, float, list[float] | None, list[float] | None]]
    ordered: list[tuple[int, np.ndarray]]
    hot: list[tuple[int, np.ndarray, int]]

    @property
    def width(self) -> int:
        return len(self.numeric) + len(self.ordered) + sum(size for *_, size in self.hot)

    def matrix(self, numbers: np.ndarray, codes: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((self.width + 1, rows))
        out[-1] = 1.0
        for line, (at, fill, clip, scale) in enumerate(self.numeric):
            value = np.where(np.isnan(numbers[at]), fill, numbers[at])
            if clip:
                value = np.minimum(np.maximum(value, clip[0]), clip[1])
            out[line] = (value - scale[0]) / scale[1] if scale else value
        line = len(self.numeric)
        for at, places in self.ordered:
            out[line] = places[codes[at]]
            line += 1
        for at, places, size in self.hot:
            slot = places[codes[at]].astype(np.int64)
            inside = np.flatnonzero(slot < size)
            out[line + slot[inside], inside] = 1.0
            line += size
        return out


@dataclass
class Block:
    part: int
    rows: int
    labels: np.ndarray
    keys: np.ndarray
    numbers: np.ndarray
    codes: np.ndarray

    @staticmethod
    def of(row: Mapping[str, Any]) -> Block:
        rows = row["rows"]
        numbers = floats(row["numbers"]).reshape(-1, rows)
        codes = np.frombuffer(row["codes"], "<i4").reshape(-1, rows)
        return Block(row["part"], rows, np.frombuffer(row["labels"], "<i4"), np.frombuffer(row["keys"], "<i8"), numbers, codes)


def blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for at in range(batch.num_rows):  # one at a time: a batch may hold many blocks
            yield Block.of(batch.slice(at, 1).to_pylist()[0])


def _packed(numeric: Sequence[str], coded: Sequence[Coded]) -> Callable:
    """Pack rows of (part, label, key, n0.., c0..) into blocks of one part each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = TaskContext.get().partitionId()
        lists = [None if c.number else pa.array(c.values, pa.string()) for c in coded]
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            for part in np.unique(parts).tolist():
                own = batch if (parts == part).all() else batch.filter(pa.array(parts == part))
                numbers = [_numbers(own.column(f"n{i}")) for i in range(len(numeric))]
                codes = [_codes(own.column(f"c{i}"), c, lists[i]) for i, c in enumerate(coded)]
                row = (
                    part,
                    lot % LOTS,
                    own.num_rows,
                    np.asarray(own.column("label")).astype("<i4").tobytes(),
                    np.asarray(own.column("key")).astype("<i8").tobytes(),
                    b"".join(a.astype("<f8").tobytes() for a in numbers),
                    b"".join(a.astype("<i4").tobytes() for a in codes),
                )
                lot += 1
                yield from batch_of([row], _BLOCKS)

    return pack


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _codes(column: pa.Array, coded: Coded, listed: pa.Array | None) -> np.ndarray:
    if listed is not None:
        at = pc.index_in(column, listed).fill_null(-1).to_numpy(zero_copy_only=False)
        return np.where(column.is_null().to_numpy(zero_copy_only=False), MISSING, np.where(at < 0, UNKNOWN, at + LISTED))
    value, values = _numbers(column), np.array(coded.values, np.float64)
    at = np.minimum(np.searchsorted(values, value), max(values.size - 1, 0))
    hit = values[at] == value if values.size else np.zeros(value.size, bool)
    return np.where(np.isnan(value), MISSING, np.where(hit, at + LISTED, UNKNOWN))


@dataclass
class SharedRows:
    """The rows of all ``states``: each encoder's are those whose ``part`` is not its key.

    Without a ``part`` column all rows belong to every encoder.
    """

    rows: DataFrame
    states: dict[int | None, EncoderState]
    label: str
    id_col: str
    part: str | None = None
    count: int = 0
    path: str | None = None
    lock: Lock = field(default_factory=Lock)

    def widest(self) -> int | None:
        """Columns of the widest matrix; None where an encoder needs a join or leaves gaps."""
        widths = []
        for s in self.states.values():
            if s.hot or any(s.modes.get(c) is None for c in (*s.boolean, *s.ordinal)):
                return None
            widths.append(len(s.numeric) + len(s.boolean) + len(s.ordinal) + sum(s.sizes[c] for c in s.categorical))
        return max(widths)

    def numeric(self) -> list[str]:
        return list(dict.fromkeys(c for s in self.states.values() for c in s.numeric))

    def coded(self) -> list[Coded]:
        some = next(iter(self.states.values()))
        out = []
        for kind, names in (("ordered", (*some.boolean, *some.ordinal)), ("hot", some.categorical)):
            for name in names:
                number = kind == "ordered" and isinstance(self.rows.schema[name].dataType, T.NumericType)
                read = float if number else str
                lists = [v for s in self.states.values() for v in (*s.values.get(name, ()), *s.orders.get(name, ()))]
                out.append(Coded(name, number, tuple(sorted({read(v) for v in lists}))))
        return out

    def view(self, key: int | None, scaled: bool) -> View:
        state = self.states[key]
        place = {c: i for i, c in enumerate(self.numeric())}
        coded = self.coded()
        numeric = [
            (place[c], state.fills[c], state.clips.get(c), state.scales[c] if scaled else None) for c in state.numeric
        ]
        orders = [*[(c, state.values[c]) for c in state.boolean], *[(c, state.orders[c]) for c in state.ordinal]]
        ordered = [(i, coded[i].positions(order, state.modes[c], -1.0)) for i, (c, order) in enumerate(orders)]
        hot = []
        for i, c in enumerate(state.categorical, start=len(orders)):
            size = len(state.values[c])
            hot.append((i, coded[i].positions(state.values[c], state.modes.get(c), float(size)), size))
        return View(numeric, ordered, hot)

    def blocks(self) -> DataFrame:
        """The rows as blocks, written when first asked for."""
        spark = self.rows.sparkSession
        with self.lock:
            if self.path is None:
                reach_workers(spark)
                numeric, coded = self.numeric(), self.coded()
                part = col(self.part).cast("int") if self.part else F.lit(0)
                plain = self.rows.select(
                    part.alias("part"),
                    col(self.label).cast("int").alias("label"),
                    F.xxhash64(col(self.id_col)).alias("key"),
                    *[known(col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(numeric)],
                    *[self._value(c).alias(f"c{i}") for i, c in enumerate(coded)],
                )
                tasks = max(1, 2 * self.count // BLOCK_ROWS)
                path = scratch_path(spark, "rows")
                with unmeasured_batches(spark):
                    plain.coalesce(tasks).mapInArrow(_packed(numeric, coded), _BLOCKS).write.parquet(path)
                self.path = path
        return spark.read.schema(_BLOCKS).parquet(self.path)

    def _value(self, coded: Coded):
        return known(col(coded.name).cast("double")) if coded.number else category_text(self.rows, coded.name)

    def drop(self) -> None:
        with self.lock:
            if self.path is not None:
                drop_scratch(self.rows.sparkSession, self.path)
                self.path = None
