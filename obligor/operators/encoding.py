"""Imputation, clipping, scaling and category codes fitted on training rows.

Statistics are gathered by a few distributed passes and then applied as literals, so
transforming is a projection. Categories are looked up in a hash map that the fitted state
carries while all lists together have at most ``MAX_CATEGORIES`` values. The longest lists
beyond that stay in a table of codes which is joined: their frequent values are still
looked up in place, so no value makes a hot key.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obligor.functions.numeric import is_floating, known
from obligor.operators.profile import CHUNK, SchemaProfile
from obligor.operators.running import dense_index
from obligor.operators.selection import column_quantiles, fold_quantiles
from obligor.session import col, keep_compiled, pin, reach_workers, scratch_path, small_table, unmeasured_batches

# Clipping quantiles and the skew from which a column is clipped.
CLIP_LOW = 0.01
CLIP_HIGH = 0.99
SKEW_THRESHOLD = 3.0
UNKNOWN = -1
# Categories of all columns that a model holds as lists; longer lists stay in a table.
MAX_CATEGORIES = 1_000_000
# A value of a long list held by one row in this many is looked up in place of a join.
HOT_PARTS = 256
# Rows that need no join are dealt over this many keys that match nothing.
DEALT = 1024
# Folder of the code table inside a saved encoder.
CODES = "codes"


# --- numeric statistics -------------------------------------------------------------


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; a column without values is absent."""
    return {c: q[0] for c, q in column_quantiles(df, columns, [0.5]).items()}


def imputed(df: DataFrame, fills: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: _filled(c, v) for c, v in fills.items()})


def _filled(name: str, value: float) -> Column:
    return F.coalesce(known(col(name).cast("double")), F.lit(float(value)))


def adjusted_skew(c: Column) -> Column:
    """Bias-corrected skewness; NULL below three values."""
    n = F.count(c).cast("double")
    factor = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2))
    return F.skewness(c) * factor


@dataclass(frozen=True)
class Moments:
    """Mean, population deviation (one if zero) and |skew| (zero if undefined)."""

    mean: float
    deviation: float
    skew: float


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, Moments]:
    """Moments of numeric columns, summed by numpy; those of no rows have no mean."""
    if not columns:
        return {}
    parts = _parts(df, columns)
    return {c: parts[-1, c][0].moments() if (-1, c) in parts else Moments(None, 1.0, 0.0) for c in columns}


@dataclass(frozen=True)
class Clip:
    low: float
    high: float


def clip_bounds(
    df: DataFrame,
    columns: Sequence[str],
    low: float = CLIP_LOW,
    high: float = CLIP_HIGH,
    skew_threshold: float = SKEW_THRESHOLD,
    known: Mapping[str, Moments] | None = None,
) -> dict[str, Clip]:
    """Bounds of the heavy-tailed columns; quantiles are only taken for those."""
    known = known or moments(df, columns)
    heavy = [c for c in columns if known[c].skew >= skew_threshold]
    return {c: Clip(*q) for c, q in column_quantiles(df, heavy, [low, high]).items()}


def clipped(df: DataFrame, bounds: Mapping[str, Clip]) -> DataFrame:
    return df.withColumns({c: clip_value(col(c), b) for c, b in bounds.items()})


def clip_value(value: Column, bounds: Clip) -> Column:
    inside = F.least(F.greatest(value.cast("double"), F.lit(bounds.low)), F.lit(bounds.high))
    return F.when(value.isNotNull(), inside)


# --- categories ---------------------------------------------------------------------


def category_text(df: DataFrame, name: str) -> Column:
    value = known(col(name)) if is_floating(df.schema[name].dataType) else col(name)
    return value.cast("string")


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows) of non-null categories, combined before the shuffle."""
    wide = df.select(*[category_text(df, c).alias(c) for c in columns])
    return (
        wide.unpivot([], [col(c) for c in columns], "column", "value")
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def sort_key(df: DataFrame, name: str):
    """How the values of a column compare: numbers by size, text by code point."""
    kind = df.schema[name].dataType
    return float if isinstance(kind, T.NumericType) else str


def most_frequent(counts: DataFrame, numeric: Sequence[str] = ()) -> DataFrame:
    """(column, value, categories): the most frequent value, the smallest one on a tie.

    ``numeric`` names the columns whose values compare as numbers. Ordering the whole
    struct makes it one bounded aggregate, with no sort and no value map.
    """
    number = F.lit(None).cast("double")
    if numeric:
        number = F.when(F.col("column").isin(*numeric), F.col("value").try_cast("double"))
    best = F.min_by("value", F.struct(-F.col("rows"), number, F.col("value")))
    return counts.groupBy("column").agg(
        best.alias("value"), F.count(F.lit(1)).alias("categories")
    )


def code_table(counts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code) with codes 0.. in text order within each column.

    Numbering is a range shuffle over (column, value), so a column with very many
    categories is spread over all tasks.
    """
    wanted = counts.where(F.col("column").isin(*columns)).select("column", "value")
    numbered = dense_index(wanted, [F.col("column"), F.col("value")], "at")
    starts = numbered.groupBy("column").agg(F.min("at").alias("start"))
    return numbered.join(F.broadcast(starts), "column").select(
        "column", "value", (F.col("at") - F.col("start")).cast("int").alias("code")
    )


def code_of(value: Column, order: Sequence[Any]) -> Column:
    """Position in ``order``, -1 when the value is not listed."""
    return (F.array_position(F.array(*[F.lit(v) for v in order]), value) - 1).cast("int")


# --- the encoder --------------------------------------------------------------------


@dataclass
class EncoderState:
    """Everything the encoder learned, as plain values."""

    numeric: list[str] = field(default_factory=list)
    fills: dict[str, float] = field(default_factory=dict)
    clips: dict[str, list[float]] = field(default_factory=dict)
    scales: dict[str, list[float]] = field(default_factory=dict)
    boolean: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    modes: dict[str, str] = field(default_factory=dict)
    values: dict[str, list[str]] = field(default_factory=dict)
    orders: dict[str, list[str]] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    #: Codes of the frequent values of each column whose list is in the table ``codes``.
    hot: dict[str, dict[str, int]] = field(default_factory=dict)
    codes: str = ""

    def code_table(self) -> DataFrame:
        """(value, code, column) of the long lists, a folder per column."""
        return SparkSession.active().read.schema("value string, code int, column string").parquet(self.codes)

    def code_rows(self, name: str) -> DataFrame:
        return self.code_table().where(F.col("column") == name).select("value", "code")

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> EncoderState:
        return EncoderState(**json.loads(text))


def _text_value(value: Any) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def fit_encoder(
    df: DataFrame,
    profile: SchemaProfile,
    orders: Mapping[str, Sequence[Any]],
    max_categories: int = MAX_CATEGORIES,
) -> EncoderState:
    """Learn all statistics of the training rows ``df``."""
    keep_compiled(df.sparkSession)
    state = EncoderState(
        boolean=list(profile.boolean),
        ordinal=list(profile.ordinal),
        categorical=list(profile.categorical),
        orders={c: [_text_value(v) for v in orders[c]] for c in profile.ordinal},
    )
    # A column without any training value cannot be imputed and is left out.
    state.fills = medians(df, profile.numeric)
    state.numeric = [c for c in profile.numeric if c in state.fills]
    filled = imputed(df.select(*[col(c) for c in state.numeric]), state.fills)
    known = moments(filled, state.numeric)
    bounds = clip_bounds(filled, state.numeric, known=known)
    state.clips = {c: [b.low, b.high] for c, b in bounds.items()}
    known.update(moments(clipped(filled, bounds), list(bounds)))
    state.scales = {c: [known[c].mean, known[c].deviation] for c in state.numeric}

    coded = list(dict.fromkeys([*state.boolean, *state.ordinal, *state.categorical]))
    if coded:
        counts = pin(category_counts(df, coded), "categories")
        numeric = [c for c in coded if isinstance(df.schema[c].dataType, T.NumericType)]
        modes = {r["column"]: r for r in most_frequent(counts, numeric).collect()}
        state.modes = {c: r["value"] for c, r in modes.items()}
        state.sizes = {c: modes[c]["categories"] if c in modes else 0 for c in coded}
        long = _long_lists(state, max_categories)
        _store_codes(counts.withColumn("group", F.lit(ALL_ROWS)), long, numeric, {ALL_ROWS: state})
        listed = [c for c in dict.fromkeys([*state.boolean, *state.categorical]) if c not in long]
        lists: dict[str, list[str]] = {c: [] for c in listed}
        if listed:
            for row in counts.where(F.col("column").isin(*listed)).toLocalIterator():
                lists[row["column"]].append(row["value"])
        state.values.update({c: sorted(v, key=sort_key(df, c)) for c, v in lists.items()})
    return state


def _long_lists(state: EncoderState, max_categories: int) -> list[str]:
    """The one-hot columns whose lists go to the table: the longest, until the rest fits."""
    room = max_categories - sum(state.sizes[c] for c in state.boolean)
    long = []
    for name in sorted(state.categorical, key=lambda c: (state.sizes[c], c)):
        room -= state.sizes[name]
        if room < 0:
            long.append(name)
    return long


def _store_codes(
    counts: DataFrame, long: Sequence[str], numeric: Sequence[str], states: Mapping[str, EncoderState]
) -> None:
    """Write the codes of long lists, numbered in value order within each group and column.

    ``counts`` has (group, column, value, rows). Numbering is one range shuffle for all groups;
    a frequent value is one of at most ``HOT_PARTS`` per group and column, or the mode.
    """
    if not long:
        return
    spark = counts.sparkSession
    number = F.when(F.col("column").isin(*numeric), F.col("value").try_cast("double"))
    wanted = counts.where(F.col("column").isin(*long)).select(
        "group", "column", number.alias("number"), "value", "rows"
    )
    numbered = dense_index(wanted, [F.col(c) for c in ("group", "column", "number", "value")], "at")
    # One row per group and column.
    starts = numbered.groupBy("group", "column").agg(F.min("at").alias("start"), F.sum("rows").alias("all"))
    coded = numbered.join(F.broadcast(starts), ["group", "column"]).select(
        "group", "column", "value", (F.col("at") - F.col("start")).cast("int").alias("code"), "rows", "all"
    )
    path = scratch_path(spark, "codes")
    coded.write.partitionBy("group", "column").parquet(path)
    stored = spark.read.schema(coded.schema).parquet(path)
    modes = [(g, c, state.modes[c]) for g, state in states.items() for c in long if c in state.modes]
    mode = F.broadcast(small_table(spark, modes, "group string, column string, mode string"))
    frequent = (F.col("rows") * HOT_PARTS >= F.col("all")) | (F.col("value") == F.col("mode"))
    for group, state in states.items():
        state.codes = f"{path}/group={group}"
        state.hot = {c: {} for c in long}
        state.values.update({c: [] for c in long})
    for row in stored.join(mode, ["group", "column"]).where(frequent).collect():
        states[row["group"]].hot[row["column"]][row["value"]] = row["code"]


# --- the encoders of all folds --------------------------------------------------------


@dataclass(frozen=True)
class Part:
    """Central sums of some values, which add up to those of several parts."""

    rows: int = 0
    mean: float = 0.0
    squares: float = 0.0
    cubes: float = 0.0
    low: float = math.inf
    high: float = -math.inf

    @staticmethod
    def of(rows: int, mean: float, variance: float, skew: float | None, low: float, high: float) -> Part:
        squares = variance * rows
        undefined = skew is None or math.isnan(skew)
        cubes = 0.0 if undefined else skew * squares**1.5 / math.sqrt(rows)
        return Part(rows, mean, squares, cubes, low, high)

    def __add__(self, other: Part) -> Part:
        if not self.rows or not other.rows:
            return self if self.rows else other
        a, b = self.rows, other.rows
        n, gap = a + b, other.mean - self.mean
        return Part(
            n,
            self.mean + gap * b / n,
            self.squares + other.squares + gap**2 * a * b / n,
            self.cubes
            + other.cubes
            + gap**3 * a * b * (a - b) / n**2
            + 3 * gap * (a * other.squares - b * self.squares) / n,
            min(self.low, other.low),
            max(self.high, other.high),
        )

    def moments(self) -> Moments:
        """Equal values have no deviation, whatever rounding says."""
        n = self.rows
        if self.low == self.high or not self.squares:
            return Moments(self.mean, 1.0, 0.0)
        skew = math.sqrt(n) * self.cubes / self.squares**1.5
        factor = math.sqrt(n * (n - 1)) / (n - 2) if n > 2 else 0.0
        return Moments(self.mean, math.sqrt(self.squares / n), abs(skew * factor))


ALL_ROWS = "all"


def _group(fold: int | None) -> str:
    return ALL_ROWS if fold is None else str(fold)


def _groups(fold_col: str, folds: Sequence[int]) -> Column:
    """The groups that a row belongs to: all rows, and the rest of every other fold."""
    others = [F.when(col(fold_col) != k, F.lit(_group(k))) for k in folds]
    return F.array_compact(F.array(F.lit(ALL_ROWS), *others))


_CENTRAL = "fold int, salt int, sums binary"
_SALTS = 32


def _central(count: int, fold: str) -> Callable:
    """Central sums of a task's rows, a line of seven per column and the rows last, for each fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            folds = np.asarray(batch.column(fold))
            for k in np.unique(folds).tolist():
                own = batch if (folds == k).all() else batch.filter(pa.array(folds == k))
                lines = [_line(own.column(f"n{i}").to_numpy(zero_copy_only=False)) for i in range(count)]
                held[k] = _joined(held.get(k), np.array(lines))
        salt = TaskContext.get().partitionId() % _SALTS
        rows = [(k, salt, sums.astype("<f8").tobytes()) for k, sums in held.items()]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        arrays = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(arrays, names=["fold", "salt", "sums"])

    return run


def _line(column: np.ndarray) -> list[float]:
    """Rows, mean, squares, cubes, least and greatest of the numbers there are, and the gaps."""
    values = column[~np.isnan(column)]
    if not values.size:
        return [0.0, 0.0, 0.0, 0.0, math.inf, -math.inf, column.size]
    with np.errstate(all="ignore"):
        mean = values.mean()
        away = values - mean
        squares = away * away
        return [values.size, mean, squares.sum(), (squares * away).sum(), values.min(), values.max(), column.size - values.size]


def _joined(held: np.ndarray | None, more: np.ndarray) -> np.ndarray:
    if held is None:
        return more
    out = []
    for a, b in zip(held.tolist(), more.tolist(), strict=True):
        part = Part(int(a[0]), *a[1:6]) + Part(int(b[0]), *b[1:6])
        out.append([part.rows, part.mean, part.squares, part.cubes, part.low, part.high, a[6] + b[6]])
    return np.array(out)


def _parts(df: DataFrame, columns: Sequence[str], fold_col: str | None = None) -> dict[tuple[int, str], tuple[Part, int]]:
    """Central sums of the known values and the number of missing ones, per fold (-1 without folds) and column.

    Tasks sum batches of numbers by numpy; what they return meets in two steps.
    """
    spark = df.sparkSession
    reach_workers(spark)
    names = list(columns)
    plain = df.select(
        F.coalesce(col(fold_col).cast("int") if fold_col else F.lit(None), F.lit(-1)).alias("fold"),
        *[known(col(c).cast("double")).alias(f"n{i}") for i, c in enumerate(names)],
    )

    def met(table: pa.Table) -> pa.Table:
        total = None
        for piece in table["sums"].to_pylist():
            total = _joined(total, np.frombuffer(piece, "<f8").reshape(-1, 7))
        head = [table[c].slice(0, 1).combine_chunks() for c in ("fold", "salt")]
        return pa.Table.from_arrays([*head, pa.array([total.astype("<f8").tobytes()])], names=["fold", "salt", "sums"])

    sums = plain.mapInArrow(_central(len(names), "fold"), _CENTRAL).groupBy("fold", "salt").applyInArrow(met, _CENTRAL)
    with unmeasured_batches(spark):
        rows = sums.collect()
    result: dict[tuple[int, str], tuple[Part, int]] = {}
    for row in sorted(rows, key=lambda r: (r["fold"], r["salt"])):
        for name, line in zip(names, np.frombuffer(row["sums"], "<f8").reshape(-1, 7).tolist(), strict=True):
            part, gaps = result.get((row["fold"], name), (Part(), 0))
            result[row["fold"], name] = (part + Part(int(line[0]), *line[1:6]), gaps + int(line[6]))
    return result


def fit_encoders(
    df: DataFrame,
    profile: SchemaProfile,
    orders: Mapping[str, Sequence[Any]],
    fold_col: str,
    folds: Sequence[int],
    max_categories: int = MAX_CATEGORIES,
) -> dict[int | None, EncoderState]:
    """What ``fit_encoder`` learns from all rows (``None``) and from the rest of every fold.

    All of them share their jobs: central sums and category counts are taken once per fold
    and added up, and one search finds the ranks of all groups, so the number of jobs does not
    depend on that of folds.
    """
    wanted: list[int | None] = [None, *folds]
    states = {
        k: EncoderState(
            boolean=list(profile.boolean),
            ordinal=list(profile.ordinal),
            categorical=list(profile.categorical),
            orders={c: [_text_value(v) for v in orders[c]] for c in profile.ordinal},
        )
        for k in wanted
    }
    _fit_numeric(df, profile.numeric, fold_col, folds, states)
    _fit_categories(df, fold_col, folds, states, max_categories)
    return states


def _fit_numeric(
    df: DataFrame, columns: Sequence[str], fold_col: str, folds: Sequence[int], states: dict[int | None, EncoderState]
) -> None:
    if not columns:
        return
    middles = fold_quantiles(df, [(k, c) for k in states for c in columns], [0.5], fold_col)
    parts = _parts(df, columns, fold_col)
    found: dict[tuple[int | None, str], Moments] = {}
    for k, state in states.items():
        state.fills = {c: middles[k, c][0] for c in columns if (k, c) in middles}
        state.numeric = list(state.fills)
        for c, fill in state.fills.items():
            total, missing = Part(), 0
            for (fold, name), (part, gaps) in parts.items():
                if name == c and fold != k:
                    total, missing = total + part, missing + gaps
            filled = total + Part(missing, fill, 0.0, 0.0, fill, fill)
            found[k, c] = filled.moments()
    heavy = [(k, c) for (k, c), m in found.items() if m.skew >= SKEW_THRESHOLD]
    fills = {(k, c): states[k].fills[c] for k, c in heavy}
    for (k, c), bounds in fold_quantiles(df, heavy, [CLIP_LOW, CLIP_HIGH], fold_col, fills).items():
        states[k].clips[c] = list(bounds)
    found.update(_clipped_moments(df, heavy, fold_col, states))
    for k, state in states.items():
        state.clips = {c: state.clips[c] for c in state.numeric if c in state.clips}
        state.scales = {c: [found[k, c].mean, found[k, c].deviation] for c in state.numeric}


def _clipped_moments(
    df: DataFrame, heavy: Sequence[tuple[int | None, str]], fold_col: str, states: Mapping[int | None, EncoderState]
) -> dict[tuple[int | None, str], Moments]:
    result = {}
    for at in range(0, len(heavy), CHUNK):
        part = heavy[at : at + CHUNK]
        aggs = []
        for i, (k, c) in enumerate(part):
            value = clip_value(_filled(c, states[k].fills[c]), Clip(*states[k].clips[c]))
            own = value if k is None else F.when(col(fold_col) != k, value)
            aggs += [F.avg(own).alias(f"m{i}"), F.stddev_pop(own).alias(f"d{i}")]
        row = df.agg(*aggs).first()
        result.update({key: Moments(row[f"m{i}"], row[f"d{i}"] or 1.0, 0.0) for i, key in enumerate(part)})
    return result


def _fit_categories(
    df: DataFrame,
    fold_col: str,
    folds: Sequence[int],
    states: dict[int | None, EncoderState],
    max_categories: int,
) -> None:
    first = states[None]
    coded = list(dict.fromkeys([*first.boolean, *first.ordinal, *first.categorical]))
    if not coded:
        return
    wide = df.select(col(fold_col).alias("_fold"), *[category_text(df, c).alias(c) for c in coded])
    counts = pin(
        wide.unpivot(["_fold"], [col(c) for c in coded], "column", "value")
        .where("value is not null")
        .groupBy("_fold", "column", "value")
        .agg(F.count(F.lit(1)).alias("rows")),
        "fold-categories",
    )
    numeric = [c for c in coded if isinstance(df.schema[c].dataType, T.NumericType)]
    grouped = (
        counts.select(F.explode(_groups("_fold", folds)).alias("group"), "column", "value", "rows")
        .groupBy(F.concat_ws(":", "group", "column").alias("column"), "value")
        .agg(F.sum("rows").alias("rows"))
    )
    names = [f"{_group(k)}:{c}" for k in states for c in numeric]
    modes = {r["column"]: r for r in most_frequent(grouped, names).collect()}
    for k, state in states.items():
        own = {c: modes.get(f"{_group(k)}:{c}") for c in coded}
        state.modes = {c: r["value"] for c, r in own.items() if r}
        state.sizes = {c: r["categories"] if r else 0 for c, r in own.items()}
    # The lists of all rows are the longest, so what fits there fits everywhere.
    long = _long_lists(first, max_categories)
    by_group = (
        counts.select(F.explode(_groups("_fold", folds)).alias("group"), "column", "value", "rows")
        .groupBy("group", "column", "value")
        .agg(F.sum("rows").alias("rows"))
    )
    _store_codes(by_group, long, numeric, {_group(k): state for k, state in states.items()})
    listed = [c for c in dict.fromkeys([*first.boolean, *first.categorical]) if c not in long]
    lists: dict[int | None, dict[str, list[str]]] = {k: {c: [] for c in listed} for k in states}
    if listed:
        # A value is known to the rest of a fold if any other fold has it.
        spread = counts.where(F.col("column").isin(*listed)).groupBy("column", "value").agg(
            F.min("_fold").alias("low"), F.max("_fold").alias("high")
        )
        for row in spread.toLocalIterator():
            for k, values in lists.items():
                if k is None or row["low"] != k or row["high"] != k:
                    values[row["column"]].append(row["value"])
    for k, state in states.items():
        state.values.update({c: sorted(v, key=sort_key(df, c)) for c, v in lists[k].items()})


def numeric_value(state: EncoderState, name: str, scaled: bool) -> Column:
    value = _filled(name, state.fills[name])
    if name in state.clips:
        value = clip_value(value, Clip(*state.clips[name]))
    if scaled:
        mean, deviation = state.scales[name]
        value = (value - F.lit(mean)) / F.lit(deviation)
    return value


def _filled_text(df: DataFrame, state: EncoderState, name: str) -> Column:
    return F.coalesce(category_text(df, name), F.lit(state.modes.get(name)))


def _ordered_code(df: DataFrame, state: EncoderState, name: str, order: Sequence[str]) -> Column:
    """Code of an imputed value; numbers are compared as numbers, so 1 equals 1.0."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        mode = state.modes.get(name)
        value = F.coalesce(known(col(name).cast("double")), F.lit(float(mode) if mode else None))
        return code_of(value, [float(v) for v in order])
    return code_of(_filled_text(df, state, name), order)


def encode(df: DataFrame, state: EncoderState, scaled: bool) -> DataFrame:
    """Append encoded columns in the order numeric, boolean, ordinal, categorical.

    Names are prefixed by their branch. One-hot columns come out as a code ``cat__x``
    whose value equal to the number of categories means unknown.
    """
    keep_compiled(df.sparkSession)
    out: list[Column] = [col(c) for c in df.columns]
    out += [numeric_value(state, c, scaled).alias(f"num__{c}") for c in state.numeric]
    out += [
        _ordered_code(df, state, c, state.values[c]).cast("double").alias(f"bool__{c}")
        for c in state.boolean
    ]
    out += [
        _ordered_code(df, state, c, state.orders[c]).cast("double").alias(f"ord__{c}")
        for c in state.ordinal
    ]
    texts = [f"_text_of_cat__{c}" for c in state.categorical]
    out += [
        _filled_text(df, state, c).alias(text) for c, text in zip(state.categorical, texts, strict=True)
    ]
    encoded = df.select(*out)
    if not texts:
        return encoded
    placed = encoded
    for name in state.categorical:
        if name in state.hot:
            placed = _joined_code(placed, state, name, df)
        else:
            placed = _indexer(f"_text_of_cat__{name}", f"cat__{name}", tuple(state.values[name])).transform(placed)
    # Joins put their columns last: back to the order of the branches.
    return placed.select(*[col(c) for c in encoded.columns if c not in texts], *[col(f"cat__{c}") for c in state.categorical])


def _joined_code(encoded: DataFrame, state: EncoderState, name: str, df: DataFrame) -> DataFrame:
    """``cat__x`` of a long list: the code of a frequent value in place, any other by a join.

    Rows with a frequent value, which those imputed by the mode are, meet no row of the table:
    they are dealt over many keys by a hash of the row, which a repeated task reproduces.
    """
    size = state.sizes[name]
    hot = state.hot[name]
    text, place, found, deal, value, code, zero = (
        f"_{part}_of_cat__{name}" for part in ("text", "place", "found", "deal", "value", "code", "zero")
    )
    nothing = F.lit(0).cast("long")
    in_place = F.get(F.array(*[F.lit(hot[v]) for v in sorted(hot)]).cast("array<int>"), col(place).cast("int"))
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.VariantType)]
    dealt = 1 + F.pmod(F.xxhash64(*[col(c) for c in plain]), F.lit(DEALT))
    indexed = _indexer(text, place, tuple(sorted(hot))).transform(encoded)
    asked = indexed.withColumn(found, in_place).withColumn(
        deal, F.when(col(found).isNull() & col(text).isNotNull(), nothing).otherwise(dealt)
    )
    coded = F.lit(None).cast("int")
    if size:
        codes = state.code_rows(name).select(
            F.col("value").alias(value), F.col("code").alias(code), nothing.alias(zero)
        )
        asked = asked.join(codes, (col(text) == col(value)) & (col(deal) == col(zero)), "left")
        coded = col(code)
    kind = {"ml_attr": {"type": "nominal", "num_vals": size + 1}}
    best = F.coalesce(col(found), coded, F.lit(size)).cast("double")
    return asked.select("*", best.alias(f"cat__{name}", metadata=kind)).drop(found, deal, value, code, zero, place)


@lru_cache(maxsize=64)
def _indexer(source: str, target: str, labels: tuple[str, ...]) -> StringIndexerModel:
    """Hash lookup of the position in a list; anything else gets the list's length.

    One column each: a model of several pads their lists to the longest one with nulls.
    """
    return StringIndexerModel.from_labels(list(labels), inputCol=source, outputCol=target, handleInvalid="keep")


def one_hot_columns(df: DataFrame, state: EncoderState, name: str) -> list[Column]:
    """0/1 columns of a categorical; unknown values are all zeros."""
    if name in state.hot:
        raise ValueError(f"'{name}' has {state.sizes[name]} categories: too many for a column each.")
    value = _filled_text(df, state, name)
    return [(value == v).cast("int").alias(f"{name}_{v}") for v in state.values[name]]


class TableEncoder(Estimator):
    """Fit the encoder on a table whose roles are known."""

    def __init__(
        self,
        profile: SchemaProfile,
        orders: Mapping[str, Sequence[Any]],
        scaled: bool,
    ) -> None:
        super().__init__()
        self.profile, self.orders, self.scaled = profile, dict(orders), scaled

    def _fit(self, dataset: DataFrame) -> TableEncoderModel:
        state = fit_encoder(dataset, self.profile, self.orders)
        return TableEncoderModel(state=state.to_json(), scaled=self.scaled)


class TableEncoderModel(Model, MLReadable, MLWritable):
    """Append the encoded columns, using fitted statistics only.

    Saving copies the codes of long lists into the model, so it needs no other folder.
    """

    state = Param(Params._dummy(), "state", "fitted statistics as JSON", TypeConverters.toString)
    scaled = Param(Params._dummy(), "scaled", "standardise numerics", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, state: str = "{}", scaled: bool = False) -> None:
        super().__init__()
        self._setDefault(state="{}", scaled=False)
        self._set(**self._input_kwargs)

    @property
    def fitted(self) -> EncoderState:
        return EncoderState.from_json(self.getOrDefault(self.state))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return encode(dataset, self.fitted, self.getOrDefault(self.scaled))

    def write(self) -> MLWriter:
        return _EncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _EncoderReader(cls)


class _EncoderWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        state = self.instance.fitted
        if any(state.sizes[c] for c in state.hot):
            state.code_table().write.partitionBy("column").parquet(f"{path}/{CODES}")


class _EncoderReader(DefaultParamsReader):
    def load(self, path: str) -> TableEncoderModel:
        model = super().load(path)
        state = model.fitted
        if state.hot:
            state.codes = f"{path}/{CODES}"
            model._set(state=state.to_json())
        return model


def encoded_columns(state: EncoderState) -> list[str]:
    return [
        *[f"num__{c}" for c in state.numeric],
        *[f"bool__{c}" for c in state.boolean],
        *[f"ord__{c}" for c in state.ordinal],
        *[f"cat__{c}" for c in state.categorical],
    ]


def vector_stages(spark, state: EncoderState) -> list:
    """Sparse one-hot vectors and the assembled ``features`` vector.

    The number of categories of each column comes with the names of a row that stands for the
    table, so nothing is scanned; that code is also the unknown one and is the slot that gets dropped.
    """
    stages: list = []
    inputs = encoded_columns(state)
    if state.categorical:
        names = [f"cat__{c}" for c in state.categorical]
        hot = [f"hot__{c}" for c in state.categorical]
        kinds = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
        largest = small_table(spark, [tuple(float(state.sizes[c]) for c in state.categorical)], kinds).select(
            *[
                col(n).alias(n, metadata={"ml_attr": {"type": "nominal", "num_vals": state.sizes[c] + 1}})
                for n, c in zip(names, state.categorical, strict=True)
            ]
        )
        stages.append(OneHotEncoder(inputCols=names, outputCols=hot, dropLast=True).fit(largest))
        inputs = [n for n in inputs if not n.startswith("cat__")] + hot
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages


# --- the report ---------------------------------------------------------------------


def engineering_report(
    original: Sequence[str], derived: Sequence[str], profile: SchemaProfile, scaled: bool
) -> list[tuple[str, int, str]]:
    """(section, position, column) rows describing what happens to every column."""
    sections = {
        "original": original,
        "derived": derived,
        "dropped": [*profile.dropped, *profile.date],
        "scaled_numeric" if scaled else "unscaled_numeric": profile.numeric,
        "ordinal": profile.ordinal,
        "one_hot": profile.categorical,
        "boolean_ordinal": profile.boolean,
        "date_derived_then_dropped": profile.date,
    }
    return [(s, i, c) for s, names in sections.items() for i, c in enumerate(names)]


REPORT_SCHEMA = "section string, position int, column string"


def report_frame(spark, rows: Sequence[tuple[str, int, str]]) -> DataFrame:
    return small_table(spark, list(rows), REPORT_SCHEMA)


def encoding_counts(report: DataFrame) -> DataFrame:
    """(kind, columns) for the encoding sections of a report, zero included."""
    kinds = F.create_map(
        *[
            F.lit(x)
            for pair in (
                ("scaled_numeric", "numeric"),
                ("unscaled_numeric", "numeric"),
                ("boolean_ordinal", "boolean"),
                ("ordinal", "ordinal"),
                ("one_hot", "one_hot"),
                ("date_derived_then_dropped", "date"),
            )
            for x in pair
        ]
    )
    names = small_table(
        report.sparkSession,
        [(k,) for k in ("numeric", "boolean", "ordinal", "one_hot", "date")], "kind string"
    )
    counted = (
        report.select(kinds[F.col("section")].alias("kind"))
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("columns"))
    )
    return names.join(F.broadcast(counted), "kind", "left").select(
        "kind", F.coalesce("columns", F.lit(0)).alias("columns")
    )
