"""Logistic regression of many parameter sets and folds in shared passes.

Every fit minimises the mean weighted log loss plus half the penalty times the squared
weights (the intercept is free). Two classes and up to ``CROSSED_WIDTH`` columns take Newton's steps, which need
few passes; the rest takes L-BFGS. A fit only asks for loss, gradient and perhaps curvature at one point at a
time, so one pass over the packed rows answers all fits of all parts at once: a search costs
the passes of its slowest fit. Before L-BFGS one more pass adds up the cross products of each part's columns; the curvature
they give at the start is what it begins with, so that related columns cost no extra passes. Parts
wider than ``CROSSED_WIDTH`` only add up squares. Blocks hold rows that are mostly filled as a
matrix, others as entries. What a pass returns follows the columns and never the rows; sums of
tasks are added where each fit's pieces meet, or on the driver where all of them are small.

The driver holds ``MEMORY`` corrections of each running fit. ``STATE_BYTES`` bounds how many fits run
side by side; the rest follows.

Folds of one table need no vectors: ``fit_shared`` makes the matrix of each fold from rows that are stored once.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obligor.operators.boosting import BLOCK_ROWS, DRIVER_BYTES, Entries, batch_of, chances, entries_of, floats
from obligor.operators.shared_rows import SharedRows, View, blocks_in
from obligor.session import drop_scratch, reach_workers, scratch_path, unmeasured_batches

#: Corrections that approximate the curvature.
MEMORY = 10
STATE_BYTES = 256 << 20
#: Widest part whose cross products are added up.
CROSSED_WIDTH = 512
#: Largest slope of the mean loss at which a fit is finished.
TOLERANCE = 1e-7
#: Rows from which a search over shared rows begins with one lot of them.
WARM_ROWS = 1 << 20
#: Largest slope at which a fit ends that began near its end, where a step less would show in the results.
NEAR_TOLERANCE = 1e-10
_SUFFICIENT = 1e-4
_HALVINGS = 40
#: Share of the loss that its sum may be off by.
_ROUNDING = 1e-12
#: Filled share from which the rows of a block are kept as a matrix.
DENSE_SHARE = 0.25

Answer = tuple[float, np.ndarray, np.ndarray | None]
Search = Generator[np.ndarray, Answer, None]
#: Divides a slope by the curvature at the start.
Scale = Callable[[np.ndarray], np.ndarray]


def descend(start: np.ndarray, steps: int, scale: Scale, found: list[np.ndarray]) -> Search:
    """L-BFGS that yields the points it wants judged; ``found`` receives the best so far."""
    point = start
    value, slope, _ = yield point
    found[:] = [point]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(slope).max() <= TOLERANCE:
            return
        way = -_curved(slope, pairs, scale)
        fall, length = float(way @ slope), 1.0
        for _ in range(_HALVINGS):
            new = point + length * way
            new_value, new_slope, _ = yield new
            if new_value <= value + _SUFFICIENT * length * fall:
                break
            length /= 2
        else:  # rounding hides any further gain
            return
        step, change = new - point, new_slope - slope
        if float(step @ change) > 0:
            pairs = [*pairs, (step, change)][-MEMORY:]
        point, value, slope = new, new_value, new_slope
        found[:] = [point]


def newton(start: np.ndarray, steps: int, found: list[np.ndarray], tolerance: float = TOLERANCE) -> Search:
    """Newton's steps, halved where the loss does not fall; ``found`` receives the best so far."""
    point = start
    value, slope, curve = yield point
    found[:] = [point]
    for _ in range(steps):
        if np.abs(slope).max() <= tolerance:
            return
        # Columns that add up to others have no curvature of their own.
        ridge = np.eye(point.size) * 1e-10 * np.trace(curve) / point.size
        way = -np.linalg.solve(curve + ridge, slope)
        fall, length, noise = float(way @ slope), 1.0, _ROUNDING * abs(value)
        for _ in range(_HALVINGS):
            new = point + length * way
            new_value, new_slope, new_curve = yield new
            if new_value <= value + _SUFFICIENT * length * fall + noise:
                break
            length /= 2
        else:
            return
        hidden = new_value > value + _SUFFICIENT * length * fall
        if hidden and np.abs(new_slope).max() > np.abs(slope).max() / 2:
            return  # rounding hides any further gain
        point, value, slope, curve = new, new_value, new_slope, new_curve
        found[:] = [point]


def _curved(slope: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]], scale: Scale) -> np.ndarray:
    """The slope times the inverse curvature: that at the start, corrected by the last steps."""
    out, kept = slope.copy(), []
    for step, change in reversed(pairs):
        share = float(step @ out) / float(step @ change)
        out -= share * change
        kept.append(share)
    out = scale(out)
    for (step, change), share in zip(pairs, reversed(kept), strict=True):
        out += step * (share - float(change @ out) / float(step @ change))
    return out


_ROWS = "part int, rows int, labels binary, whole binary, entry_rows binary, entry_columns binary, entry_values binary"


def _filled(entries: Entries, width: int) -> np.ndarray:
    """The rows as a matrix."""
    out = np.zeros((entries.rows, width))
    out[entries.row, entries.column] = entries.value
    return out


def _packed(width: Mapping[int, int]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.asarray(batch.column("part"))
            for part in np.unique(parts).tolist():
                own = batch.filter(pa.array(parts == part))
                entries, whole = entries_of(own.column("vector")), b""
                if entries.row.size > DENSE_SHARE * own.num_rows * width[part]:
                    # Column by column, where equal values lie together and take little room on disk.
                    whole = np.ascontiguousarray(_filled(entries, width[part]).T).astype("<f8").tobytes()
                    entries = Entries(own.num_rows, *(a[:0] for a in (entries.row, entries.column, entries.value)))
                row = (
                    part,
                    own.num_rows,
                    np.asarray(own.column("label")).astype("<i4").tobytes(),
                    whole,
                    entries.row.astype("<i4").tobytes(),
                    entries.column.astype("<i4").tobytes(),
                    entries.value.astype("<f8").tobytes(),
                )
                yield from batch_of([row], _ROWS)

    return run


class Block:
    """Rows of one part; ``whole`` is their matrix, None where only entries are kept."""

    def __init__(self, row: Mapping[str, Any]):
        self.part, self.rows = row["part"], row["rows"]
        self.labels = np.frombuffer(row["labels"], "<i4")
        self.whole = floats(row["whole"]).reshape(-1, self.rows).T if row["whole"] else None
        ints = (np.frombuffer(row[c], "<i4") for c in ("entry_rows", "entry_columns"))
        self.entries = Entries(self.rows, *ints, floats(row["entry_values"]))

    def matrix(self, width: int) -> np.ndarray:
        return _filled(self.entries, width) if self.whole is None else self.whole


def _blocks_in(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for at in range(batch.num_rows):  # one at a time: a batch may hold many blocks
            yield Block(batch.slice(at, 1).to_pylist()[0])


def _errors(margins: np.ndarray, labels: np.ndarray, of_class: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted loss, its slope by each margin, and the probabilities."""
    each = of_class[labels]
    chance = chances(margins)
    loss = -(each * np.log(np.maximum(chance[labels, np.arange(labels.size)], 1e-300))).sum()
    error = chance[1:] if len(margins) == 1 else chance
    hit = labels == (1 if len(margins) == 1 else np.arange(len(margins))[:, None])
    return loss, (error - hit) * each, chance


def judged(
    weights: np.ndarray, labels: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, of_class: np.ndarray
) -> np.ndarray:
    """Weighted loss, then its gradient by ``weights`` (a line per margin, the intercept last)."""
    width = weights.shape[1] - 1
    margins = np.stack([np.bincount(row, value * w[column], labels.size) + w[-1] for w in weights])
    loss, error, _ = _errors(margins, labels, of_class)
    slope = [np.append(np.bincount(column, value * e[row], width), e.sum()) for e in error]
    return np.concatenate([[loss], *slope])


def judged_whole(
    weights: np.ndarray, labels: np.ndarray, whole: np.ndarray, of_class: np.ndarray, curved: bool
) -> np.ndarray:
    """The same of a matrix; ``curved`` adds the second derivatives of a single margin."""
    margins = weights[:, :-1] @ whole.T + weights[:, -1:]
    loss, error, chance = _errors(margins, labels, of_class)
    slope = np.concatenate([error @ whole, error.sum(axis=1, keepdims=True)], axis=1)
    if not curved:
        return np.append(loss, slope)
    bend = np.sqrt(of_class[labels] * chance[0] * chance[1])
    scaled = np.empty((whole.shape[1] + 1, labels.size))
    np.multiply(whole.T, bend, out=scaled[:-1])
    scaled[-1] = bend
    return np.concatenate([[loss], slope.ravel(), (scaled @ scaled.T).ravel()])


@dataclass
class LogisticFit:
    """Weights of each margin, the intercept last; one margin stands for class 1 of two."""

    weights: np.ndarray

    def to_json(self) -> str:
        return json.dumps(self.weights.tolist())

    @staticmethod
    def from_json(text: str) -> LogisticFit:
        return LogisticFit(np.array(json.loads(text)))


_SUMS = "part int, at int, task long, sums binary"


def _summed(
    points: Mapping[tuple[int, int], np.ndarray], of_class: Mapping[tuple[int, int], np.ndarray], curved: Mapping[int, bool]
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for block in _blocks_in(batches):
            mine = {key: weights for key, weights in points.items() if key[0] == block.part}
            bent = curved[block.part]
            whole = block.matrix(next(iter(mine.values())).shape[1] - 1) if mine and bent else block.whole
            for key, weights in mine.items():
                if whole is None:
                    e = block.entries
                    sums = judged(weights, block.labels, e.row, e.column, e.value, of_class[key])
                else:
                    sums = judged_whole(weights, block.labels, whole, of_class[key], bent)
                held[key] = held[key] + sums if key in held else sums
        task = TaskContext.get().partitionId()
        yield from batch_of([(*key, task, sums.astype("<f8").tobytes()) for key, sums in held.items()], _SUMS)

    return run


def _crossed(width: Mapping[int, int]) -> Callable:
    """Cross products of the columns and a last column of ones; of wide parts the squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for block in _blocks_in(batches):
            part = block.part
            if width[part] > CROSSED_WIDTH:
                e = block.entries
                squares = np.bincount(e.column, e.value**2, width[part]) if block.whole is None else (block.whole**2).sum(axis=0)
                sums = np.append(squares, block.rows)
            else:
                whole = np.column_stack([block.matrix(width[part]), np.ones(block.rows)])
                sums = (whole.T @ whole).ravel()
            held[part] = held[part] + sums if part in held else sums
        task = TaskContext.get().partitionId()
        yield from batch_of([(p, 0, task, sums.astype("<f8").tobytes()) for p, sums in held.items()], _SUMS)

    return run


def scaling(crossed: np.ndarray, bends: np.ndarray, penalty: float) -> Scale:
    """Division by the curvature at the start: mean cross products times ``bends`` (one per margin)."""
    width = crossed.shape[-1]
    ridge = np.full(width, penalty)
    ridge[-1] = 0.0
    if crossed.ndim == 1:
        lines = [bend * crossed + ridge for bend in bends]
        lines = [np.maximum(line, 1e-8 * line.max()) for line in lines]
        return lambda slope: (slope.reshape(len(lines), -1) / np.stack(lines)).ravel()
    inverses = []
    for bend in bends:
        curve = bend * crossed + np.diag(ridge)
        # Columns that add up to others have no curvature of their own.
        inverses.append(np.linalg.inv(curve + np.eye(width) * 1e-8 * np.trace(curve) / width))
    return lambda slope: np.concatenate([i @ s for i, s in zip(inverses, slope.reshape(len(inverses), -1), strict=True)])


def _added(pieces: Sequence[bytes]) -> np.ndarray:
    total = floats(pieces[0])
    for piece in pieces[1:]:
        total = total + floats(piece)
    return total


def _gathered(sums: DataFrame, size: int, splits: int) -> dict[tuple[int, int], np.ndarray]:
    """Total of each fit; pieces are added in the order of their tasks either way."""
    if size * splits <= DRIVER_BYTES:
        held = defaultdict(list)
        for row in sums.collect():
            held[row["part"], row["at"]].append((row["task"], row["sums"]))
        return {key: _added([s for _, s in sorted(pieces)]) for key, pieces in held.items()}

    def added(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("task")
        return group.iloc[:1].assign(sums=[_added(list(group["sums"])).tobytes()])

    rows = sums.groupBy("part", "at").applyInPandas(added, _SUMS).collect()
    return {(row["part"], row["at"]): floats(row["sums"]) for row in rows}


def fit_all(
    parts: Sequence[DataFrame],
    params: Sequence[Mapping[str, Any]],
    weights: Sequence[Sequence[Mapping[int, float]]],
    num_classes: int,
    label: str,
    features: str = "features",
    steps: int = 2000,
) -> dict[tuple[int, int], LogisticFit]:
    """Fit every parameter set on every part; models by (part, set).

    ``params`` hold C and optionally max_iter; ``weights[part][set]`` the weight of each class.
    C weighs the loss of all rows against the penalty, as the sum of their weights is their number.
    """
    spark = parts[0].sparkSession
    reach_workers(spark)
    margins = num_classes if num_classes > 2 else 1
    rows = None
    for at, part in enumerate(parts):
        own = part.select(
            F.lit(at).alias("part"), F.col(label).cast("int").alias("label"), F.unwrap_udt(features).alias("vector")
        )
        rows = own if rows is None else rows.unionByName(own)
    facts = rows.groupBy("part", "label").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.coalesce("vector.size", F.size("vector.values"))).alias("width"),
    ).collect()
    if len({r["part"] for r in facts}) < len(parts):
        raise ValueError("A fit needs rows in every part.")
    path = scratch_path(spark, "rows")
    tasks = max(1, 2 * sum(r["rows"] for r in facts) // BLOCK_ROWS)
    width: dict[int, int] = {}
    for r in facts:
        width[r["part"]] = max(r["width"], width.get(r["part"], 0))
    with unmeasured_batches(spark):
        rows.coalesce(tasks).mapInArrow(_packed(width), _ROWS).write.parquet(path)
    blocks = spark.read.schema(_ROWS).parquet(path)
    splits = blocks.rdd.getNumPartitions()

    curved = {part: margins == 1 and w <= CROSSED_WIDTH for part, w in width.items()}
    counts = {p: {r["label"]: r["rows"] for r in facts if r["part"] == p} for p in width}
    crossed = {}
    if plain := {part: w for part, w in width.items() if not curved[part]}:
        size = sum(8 * (w + 1) ** (2 if w <= CROSSED_WIDTH else 1) for w in plain.values())
        own = blocks.where(F.col("part").isin(list(plain))).mapInArrow(_crossed(plain), _SUMS)
        crossed = {
            part: sums.reshape(width[part] + 1, -1).squeeze() / sum(counts[part].values())
            for (part, _), sums in _gathered(own, size, splits).items()
        }

    def asked(points: Mapping[Key, np.ndarray], of_class: Mapping[Key, np.ndarray]) -> dict[Key, np.ndarray]:
        size = sum(8 * (p.size + 1 + curved[key[0]] * p.size**2) for key, p in points.items())
        mine = blocks.where(F.col("part").isin(sorted({part for part, _ in points})))
        sums = _gathered(mine.mapInArrow(_summed(points, of_class, curved), _SUMS), size, splits)
        return {key: sums[key] / sum(of_class[key][k] * n for k, n in counts[key[0]].items()) for key in points}

    results = _solved(asked, width, counts, params, weights, num_classes, steps, curved, crossed)
    drop_scratch(spark, path)
    return results


Key = tuple[int, int]


def _solved(
    asked: Callable[[Mapping[Key, np.ndarray], Mapping[Key, np.ndarray]], dict[Key, np.ndarray]],
    width: Mapping[int, int],
    counts: Mapping[int, Mapping[int, int]],
    params: Sequence[Mapping[str, Any]],
    weights: Sequence[Sequence[Mapping[int, float]]],
    num_classes: int,
    steps: int,
    curved: Mapping[int, bool],
    crossed: Mapping[int, np.ndarray],
    starts: Mapping[Key, np.ndarray] | None = None,
) -> dict[Key, LogisticFit]:
    """Every fit, from what ``asked`` tells of their points: mean loss, slopes and curvature.

    A fit begins at ``starts`` where that is given, else at the shares of the classes.
    """
    margins = num_classes if num_classes > 2 else 1
    of_class, total, penalty = {}, {}, {}
    for part in width:
        for at, own in enumerate(params):
            held = weights[part][at]
            of_class[part, at] = np.array([held.get(k, 0.0) for k in range(num_classes)])
            total[part, at] = sum(of_class[part, at][k] * n for k, n in counts[part].items())
            penalty[part, at] = 1.0 / (own["C"] * sum(counts[part].values()))

    def search(key: Key, found: list[np.ndarray]) -> Search:
        start = np.zeros((margins, width[key[0]] + 1))
        share = np.array([of_class[key][k] * counts[key[0]].get(k, 0) for k in range(num_classes)]) / total[key]
        share = np.clip(share, 1e-6, 1 - 1e-6)
        start[:, -1] = np.log(share) if margins > 1 else np.log(share[1:] / share[:1])
        near = starts is not None and key in starts
        limit = params[key[1]].get("max_iter", steps)
        if curved[key[0]]:
            return newton((starts[key] if near else start).ravel(), limit, found, NEAR_TOLERANCE if near else TOLERANCE)
        bends = share * (1 - share) if margins > 1 else (share * (1 - share))[1:]
        scale = scaling(crossed[key[0]], bends, penalty[key])
        return descend(start.ravel(), limit, scale, found)

    results: dict[Key, list[np.ndarray]] = {key: [] for key in of_class}
    waiting = list(of_class)
    while waiting:
        most = max(2 * (w + 1) ** 2 if curved[p] else (2 * MEMORY + 4) * margins * (w + 1) for p, w in width.items())
        room = STATE_BYTES // (8 * most)
        group, waiting = waiting[: max(1, room)], waiting[max(1, room) :]
        live = {key: search(key, results[key]) for key in group}
        points = {key: next(fit) for key, fit in live.items()}
        while points:
            shaped = {key: point.reshape(margins, -1) for key, point in points.items()}
            means = asked(shaped, of_class)
            after = {}
            for key, point in shaped.items():
                mean = means[key]
                free = point.copy()
                free[:, -1] = 0.0
                value = mean[0] + 0.5 * penalty[key] * float((free**2).sum())
                slope, curve = mean[1 : point.size + 1] + penalty[key] * free.ravel(), None
                if curved[key[0]]:
                    curve = mean[point.size + 1 :].reshape(point.size, -1).copy()
                    inner = np.arange(point.size - 1)
                    curve[inner, inner] += penalty[key]
                try:
                    after[key] = live[key].send((value, slope, curve))
                except StopIteration:
                    pass
            points = after
    return {key: LogisticFit(found[0].reshape(margins, -1)) for key, found in results.items()}


# --- rows that all parts share --------------------------------------------------------


def judged_lines(weights: np.ndarray, labels: np.ndarray, lines: np.ndarray, of_class: np.ndarray) -> np.ndarray:
    """What ``judged_whole`` gives with second derivatives; a line of the matrix per column, ones last. The weights of the rows follow."""
    margins = weights @ lines
    loss, error, chance = _errors(margins, labels, of_class)
    scaled = lines * np.sqrt(of_class[labels] * chance[0] * chance[1])
    return np.concatenate([[loss], lines @ error[0], (scaled @ scaled.T).ravel(), [of_class[labels].sum()]])


def _summed_lines(
    points: Mapping[Key, np.ndarray], of_class: Mapping[Key, np.ndarray], views: Sequence[View], without: Sequence[int | None]
) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Key, np.ndarray] = {}
        for block in blocks_in(batches):
            for part, view in enumerate(views):
                mine = {key: point for key, point in points.items() if key[0] == part and without[part] != block.part}
                lines = view.matrix(block.numbers, block.codes, block.rows) if mine else None
                for key, point in mine.items():
                    sums = judged_lines(point, block.labels, lines, of_class[key])
                    held[key] = held[key] + sums if key in held else sums
        task = TaskContext.get().partitionId()
        yield from batch_of([(*key, task, sums.astype("<f8").tobytes()) for key, sums in held.items()], _SUMS)

    return run


def fit_shared(
    store: SharedRows,
    keys: Sequence[int | None],
    counts: Sequence[Mapping[int, int]],
    params: Sequence[Mapping[str, Any]],
    weights: Sequence[Sequence[Mapping[int, float]]],
    scaled: bool,
    steps: int = 2000,
) -> dict[Key, LogisticFit]:
    """``fit_all`` of two classes for the encoders ``keys`` of rows that are stored once.

    ``counts`` are the rows of each class. Above ``WARM_ROWS`` rows a search first runs on one lot of the blocks
    and goes on from there with all of them, which takes fewer passes and ends at smaller slopes.
    """
    blocks = store.blocks()
    if any(not sum(c.values()) for c in counts):
        raise ValueError("A fit needs rows in every part.")
    views = [store.view(key, scaled) for key in keys]
    without = [key if store.part else None for key in keys]
    width = {part: view.width for part, view in enumerate(views)}
    curved = dict.fromkeys(width, True)

    def from_rows(held: DataFrame) -> Callable:
        splits = held.rdd.getNumPartitions()

        def asked(points: Mapping[Key, np.ndarray], of_class: Mapping[Key, np.ndarray]) -> dict[Key, np.ndarray]:
            size = sum(8 * (p.size + 2 + p.size**2) for p in points.values())
            sums = _gathered(held.mapInArrow(_summed_lines(points, of_class, views, without), _SUMS), size, splits)
            missing = {key: np.zeros(p.size**2 + p.size + 1) for key, p in points.items()}
            return missing | {key: s[:-1] / s[-1] for key, s in sums.items() if s[-1]}

        return asked

    own = dict(enumerate(counts))
    rest = (width, own, params, weights, 2, steps, curved, {})
    starts = None
    if store.count > WARM_ROWS:
        spark, path = blocks.sparkSession, scratch_path(blocks.sparkSession, "few-rows")
        blocks.where("lot = 0").write.parquet(path)
        few = spark.read.schema(blocks.schema).parquet(path)
        starts = {key: fit.weights for key, fit in _solved(from_rows(few), *rest).items()}
        drop_scratch(spark, path)
    return _solved(from_rows(blocks), *rest, starts)


class LogisticModel(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Add the vector ``probability`` by a fitted ``LogisticFit``; expressions only, no Python."""

    model = Param(Params._dummy(), "model", "weights as JSON", TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector column", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, model: str = "[]", featuresCol: str = "features") -> None:
        super().__init__()
        self._setDefault(model="[]", featuresCol="features")
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = LogisticFit.from_json(self.getOrDefault(self.model)).weights
        rows = dataset.withColumn("_vector", F.unwrap_udt(self.getOrDefault(self.featuresCol)))
        whole = F.sequence(F.lit(0), F.size("_vector.values") - 1)
        places = F.when(F.size("_vector.values") == 0, F.array().cast("array<int>")).otherwise(
            F.coalesce("_vector.indices", whole)
        )
        rows = rows.withColumn("_margins", F.array(*[_margin(places, line) for line in weights.tolist()]))
        scored = rows.withColumn("_chances", _chances("_margins", len(weights)))
        return scored.withColumn("probability", array_to_vector("_chances")).drop("_vector", "_margins", "_chances")

    @property
    def fitted(self) -> LogisticFit:
        return LogisticFit.from_json(self.getOrDefault(self.model))


def _chances(margins: str, count: int) -> Column:
    if count == 1:
        one = 1.0 / (1.0 + F.exp(-F.col(margins)[0]))
        return F.array(1.0 - one, one)
    top = F.array_max(margins)
    odds = F.transform(margins, lambda m: F.exp(m - top))
    total = F.aggregate(odds, F.lit(0.0), lambda a, b: a + b)
    return F.transform(odds, lambda o: o / total)


def scored_columns(
    df: DataFrame, fits: Mapping[str, LogisticFit], plain: Sequence[Column], codes: Sequence[tuple[Column, int]]
) -> DataFrame:
    """Add the array of probabilities of each fit, under its name, without making vectors.

    ``plain`` are the first slots and ``codes`` the place of the one that is set among so many further ones; a place
    outside sets none. Terms are added in the order of the slots, as over a vector.
    """
    names = {name: f"_margins_of_{name}" for name in fits}

    def margin(line: list[float]) -> Column:
        total, at = F.lit(line[-1]), len(plain)
        for value, weight in zip(plain, line, strict=False):
            total = total + value * F.lit(weight)
        for code, size in codes:
            if size:
                total = total + F.coalesce(F.get(F.lit(line[at : at + size]), code.cast("int")), F.lit(0.0))
            at += size
        return total

    lines = {names[name]: F.array(*[margin(line) for line in fit.weights.tolist()]) for name, fit in fits.items()}
    marked = df.withColumns(lines)
    chances = {name: _chances(names[name], len(fit.weights)) for name, fit in fits.items()}
    return marked.withColumns(chances).drop(*names.values())


def _margin(places: Column, line: list[float]) -> Column:
    weights = F.lit(line[:-1])
    terms = F.zip_with(places, F.col("_vector.values"), lambda i, v: F.get(weights, i) * v)
    return F.aggregate(terms, F.lit(line[-1]), lambda a, b: a + b)
