"""Exact order statistics without a global sort.

Sorting a table to read a handful of ranks, or ``percentile``, which keeps every
distinct value in one buffer, does not survive a large input. Here each wanted rank
is bracketed: a mergeable quantile sketch names two values around it, one narrow scan counts
the rows below and between them, and so on until few rows are left, which are then
counted by value. A bracket's rows follow the ranks and not the width of the values, so a column
that spans many powers of ten takes no more scans. Where a sketch misses a rank, equal-width bins
cut its bracket instead. Scans are filtered and combined map-side, so one value held by a third
of all rows costs one group.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from obligor.functions.numeric import known
from obligor.session import col, small_table

BINS = 512
#: Size of a sketch, and how far beside a rank its values are taken, as a share of the rows.
SKETCH_SIZE = 4096
SKETCH_ERROR = 0.002
_SALTS = 64
EXACT_ROWS = 500_000
# Only guards the driver against a group column that holds values.
MAX_GROUPS = 10_000


class Hit(NamedTuple):
    """Value at a zero-based rank, rows strictly below it and rows equal to it."""

    value: Any
    below: int
    ties: int


class Cut(NamedTuple):
    """Last row inside a rank cutoff: its value, and its id where only some ties are in."""

    value: Any
    last_id: Any


@dataclass(frozen=True)
class _Bracket:
    group: str
    low: Any
    high: Any
    below: int
    rows: int
    ranks: tuple[int, ...]


class Extent(NamedTuple):
    rows: int
    low: Any
    high: Any


def group_extents(values: DataFrame) -> dict[str, Extent]:
    """Size and range per group ``g`` of a (g, v) table. Groups are columns or classes: few."""
    rows = (
        values.groupBy("g")
        .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        .limit(MAX_GROUPS + 1)
        .collect()
    )
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"More than {MAX_GROUPS} groups: this is no column or class label.")
    # NaN sorts above every number, so one would show as the largest value.
    if any(isinstance(r["high"], float) and math.isnan(r["high"]) for r in rows):
        raise ValueError("NaN has no rank; make it NULL first.")
    return {r["g"]: Extent(r["n"], r["low"], r["high"]) for r in rows}


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numeric columns as (g, v) rows without NULLs; NaN counts as missing."""
    wide = df.select(*[known(col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot([], [col(c) for c in columns], "g", "v").where("v is not null")


def order_statistics(
    values: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    exact_rows: int = EXACT_ROWS,
    bins: int = BINS,
    extents: Mapping[str, Extent] | None = None,
) -> dict[tuple[str, int], Hit]:
    """Exact value at each zero-based ascending rank of each group.

    ``values`` holds (g string, v numeric) without NULLs and is scanned once per
    pass, so hand in a pinned or directly scanned table.
    """
    wanted = {g: tuple(sorted(set(r))) for g, r in ranks.items() if r}
    if not wanted:
        return {}
    spark = values.sparkSession
    extents = extents or group_extents(values)
    brackets = []
    for group, targets in wanted.items():
        rows, low, high = extents.get(group, Extent(0, None, None))
        if targets[-1] >= rows:
            raise ValueError(f"Rank {targets[-1]} asked of group '{group}' of {rows} rows.")
        brackets.append(_Bracket(group, low, high, 0, rows, targets))

    found: dict[tuple[str, int], Hit] = {}
    while True:
        rest = []
        for bracket in brackets:
            if bracket.low == bracket.high:
                hit = Hit(bracket.low, bracket.below, bracket.rows)
                found.update({(bracket.group, rank): hit for rank in bracket.ranks})
            else:
                rest.append(bracket)
        wide = [b for b in rest if b.rows > exact_rows and float(b.low) < float(b.high)]
        narrow = [b for b in rest if b not in wide]
        if not wide:
            break
        closer, missed = _sketched(spark, values, wide)
        brackets = narrow + closer + (_refine(spark, values, missed, bins) if missed else [])
    if narrow:
        found.update(_count_by_value(spark, values, narrow))
    return found


def _bracketed(
    spark: SparkSession, values: DataFrame, brackets: Sequence[_Bracket]
) -> DataFrame:
    """Rows that fall into a bracket, tagged with its number ``b``.

    Brackets of a group are disjoint, so a row is matched at most once. The bracket
    table has at most one row per wanted rank, which bounds the broadcast.
    """
    kind = values.schema["v"].dataType
    schema = T.StructType(
        [
            T.StructField("g", T.StringType()),
            T.StructField("b", T.IntegerType()),
            T.StructField("low", kind),
            T.StructField("high", kind),
        ]
    )
    rows = [(x.group, i, x.low, x.high) for i, x in enumerate(brackets)]
    table = small_table(spark, rows, schema)
    return values.join(F.broadcast(table), "g").where("v >= low and v <= high")


def _holding(
    spark: SparkSession, counts: DataFrame, order: str, brackets: Sequence[_Bracket]
) -> list[Row]:
    """Of (b, order, n, low, high) counts, the entries that hold a wanted rank.

    Each comes with ``rank`` and ``below``. The window runs inside a bracket, over at
    most the bins or the few rows that are left; at most one row per rank returns.
    """
    running = Window.partitionBy("b").orderBy(order)
    wanted = small_table(
        spark,
        [(i, x.below, rank) for i, x in enumerate(brackets) for rank in x.ranks],
        "b int, start bigint, rank bigint",
    )
    placed = counts.withColumn("through", F.sum("n").over(running))
    return (
        placed.join(F.broadcast(wanted), "b")
        .where("rank - start < through and rank - start >= through - n")
        .withColumn("below", F.expr("start + through - n"))
        .collect()
    )


def _sketched(
    spark: SparkSession, values: DataFrame, brackets: Sequence[_Bracket]
) -> tuple[list[_Bracket], list[_Bracket]]:
    """Brackets around each rank by sketched values, and those in which a rank was missed.

    Sketches of a bracket meet in two steps, so no task receives one from every input split.
    """
    shares = sorted(
        {
            min(max((rank - b.below + 0.5) / b.rows + side * SKETCH_ERROR, 0.0), 1.0)
            for b in brackets
            for rank in b.ranks
            for side in (-1, 1)
        }
    )
    sketches = (
        _bracketed(spark, values, brackets)
        .groupBy("b", (F.spark_partition_id() % _SALTS).alias("salt"))
        .agg(F.kll_sketch_agg_double(F.col("v").cast("double"), F.lit(SKETCH_SIZE)).alias("s"))
        .groupBy("b")
        .agg(F.kll_merge_agg_double("s").alias("s"))
    )
    at = F.array(*[F.lit(share) for share in shares])
    taken = sketches.select("b", F.kll_sketch_get_quantile_double("s", at).alias("q")).collect()
    found = {r["b"]: dict(zip(shares, r["q"], strict=True)) for r in taken}
    # Values taken around neighbouring ranks are one piece, so pieces are disjoint.
    pieces: list[tuple[int, int, float, float]] = []
    asked: list[list[int]] = []
    for i, b in enumerate(brackets):
        for rank in b.ranks:
            share = (rank - b.below + 0.5) / b.rows
            low, high = (found[i][min(max(share + side * SKETCH_ERROR, 0.0), 1.0)] for side in (-1, 1))
            if pieces and pieces[-1][0] == i and low <= pieces[-1][3]:
                pieces[-1] = (i, len(asked) - 1, pieces[-1][2], max(high, pieces[-1][3]))
                asked[-1].append(rank)
            else:
                pieces.append((i, len(asked), low, high))
                asked.append([rank])
    # At most one row per wanted rank.
    table = small_table(spark, pieces, "b int, piece int, low double, high double")
    inside = _bracketed(spark, values, brackets).select("b", "v")
    v = F.col("v").cast("double")
    between = (v >= F.col("low")) & (v <= F.col("high"))
    counted = (
        inside.join(F.broadcast(table), "b")
        .where(v <= F.col("high"))
        .groupBy("b", "piece")
        .agg(
            F.count_if(v < F.col("low")).alias("under"),
            F.count_if(between).alias("n"),
            F.min(F.when(between, F.col("v"))).alias("low"),
            F.max(F.when(between, F.col("v"))).alias("high"),
        )
    )
    closer, reached = [], set()
    for r in counted.collect():
        b = brackets[r["b"]]
        below = b.below + r["under"]
        held = tuple(rank for rank in asked[r["piece"]] if below <= rank < below + r["n"])
        # A bracket that does not shrink is left to the bins.
        if held and r["n"] < b.rows:
            closer.append(_Bracket(b.group, r["low"], r["high"], below, r["n"], held))
            reached.update((r["b"], rank) for rank in held)
    missed = []
    for i, b in enumerate(brackets):
        left = tuple(rank for rank in b.ranks if (i, rank) not in reached)
        if left:
            missed.append(_Bracket(b.group, b.low, b.high, b.below, b.rows, left))
    return closer, missed


def _refine(
    spark: SparkSession, values: DataFrame, brackets: Sequence[_Bracket], bins: int
) -> list[_Bracket]:
    """Replace each bracket by the bins of it that hold its ranks."""
    # Halving first keeps the width finite for any doubles.
    v, low, high = (F.col(c).cast("double") / 2 for c in ("v", "low", "high"))
    slot = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = (
        _bracketed(spark, values, brackets)
        .groupBy("b", slot.alias("slot"))
        .agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    )
    inside: dict[tuple, list[int]] = {}
    for r in _holding(spark, counts, "slot", brackets):
        key = (brackets[r["b"]].group, r["low"], r["high"], r["below"], r["n"])
        inside.setdefault(key, []).append(r["rank"])
    return [_Bracket(*key, tuple(sorted(ranks))) for key, ranks in inside.items()]


def _count_by_value(
    spark: SparkSession, values: DataFrame, brackets: Sequence[_Bracket]
) -> dict[tuple[str, int], Hit]:
    counts = _bracketed(spark, values, brackets).groupBy("b", "v").agg(F.count("v").alias("n"))
    return {
        (brackets[r["b"]].group, r["rank"]): Hit(r["v"], r["below"], r["n"])
        for r in _holding(spark, counts, "v", brackets)
    }


def quantiles(
    values: DataFrame,
    probabilities: Sequence[float],
    **limits: int,
) -> dict[str, list[float]]:
    """Linearly interpolated quantiles of every group of a (g, v) table."""
    extents = group_extents(values)
    sizes = {g: e.rows for g, e in extents.items()}
    spots = {g: [p * (n - 1) for p in probabilities] for g, n in sizes.items() if n}
    ranks = {
        g: [r for s in at for r in (math.floor(s), min(math.floor(s) + 1, sizes[g] - 1))]
        for g, at in spots.items()
    }
    hits = order_statistics(values, ranks, extents=extents, **limits)
    result = {}
    for g, at in spots.items():
        row = []
        for spot in at:
            base = math.floor(spot)
            low = float(hits[g, base].value)
            high = float(hits[g, min(base + 1, sizes[g] - 1)].value)
            row.append(low + (high - low) * (spot - base))
        result[g] = row
    return result


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], exact_rows: int = EXACT_ROWS
) -> dict[str, list[float]]:
    """Exact quantiles of numeric columns, NULLs ignored."""
    found = fold_quantiles(df, [(None, c) for c in columns], probabilities, exact_rows=exact_rows)
    return {c: held for (_, c), held in found.items()}


#: Columns that one aggregate looks at.
WIDE = 20

Group = tuple[int | None, str]


@dataclass(frozen=True)
class _Piece:
    """Values of a column from ``low`` to ``high``: rows under and in them per fold, and the ranks they hold."""

    column: str
    low: float
    high: float
    under: Mapping[Any, int]
    rows: Mapping[Any, int]
    asked: tuple[tuple[int | None, int], ...]
    slack: float = SKETCH_ERROR


def _but(counts: Mapping[Any, int], fold: int | None) -> int:
    """Rows of all folds but one."""
    return sum(n for k, n in counts.items() if fold is None or k != fold)


def _number(name: str):
    return known(col(name).cast("double"))


def _chunks(items: Sequence) -> list[Sequence]:
    return [items[at : at + WIDE] for at in range(0, len(items), WIDE)]


def fold_quantiles(
    df: DataFrame,
    groups: Sequence[Group],
    probabilities: Sequence[float],
    fold_col: str | None = None,
    fills: Mapping[Group, float] | None = None,
    exact_rows: int = EXACT_ROWS,
) -> dict[Group, list[float]]:
    """Interpolated quantiles of (fold left out, column) groups; None leaves out no fold.

    A row is read once a pass for all its columns and groups: counts are taken per fold and added
    up, and only rows in the brackets of a rank become rows of their own. Groups without values
    are absent; those in ``fills`` count missing values as the fill.
    """
    columns = list(dict.fromkeys(c for _, c in groups))
    fold = F.lit(None).cast("int") if fold_col is None else col(fold_col)
    whole: dict[str, _Piece] = {}
    missing: dict[str, dict[Any, int]] = {}
    for part in _chunks(columns):
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(part):
            aggs += [of(_number(c)).alias(f"{n}{i}") for n, of in (("n", F.count), ("a", F.min), ("z", F.max))]
        rows = df.groupBy(fold.alias("fold")).agg(*aggs).collect()
        for i, c in enumerate(part):
            sizes = {r["fold"]: r[f"n{i}"] for r in rows}
            missing[c] = {r["fold"]: r["rows"] - r[f"n{i}"] for r in rows}
            if any(sizes.values()):
                ends = [[r[f"{n}{i}"] for r in rows if r[f"n{i}"]] for n in "az"]
                whole[c] = _Piece(c, min(ends[0]), max(ends[1]), dict.fromkeys(sizes, 0), sizes, ())

    fills = fills or {}
    spots: dict[Group, list[float]] = {}
    wanted: dict[str, set[tuple[int | None, int]]] = {}
    gaps: dict[Group, int] = {}
    for k, c in groups:
        held = _but(whole[c].rows, k) if c in whole else 0
        if not held:
            continue
        gaps[k, c] = _but(missing[c], k) if (k, c) in fills else 0
        last = held + gaps[k, c] - 1
        spots[k, c] = [p * last for p in probabilities]
        for spot in spots[k, c]:
            for rank in (math.floor(spot), min(math.floor(spot) + 1, last)):
                near = {r for r in (rank, rank - gaps[k, c]) if 0 <= r < held}
                wanted.setdefault(c, set()).update((k, r) for r in near)
    pieces = [replace(whole[c], asked=tuple(sorted(asked, key=str))) for c, asked in wanted.items()]
    found = _values_at(df, fold, pieces, exact_rows)

    def value(k: int | None, c: str, rank: int) -> float:
        before = found.get((k, c, rank))
        if (k, c) not in fills or not gaps[k, c]:
            return before
        after = found.get((k, c, rank - gaps[k, c]))
        if before is not None and before < fills[k, c]:
            return before
        return after if after is not None and after > fills[k, c] else fills[k, c]

    result = {}
    for (k, c), at in spots.items():
        last = _but(whole[c].rows, k) + gaps[k, c] - 1
        row = []
        for spot in at:
            base = math.floor(spot)
            low, high = float(value(k, c, base)), float(value(k, c, min(base + 1, last)))
            row.append(low + (high - low) * (spot - base))
        result[k, c] = row
    return result


def _values_at(df: DataFrame, fold, pieces: Sequence[_Piece], exact_rows: int) -> dict[tuple[int | None, str, int], float]:
    found: dict[tuple[int | None, str, int], float] = {}
    ready: list[_Piece] = []
    while pieces:
        wide = []
        for piece in pieces:
            if piece.low == piece.high:
                found.update({(k, piece.column, rank): piece.low for k, rank in piece.asked})
            elif sum(piece.rows.values()) > exact_rows and piece.slack < 0.25:
                wide.append(piece)
            else:
                ready.append(piece)
        pieces = [closer for part in _chunks(wide) for closer in _closer(df, fold, part)]
    for part in _chunks(ready):
        found.update(_counted(df, fold, part))
    return found


def _inside(piece: _Piece):
    v = _number(piece.column)
    return F.when((v >= piece.low) & (v <= piece.high), v)


def _closer(df: DataFrame, fold, pieces: Sequence[_Piece]) -> list[_Piece]:
    """Smaller pieces around the ranks of each piece, by sketched values and one count."""
    # Sketches meet in two steps, so no task receives one from every input split.
    salted = df.groupBy((F.spark_partition_id() % _SALTS).alias("salt")).agg(
        *[F.kll_sketch_agg_double(_inside(p), F.lit(SKETCH_SIZE)).alias(str(i)) for i, p in enumerate(pieces)]
    )
    sketches = salted.drop("salt").unpivot([], [str(i) for i in range(len(pieces))], "p", "s")
    merged = sketches.where("s is not null").groupBy("p").agg(F.kll_merge_agg_double("s").alias("s"))

    def share(piece: _Piece, k: int | None, rank: int, side: int) -> float:
        at = (rank - _but(piece.under, k) + 0.5) / max(_but(piece.rows, k), 1)
        return min(max(at + side * piece.slack, 0.0), 1.0)

    shares = sorted({share(p, *a, side) for p in pieces for a in p.asked for side in (-1, 1)})
    at = F.array(*[F.lit(s) for s in shares])
    taken = merged.select("p", F.kll_sketch_get_quantile_double("s", at).alias("q")).collect()
    quantile = {int(r["p"]): dict(zip(shares, r["q"], strict=True)) for r in taken}
    parts: list[_Piece] = []
    parents: list[_Piece] = []
    for i, p in enumerate(pieces):
        ends = [(quantile[i][share(p, *a, -1)], quantile[i][share(p, *a, 1)], a) for a in p.asked]
        joined: list[tuple[float, float, list]] = []
        for low, high, ask in sorted(ends, key=lambda e: e[:2]):
            if joined and low <= joined[-1][1]:
                joined[-1] = (joined[-1][0], max(high, joined[-1][1]), [*joined[-1][2], ask])
            else:
                joined.append((low, high, [ask]))
        parts += [_Piece(p.column, low, high, {}, {}, tuple(asks), p.slack) for low, high, asks in joined]
        parents += [p] * len(joined)
    out: list[_Piece] = []
    for first in range(0, len(parts), WIDE):
        part = parts[first : first + WIDE]
        aggs = []
        for i, p in enumerate(part):
            own = _inside(p)
            aggs.append(F.count_if(_number(p.column) < p.low).alias(f"u{i}"))
            aggs += [of(own).alias(f"{n}{i}") for n, of in (("n", F.count), ("a", F.min), ("z", F.max))]
        rows = df.groupBy(fold.alias("fold")).agg(*aggs).collect()
        for i, (p, parent) in enumerate(zip(part, parents[first:], strict=False)):
            under, held = ({r["fold"]: r[f"{n}{i}"] for r in rows} for n in "un")
            hit = [a for a in p.asked if 0 <= a[1] - _but(under, a[0]) < _but(held, a[0])]
            lost = tuple(a for a in p.asked if a not in hit)
            if hit:
                low = min(r[f"a{i}"] for r in rows if r[f"n{i}"])
                high = max(r[f"z{i}"] for r in rows if r[f"n{i}"])
                # What does not shrink is counted by value.
                slack = p.slack if sum(held.values()) < sum(parent.rows.values()) else 1.0
                out.append(_Piece(p.column, low, high, under, held, tuple(hit), slack))
            if lost:
                out.append(replace(parent, asked=lost, slack=4 * parent.slack))
    return out


def _counted(df: DataFrame, fold, pieces: Sequence[_Piece]) -> dict[tuple[int | None, str, int], float]:
    """Rows of the pieces counted by value; equal values combine map-side, before groups are told apart."""
    spark = df.sparkSession
    own = F.array_compact(
        F.array(*[F.when(_inside(p).isNotNull(), F.struct(F.lit(i).alias("p"), _inside(p).alias("v"))) for i, p in enumerate(pieces)])
    )
    rows = df.select(fold.alias("fold"), F.explode(own).alias("x")).select("fold", "x.p", "x.v")
    counts = rows.groupBy("p", "fold", "v").agg(F.count(F.lit(1)).alias("n"))
    pairs = list(dict.fromkeys((i, k) for i, p in enumerate(pieces) for k, _ in p.asked))
    # One row per group and column, and one per wanted rank.
    table = small_table(spark, [(i, m, k) for m, (i, k) in enumerate(pairs)], "p int, m int, without int")
    kept = F.col("without").isNull() | ~F.col("fold").eqNullSafe(F.col("without"))
    grouped = counts.join(F.broadcast(table), "p").where(kept).groupBy("m", "v").agg(F.sum("n").alias("n"))
    wanted = small_table(
        spark,
        [(pairs.index((i, k)), rank - _but(p.under, k), rank) for i, p in enumerate(pieces) for k, rank in p.asked],
        "m int, place bigint, rank bigint",
    )
    placed = grouped.withColumn("through", F.sum("n").over(Window.partitionBy("m").orderBy("v")))
    hits = placed.join(F.broadcast(wanted), "m").where("place < through and place >= through - n")
    return {(pairs[r["m"]][1], pieces[pairs[r["m"]][0]].column, r["rank"]): r["v"] for r in hits.collect()}


def rank_cuts(
    rows: DataFrame,
    ranks: Mapping[str, Sequence[int]],
    extents: Mapping[str, Extent] | None = None,
    **limits: int,
) -> dict[tuple[str, int], Cut]:
    """Rows (g, v, id) at ascending (v, id) ranks, as cut points.

    A cut inside a run of equal values gets its id from a second selection over the
    ids of that run alone.
    """
    hits = order_statistics(rows.select("g", "v"), ranks, extents=extents, **limits)
    runs = {
        (g, hit.value) for (g, rank), hit in hits.items() if rank - hit.below < hit.ties - 1
    }
    ids: dict[tuple[str, int], Any] = {}
    if runs:
        spark = rows.sparkSession
        numbered = {run: str(i) for i, run in enumerate(sorted(runs))}
        schema = T.StructType(
            [
                T.StructField("g", T.StringType()),
                T.StructField("v", rows.schema["v"].dataType),
                T.StructField("run", T.StringType()),
            ]
        )
        table = small_table(spark, [(g, v, tag) for (g, v), tag in numbered.items()], schema)
        tied = rows.join(F.broadcast(table), ["g", "v"])
        wanted: dict[str, list[int]] = {}
        for (g, rank), hit in hits.items():
            if (g, hit.value) in numbered:
                wanted.setdefault(numbered[g, hit.value], []).append(rank - hit.below)
        inner = order_statistics(
            tied.select(F.col("run").alias("g"), F.col("id").alias("v")), wanted, **limits
        )
        for (g, rank), hit in hits.items():
            if (g, hit.value) in numbered:
                spot = inner[numbered[g, hit.value], rank - hit.below]
                ids[g, rank] = spot.value
    return {key: Cut(hit.value, ids.get(key)) for key, hit in hits.items()}


def after_cut(v, row_id, cut: Cut):
    """Whether a row comes strictly after the cut in (v, id) order."""
    later = v > F.lit(cut.value)
    if cut.last_id is None:
        return later
    return later | ((v == F.lit(cut.value)) & (row_id > F.lit(cut.last_id)))


def numeric_id(df: DataFrame, id_col: str):
    """Numeric ids as they are, any other type by a 64-bit hash."""
    kind = df.schema[id_col].dataType
    return col(id_col) if isinstance(kind, T.IntegralType) else F.xxhash64(col(id_col))

