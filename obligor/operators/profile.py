"""Schema profiling: what role each column plays, decided from names and values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from obligor.functions.dates import parse_mixed
from obligor.functions.names import matches_any
from obligor.functions.numeric import is_floating, is_number, known, nan_to_null
from obligor.session import col, small_table

# Thresholds, tokens and value orders of the profiling rules.
MAX_NULL_RATE = 0.98
DATE_SHARE = 0.8
DATE_SAMPLE = 100
BOOLEAN_TOKENS = ("0", "1", "Y", "N", "yes", "no")
MIN_ORDINAL_VALUES = 2
MAX_ORDINAL_VALUES = 8
ORDINAL_NAMES = ("grade", "rating", "status", "risk", "quality", "level", "band")
ORDERED_VALUE_SETS = (
    ("none", "low", "medium", "high", "very high"),
    ("unknown", "poor", "fair", "good", "excellent"),
    ("a", "b", "c", "d", "e", "f", "g"),
)
TYPE_ORDER = ("date", "boolean", "ordinal", "numeric", "categorical", "dropped")
# Columns per aggregate, which bounds the size of one plan.
CHUNK = 100
SKETCH_GROUPS = 256


@dataclass(frozen=True)
class ColumnFacts:
    """What one pass over the table says about a column."""

    name: str
    kind: T.DataType
    rows: int
    nulls: int
    constant: bool
    boolean_values: bool
    ordered_set: int | None

    @property
    def null_rate(self) -> float:
        return self.nulls / self.rows if self.rows else float("nan")

    @property
    def dropped(self) -> bool:
        return self.constant or self.null_rate >= MAX_NULL_RATE


@dataclass(frozen=True)
class SchemaProfile:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    ordinal: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    date: list[str] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    def detected(self) -> dict[str, str]:
        """One type per column; on overlap the later of ``TYPE_ORDER`` wins."""
        return {name: kind for kind in TYPE_ORDER for name in getattr(self, kind)}


def is_text(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.CharType, T.VarcharType))


def _is_clock(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def _label(value: Column) -> Column:
    return F.lower(F.trim(value))


def _may_be_ordinal(name: str, kind: T.DataType) -> bool:
    return is_text(kind) and matches_any(name, ORDINAL_NAMES)


def column_facts(df: DataFrame, columns: Sequence[str] | None = None) -> list[ColumnFacts]:
    """Null counts and value-set flags of all columns in one bounded aggregate.

    "At most one distinct value" is min = max, so no distinct counting is needed.
    """
    df = nan_to_null(df)
    names = list(columns if columns is not None else df.columns)
    facts: list[ColumnFacts] = []
    for at in range(0, len(names), CHUNK):
        part = names[at : at + CHUNK]
        aggs = [F.count(F.lit(1)).alias("n")]
        for i, name in enumerate(part):
            c, kind = col(name), df.schema[name].dataType
            aggs.append(F.count(c).alias(f"present_{i}"))
            aggs.append((F.min(c) < F.max(c)).alias(f"varies_{i}"))
            if is_number(kind):
                aggs.append(F.bool_and(c.isin(0, 1)).alias(f"flag_{i}"))
            elif is_text(kind):
                aggs.append(F.bool_and(c.isin(*BOOLEAN_TOKENS)).alias(f"flag_{i}"))
            if _may_be_ordinal(name, kind):
                for k, labels in enumerate(ORDERED_VALUE_SETS):
                    aggs.append(F.bool_and(_label(c).isin(*labels)).alias(f"set_{i}_{k}"))
        row = df.agg(*aggs).first().asDict()
        for i, name in enumerate(part):
            kind = df.schema[name].dataType
            hits = [k for k in range(len(ORDERED_VALUE_SETS)) if row.get(f"set_{i}_{k}")]
            facts.append(
                ColumnFacts(
                    name=name,
                    kind=kind,
                    rows=row["n"],
                    nulls=row["n"] - row[f"present_{i}"],
                    constant=not row[f"varies_{i}"],
                    boolean_values=isinstance(kind, T.BooleanType) or bool(row.get(f"flag_{i}")),
                    ordered_set=hits[0] if hits else None,
                )
            )
    return facts


def first_values(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(column, value) for the first 100 non-null values of each column in id order.

    One scan for all columns: ranks within (column, hash group) leave a bounded number of
    rows per group, and ranks within the column are taken of those.
    """
    wide = df.select(col(id_col).alias("_id"), *[col(name) for name in columns])
    long = wide.unpivot(["_id"], [col(name) for name in columns], "column", "value")
    group = F.pmod(F.xxhash64("_id"), F.lit(SKETCH_GROUPS))
    rows = long.where("value is not null").withColumn("_group", group)
    for keys in (["column", "_group"], ["column"]):
        order = Window.partitionBy(*keys).orderBy("_id", "value")
        rows = rows.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= DATE_SAMPLE)
    return rows.select("column", "value")


def date_shares(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """(column, sampled, parsed) over the leading values of text columns."""
    return (
        first_values(df, columns, id_col)
        .groupBy("column")
        .agg(
            F.count(F.lit(1)).alias("sampled"),
            F.count(parse_mixed(F.col("value"))).alias("parsed"),
        )
    )


def date_columns(df: DataFrame, columns: Sequence[str], id_col: str) -> list[str]:
    """Clock-typed columns and text columns whose leading values mostly parse."""
    text = [c for c in columns if is_text(df.schema[c].dataType)]
    parsed: set[str] = set()
    for at in range(0, len(text), CHUNK):
        shares = date_shares(df, text[at : at + CHUNK], id_col).collect()
        parsed |= {r["column"] for r in shares if r["parsed"] / r["sampled"] >= DATE_SHARE}
    return [c for c in columns if c in parsed or _is_clock(df.schema[c].dataType)]


def _few_values(df: DataFrame, name: str) -> list[Any] | None:
    """Distinct values of a column, or ``None`` when there are too many to list."""
    limit = MAX_ORDINAL_VALUES + 1
    rows = df.where(col(name).isNotNull()).select(col(name)).distinct().limit(limit).collect()
    return None if len(rows) == limit else [r[0] for r in rows]


def infer_ordinal_mappings(
    df: DataFrame,
    configured: Mapping[str, Sequence[Any]] | None = None,
    facts: Sequence[ColumnFacts] | None = None,
    normalize: bool = False,
) -> dict[str, list[Any]]:
    """Value orders: configured ones, plus text columns whose values fit a known order.

    Inferred labels are lower case while values are compared as they are, so a value
    such as "Low" is unknown to the encoder. ``normalize=True`` lists the raw spellings
    in order instead.
    """
    orders = {name: list(values) for name, values in (configured or {}).items()}
    for fact in facts if facts is not None else column_facts(df):
        if fact.name in orders or fact.ordered_set is None:
            continue
        values = _few_values(df, fact.name)
        if values is None or len(values) < MIN_ORDINAL_VALUES:
            continue
        labels = ORDERED_VALUE_SETS[fact.ordered_set]
        spelled = {value: value.strip().lower() for value in sorted(values)}
        if normalize:
            orders[fact.name] = sorted(spelled, key=lambda v: (labels.index(spelled[v]), v))
        else:
            present = set(spelled.values())
            orders[fact.name] = [label for label in labels if label in present]
    return orders


def roles(
    facts: Sequence[ColumnFacts], orders: Mapping[str, Sequence[Any]], dates: Sequence[str]
) -> SchemaProfile:
    """Apply the role rules to known facts.

    Dropping comes first. A column with a value order stays ordinal even when it is
    also numeric, boolean or a date, and is then encoded once per role.
    """
    kept = [f for f in facts if not f.dropped]
    names = [f.name for f in kept]
    date = [n for n in names if n in dates]
    boolean = [f.name for f in kept if f.boolean_values and f.name not in date]
    ordinal = [n for n in orders if n in names]
    numeric = [f.name for f in kept if is_number(f.kind) and f.name not in boolean]
    taken = {*date, *boolean, *ordinal, *numeric}
    return SchemaProfile(
        numeric=numeric,
        categorical=[n for n in names if n not in taken],
        ordinal=ordinal,
        boolean=boolean,
        date=date,
        dropped=[f.name for f in facts if f.dropped],
    )


def profile_schema(
    df: DataFrame,
    id_col: str,
    configured: Mapping[str, Sequence[Any]] | None = None,
    facts: Sequence[ColumnFacts] | None = None,
    normalize: bool = False,
    dates: Sequence[str] | None = None,
) -> tuple[SchemaProfile, dict[str, list[Any]]]:
    """Column roles and value orders of every column but the id.

    ``dates`` names the date columns where they are known already.
    """
    df = nan_to_null(df)
    columns = [c for c in df.columns if c != id_col]
    facts = list(facts if facts is not None else column_facts(df, columns))
    orders = infer_ordinal_mappings(df, configured, facts, normalize)
    if dates is None:
        dates = date_columns(df, [f.name for f in facts if not f.dropped], id_col)
    return roles(facts, orders, dates), orders


def as_text(df: DataFrame, name: str) -> Column:
    """Value as text; distinct values stay distinct and -0.0 equals 0.0."""
    kind = df.schema[name].dataType
    if is_floating(kind):
        return (known(col(name)) + F.lit(0.0)).cast("string")
    if isinstance(kind, T.BooleanType):
        return F.initcap(col(name).cast("string"))
    return col(name).cast("string")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, rows) for the non-null values of several columns.

    One shuffle keyed by column and value, combined map-side, so neither a frequent
    value nor a wide column ends in one task.
    """
    wide = df.select(*[as_text(df, c).alias(c) for c in columns])
    return (
        wide.unpivot([], [col(c) for c in columns], "column", "value")
        .where("value is not null")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def distinct_estimates(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Estimated distinct values per column, to tell long value lists from short ones.

    Sketches are merged in two steps, so that no task receives one from every split.
    """
    estimates: dict[str, int] = {}
    for at in range(0, len(columns), CHUNK):
        part = list(columns)[at : at + CHUNK]
        sketches = [F.hll_sketch_agg(as_text(df, c)).alias(f"s{i}") for i, c in enumerate(part)]
        merged = [
            F.hll_sketch_estimate(F.hll_union_agg(f"s{i}")).alias(f"e{i}") for i in range(len(part))
        ]
        group = F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_group")
        row = df.groupBy(group).agg(*sketches).agg(*merged).first()
        estimates.update({c: row[f"e{i}"] or 0 for i, c in enumerate(part)})
    return estimates


def unique_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, unique_values) with zero for an all-null column."""
    counted = value_counts(df, columns).groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_values")
    )
    names = small_table(df.sparkSession, [(c,) for c in columns], "column string")
    return names.join(counted, "column", "left").select(
        "column", F.coalesce("unique_values", F.lit(0)).alias("unique_values")
    )


def detect_columns(df: DataFrame, id_col: str) -> DataFrame:
    """(column, detected_type, unique_values) for every column but the id."""
    columns = [c for c in df.columns if c != id_col]
    found = profile_schema(df, id_col)[0].detected()
    kinds = small_table(
        df.sparkSession,
        [(c, found.get(c, "categorical")) for c in columns], "column string, detected_type string"
    )
    return kinds.join(unique_counts(df, columns), "column")


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_rate), highest first."""
    names = list(columns if columns is not None else df.columns)
    rates = nan_to_null(df).agg(*[F.avg(col(c).isNull().cast("int")).alias(c) for c in names])
    return rates.unpivot([], [col(c) for c in names], "column", "missing_rate").orderBy(
        F.desc("missing_rate"), "column"
    )


def top_missing(df: DataFrame, columns: Sequence[str] | None = None, k: int = 20) -> DataFrame:
    """The k highest missing rates, then without the zeros."""
    return missing_summary(df, columns).limit(k).where("missing_rate > 0")


def ordinal_values(df: DataFrame, name: str) -> DataFrame:
    """(position, label) of the known order that the values of a column fit."""
    window = Window.orderBy("labels_at", "position")
    sets = small_table(
        df.sparkSession,
        [
            (k, i, label)
            for k, labels in enumerate(ORDERED_VALUE_SETS)
            for i, label in enumerate(labels)
        ],
        "labels_at int, position int, label string",
    )
    seen = df.where(col(name).isNotNull()).select(_label(col(name)).alias("label")).distinct()
    known = seen.join(F.broadcast(sets), "label")
    fitting = (
        known.groupBy("labels_at")
        .agg(F.count("*").alias("hits"))
        .join(F.broadcast(seen.agg(F.count("*").alias("labels"))), F.col("hits") == F.col("labels"))
        .agg(F.min("labels_at").alias("labels_at"))
    )
    return (
        sets.join(F.broadcast(fitting), "labels_at")
        .join(seen, "label")
        .select((F.row_number().over(window) - 1).alias("position"), "label")
    )
