"""Model explanations: permutation importance, partial dependence, sampled Shapley values.

A model is any function from a DataFrame with feature columns to the same rows with an
array column ``probs``.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator, Sequence
from itertools import islice
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from obligor.operators.packing import packed_auc
from obligor.operators.running import SAMPLE_PER_CELL, WINDOW_ROWS, dense_index
from obligor.operators.selection import column_quantiles
from obligor.operators.splitting import fixed_sample
from obligor.session import col, pin, reach_workers, unmeasured_batches

Predict = Callable[[DataFrame], DataFrame]

# Repeats, grid and sample sizes.
REPEATS = 10
GRID_POINTS = 100
GRID_LOW, GRID_HIGH = 0.05, 0.95
PDP_FEATURES = 3
SHAP_ROWS = 50
SHAP_TOP = 12
# Rows whose features one task holds as a hash table while others look up their partner.
PARTNER_ROWS = 250_000


def candidate_maps(seed: int) -> Iterator[tuple[int, int]]:
    """(step, shift) pairs in a fixed order, whatever the table."""
    draw = random.Random(seed)
    while True:
        yield draw.randrange(1, 1 << 20), draw.randrange(1 << 20)


def _rotations(rows: int, repeats: int, seed: int) -> list[tuple[int, int]]:
    """The first maps i -> (step * i + shift) mod rows that are one-to-one."""
    return list(islice((m for m in candidate_maps(seed) if gcd(m[0], rows) == 1), repeats))


def _indexed(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, int]:
    """The rows with a dense number ``_i``, and how many there are."""
    # dense_index has written the rows already; partner numbers are added as they are read.
    rows = dense_index(df, order, "_i")
    return rows, rows.count()


def _permuted(
    rows: DataFrame, n: int, features: Sequence[str], maps: Sequence[tuple[int, int]], plain: Sequence[str]
) -> DataFrame:
    """(_f, _r, plain, features): every row once a feature and repeat, that feature taken from its partner.

    Feature number ``len(features)`` leaves a row as it is; it comes in the first repeat only.
    """
    steps = F.array(
        *[
            F.struct(F.lit(r).alias("r"), F.lit(a).cast("bigint").alias("a"), F.lit(b).cast("bigint").alias("b"))
            for r, (a, b) in enumerate(maps)
        ]
    )
    left = rows.withColumn("_m", F.explode(steps)).select(
        *[col(c) for c in (*plain, *features)],
        F.col("_m.r").alias("_r"),
        F.pmod(F.col("_m.a") * F.col("_i") + F.col("_m.b"), F.lit(n)).alias("_j"),
    )
    partners = rows.select(F.col("_i").alias("_j"), F.struct(*[col(c) for c in features]).alias("_other"))
    # Hashed partners spare the sort of the side that grows with the repeats.
    parts = -(-n // PARTNER_ROWS)
    if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        left, partners = left.repartition(parts, "_j"), partners.repartition(parts, "_j")
    last = F.when(F.col("_r") == 0, F.lit(len(features))).otherwise(F.lit(len(features) - 1))
    paired = left.join(partners.hint("shuffle_hash"), "_j").withColumn("_f", F.explode(F.sequence(F.lit(0), last)))
    return paired.select(
        "_f",
        "_r",
        *[col(c) for c in plain],
        *[
            F.when(F.col("_f") == k, F.col("_other")[c]).otherwise(col(c)).alias(c)
            for k, c in enumerate(features)
        ],
    )


def _class_scores(scored: DataFrame, y: str, num_classes: int) -> DataFrame:
    """(_f, _r, _class, hit, score): class 1 of two classes, each one against the rest of more.

    Scores may be NULL: a condition on them here would compute each one twice.
    """
    if num_classes > 2:
        rows = scored.select("_f", "_r", col(y).alias("_y"), F.posexplode("probs").alias("_class", "score"))
        hit = F.col("_y") == F.col("_class")
    else:
        rows = scored.select("_f", "_r", col(y).alias("_y"), F.lit(0).alias("_class"), F.col("probs")[1].alias("score"))
        hit = F.col("_y") == 1
    # -0.0 and 0.0 are one score.
    score = F.col("score").cast("double") + F.lit(0.0)
    return rows.where(F.col("_y").isNotNull()).select(
        "_f", "_r", "_class", hit.alias("hit"), score.alias("score")
    )


def permutation_importance(
    df: DataFrame,
    predict: Predict,
    y: str,
    features: Sequence[str],
    id_col: str,
    num_classes: int = 2,
    repeats: int = REPEATS,
    seed: int = 42,
    key: Column | None = None,
    cell_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """(feature, importance_mean, importance_std), most important first.

    Rows get a dense number in the order of ``key``, by default a hash of the id. Each repeat pairs every row with a partner
    through a one-to-one map of these numbers, in one equi-join for all repeats; a
    feature is then permuted by taking the partner's value. As every feature uses the
    partners of the repeat, the join does not grow with the number of features. Scores
    are shuffled once, packed, in cells of about ``cell_rows`` of a feature and repeat.
    """
    key = F.xxhash64(F.lit(seed), col(id_col)) if key is None else key
    plain = [id_col, y]
    order = [key, col(id_col)]
    rows, n = _indexed(df.select(*[col(c) for c in (*plain, *features)]), order)

    def scores(of: DataFrame, size: int, times: int) -> DataFrame:
        permuted = _permuted(of, size, features, _rotations(size, times, seed), plain)
        return _class_scores(predict(permuted), y, num_classes)

    spark = df.sparkSession
    edges: dict[tuple[int, int], list[float]] = {}
    cells = -(-n // cell_rows)
    if cells > 1:
        # Rows permuted among a sample have the same distribution; edges only balance the cells.
        sample = rows.drop("_i").sample(fraction=min(1.0, SAMPLE_PER_CELL * cells / n), seed=7)
        few, size = _indexed(sample, order)
        steps = [i / cells for i in range(1, cells)]
        if size:
            places = scores(few, size, 1).groupBy("_f", "_class").agg(F.percentile_approx("score", steps, 100 * cells))
            with unmeasured_batches(spark):
                edges = {(f, k): sorted(set(at)) for f, k, at in places.collect()}
    with unmeasured_batches(spark):
        aucs = pin(packed_auc(scores(rows, n, repeats), edges), "importances")
    # A class without rows makes the score undefined, as a single class does.
    weighted = F.when(
        F.count_if(F.col("roc_auc").isNull()) == 0,
        F.try_divide(F.sum(F.col("roc_auc") * F.col("positives")), F.sum("positives")),
    )
    whole = weighted if num_classes > 2 else F.first("roc_auc")
    drops = aucs.groupBy("_f", "_r").agg(whole.alias("roc_auc"))
    base = drops.where(F.col("_f") == len(features)).first()
    base_score = F.lit(base["roc_auc"] if base else None).cast("double")
    names = F.array(*[F.lit(c) for c in features])
    return (
        drops.where(F.col("_f") < len(features))
        .groupBy(names[F.col("_f")].alias("feature"))
        .agg(
            F.avg(base_score - F.col("roc_auc")).alias("importance_mean"),
            F.stddev_pop(base_score - F.col("roc_auc")).alias("importance_std"),
        )
        .orderBy(F.desc("importance_mean"), "feature")
    )


def top_importance(importance: DataFrame, k: int) -> DataFrame:
    return importance.orderBy(F.desc("importance_mean"), "feature").limit(k)


def dependence_grid(df: DataFrame, feature: str) -> list[float]:
    """Even steps between the 5th and 95th percentile, or all values when they are few."""
    present = df.where(col(feature).isNotNull()).select(col(feature).cast("double").alias("v"))
    # A sketch tells clearly long lists apart, so only short ones are ever shuffled.
    if present.agg(F.approx_count_distinct("v")).first()[0] < 2 * GRID_POINTS:
        values = present.distinct().limit(GRID_POINTS).collect()
        if len(values) < GRID_POINTS:
            return sorted(r["v"] for r in values)
    low, high = column_quantiles(df, [feature], [GRID_LOW, GRID_HIGH])[feature]
    step = (high - low) / (GRID_POINTS - 1)
    return [low + i * step for i in range(GRID_POINTS)]


def partial_dependence(
    df: DataFrame, predict: Predict, features: Sequence[str], klass: int = 1
) -> DataFrame:
    """(feature, grid_value, average): mean prediction with the feature set to a value.

    Every row is expanded by the grid (at most 100 literals) map-side and averages
    combine before the only shuffle.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    result = None
    for feature in [f for f in features if f in numeric][:PDP_FEATURES]:
        grid = F.array(*[F.lit(v) for v in dependence_grid(df, feature)])
        spread = df.withColumn("_at", F.explode(grid)).withColumn(feature, F.col("_at"))
        part = (
            predict(spread)
            .groupBy(F.lit(feature).alias("feature"), F.col("_at").alias("grid_value"))
            .agg(F.avg(F.col("probs")[klass]).alias("average"))
        )
        result = part if result is None else result.unionByName(part)
    if result is None:
        raise ValueError("No numeric feature to show.")
    return result


def shapley_values(
    df: DataFrame,
    predict: Predict,
    features: Sequence[str],
    id_col: str,
    klass: int = 1,
    rows: int = SHAP_ROWS,
    orders: int = 4,
    seed: int = 42,
    key: Column | None = None,
) -> DataFrame:
    """(id, feature, shapley): sampled Shapley values of a fixed sample of rows.

    The sample is also the background. For each sampled feature order and its reverse,
    features switch from a background row to the explained row one by one; a feature's
    value is the mean change of the prediction at its switch, so the values of a row sum
    to its prediction minus the mean background prediction.
    """
    features = list(features)
    sample = pin(fixed_sample(df, id_col, rows, seed, key).select(col(id_col), *map(col, features)))
    count = len(features)
    places = feature_orders(count, orders, seed)
    # The background has at most `rows` rows: it travels as one array.
    background = sample.agg(
        F.collect_list(F.struct(*[col(c) for c in features])).alias("_background")
    ).withColumn("_one", F.lit(1))
    points = (
        sample.withColumn("_one", F.lit(1))
        .join(F.broadcast(background), "_one")
        .withColumn("_b", F.explode("_background"))
        .drop("_background", "_one")
        .withColumn(
            "_o", F.explode(F.array(*[F.array(*[F.lit(p) for p in place]) for place in places]))
        )
        .withColumn("_switched", F.explode(F.sequence(F.lit(0), F.lit(count))))
        .select(
            col(id_col),
            "_o",
            "_switched",
            *[
                F.when(F.col("_o")[k] < F.col("_switched"), col(c))
                .otherwise(F.col("_b")[c])
                .alias(c)
                for k, c in enumerate(features)
            ],
        )
    )
    means = (
        predict(points)
        .groupBy(col(id_col), "_o", "_switched")
        .agg(F.avg(F.col("probs")[klass]).alias("_mean"))
    )
    steps = Window.partitionBy(col(id_col), "_o").orderBy("_switched")
    change = F.col("_mean") - F.lag("_mean").over(steps)
    names = F.array(*[F.lit(c) for c in features])
    gained = means.withColumn("_gain", change).where("_switched > 0")
    at = (F.array_position("_o", F.col("_switched") - 1) - 1).cast("int")
    return gained.groupBy(col(id_col), names[at].alias("feature")).agg(
        F.avg("_gain").alias("shapley")
    )


def feature_orders(count: int, orders: int, seed: int) -> list[list[int]]:
    """Sampled orders of the features and their reverses, as the place of each feature."""
    draw = random.Random(seed)
    places: list[list[int]] = []
    for _ in range(orders):
        order = list(range(count))
        draw.shuffle(order)
        for way in (order, order[::-1]):
            place = [0] * count
            for at, k in enumerate(way):
                place[k] = at
            places.append(place)
    return places


_POINT = T.StructType(
    [
        T.StructField("_row", T.IntegerType()),
        T.StructField("_gained", T.IntegerType()),
        T.StructField("_next", T.IntegerType()),
        T.StructField("features", VectorUDT()),
    ]
)


def _walks(
    row: int, own: dict[int, float], backgrounds: Sequence[dict[int, float]], places: np.ndarray, width: int
) -> Iterator[pa.RecordBatch]:
    """Points on the ways from each background row to one row; only columns that differ are steps."""
    for background in backgrounds:
        differ = np.array([k for k in {*own, *background} if own.get(k, 0.0) != background.get(k, 0.0)], np.int64)
        rows, gained, following, indices, values = [], [], [], [], []
        for place in places:
            steps = differ[np.argsort(place[differ], kind="stable")].tolist()
            at = dict(background)
            for k, after in zip([-1, *steps], [*steps, -1], strict=True):
                if k >= 0:
                    at[k] = own.get(k, 0.0)
                held = sorted(i for i, v in at.items() if v)
                rows.append(row)
                gained.append(k)
                following.append(after)
                indices.append(held)
                values.append([at[i] for i in held])
        vectors = pa.StructArray.from_arrays(
            [
                pa.array([0] * len(rows), pa.int8()),
                pa.array([width] * len(rows), pa.int32()),
                pa.array(indices, pa.list_(pa.int32())),
                pa.array(values, pa.list_(pa.float64())),
            ],
            names=["type", "size", "indices", "values"],
        )
        facts = [pa.array(v, pa.int32()) for v in (rows, gained, following)]
        yield pa.RecordBatch.from_arrays([*facts, vectors], names=_POINT.names)


def shapley_of_vectors(
    df: DataFrame,
    predict: Predict,
    names: Sequence[str],
    id_col: str,
    klass: int = 1,
    orders: int = 4,
    seed: int = 42,
) -> DataFrame:
    """(id, feature, shapley) of the rows of a bounded sample over the slots of ``features``.

    The same values as ``shapley_values`` of the slots as columns: a switch of a slot that is
    equal in both rows changes nothing, so a walk only steps through those that differ.
    Its length follows the filled slots of two rows, not the number of categories. Slots
    with an empty name are not reported.
    """
    spark = df.sparkSession
    reach_workers(spark)
    # The sample is a few rows, and the background of each of them.
    sample = df.select(col(id_col).alias("id"), F.unwrap_udt("features").alias("v")).orderBy("id").collect()
    held = [filled_slots(r["v"]) for r in sample]
    ids = spark.createDataFrame(
        [(i, r["id"]) for i, r in enumerate(sample)],
        T.StructType([T.StructField("_row", T.IntegerType()), T.StructField(id_col, df.schema[id_col].dataType)]),
    )
    width = len(names)
    places = np.array(feature_orders(width, orders, seed), np.int32)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column("_row").to_pylist():
                yield from _walks(row, held[row], held, places, width)

    walked = ids.select("_row").repartition(max(1, len(sample))).mapInArrow(points, _POINT)
    scored = predict(walked).select("_row", "_gained", "_next", F.col("probs")[klass].alias("p"))
    # Each point ends the step of one slot and begins that of the next.
    shares = scored.select(
        "_row",
        F.explode(
            F.array(F.struct(F.col("_gained").alias("k"), F.col("p")), F.struct(F.col("_next").alias("k"), (-F.col("p")).alias("p")))
        ).alias("s"),
    ).where("s.k >= 0")
    total = shares.groupBy("_row", F.col("s.k").alias("k")).agg((F.sum("s.p") / (len(sample) * len(places))).alias("value"))
    every = ids.select("_row", col(id_col), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("k"))
    label = spark.createDataFrame([(k, name) for k, name in enumerate(names) if name], "k int, feature string")
    return (
        every.join(total, ["_row", "k"], "left")
        .join(label, "k")
        .select(col(id_col), "feature", F.coalesce("value", F.lit(0.0)).alias("shapley"))
    )


def filled_slots(vector: Row) -> dict[int, float]:
    """The values of an unwrapped vector that are not zero, by slot."""
    places = vector["indices"] if vector["indices"] is not None else range(len(vector["values"]))
    return {k: v for k, v in zip(places, vector["values"], strict=True) if v}


def shapley_summary(values: DataFrame, k: int = SHAP_TOP) -> DataFrame:
    """(feature, mean_abs_shapley), the k largest."""
    return (
        values.groupBy("feature")
        .agg(F.avg(F.abs("shapley")).alias("mean_abs_shapley"))
        .orderBy(F.desc("mean_abs_shapley"), "feature")
        .limit(k)
    )
