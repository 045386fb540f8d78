"""Running totals and dense row numbers that never need one global task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obligor.session import pin

WINDOW_ROWS = 1_000_000
SAMPLE_PER_CELL = 100


def cell_edges(table: DataFrame, order: str, rows: int, window_rows: int) -> list[float]:
    """Split points that spread ``order`` over cells of about ``window_rows`` rows.

    Their number follows the rows: the driver holds one number per ``window_rows`` rows.
    They only balance the work: any split points give the same totals, so a sample
    is enough to choose them.
    """
    cells = -(-rows // window_rows)
    if cells <= 1:
        return []
    share = min(1.0, SAMPLE_PER_CELL * cells / rows)
    sample = table.sample(fraction=share, seed=7)
    steps = [i / cells for i in range(1, cells)]
    return sorted(set(sample.approxQuantile(order, steps, 1 / (4 * cells))))


def with_cell(table: DataFrame, order: str, edges: Sequence[float], name: str) -> DataFrame:
    """Cell number by binary search over the edges, inside the JVM."""
    if not edges:
        return table.withColumn(name, F.lit(0.0))
    splits = [-float("inf"), *edges, float("inf")]
    return Bucketizer(splits=splits, inputCol=order, outputCol=name).transform(table)


def running_totals(
    table: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    descending: bool = False,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add ``<s>_before`` for each ``s``: its total over earlier rows of the same keys.

    ``order`` is numeric and unique within keys, and ``table`` is pinned. A table of
    up to ``window_rows`` rows uses one window per key. A larger one is cut into cells
    by value: the totals of earlier cells are added to a window inside each cell.
    """
    keys = list(keys)
    rows = table.count()
    edges = cell_edges(table, order, rows, window_rows)
    way = F.desc if descending else F.asc
    if not edges:
        inside = Window.partitionBy(*keys).orderBy(way(order))
        return table.withColumns({f"{s}_before": F.sum(s).over(inside) - F.col(s) for s in sums})
    celled = with_cell(table, order, edges, "cell")
    totals = celled.groupBy(*keys, "cell").agg(*[F.sum(s).alias(f"{s}_cell") for s in sums])
    across = Window.partitionBy(*keys).orderBy(way("cell"))
    offsets = totals.select(
        *keys,
        "cell",
        *[(F.sum(f"{s}_cell").over(across) - F.col(f"{s}_cell")).alias(f"{s}_offset") for s in sums],
    )
    inside = Window.partitionBy(*keys, "cell").orderBy(way(order))
    placed = celled.join(offsets, [*keys, "cell"])
    return placed.select(
        *table.columns,
        *[
            (F.col(f"{s}_offset") + F.sum(s).over(inside) - F.col(s)).alias(f"{s}_before")
            for s in sums
        ],
    )


def dense_index(df: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """Number rows 0..n-1 in the given order by a range shuffle.

    Rows are range-partitioned and sorted, numbered inside their partition, and
    written down so that the numbering cannot change; partition offsets (one row per
    shuffle partition) are then added.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = pin(ranged.withColumn("_n", F.monotonically_increasing_id()), "indexed")
    # The id packs the partition above bit 33 and the row number below it.
    part = F.shiftright("_n", 33)
    inside = F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    marked = numbered.withColumns({"_part": part, "_n": inside})
    sizes = marked.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select(
        "_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start")
    )
    return marked.join(F.broadcast(offsets), "_part").select(
        *df.columns, (F.col("_start") + F.col("_n")).cast("bigint").alias(name)
    )
