"""Shards as runs of a Hilbert curve over several metadata columns.

Each column is quantised to four bits: a category by a hash, which keeps equal values
together, and a number by its length in binary. The curve index of a row comes from a
table with one row per cell (4,096 for three columns, whatever the input). Rows are sorted
by (curve index, id) across the cluster; a row's place is its place within its partition
plus the rows of the partitions before, one number per partition. Runs of equal length
are the shards, so each shard holds a compact box of (column, column, column) and most
files can be skipped by any of the columns.

A hot cell is cut by the ids within it, so no task receives a whole cell.

Law ``rows``: the counts of two shards differ by one at most. Defined results: a null text
has size 1 and the checksum of an empty one; null metadata is a category of its own or the
number 0; rows with a null id come first in their cell; repeated rows are placed each; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from obligor.session import pin, small_table

SHARDS = 8
#: Bits of each quantised column.
BITS = 4


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Place of a cell on the Hilbert curve through a cube of ``2 ** bits`` cells a side.

    Works from the coarsest bit down: the Gray code of the bits so far says which corner
    of the cube is entered, and the axes are exchanged or mirrored for the next level.
    """
    axes = list(point)
    n = len(axes)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for i in range(n):
            if axes[i] & level:
                axes[0] ^= low
            else:
                swap = (axes[0] ^ axes[i]) & low
                axes[0] ^= swap
                axes[i] ^= swap
        level >>= 1
    for i in range(1, n):
        axes[i] ^= axes[i - 1]
    mirror = 0
    level = 1 << (bits - 1)
    while level > 1:
        if axes[-1] & level:
            mirror ^= level - 1
        level >>= 1
    axes = [axis ^ mirror for axis in axes]
    index = 0
    for bit in reversed(range(bits)):
        for axis in axes:
            index = index << 1 | axis >> bit & 1
    return index


def by_category(column: Column) -> Column:
    """Four bits of a category: the first hexadecimal digit of its MD5."""
    digit = F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), 1, 1)
    return F.conv(digit, 16, 10).cast("int")


def by_magnitude(column: Column) -> Column:
    """Four bits of a count: its length in binary, at most 15."""
    value = F.greatest(F.coalesce(column.cast("long"), F.lit(0)), F.lit(0).cast("long"))
    return F.when(value == 0, 0).otherwise(F.least(F.length(F.bin(value)), F.lit(2**BITS - 1))).cast("int")


def hilbert_shards(
    df: DataFrame,
    cells: list[Column],
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, curve), one row per row.

    ``cells`` are columns of ``df`` quantised to ``BITS`` bits.
    """
    spark = df.sparkSession
    names = [f"cell_{i}" for i in range(len(cells))]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[cell.alias(name) for cell, name in zip(cells, names, strict=True)],
    )
    # 2 ** (BITS * columns) rows, whatever the input.
    curve = small_table(
        spark,
        [(*p, hilbert_index(p, BITS)) for p in product(range(1 << BITS), repeat=len(cells))],
        ", ".join(f"{name} int" for name in [*names, "curve"]),
    )
    # Written first: cutting ranges reads its input twice.
    placed = pin(rows.join(F.broadcast(curve), names).drop(*names), "curve")
    order = ["curve", "doc_id", "text_crc32"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        placed.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    # The id holds the partition above its lower 33 bits and the row within it below.
    ordered = pin(
        ordered.withColumn("part", F.shiftright("at", 33)).withColumn(
            "at", F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "ordered",
    )
    counts = ordered.groupBy("part").agg(F.count("*").alias("rows"))
    before = counts.select(
        "part",
        (F.sum("rows").over(W.orderBy("part")) - F.col("rows")).alias("before"),
        F.sum("rows").over(W.partitionBy()).alias("total"),
    )
    # One row per shuffle partition.
    ranked = ordered.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at"))
    shard = F.expr(f"rank * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )
