"""Consecutive ids for new rows without one global window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that differ in their last RANGE_BITS only are one range: at most 2**18 rows, since keys are unique.
RANGE_BITS = 18
# So many ranges (2**16) are summed up together, on each level.
LEVEL_BITS = 16
# Levels end where at most 2**14 ranges are left.
TOP_BITS = 14


def number_rows(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """1-based rank of each row by its unique integer ``key``, of 32 or 64 bits.

    Rows are ranked inside fixed key ranges, in parallel. A range begins after all rows of the ranges before it,
    whose sizes are added up level by level: ranges inside blocks of 2**16 ranges, then those blocks
    inside larger ones, until at most 16384 are left. So no window and no broadcast grows with the rows, however
    wide or sparse the keys. The result depends on the keys alone, so a retried task repeats it.
    """
    bits = 64 if isinstance(df.schema[key].dataType, T.LongType) else 32
    ranged = df.withColumn("_range", F.shiftright(key, RANGE_BITS))
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    starts = range_starts(sizes, bits - RANGE_BITS)
    return (
        ranged.withColumn("_inside", inside)
        .join(F.broadcast(starts) if bits == 32 else starts, "_range")
        .withColumn(name, F.col("_start") + F.col("_inside"))
        .drop("_range", "_inside", "_start")
    )


def range_starts(sizes: DataFrame, bits: int) -> DataFrame:
    """(_range, _start): rows before each range of ``bits`` bits, from (_range, _size)."""
    earlier = (Window.unboundedPreceding, -1)
    if bits <= TOP_BITS:  # one task, of at most 2**TOP_BITS rows
        before = Window.orderBy("_range").rowsBetween(*earlier)
        return sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    grouped = sizes.withColumn("_block", F.shiftright("_range", LEVEL_BITS))
    before = Window.partitionBy("_block").orderBy("_range").rowsBetween(*earlier)
    inner = grouped.select("_range", "_block", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_inner"))
    blocks = grouped.groupBy("_block").agg(F.sum("_size").alias("_size")).withColumnRenamed("_block", "_range")
    above = range_starts(blocks, bits - LEVEL_BITS).select(F.col("_range").alias("_block"), F.col("_start").alias("_above"))
    return inner.join(above, "_block").select("_range", (F.col("_above") + F.col("_inner")).alias("_start"))


def highest(table: DataFrame, key: str) -> Column:
    """Largest id in use (0 for an empty table) as a scalar subquery."""
    return table.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
