"""Consecutive numbers for the rows of a large table, without a window over all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varilake.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row within it below


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with n from 1 in the order of key: a range sort, then each partition's rows counted on from those before it.

    The sorted table is written once, so that counts and numbers come from the same partitions.
    """
    placed = materialize(df.orderBy(key).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_m"))
    # one row per partition
    before = F.coalesce(F.sum("_m").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn("n", F.col("_before") + row + 1).drop("_id", "_part", "_before")
