"""Consecutive numbers of ordered rows, without a window over a whole group.

Rows are dealt into ranges of (keys, order) and sorted there; a row's number is its
place in its range plus what earlier ranges hold of its group. Only counts per range
and group are summed up, so a group that holds most rows is spread over as many
tasks as any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import written

# monotonically_increasing_id puts the partition above this bit and the row's place in it below
PLACE_BITS = 33


def number_rows(df: DataFrame, keys: list[str], order: list[str], out: str, total: str | None = None) -> DataFrame:
    """Adds ``out`` (from 0, bigint) in the order of ``order`` within ``keys``, and their number of rows as ``total`` if asked for.

    Nulls come first, as in any ascending order, and a null key is a group of its
    own. Rows that are equal in ``order`` are numbered in any order. The sorted
    rows are written once: numbers are the same however often the result is read.
    """
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order]]
    placed = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    placed = placed.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    blocks = placed.groupBy("_part", *keys).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*keys)  # a row for each range of the group
    blocks = blocks.select(F.col("_part").alias("_of"), *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_low",
                           F.coalesce(F.sum("_n").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
                           F.sum("_n").over(own).alias("_total"))
    same = F.col("_part") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    joined = placed.join(blocks, same)
    numbers = [(F.col("_at") - F.col("_low") + F.col("_before")).alias(out)] + ([F.col("_total").alias(total)] if total else [])
    return joined.select(*df.columns, *numbers)
