"""Numbered lines of text files of any size.

A file is read in splits. A line's number is its place in its split plus the lines
of earlier splits (and earlier files), from one count per split; no text is
shuffled, and no task reads more than its splits, however long a log is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.functions.text import LINE_BREAK


def numbered_lines(spark: SparkSession, path: str, across_files: bool = False) -> DataFrame:
    """(file, line_no, line): lines from 0 in each file, or over all files of the folder in the order of their names.

    Lines end as in Python's splitlines(). Line feeds and carriage returns split
    the file; a line that holds one of the rarer separators is split further, and
    where a file ends in one of those, an empty last line is counted.
    """
    m = F.col("_metadata")
    rows = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.split("value", LINE_BREAK).alias("parts"))
    # lines of a split come one after another, and the same files give the same splits
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("low"), F.sum(F.size("parts")).alias("n"), F.max(F.size("parts")).alias("most"))
    order = Window.orderBy("file", "block") if across_files else Window.partitionBy("file").orderBy("block")  # a row for each split
    splits = splits.select(F.col("file").alias("of_file"), F.col("block").alias("of_block"), "low", "most",
                           F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    joined = rows.join(splits, (F.col("file") == F.col("of_file")) & (F.col("block") == F.col("of_block")))
    # where some line of a split is split further, its lines count up to theirs
    within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    plain = joined.where("most = 1").select("file", (F.col("at") - F.col("low") + F.col("before")).alias("first"), "parts")
    odd = joined.where("most > 1").select("file", (F.coalesce(F.sum(F.size("parts")).over(within), F.lit(0)) + F.col("before")).alias("first"), "parts")
    lines = plain.union(odd).select("file", "first", F.posexplode("parts").alias("k", "line"))
    return lines.select("file", (F.col("first") + F.col("k")).alias("line_no"), "line")
