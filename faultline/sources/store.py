"""Versioned tables in shared storage: new folders and an append-only pointer table.

A version's data go to a folder that no other attempt uses; then one row per
part is appended to ``_versions`` in one file, whose
commit is the switch. Nothing that a reader may hold is ever overwritten, so a
failed or repeated writer leaves the newest complete version as it was.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTERS = "part int, seq long, written long, path string"


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; any other trouble with the storage raises."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def pointers(spark: SparkSession, base: str) -> DataFrame | None:
    """The pointer table, or None when no version was ever written."""
    where = f"{base}/_versions"
    return spark.read.schema(POINTERS).parquet(where) if _exists(spark, where) else None


def current(spark: SparkSession, base: str, before: int | None = None) -> dict[int, str]:
    """The newest path of each part, of versions numbered below ``before``."""
    table = pointers(spark, base)
    if table is None:
        return {}
    if before is not None:
        table = table.where(F.col("seq") < before)
    newest = table.groupBy("part").agg(F.max_by("path", F.struct("seq", "written", "path")).alias("path"))
    return {r["part"]: r["path"] for r in newest.collect()}  # a row for each part


def commit(spark: SparkSession, base: str, paths: dict[int, str], seq: int) -> None:
    rows = [(part, seq, time.time_ns(), path) for part, path in paths.items()]
    spark.createDataFrame(rows, POINTERS).coalesce(1).write.mode("append").parquet(f"{base}/_versions")


def next_seq(spark: SparkSession, base: str) -> int:
    table = pointers(spark, base)
    return 0 if table is None else (table.agg(F.max("seq")).first()[0] or 0) + 1


def fresh_folder(base: str, seq: int) -> str:
    return f"{base}/data/v={seq:012d}-{uuid.uuid4().hex[:12]}"
