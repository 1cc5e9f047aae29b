"""Shared-folder helpers: tables and files that any executor can reread.

Lineage is cut by writing Parquet into the folder the cluster names in
``spark.checkpoint.dir``; an executor can be lost at any time without losing
what another one wrote.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a scratch folder only for a local master.

    Raises ``RuntimeError`` when a cluster session names no shared folder: a
    folder of one machine would be invisible to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-shared-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run or attempt uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the table read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_memory() -> None:
    """Give memory that is free in this Python worker back to the machine.

    Spark keeps a worker for later tasks, and several stand beside an executor;
    what one has freed but not returned would count against all of them.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library that returns memory by itself
        pass


def trimmed(step):
    """A function over a task's batches that returns its memory when it ends."""
    @wraps(step)
    def run(batches):
        try:
            yield from step(batches)
        finally:
            release_memory()
    return run


def buckets_for(docs: DataFrame, column: str, each: int) -> int:
    """Buckets of about ``each`` bytes of a text column, and not fewer than the session's shuffle partitions."""
    size = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
