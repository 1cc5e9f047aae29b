"""Stored incidents as a bucketed table.

The table is bucketed and sorted by the incident id. A lookup by id reads one bucket,
and joins on the id (embeddings, validation, upserts) shuffle the new rows only: the
store is already dealt by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import memory

KEY = "incident_id"


def save_bucketed(incidents: DataFrame, name: str, path: str, buckets: int = 64) -> DataFrame:
    """Write the incidents as table ``name`` under ``path``; choose the buckets so that one is a task's worth of rows."""
    incidents.repartition(buckets, KEY).write.mode("errorifexists").format("parquet").option("path", path).bucketBy(buckets, KEY).sortBy(KEY).saveAsTable(name)
    return incidents.sparkSession.table(name)


def look_up(spark: SparkSession, name: str, incident_id: str) -> DataFrame:
    """An incident by id, from its bucket alone."""
    return memory.get_incident(spark.table(name), incident_id)


def upsert_bucketed(store: DataFrame, batch: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """M1 over a bucketed store: the batch is reduced to a row for each id and meets the store in a join on the id.

    Same rows as ``memory.upsert``; the store's side is not shuffled.
    """
    order = F.struct(*[F.col(c) for c in order_cols]) if order_cols else F.lit(0)
    kept = [c for c in memory.INCIDENT_SCHEMA.fieldNames() if c not in memory.UPSERT_COLUMNS and c != KEY]
    one = batch.groupBy(KEY).agg(F.min_by(F.struct(*kept), order).alias("_first"), F.max_by(F.struct(*memory.UPSERT_COLUMNS), order).alias("_last"))
    old = store.select(KEY, *[F.col(c).alias(f"_old_{c}") for c in [*kept, *memory.UPSERT_COLUMNS]], F.lit(True).alias("_stored"))
    j = old.join(one.hint("merge"), KEY, "full")
    stored, new = F.col("_stored").isNotNull(), F.col("_last").isNotNull()
    columns = {c: F.when(stored, F.col(f"_old_{c}")).otherwise(F.col("_first")[c]) for c in kept}
    columns |= {c: F.when(new, F.col("_last")[c]).otherwise(F.col(f"_old_{c}")) for c in memory.UPSERT_COLUMNS}
    return j.select(KEY, *[v.alias(c) for c, v in columns.items()]).select(*memory.INCIDENT_SCHEMA.fieldNames())
