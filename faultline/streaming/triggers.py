"""Failure triggers as a stream -> intake -> classification -> upsert (M1).

The upsert is a streaming aggregation keyed by the incident id: its state holds,
for each id, the kept columns of the first trigger and the ten upsert columns of
the last. Each micro-batch writes the ids it changed to a folder of its own, so a
repeated batch replaces its own rows and nothing else is rewritten; the newest row
of an id is the incident. Exactly-once results follow from the checkpointed offsets
and state. Ids never expire, so the state grows with them: on a cluster set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which
keeps it on the executors' disks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators import incidents, logs, memory
from faultline.sources.files import TRIGGER

KEPT = [c for c in memory.INCIDENT_SCHEMA.fieldNames() if c not in memory.UPSERT_COLUMNS and c != "incident_id"]
CHANGES = T.StructType([*memory.INCIDENT_SCHEMA.fields, T.StructField("batch", T.LongType())])


def trigger_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The triggers of new files, with the time at which their file came (``_arrived``)."""
    rows = spark.readStream.schema(TRIGGER).option("maxFilesPerTrigger", max_files).json(path)
    return rows.select("*", F.col("_metadata.file_modification_time").alias("_arrived"))


def triggers_to_incidents(triggers: DataFrame) -> DataFrame:
    """Intake + regex signals on the error message + rule classification."""
    if "_arrived" not in triggers.columns:
        triggers = triggers.withColumn("_arrived", F.lit(None).cast("timestamp"))
    t = incidents.intake(triggers).withColumn("_message", F.coalesce("error_message", F.lit("")))  # the signals' message is the matched part
    s = logs.extract_signals(t, "error_message")
    c = incidents.classify(s)
    return c.select(
        "incident_id", F.coalesce(F.try_to_timestamp("timestamp").cast("timestamp_ntz"), F.localtimestamp())
        .alias("created_at"), "severity", F.lit("open").alias("status"), F.lit("stream").alias("source"),
        "pipeline_name", "dag_id", "task_id", "run_id", "dbt_model",
        F.try_element_at("tables", F.lit(1)).alias("target_table"),
        F.try_element_at("columns", F.lit(1)).alias("target_column"), "failure_class",
        F.col("_message").alias("issue_summary"), F.lit(None).cast("string").alias("root_cause"),
        F.col("classification_confidence").cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("fix_summary"), F.lit(None).cast("string").alias("prevention_summary"),
        F.to_json(F.struct("error_type", "sql_state_code")).alias("evidence_json"),
        F.lit(False).alias("validated"), F.lit(None).cast("array<float>").alias("embedding"),
        # triggers of an id apply by their time, then as their files came, then by a hash of the payload
        F.struct(F.try_to_timestamp("timestamp").alias("at"), F.col("_arrived"), F.xxhash64("run_id", "task_id", "_message", "question").alias("hash")).alias("_order"))


def upserted(rows: DataFrame) -> DataFrame:
    """M1 over rows with ``_order``, a stream or a table: of an id's rows the first sets the kept columns, the last the ten others."""
    one = rows.groupBy("incident_id").agg(F.min_by(F.struct(*KEPT), "_order").alias("_k"), F.max_by(F.struct(*memory.UPSERT_COLUMNS), "_order").alias("_u"))
    return one.select("incident_id", "_k.*", "_u.*").select(*memory.INCIDENT_SCHEMA.fieldNames())


def start_upsert_stream(spark: SparkSession, trigger_path: str, store_path: str, checkpoint: str,
                        available_now: bool = True, max_files: int = 100):
    """Run the trigger stream; a micro-batch writes the ids it changed to ``store_path/batch=<id>``."""
    def write_changes(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{store_path}/batch={batch_id}")

    w = upserted(triggers_to_incidents(trigger_stream(spark, trigger_path, max_files))).writeStream.outputMode("update") \
        .foreachBatch(write_changes).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def read_store(spark: SparkSession, store_path: str) -> DataFrame:
    """The incidents: each id's row of the newest batch that changed it (a grouped maximum)."""
    rows = spark.read.schema(CHANGES).parquet(store_path)
    rest = [c for c in memory.INCIDENT_SCHEMA.fieldNames() if c != "incident_id"]
    return rows.groupBy("incident_id").agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select("incident_id", "_r.*")
