"""Readers and writers.

All readers declare their schema (no inference pass over the data) and return
lazy DataFrames; writers go through versioned folders so a failed or retried
job never leaves a half-written table under the name readers use.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.sources import store

# --- declared bronze / memory schemas (fixed values) -------------------------

BRONZE_SALES = T.StructType([T.StructField(c, T.StringType(), True) for c in
                             ["order_id", "customer_id", "order_date", "product", "quantity", "unit_price"]])
BRONZE_CUSTOMERS = T.StructType([T.StructField(c, T.StringType(), True) for c in
                                 ["customer_id", "customer_name", "email", "region"]])

SEED_INCIDENT = T.StructType([
    T.StructField("incident_id", T.StringType()),
    T.StructField("failure_class", T.StringType()),
    T.StructField("pipeline_name", T.StringType()),
    T.StructField("dag_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("evidence_summary", T.StringType()),
    T.StructField("fix_applied", T.StringType()),
    T.StructField("prevention_added", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

TRIGGER = T.StructType([T.StructField(c, T.StringType()) for c in
                        ["pipeline_name", "dag_id", "task_id", "run_id", "severity",
                         "error_message", "question", "timestamp", "incident_id"]])

EXPECTED = T.StructType([
    T.StructField("failure_class", T.StringType()),
    T.StructField("expected_tables", T.ArrayType(T.StringType())),
    T.StructField("expected_column", T.StringType()),
    T.StructField("root_cause_keywords", T.ArrayType(T.StringType())),
    T.StructField("fix_should_mention", T.ArrayType(T.StringType())),
    T.StructField("prevention_should_mention", T.ArrayType(T.StringType())),
])

SCENARIO = T.StructType([
    T.StructField("scenario_id", T.StringType()),
    T.StructField("scenario_name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("trigger", TRIGGER),
    T.StructField("expected", EXPECTED),
])

_NODE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("resource_type", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("database", T.StringType()),
    T.StructField("relation_name", T.StringType()),
    T.StructField("depends_on", T.StructType([T.StructField("nodes", T.ArrayType(T.StringType()))])),
    T.StructField("raw_code", T.StringType()),
    T.StructField("raw_sql", T.StringType()),
    T.StructField("compiled_code", T.StringType()),
    T.StructField("compiled_sql", T.StringType()),
    T.StructField("columns", T.MapType(T.StringType(), T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("data_type", T.StringType()),
        T.StructField("description", T.StringType())]))),
    T.StructField("description", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("original_file_path", T.StringType()),
    T.StructField("config", T.MapType(T.StringType(), T.StringType())),
])
_SOURCE = T.StructType([
    T.StructField("source_name", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("resource_type", T.StringType()),
])
MANIFEST = T.StructType([
    T.StructField("nodes", T.MapType(T.StringType(), _NODE)),
    T.StructField("sources", T.MapType(T.StringType(), _SOURCE)),
])
RUN_RESULTS = T.StructType([T.StructField("results", T.ArrayType(T.StructType([
    T.StructField("unique_id", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("execution_time", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("failures", T.LongType()),
])))])
TASK_LOG = T.StructType([
    T.StructField("dag_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("try_number", T.IntegerType()),
    # a list of entries (objects or plain strings) or one string: raw JSON text
    T.StructField("content", T.StringType()),
])
LOG_ENTRY = "timestamp string, level string, event string"
TASK_INSTANCE = T.StructType([
    T.StructField("dag_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("try_number", T.IntegerType()),
    T.StructField("run_type", T.StringType()),
    T.StructField("start_date", T.StringType()),
])

# --- S1 / S2 / S3: bronze CSV load --------------------------------------------


def read_bronze_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header, every column text, empty field -> NULL.

    FAILFAST + enforceSchema=false make an extra, missing or renamed column an
    error, as a COPY into a fixed table would be.
    """
    return (spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("nullValue", "")
            .option("mode", "FAILFAST")
            .csv(path))


def check_csv_header(spark: SparkSession, path: str, schema: T.StructType) -> dict:
    """Header of a CSV vs the declared columns, before loading.

    Spark derives the header from the first line only (no inference pass), so
    this is a metadata read; ``read_bronze_csv`` also fails on a mismatch.
    """
    found = spark.read.option("header", True).csv(path).columns
    expected = schema.fieldNames()
    return {"expected": expected, "found": found,
            "missing": [c for c in expected if c not in found],
            "extra": [c for c in found if c not in expected],
            "ok": found == expected}


def csv_headers(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """X7 over a folder: (file, found, missing, extra, ok) for every file, from its first line.

    The first line is the one of least place in a file's first split; a task keeps
    one line for each file it reads.
    """
    m = F.col("_metadata")
    rows = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    first = rows.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("line"))
    found = F.transform(F.split("line", ","), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    expected = F.array(*[F.lit(c) for c in schema.fieldNames()])
    return first.select("file", found.alias("found"), F.array_except(expected, found).alias("missing"), F.array_except(found, expected).alias("extra"), (found == expected).alias("ok"))


def write_versioned(df: DataFrame, base: str, observation: Observation | None = None,
                    partition_by: list[str] | None = None) -> str:
    """Full refresh as a new version folder plus a pointer row.

    Plain overwrite is not atomic; readers follow the newest pointer, which is
    appended only after the data is committed.
    """
    spark = df.sparkSession
    seq = store.next_seq(spark, base)
    target = store.fresh_folder(base, seq)
    if observation is not None:
        df = df.observe(observation, F.count(F.lit(1)).alias("rows_loaded"))
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(target)
    store.commit(spark, base, {0: target}, seq)
    return target


def current_version(spark: SparkSession, base: str) -> str:
    """The newest complete version's folder; raises when there is none."""
    paths = store.current(spark, base)
    if not paths:
        raise FileNotFoundError(f"no version of {base}")
    return paths[0]


def load_bronze(spark: SparkSession, csv_path: str, schema: T.StructType, base: str) -> tuple[str, int]:
    """S1+S2+S3: CSV -> bronze Parquet version; returns (path, rows loaded),
    the count observed during the write, without a second scan."""
    obs = Observation("load")
    path = write_versioned(read_bronze_csv(spark, csv_path, schema), base, obs)
    return path, int(obs.get["rows_loaded"])


# --- S4 / S5: named tables -----------------------------------------------------


def table(spark: SparkSession, root: str, layer: str, name: str) -> DataFrame:
    """The newest version of a named table."""
    return spark.read.parquet(current_version(spark, os.path.join(root, layer, name)))


# --- S6 / S7: model artifacts --------------------------------------------------


def read_nodes(spark: SparkSession, manifest_path: str) -> DataFrame:
    """Model nodes of a manifest: one row per model."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(manifest_path)
    n = m.select(F.explode("nodes").alias("unique_id", "n"))
    return (n.where(F.col("n.resource_type") == "model").select(
        "unique_id",
        F.col("n.name").alias("name"),
        F.col("n.schema").alias("schema"),
        F.col("n.database").alias("database"),
        F.col("n.relation_name").alias("relation_name"),
        F.coalesce(F.col("n.depends_on.nodes"), F.array().cast("array<string>")).alias("depends_on"),
        F.coalesce(F.col("n.raw_code"), F.col("n.raw_sql"), F.lit("")).alias("raw_sql"),
        F.coalesce(F.col("n.compiled_code"), F.col("n.compiled_sql"), F.lit("")).alias("compiled_sql"),
        F.col("n.columns").alias("columns"),
        F.coalesce(F.col("n.description"), F.lit("")).alias("description"),
        F.coalesce(F.col("n.path"), F.lit("")).alias("path"),
        F.coalesce(F.col("n.original_file_path"), F.lit("")).alias("original_file_path"),
        F.coalesce(F.col("n.config"), F.create_map().cast("map<string,string>")).alias("config")))


def read_sources(spark: SparkSession, manifest_path: str) -> DataFrame:
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(manifest_path)
    return m.select(F.explode("sources").alias("unique_id", "s")).select(
        "unique_id", F.col("s.source_name").alias("source_name"),
        F.col("s.name").alias("table_name"), F.col("s.schema").alias("schema"))


def read_run_results(spark: SparkSession, path: str) -> DataFrame:
    """One row per result with the model name (last dotted part of the id)."""
    r = spark.read.schema(RUN_RESULTS).option("multiLine", True).json(path)
    return r.select(F.explode("results").alias("r")).select(
        F.col("r.unique_id").alias("unique_id"),
        F.element_at(F.split(F.col("r.unique_id"), "[.]"), -1).alias("model"),
        F.col("r.status").alias("status"),
        F.col("r.execution_time").alias("execution_time"),
        F.coalesce(F.col("r.message"), F.lit("")).alias("message"),
        F.col("r.failures").alias("failures"))


# --- S8 / S9 / S10: task logs and task instances -------------------------------


def _entries(logs: DataFrame):
    """The content as an array of (timestamp, level, event); a plain string,
    as the whole content or as an entry, is an event alone."""
    c = F.col("content")
    if not isinstance(logs.schema["content"].dataType, T.StringType):
        return c
    items = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))

    def entry(x):
        parsed = F.when(F.trim(x).startswith("{"), F.from_json(x, LOG_ENTRY))
        plain = F.struct(F.lit(None).cast("string").alias("timestamp"), F.lit(None).cast("string").alias("level"), x.alias("event"))
        return F.coalesce(parsed, plain)

    return F.when(c.isNotNull(), F.transform(items, entry))


def task_log_lines(logs: DataFrame) -> DataFrame:
    """Structured entries -> numbered text lines.

    ``[ts] LEVEL - event`` when there is a timestamp; the bare event when it is
    non-empty; otherwise the entry is dropped. Level defaults to info.
    """
    e = logs.select("dag_id", "run_id", "task_id", "try_number",
                    F.posexplode(_entries(logs)).alias("entry_no", "e"))
    ts = F.col("e.timestamp")
    ev = F.coalesce(F.col("e.event"), F.lit(""))
    line = (F.when(F.coalesce(ts, F.lit("")) != "",
                   F.format_string("[%s] %s - %s", ts, F.upper(F.coalesce(F.col("e.level"), F.lit("info"))), ev))
            .when(ev != "", ev))
    return e.select("dag_id", "run_id", "task_id", "try_number", "entry_no", line.alias("line")) \
        .where(F.col("line").isNotNull())


def task_log_texts(logs: DataFrame) -> DataFrame:
    """One text per (run, task, try), lines joined in entry order.

    The entries of one try already sit in one input row, so this regroups no
    more than a row holds.
    """
    fmt = lambda x: F.when(F.coalesce(x["timestamp"], F.lit("")) != "",
                           F.format_string("[%s] %s - %s", x["timestamp"],
                                           F.upper(F.coalesce(x["level"], F.lit("info"))),
                                           F.coalesce(x["event"], F.lit("")))) \
        .when(F.coalesce(x["event"], F.lit("")) != "", x["event"])
    return logs.select("dag_id", "run_id", "task_id", "try_number",
                       F.array_join(F.transform(_entries(logs), fmt), "\n").alias("log_text"))


def read_task_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK_LOG).json(path)


def pick_log(texts: DataFrame, instances: DataFrame) -> DataFrame:
    """Log of the task's latest try, falling back to try 0 when empty."""
    keys = ["dag_id", "run_id", "task_id"]
    latest = texts.alias("t")
    zero = texts.where(F.col("try_number") == 0).select(*keys, F.col("log_text").alias("try0_text"))
    ti = instances.select(*keys, F.coalesce("try_number", F.lit(0)).alias("try_number"))
    j = ti.join(latest, keys + ["try_number"], "left").join(zero, keys, "left")
    chosen = F.when(F.coalesce(F.col("log_text"), F.lit("")) == "",
                    F.when(F.col("try_number") != 0, F.col("try0_text")).otherwise(F.col("log_text"))) \
        .otherwise(F.col("log_text"))
    return j.select(*keys, "try_number", F.coalesce(chosen, F.lit("")).alias("log_text"))


def read_task_instances(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TASK_INSTANCE).json(path)


def task_statuses(instances: DataFrame, dag_id: str, run_id: str) -> DataFrame:
    """Task-instance states of one run."""
    return instances.where((F.col("dag_id") == dag_id) & (F.col("run_id") == run_id)) \
        .select("task_id", "state", "try_number")


# --- S11 / S12 / S14 / S15 ------------------------------------------------------


def read_seed_incidents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEED_INCIDENT).option("multiLine", True).json(path)


def read_scenarios(spark: SparkSession, pattern: str, like: str | None = None) -> DataFrame:
    """Scenario files (one JSON object each); optional file-name filter."""
    df = spark.read.schema(SCENARIO).option("multiLine", True).json(pattern) \
        .withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    if like:
        df = df.where(F.col("file").contains(like))
    return df


def read_triggers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIGGER).json(path)


def write_run(rows: DataFrame, path: str, run_id: str, kind: str = "parquet") -> None:
    """Rows of one run into the run's own folder of a table: a repeat replaces the run's rows and leaves all others.

    Spark commits the folder at the end of the job; a failed job leaves what was there.
    """
    rows.withColumn("run_id", F.lit(run_id)).write.format(kind).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").save(path)


def write_reports(reports: DataFrame, path: str, run_id: str) -> None:
    """One JSON object per incident, replay-safe by run."""
    write_run(reports, path, run_id, "json")


# --- S16: dataset discovery ------------------------------------------------------


def profile_datasets(tables: dict[str, DataFrame]) -> DataFrame:
    """Every dataset with its columns and the min/max of its first date/time-named
    column. ``tables`` maps ``schema.table`` to a DataFrame; one aggregate per
    dataset (each a single pass, pruned to that one column), unioned."""
    out = None
    for name, df in tables.items():
        schema, _, tname = name.partition(".")
        cols = df.columns
        date_cols = [c for c in cols if "date" in c.lower() or "time" in c.lower()]
        if date_cols:
            c = date_cols[0]
            agg = df.agg(F.min(c).cast("string").alias("min_value"), F.max(c).cast("string").alias("max_value"))
            dcol = F.lit(c)
        else:
            agg = df.sparkSession.range(1).select(F.lit(None).cast("string").alias("min_value"),
                                                  F.lit(None).cast("string").alias("max_value"))
            dcol = F.lit(None).cast("string")
        row = agg.select(F.lit(schema).alias("schema"), F.lit(tname).alias("table"),
                         F.array(*[F.lit(c) for c in cols]).alias("columns"),
                         dcol.alias("date_column"), "min_value", "max_value")
        out = row if out is None else out.unionByName(row)
    return out
