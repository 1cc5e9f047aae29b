"""Registered queries of readers, sinks, streams and histories.

The stand-in inputs are files that Spark writes from the driver's tables into the
application's run folder; the library's readers read them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import checks, investigate, memory, reports, schema_history
from faultline.plans import catalog
from faultline.plans.tables import read
from faultline.session import fresh_path
from faultline.sources import buckets, files, lines
from faultline.streaming import triggers

# --- tables and files (S1-S7, X7) ----------------------------------------------------------


def q_bronze_load(spark: SparkSession, sf: str) -> DataFrame:
    """Bronze sales as CSV, loaded twice; the newest version has the rows once."""
    base = fresh_path(spark, "bronze")
    catalog.bronze_sales_input(spark, sf).write.option("header", True).csv(f"{base}/csv")
    for _ in range(2):
        _, loaded = files.load_bronze(spark, f"{base}/csv", files.BRONZE_SALES, f"{base}/bronze/sales")
    return files.table(spark, base, "bronze", "sales").withColumn("rows_loaded", F.lit(loaded).cast("bigint"))


def q_csv_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as one CSV file for each market segment; two segments come with other columns."""
    base = fresh_path(spark, "headers")
    c = catalog.bronze_customers_input(spark, sf).withColumn("segment", F.upper(F.trim("region")))
    for name, frame in (("HOUSEHOLD", c.drop("region")), ("MACHINERY", c.withColumnRenamed("email", "e_mail")), ("", c)):
        own = frame.where(F.col("segment") == name) if name else frame.where("segment not in ('HOUSEHOLD', 'MACHINERY')")
        own.repartition("segment").write.mode("append").option("header", True).partitionBy("segment").csv(base)
    found = files.csv_headers(spark, base, files.BRONZE_CUSTOMERS)
    return found.select(F.regexp_extract("file", "segment=([A-Z]+)", 1).alias("segment"), F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "ok").distinct()


def q_manifest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest for each nation, its customers being models (every tenth a test) and its suppliers sources."""
    c, s = read(spark, sf, "customer"), read(spark, sf, "supplier")
    key = F.col("c_custkey").cast("string")
    node = F.struct(F.concat(F.lit("customer_"), key).alias("name"), F.when(F.col("c_custkey") % 10 == 0, "test").otherwise("model").alias("resource_type"),
                    F.when(F.col("c_custkey") % 3 != 0, F.lit("silver")).alias("schema"), F.struct(F.array(F.col("c_mktsegment")).alias("nodes")).alias("depends_on"),
                    F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("select "), key)).alias("raw_code"), F.concat(F.lit("old "), key).alias("raw_sql"), F.col("c_name").alias("description"))
    nodes = c.groupBy("c_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("model.tpch.customer_"), key), node))).alias("nodes"))
    skey = F.col("s_suppkey").cast("string")
    source = F.struct(F.lit("supplier").alias("source_name"), F.concat(F.lit("supplier_"), skey).alias("name"), F.lit("raw").alias("schema"), F.lit("source").alias("resource_type"))
    sources = s.groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("source.tpch.supplier_"), skey), source))).alias("sources"))
    path = fresh_path(spark, "manifests")
    nodes.join(sources, F.col("c_nationkey") == F.col("s_nationkey"), "left").select(F.to_json(F.struct("nodes", "sources"))).write.option("maxRecordsPerFile", 1).text(path)
    models = files.read_nodes(spark, path).select(F.lit("model").alias("kind"), "unique_id", "name", F.col("schema"), F.array_join("depends_on", ",").alias("depends_on"), F.col("raw_sql").alias("about"))
    return models.unionByName(files.read_sources(spark, path).select(F.lit("source").alias("kind"), "unique_id", F.col("table_name").alias("name"), F.col("schema"), F.lit("").alias("depends_on"),
                                                                     F.col("source_name").alias("about")))


def q_run_results(spark: SparkSession, sf: str) -> DataFrame:
    """One file of results for each nation of customers, an order each."""
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    result = F.struct(F.concat(F.lit("model.tpch.order_"), F.col("o_orderkey").cast("string")).alias("unique_id"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("error").alias("status"),
                      F.col("o_totalprice").alias("execution_time"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("message"),
                      F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")).alias("failures"))
    path = fresh_path(spark, "run-results")
    o.groupBy("c_nationkey").agg(F.collect_list(result).alias("results")).select(F.to_json(F.struct("results"))).write.option("maxRecordsPerFile", 1).text(path)
    return files.read_run_results(spark, path)


# --- task logs (S8-S10, L0) -----------------------------------------------------------------


def task_log_files(spark: SparkSession, sf: str) -> tuple[str, str]:
    """events as stored logs (one for each user, kind of event and try) and their task instances.

    Tries are 0 and 1; a task that ran twice, with errors or views, has an empty log of its last try.
    """
    ev = read(spark, sf, "events")
    entry = F.struct(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.when(F.col("value") > 100, "warning").alias("level"),
                     F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("event "), F.col("event_id").cast("string"))).otherwise("").alias("event"))
    plain = F.when(F.col("event_id") % 13 == 0, F.to_json(F.struct(F.concat(F.lit("bare "), F.col("event_id").cast("string")).alias("event")))).otherwise(F.to_json(entry))
    keys = [F.lit("sales_pipeline").alias("dag_id"), F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"), F.col("event_type").alias("task_id"), (F.col("event_id") % 2).cast("int").alias("try_number")]
    rows = ev.select(*keys, "event_id", plain.alias("entry"))
    logs = rows.groupBy("dag_id", "run_id", "task_id", "try_number").agg(F.array_sort(F.collect_list(F.struct("event_id", "entry"))).alias("e"))
    empty = (F.col("try_number") == 1) & F.col("task_id").isin("error", "view")
    content = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["entry"]), ","), F.lit("]"))
    base = fresh_path(spark, "task-logs")
    logs.select("dag_id", "run_id", "task_id", "try_number", F.when(~empty, content).alias("content")).write.json(f"{base}/logs")
    runs = rows.groupBy("dag_id", "run_id", "task_id").agg(F.max("try_number").alias("try_number"), F.max("event_id").alias("last"))
    runs.select("dag_id", "run_id", "task_id", F.when(F.col("last") % 3 == 0, "failed").otherwise("success").alias("state"), "try_number").write.json(f"{base}/instances")
    return f"{base}/logs", f"{base}/instances"


def q_task_log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The stored entries as numbered lines."""
    logs, _ = task_log_files(spark, sf)
    return files.task_log_lines(files.read_task_logs(spark, logs)).select("run_id", "task_id", "try_number", "entry_no", "line")


def q_picked_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Each task's log of its last try, or of try 0 where that is empty."""
    logs, instances = task_log_files(spark, sf)
    picked = files.pick_log(files.task_log_texts(files.read_task_logs(spark, logs)), files.read_task_instances(spark, instances))
    return picked.select("run_id", "task_id", "try_number", "log_text")


def q_task_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """The task states of one run, the first user's."""
    _, instances = task_log_files(spark, sf)
    first = read(spark, sf, "events").agg(F.min("user_id")).first()[0]
    return files.task_statuses(files.read_task_instances(spark, instances), "sales_pipeline", f"run_{first}")


def q_numbered_log(spark: SparkSession, sf: str) -> DataFrame:
    """S8/L0 for a log larger than a row or a file: all events as one log in several files, numbered by splits."""
    path = fresh_path(spark, "large-log")
    ev = read(spark, sf, "events")
    line = F.concat_ws(" ", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("event_type"), F.col("event_id").cast("string"))
    ev.repartitionByRange(8, "ts", "event_id").sortWithinPartitions("ts", "event_id").select(line.alias("value")).write.text(path)
    return lines.numbered_lines(spark, path, across_files=True).select("line_no", "line")


# --- seeds, scenarios, triggers, the stream (S11, S12, S15, T1) ------------------------------


def q_seed_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents as seed incidents, a file with an array for each language."""
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    seed = F.struct(F.concat(F.lit("SEED-"), F.col("doc_id").cast("string")).alias("incident_id"), F.when(F.col("toxic") == 1, "access").otherwise("data_quality").alias("failure_class"),
                    F.col("source").alias("pipeline_name"), F.when(F.col("quality") == 1, "warning").alias("severity"), F.substring("text", 1, 40).alias("summary"),
                    F.col("lang").alias("root_cause"), F.array("lang", "source").alias("tags"))
    path = fresh_path(spark, "seeds")
    d.groupBy("lang").agg(F.to_json(F.collect_list(seed)).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    out = memory.normalize_incidents(files.read_seed_incidents(spark, path))
    return out.select("incident_id", "failure_class", "pipeline_name", "severity", "status", "source", "issue_summary", "root_cause", "confidence", F.get_json_object("evidence_json", "$.tags[1]").alias("second_tag"), "validated")


def q_scenarios(spark: SparkSession, sf: str) -> DataFrame:
    """A scenario file for each source of documents; those of the larger half are asked for by the file's folder."""
    d = read(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
    base = fresh_path(spark, "scenarios")
    name = F.concat_ws("_", "source", "lang")
    trigger = F.struct(F.col("source").alias("pipeline_name"), F.concat(F.lit("run_"), F.col("last").cast("string")).alias("run_id"), F.concat(F.lit("documents: "), F.col("n").cast("string")).alias("error_message"))
    expected = F.struct(F.when(F.col("lang") == "en", "data_quality").otherwise("schema_drift").alias("failure_class"), F.array("source").alias("expected_tables"), F.col("lang").alias("expected_column"))
    body = F.to_json(F.struct(name.alias("scenario_id"), F.upper(name).alias("scenario_name"), trigger.alias("trigger"), expected.alias("expected")))
    d.select(body.alias("value"), "lang").repartition("lang").write.partitionBy("lang").option("maxRecordsPerFile", 1).text(base)
    s = files.read_scenarios(spark, f"{base}/lang=*/*.txt", like="part-")
    return s.select("scenario_id", "scenario_name", F.col("trigger.run_id").alias("run_id"), F.col("trigger.error_message").alias("error_message"),
                    F.col("expected.failure_class").alias("failure_class"), F.array_join("expected.expected_tables", ",").alias("tables"), F.col("expected.expected_column").alias("column"))


def trigger_files(spark: SparkSession, sf: str) -> str:
    """error events as triggers with an id for each user, in three files by time; the last repeats a part of the second."""
    ev = read(spark, sf, "events").where("event_type = 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    message = F.element_at(F.array(F.lit(catalog.ERROR_MESSAGES[0]), F.lit(catalog.ERROR_MESSAGES[4]), F.lit("worker lost")), (k % 3 + 1))
    rows = ev.select(F.lit("sales_pipeline").alias("dag_id"), F.concat(F.lit("run_dbt_"), F.when(k % 2 == 0, "fct_sales").otherwise("other")).alias("task_id"),
                     F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"), F.when(F.col("value") > 100, "critical").alias("severity"),
                     F.concat(message, F.lit(" #"), F.col("event_id").cast("string")).alias("error_message"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
                     F.concat(F.lit("INC-"), F.col("user_id").cast("string")).alias("incident_id"), F.dayofmonth("ts").alias("day"))
    path = fresh_path(spark, "triggers")
    for part in ("day > 20", "day <= 10", "day between 8 and 20"):
        rows.where(part).drop("day").coalesce(4).write.mode("append").json(path)
    return path


def q_read_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """The trigger files as a table, repeated triggers included."""
    return files.read_triggers(spark, trigger_files(spark, sf)).select("incident_id", "run_id", "task_id", "severity", "error_message", "timestamp")


def q_trigger_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The triggers as a stream in several micro-batches, late ones among them; the store is that of one batch upsert."""
    base = fresh_path(spark, "trigger-stream")
    triggers.start_upsert_stream(spark, trigger_files(spark, sf), f"{base}/store", f"{base}/checkpoint", max_files=4).awaitTermination()
    s = triggers.read_store(spark, f"{base}/store")
    return s.select("incident_id", "created_at", "severity", "task_id", "run_id", "dbt_model", "target_table", "target_column", "failure_class", "issue_summary")


# --- sinks and stores (S14, E12, U1, P7, R4) --------------------------------------------------


def finished_reports(spark: SparkSession, sf: str) -> DataFrame:
    d = catalog.document_reports_input(spark, sf)
    d = d.withColumn("incident_id", F.concat(F.lit("INC-"), F.col("doc_id").cast("string"))).withColumn("confidence", F.lit(0.5)).withColumn("dbt_model", F.col("scenario")) \
        .withColumn("error_message", F.substring("root_cause", 1, 30)).withColumn("table", F.col("scenario")).withColumn("column", F.col("failure_class"))
    return reports.build_report(d.withColumn("database_evidence_count", F.col("doc_id") % 3))


def q_report_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs' reports, the second written twice; read back each is there once."""
    path = fresh_path(spark, "reports")
    r = finished_reports(spark, sf).select("doc_id", "report.*")
    for run, part in (("odd", "doc_id % 2 = 1"), ("even", "doc_id % 2 = 0"), ("even", "doc_id % 2 = 0")):
        files.write_reports(r.where(part).drop("doc_id"), path, run)
    back = spark.read.schema("incident_id string, what_failed string, failure_class string, root_cause string, fix struct<monitoring:string>, prevention array<string>, run_id string").json(path)
    return back.select("run_id", "incident_id", "what_failed", "failure_class", "root_cause", F.col("fix.monitoring").alias("monitoring"), F.array_join("prevention", ",").alias("prevention"))


def q_incident_records(spark: SparkSession, sf: str) -> DataFrame:
    """The stored rows of the reports."""
    rows = reports.to_incident(finished_reports(spark, sf))
    return rows.select("incident_id", "severity", "status", "source", "dbt_model", "target_table", "target_column", "failure_class", "issue_summary", "confidence",
                       F.get_json_object("fix_summary", "$.monitoring").alias("monitoring"), F.get_json_object("evidence_json", "$.database_evidence_count").cast("bigint").alias("evidence"))


def q_evidence_table(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and upstream evidence of customers' segments in one table, one run written twice."""
    tables = {"bronze.customers": catalog.bronze_customers_input(spark, sf), "tpch.orders": read(spark, sf, "orders")}
    ask = read(spark, sf, "customer").select(F.col("c_mktsegment").alias("incident_id")).distinct()

    def plan(schema: str, table: str, column: str) -> DataFrame:
        template = F.explode(F.array(F.lit("row_count"), F.lit("null_check"), F.lit("duplicate_total")))
        return ask.select("incident_id", F.lit(schema).alias("schema"), F.lit(table).alias("table"), F.lit(column).alias("column"), template.alias("template"))

    direct = checks.run_plan(plan("bronze", "customers", "customer_id"), tables)
    upstream = checks.run_plan(plan("tpch", "orders", "o_custkey"), tables).withColumn("context", F.concat(F.lit("upstream:"), "schema", F.lit("."), "table"))
    path = fresh_path(spark, "evidence-table")
    both = checks.all_evidence(direct, upstream)
    checks.append_evidence(both, path, "r1")
    for _ in range(2):
        checks.append_evidence(both.where("incident_id = 'BUILDING'"), path, "r2")
    return spark.read.parquet(path).where("recorded_at is not null").select("run_id", "incident_id", "context", "template", "value")


def q_point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The incident of the newest event's user, from the stored incidents."""
    user = read(spark, sf, "events").agg(F.max_by("user_id", F.struct("ts", "event_id"))).first()[0]
    path = fresh_path(spark, "store")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    buckets.save_bucketed(catalog.upserted_store(spark, sf), name, path, 16)
    return buckets.look_up(spark, name, f"INC-{user}-view").select("incident_id", "created_at", "failure_class", "issue_summary", "confidence")


def q_bucketed_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """M1 on a stored table: the first half of the month's events is the bucketed store, the second the batch."""
    path = fresh_path(spark, "store")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    first, second = (catalog.incident_batch_input(spark, sf, half) for half in (True, False))
    stored = buckets.save_bucketed(memory.upsert(spark.createDataFrame([], memory.INCIDENT_SCHEMA), first, ["ts", "event_id"]), name, path, 16)
    return buckets.upsert_bucketed(stored, second, ["ts", "event_id"]).drop("embedding")


# --- investigations ---------------------------------------------------------------------------

#: Class of a stand-in stored incident by its vector's label.
LABEL_CLASSES = ["data_quality", "schema_drift", "code_failure", "access"]


def q_investigations(spark: SparkSession, sf: str) -> DataFrame:
    """From trigger to stored report: error events as triggers, embeddings as the incidents stored before; the rows that come new into the store."""
    ev = read(spark, sf, "events").where("event_type = 'error'")
    e = read(spark, sf, "embeddings")
    k = F.get_json_object("props", "$.k").cast("int")
    body = [F.format_string(m, F.col("user_id")) if "%d" in m else F.lit(m) for m in catalog.ERROR_MESSAGES]
    none = F.lit(None).cast("string")
    rows = ev.select(none.alias("pipeline_name"), F.lit("sales_pipeline").alias("dag_id"), F.concat(F.lit("run_dbt_"), F.when(k % 2 == 0, "fct_sales").otherwise("other")).alias("task_id"),
                     F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"), none.alias("severity"), F.element_at(F.array(*body), k % 9 + 1).alias("error_message"), none.alias("question"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("INC-"), F.col("event_id").cast("string")).alias("incident_id"), F.lit(0.9).alias("confidence"),
                     (F.col("event_id") % F.lit(max(1, e.count()))).alias("_vec"))
    rows = rows.join(e.select(F.col("vec_id").alias("_vec"), "embedding"), "_vec", "left").drop("_vec")
    names = F.array(*[F.lit(c) for c in LABEL_CLASSES])
    store = memory.normalize_incidents(e.select(F.concat(F.lit("OLD-"), F.col("vec_id").cast("string")).alias("incident_id"), F.get(names, (F.col("label") % 4).cast("int")).alias("failure_class"), "embedding"))
    found = investigate.investigate(rows, catalog.pipeline_tables(spark, sf), store)
    out = investigate.store_investigations(store, found).where("source = 'agent'")
    number = lambda name: F.get_json_object("evidence_json", f"$.{name}").cast("bigint").alias(name)
    return out.select("incident_id", "pipeline_name", "run_id", "dbt_model", "target_table", "target_column", "failure_class", "issue_summary", "confidence",
                      number("database_evidence_count"), number("similar_incidents_count"))


# --- histories and grains (Q1, Q7, X1, A3, A4, X6) --------------------------------------------


def deliveries_history(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as schema captures: each month a supplier delivers is a capture of its data set, the return flags are columns, the
    line status of the month's last line with the flag is the column's type."""
    li = read(spark, sf, "lineitem")
    return li.groupBy(F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("dataset"), F.trunc(F.col("l_shipdate").cast("date"), "month").alias("captured_at"), F.col("l_returnflag").alias("column_name")) \
        .agg(F.max_by("l_linestatus", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("data_type"))


def stored_history(spark: SparkSession, sf: str) -> DataFrame:
    """Q1: the captures as the appended history holds them."""
    path = fresh_path(spark, "schema-history")
    schema_history.append_snapshot(deliveries_history(spark, sf), path)
    return spark.read.schema("captured_at date, column_name string, data_type string, dataset string").parquet(path)


def q_schema_validity(spark: SparkSession, sf: str) -> DataFrame:
    return schema_history.validity(stored_history(spark, sf))


def q_schema_changes(spark: SparkSession, sf: str) -> DataFrame:
    return schema_history.changes(deliveries_history(spark, sf))


def q_schema_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each supplier's columns at the middle of each year."""
    h = deliveries_history(spark, sf)
    at = F.make_date(F.year("captured_at"), F.lit(6), F.lit(15)).alias("at")
    return schema_history.as_of(schema_history.validity(h), h.select("dataset", at))


def q_duplicate_grains(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A4 and X6 for five grains of lineitem in one scan; of the most frequent keys the counts."""
    g = checks.duplicate_grains(read(spark, sf, "lineitem"), [["l_orderkey", "l_linenumber"], ["l_orderkey"], ["l_partkey", "l_suppkey"], ["l_shipdate"], ["l_orderkey", "l_partkey"]])
    most = F.transform("top", lambda x: F.get_json_object(x, "$.cnt").cast("bigint"))
    return g.select("grain", "violations", "rows_in_violation", F.array_join(most.cast("array<string>"), ",").alias("most"))


REGISTRY = {name[2:]: f for name, f in list(globals().items()) if name.startswith("q_")}
