"""Registered queries over the driver's tables.

Each builder takes (spark, sf_dir) and returns a DataFrame. The ``*_input``
helpers only reshape driver tables into the schema an operator expects (for
instance lineitem rows as all-text bronze sales); the operator itself comes
from the library and does all the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators import contracts, medallion
from faultline.plans.tables import read
from faultline.session import small_tasks, written

# --- stand-in inputs -------------------------------------------------------------


def bronze_sales_input(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as all-text bronze sales rows; every seventh line of an order
    comes without a date, every part whose key ends in 50 without a customer."""
    li = read(spark, sf, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("order_id"),
        F.when(F.col("l_partkey") % 100 != 50, F.col("l_suppkey").cast("string")).alias("customer_id"),
        F.when(F.col("l_linenumber") != 7, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("order_date"),
        F.concat(F.lit("part-"), F.col("l_partkey").cast("string")).alias("product"),
        F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.col("l_extendedprice").cast(T.DecimalType(18, 2)).cast("string").alias("unit_price"))


def bronze_customers_input(spark: SparkSession, sf: str) -> DataFrame:
    """customer as all-text bronze customer rows (padded, mixed case); every
    fifth customer arrives a second time under another name."""
    c = read(spark, sf, "customer")
    name = F.explode(F.when(F.col("c_custkey") % 5 == 0, F.array(F.lower("c_name"), F.concat(F.lit("a "), F.lower("c_name")))).otherwise(F.array(F.lower("c_name"))))
    c = c.select("*", name.alias("_name"))
    return c.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.concat(F.lit(" "), F.col("_name"), F.lit(" ")).alias("customer_name"),
        F.concat(F.col("c_name"), F.lit("@Example.COM")).alias("email"),
        F.concat(F.lit(" "), F.lower("c_mktsegment")).alias("region"))


def orders_sales_input(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("customer_id"),
                    F.to_date("o_orderdate").alias("order_date"),
                    F.col("o_totalprice").cast(T.DecimalType(18, 2)).alias("total_amount"))


def customer_dim_input(spark: SparkSession, sf: str) -> DataFrame:
    c = read(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
                    F.col("c_mktsegment").alias("region"))


# --- medallion ----------------------------------------------------------------------


def q_fct_sales(spark: SparkSession, sf: str) -> DataFrame:
    g = medallion.fct_sales(orders_sales_input(spark, sf), customer_dim_input(spark, sf))
    return g.withColumn("daily_revenue", F.col("daily_revenue").cast("double"))


def q_silver_sales(spark: SparkSession, sf: str) -> DataFrame:
    s = medallion.silver_sales(bronze_sales_input(spark, sf))
    return s.withColumn("unit_price", F.col("unit_price").cast("double")) \
        .withColumn("total_amount", F.col("total_amount").cast("double"))


def q_silver_customers(spark: SparkSession, sf: str) -> DataFrame:
    return medallion.silver_customers(bronze_customers_input(spark, sf))


def q_column_tests(spark: SparkSession, sf: str) -> DataFrame:
    ss = medallion.silver_sales(bronze_sales_input(spark, sf))
    sc = medallion.silver_customers(bronze_customers_input(spark, sf))
    a = contracts.run_tests(ss, "silver_sales", [("order_id", "unique"), ("order_id", "not_null"),
                                                 ("order_date", "not_null"), ("total_amount", "not_null")])
    b = contracts.run_tests(sc, "silver_customers", [("customer_id", "unique"), ("customer_id", "not_null"),
                                                     ("customer_name", "not_null")])
    return a.unionByName(b)


def q_contract_violations(spark: SparkSession, sf: str) -> DataFrame:
    g = medallion.fct_sales(orders_sales_input(spark, sf), customer_dim_input(spark, sf))
    return contracts.contract_violations(g, medallion.FCT_SALES_CONTRACT)


# --- checks ----------------------------------------------------------------------------

from faultline.operators import checks  # noqa: E402


def q_null_check(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    ev = checks.table_evidence(o, [{"template": "null_check", "column": c} for c in o.columns], "tpch", "orders")
    return ev.select("column_name", F.col("value").cast("bigint").alias("null_count"))


def q_table_profile(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    specs = [{"template": "row_count"}]
    specs += [{"template": "null_check", "column": c} for c in li.columns]
    specs += [{"template": "freshness", "timestamp_column": "l_shipdate"},
              {"template": "partition_check", "date_column": "l_returnflag", "date_value": "R"},
              {"template": "duplicate_total", "column": "l_orderkey"},
              {"template": "duplicate_check", "column": "l_orderkey"}]
    ev = checks.table_evidence(li, specs, "tpch", "lineitem")
    return ev.select("template", "column_name", "value", "row_count")


def q_duplicate_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_check(read(spark, sf, "lineitem"), "l_orderkey")


def q_duplicate_total(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_total(read(spark, sf, "lineitem"), "l_partkey")


def q_row_count(spark: SparkSession, sf: str) -> DataFrame:
    return checks.row_count(read(spark, sf, "events"))


def q_freshness(spark: SparkSession, sf: str) -> DataFrame:
    return checks.freshness(read(spark, sf, "events"), "ts")


def q_partition_check(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders").select(F.to_date("o_orderdate").alias("order_date"))
    return checks.partition_check(o, "order_date", "1996-01-02")


def drifted_customers_input(spark: SparkSession, sf: str) -> DataFrame:
    """customer keys as bronze text where two market segments arrive in the
    drifted ``CUST-<n>`` format."""
    c = read(spark, sf, "customer")
    key = F.when(c.c_mktsegment.isin("HOUSEHOLD", "MACHINERY"),
                 F.regexp_replace("c_name", "Customer#", "CUST-")).otherwise(c.c_custkey.cast("string"))
    return c.select(key.alias("customer_id"), F.col("c_name").alias("customer_name"))


def q_invalid_cast_check(spark: SparkSession, sf: str) -> DataFrame:
    return checks.invalid_cast_check(drifted_customers_input(spark, sf), "customer_id")


def q_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    return checks.sample_rows(read(spark, sf, "orders"), "o_totalprice > 400000", ["o_orderkey"])


# --- logs ------------------------------------------------------------------------------

from pyspark.sql import Window  # noqa: E402

from faultline.operators import logs  # noqa: E402
from faultline.operators.numbering import number_rows  # noqa: E402

# Message templates for the stand-in task logs (input construction only).
ERROR_MESSAGES = [
    'null value in column "customer_id" of relation "gold.fct_sales" violates not-null constraint',
    'invalid input syntax for type integer: "CUST-%d"',
    'relation "silver.silver_sales_%d" does not exist',
    'column "order_dt" of relation "silver_sales" does not exist',
    "permission denied for table sales",
    'duplicate key value violates unique constraint "orders_pkey" on insert into gold.fct_sales',
    "Compilation Error in model silver_customers (models/silver/silver_customers.sql)",
    "Database Error in model fct_sales (models/gold/fct_sales.sql)",
    'invalid input syntax for type date: "2026-13-%d"',
]
INFO_MESSAGES = {
    "view": "Reading rows from bronze.sales join bronze.customers",
    "click": "Slow query on table silver.silver_customers (%d ms)",
    "signup": "Task started for model silver_sales",
    "purchase": "Inserting batch into gold.fct_sales",
}


def task_log_lines_input(spark: SparkSession, sf: str) -> DataFrame:
    """events as task-log lines: one log per user, one line per event in time
    order, formatted ``[ts] LEVEL - message``."""
    ev = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    msg = None
    for i, m in enumerate(ERROR_MESSAGES):
        body = F.format_string(m, F.col("user_id")) if "%d" in m else F.lit(m)
        msg = F.when(k % 9 == i, body) if msg is None else msg.when(k % 9 == i, body)
    info = None
    for et, m in INFO_MESSAGES.items():
        body = F.format_string(m, F.col("value").cast("int")) if "%d" in m else F.lit(m)
        info = F.when(F.col("event_type") == et, body) if info is None else info.when(F.col("event_type") == et, body)
    message = F.when(F.col("event_type") == "error", msg).otherwise(info)
    # few lines are loud: most failures are first reported by an INFO line
    level = F.when((F.col("event_type") == "error") & (F.col("value") > 100), "ERROR") \
        .when((F.col("event_type") == "click") & (F.col("value") > 150), "WARNING").otherwise("INFO")
    lines = ev.select(F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("log_id"), "ts", "event_id",
                      F.format_string("[%s] %s - %s", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), level, message).alias("line"))
    return number_rows(lines, ["log_id"], ["ts", "event_id"], "line_no", "n_lines").select("log_id", "line_no", "n_lines", "line")


def q_split_lines(spark: SparkSession, sf: str) -> DataFrame:
    return logs.split_log_lines(read(spark, sf, "documents"), ["doc_id"], "text")


def q_error_lines(spark: SparkSession, sf: str) -> DataFrame:
    return logs.error_lines(task_log_lines_input(spark, sf)).drop("n_lines")


def q_relevant_lines(spark: SparkSession, sf: str) -> DataFrame:
    return logs.relevant_lines(task_log_lines_input(spark, sf), ["log_id"])


def q_truncate_log(spark: SparkSession, sf: str) -> DataFrame:
    return logs.truncate_log(logs.relevant_lines(task_log_lines_input(spark, sf), ["log_id"]), ["log_id"])


def q_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return logs.line_matches(task_log_lines_input(spark, sf), ["log_id"]).select(
        "log_id", "pattern", "match", F.try_element_at("groups", F.lit(1)).alias("group1"),
        F.try_element_at("groups", F.lit(2)).alias("group2"))


def q_resolve_error(spark: SparkSession, sf: str) -> DataFrame:
    return log_signals(spark, sf).select("log_id", "error_type", "sql_state_code", "error_message")


def q_referenced_objects(spark: SparkSession, sf: str) -> DataFrame:
    r = log_signals(spark, sf)
    return r.select("log_id", F.array_join("tables", ",").alias("tables"),
                    F.array_join("columns", ",").alias("columns"), F.array_join("models", ",").alias("models"))


# --- incidents, investigation, memory ------------------------------------------------------

from faultline.operators import incidents, memory, pivots  # noqa: E402
from faultline.operators.investigate import class_plan  # noqa: E402

TASK_IDS = ["run_dbt_silver_sales", "run_dbt_silver_customers", "run_dbt_fct_sales", "run_dbt_tests",
            "ingest_raw_sales", "run_dbt_gold_orders"]


def triggers_input(spark: SparkSession, sf: str) -> DataFrame:
    """error events as failure triggers (pipeline name left out for a third)."""
    ev = read(spark, sf, "events").where(F.col("event_type") == "error")
    k = F.get_json_object("props", "$.k").cast("int")
    task = None
    for i, t in enumerate(TASK_IDS):
        task = F.when(k % 6 == i, F.lit(t)) if task is None else task.when(k % 6 == i, F.lit(t))
    return ev.select(
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.lit("sales_pipeline")).cast("string").alias("pipeline_name"),
        F.lit("sales_pipeline").alias("dag_id"), task.alias("task_id"),
        F.concat(F.lit("run_"), F.col("event_id").cast("string")).alias("run_id"),
        F.lit(None).cast("string").alias("severity"),
        F.format_string("event %d failed with value %.2f", F.col("event_id"), F.col("value")).alias("error_message"),
        F.lit(None).cast("string").alias("question"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.lit(None).cast("string").alias("incident_id"))


def q_intake(spark: SparkSession, sf: str) -> DataFrame:
    return incidents.intake(triggers_input(spark, sf)).select(
        "incident_id", "pipeline_name", "severity", "task_id", "dbt_model", "run_id")


def log_signals(spark: SparkSession, sf: str) -> DataFrame:
    return logs.signals_of_lines(task_log_lines_input(spark, sf).drop("n_lines"), ["log_id"])


def q_classify(spark: SparkSession, sf: str) -> DataFrame:
    c = incidents.classify(log_signals(spark, sf))
    return c.select("log_id", "error_type", "failure_class", "classification_confidence",
                    F.array_join("investigation_priorities", ",").alias("priorities"))


def investigation_targets(spark: SparkSession, sf: str) -> DataFrame:
    c = incidents.classify(log_signals(spark, sf))
    t = incidents.resolve_target(c.withColumn("incident_id", F.col("log_id")))
    t = t.withColumn("upstream_sources", F.lit(None).cast("array<struct<schema:string,table_name:string>>")) \
        .withColumn("upstream_models", F.lit(None).cast("array<string>"))
    t = incidents.redirect_target(t)
    return t.withColumn("date_value", F.lit(None).cast("string")).withColumn("condition", F.lit(None).cast("string"))


def q_plan_checks(spark: SparkSession, sf: str) -> DataFrame:
    p = checks.expand_checks(investigation_targets(spark, sf))
    return p.select("incident_id", "failure_class", "schema", "table", "column", "ordinal", "template")


def pipeline_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The medallion tables built from driver data, by ``schema.table``."""
    bs, bc = bronze_sales_input(spark, sf), bronze_customers_input(spark, sf)
    ss, sc = medallion.silver_sales(bs), medallion.silver_customers(bc)
    # The gold layer is materialised (written to the shared checkpoint folder)
    # as a medallion build would; every check then scans the table instead of
    # re-running the join and aggregation.
    with small_tasks(spark):
        gold = medallion.fct_sales(ss, sc).checkpoint(eager=True)
    return {"bronze.sales": bs, "bronze.customers": bc, "silver.silver_sales": ss,
            "silver.silver_customers": sc, "gold.fct_sales": gold}


def q_run_checks(spark: SparkSession, sf: str) -> DataFrame:
    ev = checks.run_plan(class_plan(investigation_targets(spark, sf)), pipeline_tables(spark, sf))
    return ev.select("incident_id", "schema", "table", "template", "column_name", "value", "row_count", "error")


def embeddings_input(spark: SparkSession, sf: str, id_col: str) -> DataFrame:
    e = read(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias(id_col), F.concat(F.lit("class_"), F.col("label").cast("string"))
                    .alias("failure_class"), "embedding")


def q_similar_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return memory.search_similar(embeddings_input(spark, sf, "query_id"), embeddings_input(spark, sf, "incident_id"))


def q_similar_by_pivots(spark: SparkSession, sf: str) -> DataFrame:
    return pivots.search_by_pivots(embeddings_input(spark, sf, "query_id"), embeddings_input(spark, sf, "incident_id"))


def incident_batch_input(spark: SparkSession, sf: str, first_half: bool) -> DataFrame:
    """events as incident records keyed by user and event type; the first half
    of the month is the stored history, the second half a new batch."""
    ev = read(spark, sf, "events")
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    ev = ev.where(cut if first_half else ~cut)
    return ev.select(
        F.concat(F.lit("INC-"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")).alias("incident_id"),
        F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"),
        F.lit("open").alias("status"), F.lit("events").alias("source"),
        F.lit("sales_pipeline").alias("pipeline_name"), F.lit("sales_pipeline").alias("dag_id"),
        F.col("event_type").alias("task_id"),
        F.concat(F.lit("run_"), F.col("user_id").cast("string")).alias("run_id"),
        F.lit(None).cast("string").alias("dbt_model"), F.lit("events").alias("target_table"),
        F.lit("value").alias("target_column"), F.col("event_type").alias("failure_class"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("issue_summary"),
        F.col("props").alias("root_cause"), (F.col("value") / 500.0).alias("confidence"),
        F.lit(None).cast("string").alias("fix_summary"), F.lit(None).cast("string").alias("prevention_summary"),
        F.col("props").alias("evidence_json"), F.lit(False).alias("validated"),
        F.lit(None).cast("array<float>").alias("embedding"), "ts", "event_id")


def upserted_store(spark: SparkSession, sf: str) -> DataFrame:
    empty = spark.createDataFrame([], memory.INCIDENT_SCHEMA)
    b1 = incident_batch_input(spark, sf, True)
    b2 = incident_batch_input(spark, sf, False)
    s1 = memory.upsert(empty, b1, ["ts", "event_id"])
    return memory.upsert(s1, b2, ["ts", "event_id"])


def q_upsert_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return upserted_store(spark, sf).drop("embedding")


def q_recent_incidents(spark: SparkSession, sf: str) -> DataFrame:
    return memory.recent_incidents(upserted_store(spark, sf))


# --- layered questions ----------------------------------------------------------------------

from faultline.operators import drift, evaluate, lineage, reports  # noqa: E402
from faultline.plans import rules  # noqa: E402


def order_layers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """orders through the three layers: text bronze, typed silver, gold fact.
    Silver loses every 13th of a month, gold every 27th."""
    o = read(spark, sf, "orders")
    bronze = o.select(F.col("o_orderkey").cast("string").alias("order_id"),
                      F.col("o_custkey").cast("string").alias("customer_id"),
                      F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
                      F.col("o_totalprice").cast(T.DecimalType(18, 2)).cast("string").alias("total_amount"))
    silver = bronze.where(F.col("order_date").isNotNull() & ~F.col("order_date").endswith("-13")).select(
        F.col("order_id").cast("bigint").alias("order_id"), F.col("customer_id").cast("bigint").alias("customer_id"),
        F.col("order_date").cast("date").alias("order_date"),
        F.col("total_amount").cast(T.DecimalType(18, 2)).alias("total_amount"))
    gold = medallion.fct_sales(silver.where(F.dayofmonth("order_date") != 27), customer_dim_input(spark, sf))
    return {"bronze.orders": bronze, "silver.silver_orders": silver, "gold.fct_orders": gold}


def missing_day_questions(spark: SparkSession, sf: str) -> DataFrame:
    """A 'missing data' question for every calendar day between the first and the last order."""
    span = read(spark, sf, "orders").agg(F.min(F.to_date("o_orderdate")).alias("lo"), F.max(F.to_date("o_orderdate")).alias("hi"))
    gaps = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    lt = F.array(*[F.struct(F.lit(s).alias("schema"), F.lit(t).alias("table"), F.lit(None).cast("string").alias("layer"))
                   for s, t in (("bronze", "orders"), ("silver", "silver_orders"), ("gold", "fct_orders"))])
    q = gaps.select(F.concat(F.lit("Q-"), F.col("day").cast("string")).alias("incident_id"),
                    F.lit("missing_data").alias("investigation_type"),
                    F.col("day").cast("string").alias("date_value"))
    q = incidents.question_priorities(q)
    return q.select("incident_id", F.col("priorities").alias("check_priorities"), lt.alias("layer_tables"),
                    F.lit("customer_id").alias("column"), F.lit("order_date").alias("date_column"), "date_value",
                    F.lit("order_date").alias("timestamp_column"))


def q_layer_checks(spark: SparkSession, sf: str) -> DataFrame:
    ev = checks.layer_checks(missing_day_questions(spark, sf), order_layers(spark, sf))
    return ev.select("incident_id", "context", "template", "column_name", "value")


def q_origin_layer(spark: SparkSession, sf: str) -> DataFrame:
    ev = checks.layer_checks(missing_day_questions(spark, sf), order_layers(spark, sf))
    return checks.origin_layer(ev)


def part_nodes_input(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Model artifacts from the tables' foreign keys: an order is a model that
    depends on its customer's model, then on the parts of its lines (sources,
    in line order); a customer depends on its nation (a source). Every
    seventh part has no schema of its own."""
    o, li, c = (read(spark, sf, t) for t in ("orders", "lineitem", "customer"))
    parts = li.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
                                                     lambda x: F.concat(F.lit("source.tpch.part_"), x["l_partkey"].cast("string"))).alias("p"))
    customer = F.array(F.concat(F.lit("model.tpch.silver_customer_"), F.col("o_custkey").cast("string")))
    orders = o.join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.concat(F.lit("model.tpch.order_"), F.col("o_orderkey").cast("string")).alias("unique_id"),
        F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"), F.lit("gold").alias("schema"),
        F.col("o_orderpriority").alias("description"), F.concat(customer, F.coalesce("p", F.array().cast("array<string>"))).alias("depends_on"))
    customers = c.select(
        F.concat(F.lit("model.tpch.silver_customer_"), F.col("c_custkey").cast("string")).alias("unique_id"),
        F.concat(F.lit("silver_customer_"), F.col("c_custkey").cast("string")).alias("name"), F.lit("silver").alias("schema"),
        F.col("c_mktsegment").alias("description"),
        F.array(F.concat(F.lit("source.tpch.nation_"), F.col("c_nationkey").cast("string"))).alias("depends_on"))
    p, n = read(spark, sf, "part"), read(spark, sf, "nation")
    key = F.col("p_partkey").cast("string")
    sources = p.select(F.concat(F.lit("source.tpch.part_"), key).alias("unique_id"), F.lit("part").alias("source_name"), F.concat(F.lit("part_"), key).alias("table_name"),
                       F.when(F.col("p_partkey") % 7 != 0, F.lit("raw")).alias("schema")) \
        .unionByName(n.select(F.concat(F.lit("source.tpch.nation_"), F.col("n_nationkey").cast("string")).alias("unique_id"), F.lit("nation").alias("source_name"),
                              F.concat(F.lit("nation_"), F.col("n_nationkey").cast("string")).alias("table_name"), F.lit("bronze").alias("schema")))
    return written(orders.unionByName(customers), "nodes"), sources


def part_families_input(spark: SparkSession, sf: str) -> list:
    """The upstream tables of the artifacts above: the lines of each part, the customers of each nation."""
    li, c = read(spark, sf, "lineitem"), read(spark, sf, "customer")
    return [checks.Family("raw", "part_", li, "l_partkey", read(spark, sf, "part").select(F.col("p_partkey").alias("key"))),
            checks.Family("bronze", "nation_", c, "c_nationkey", read(spark, sf, "nation").select(F.col("n_nationkey").alias("key")))]


def q_upstream_checks(spark: SparkSession, sf: str) -> DataFrame:
    """A11 over the lineage of orders and customers: incidents are the urgent orders and one in five customers."""
    nodes, sources = part_nodes_input(spark, sf)
    lin = lineage.lineage(nodes, sources)
    bad = nodes.where("description in ('1-URGENT', 'BUILDING')").select(
        F.col("unique_id").alias("incident_id"), F.col("name").alias("model"), F.when(F.col("schema") == "gold", F.lit("l_quantity")).alias("column"))
    ev = checks.upstream_checks(bad, lin, {}, part_families_input(spark, sf))
    return ev.select("incident_id", "context", "template", "column_name", "value", "error")


# --- reports and evaluation ------------------------------------------------------------------

LANG_SCENARIO = {"en": "null_join_key", "fr": "schema_drift", "de": "missing_partition", "es": "missing_partition"}
LANG_CLASS = {"en": "data_quality", "fr": "schema_drift", "de": "silent_correctness", "es": "dependency"}


# What a stand-in report says beside its document's text, by language: (documents that say it, words).
ANSWERS = {
    "en": ("doc_id % 10 <> 0", " null customer_id after the join in bronze.sales breaks the not null constraint: filter them, add a not_null test and an alert"),
    "fr": ("doc_id % 3 <> 0", " the cast of customer_id from text to integer in bronze.customers fails: remove the prefix, put the format under a schema contract"),
}


def document_reports_input(spark: SparkSession, sf: str) -> DataFrame:
    """documents as finished reports: the text, for most English and French
    ones with an answer, is the root cause and the fix, lines are the evidence
    chain; scenario and class follow the language."""
    d = read(spark, sf, "documents")
    said = F.lit("")
    for lang, (who, words) in ANSWERS.items():
        said = F.when((F.col("lang") == lang) & F.expr(who), F.lit(words)).otherwise(said)
    d = d.withColumn("text", F.concat("text", said))
    scen = F.create_map(*[F.lit(x) for kv in LANG_SCENARIO.items() for x in kv])
    cls = F.create_map(*[F.lit(x) for kv in LANG_CLASS.items() for x in kv])
    return d.select("doc_id", scen[F.col("lang")].alias("scenario"), cls[F.col("lang")].alias("failure_class"),
                    F.col("text").alias("root_cause"), F.array(F.col("source")).alias("evidence_chain"),
                    F.struct(F.col("text").alias("immediate"), F.lit("").alias("preventive"),
                             F.col("lang").alias("monitoring")).alias("fix"),
                    F.array(F.col("source"), F.col("lang")).alias("prevention"))


def q_score_reports(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.score_reports(document_reports_input(spark, sf), evaluate.expected_df(spark))
    return s.select("doc_id", "scenario", *evaluate.CRITERIA, "total")


def q_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    s = evaluate.score_reports(document_reports_input(spark, sf), evaluate.expected_df(spark))
    return evaluate.scorecard(s, ["scenario"])


def log_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Stand-in for an investigator's own view of each log: how sure it is
    (half, and more the more of the lines are errors) and whether logs count
    as available (ten lines or more)."""
    lines = task_log_lines_input(spark, sf).groupBy("log_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("line").contains("] ERROR - ")).alias("errors"))
    return lines.select(F.col("log_id").alias("incident_id"), F.round(F.lit(0.5) + F.col("errors") / F.col("n"), 4).alias("stated"),
                        (F.col("n") >= 10).alias("logs_available"))


def q_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Investigation reports for the task logs: signals -> class -> target ->
    report fields (R1-R3) with capped confidence (C12, C13, C14)."""
    t = written(investigation_targets(spark, sf), "targets")
    ev = checks.run_plan(class_plan(t), pipeline_tables(spark, sf))
    r = t.join(checks.evidence_available(t, ev), "incident_id").join(log_facts(spark, sf), "incident_id") \
        .withColumn("dbt_model", F.try_element_at("models", F.lit(1))).withColumn("question", F.lit(None).cast("string"))
    conf = incidents.cap_confidence(F.col("stated"), F.col("logs_available"), F.col("db_evidence_available"))
    r = reports.build_report(r.withColumn("confidence", conf).withColumn("severity", F.lit("error")))
    return r.select("incident_id", F.col("report.failure_class").alias("failure_class"),
                    F.col("report.what_failed").alias("what_failed"),
                    F.col("report.how_it_failed").alias("how_it_failed"),
                    F.col("report.where_failed.table").alias("table"),
                    F.col("report.where_failed.column").alias("column"), "database_evidence_count",
                    F.round(F.col("report.confidence"), 4).alias("confidence"),
                    incidents.confidence_band(F.col("report.confidence")).alias("band"))


def responses_input(spark: SparkSession, sf: str) -> DataFrame:
    """conversation turns as stored model responses: assistant turns arrive as
    fenced JSON objects, system turns as prose around an object, user turns as
    plain text (which must not parse)."""
    c = read(spark, sf, "conversations")
    obj = F.to_json(F.struct("conv_id", "turn", "role", F.length("text").alias("n_chars")))
    text = F.when(F.col("role") == "assistant", F.concat(F.lit("```json\n"), obj, F.lit("\n```"))) \
        .when(F.col("role") == "system", F.concat(F.lit("Result follows: "), obj, F.lit(" -- end"))) \
        .otherwise(F.col("text"))
    return c.select("conv_id", "turn", text.alias("response"))


def q_parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    p = reports.parse_responses(responses_input(spark, sf), "response",
                                "conv_id long, turn long, role string, n_chars int")
    return p.select("conv_id", "turn", "parse_ok", F.col("parsed.role").alias("parsed_role"),
                    F.col("parsed.n_chars").alias("parsed_chars"))


def context_pieces_input(spark: SparkSession, sf: str) -> DataFrame:
    """document lines as context pieces of one prompt per document, tokens =
    whitespace words."""
    from faultline.functions.text import word_count
    lines = logs.split_log_lines(read(spark, sf, "documents"), ["doc_id"], "text")
    return lines.select("doc_id", F.col("line_no").cast("int").alias("ordinal"),
                        F.concat(F.lit("line_"), F.col("line_no").cast("string")).alias("label"),
                        F.col("line").alias("text"), word_count(F.col("line")).alias("tokens"))


def q_pack_context(spark: SparkSession, sf: str) -> DataFrame:
    return reports.pack_context(context_pieces_input(spark, sf), ["doc_id"],
                                rules.NODE_BUDGETS["signal_extraction"])


def usage_input(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as model usage: the n-th assistant turn ends the n-th call
    of an investigation; the call's input are all turns before it and after
    the last one. Turns after the last assistant turn are a call without an
    answer, so every turn of every conversation counts."""
    from faultline.functions.text import word_count
    c = read(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    answer = F.col("role") == "assistant"
    c = c.withColumn("call", F.count_if(answer).over(w)).withColumn("words", word_count(F.col("text")))
    nodes = F.array(*[F.lit(n) for n in rules.NODE_BUDGETS])
    return c.groupBy("conv_id", "call").agg(F.coalesce(F.sum(F.when(~answer, F.col("words"))), F.lit(0)).alias("input_tokens"),
                                            F.coalesce(F.sum(F.when(answer, F.col("words"))), F.lit(0)).alias("output_tokens")) \
        .withColumn("node", F.get(nodes, F.col("call").cast("int")))


def q_usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    u = reports.usage_cost(usage_input(spark, sf), ["conv_id"])
    return u.withColumn("cost_usd", F.round("cost_usd", 9))


# --- described controls ----------------------------------------------------------------------


def q_format_drift(spark: SparkSession, sf: str) -> DataFrame:
    ev = read(spark, sf, "events")
    cut = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    return drift.format_drift(ev.where(cut), ev.where(~cut), ["event_type"], "props")


def q_rolling_deviation(spark: SparkSession, sf: str) -> DataFrame:
    return drift.rolling_deviation(read(spark, sf, "events"), ["event_type"], "ts")


def q_missing_partitions(spark: SparkSession, sf: str) -> DataFrame:
    e = drift.missing_partitions(read(spark, sf, "events"), "ts").withColumn("table", F.lit("events"))
    o = drift.missing_partitions(read(spark, sf, "orders"), "o_orderdate").withColumn("table", F.lit("orders"))
    return e.unionByName(o)


def q_orphans(spark: SparkSession, sf: str) -> DataFrame:
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    parts = [drift.orphans(li, "l_orderkey", o, "o_orderkey", "lineitem.l_orderkey->orders"),
             drift.orphans(li, "l_partkey", read(spark, sf, "part"), "p_partkey", "lineitem.l_partkey->part"),
             drift.orphans(li, "l_suppkey", read(spark, sf, "supplier"), "s_suppkey", "lineitem.l_suppkey->supplier"),
             drift.orphans(o, "o_custkey", read(spark, sf, "customer"), "c_custkey", "orders.o_custkey->customer"),
             drift.orphans(read(spark, sf, "labels"), "doc_id", read(spark, sf, "documents"), "doc_id",
                           "labels.doc_id->documents"),
             drift.orphans(o, "o_custkey", read(spark, sf, "customer").where("c_acctbal > 0"), "c_custkey", "orders.o_custkey->customer in credit"),
             drift.orphans(read(spark, sf, "documents"), "doc_id", read(spark, sf, "labels"), "doc_id", "documents.doc_id->labels")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_grain(spark: SparkSession, sf: str) -> DataFrame:
    g1 = drift.grain_violations(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "lineitem")
    g2 = drift.grain_violations(read(spark, sf, "lineitem"), ["l_orderkey"], "lineitem")
    g3 = drift.grain_violations(read(spark, sf, "conversations"), ["conv_id", "turn"], "conversations")
    return g1.unionByName(g2).unionByName(g3)


# --- lineage ---------------------------------------------------------------------------------


def q_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """A lineage record and its dependency chain for every order and customer."""
    lin = lineage.dependency_chain(lineage.lineage(*part_nodes_input(spark, sf)))
    sources = F.array_join(F.transform("upstream_sources", lambda s: F.concat(F.coalesce(s["schema"], F.lit("-")), F.lit("."), s["table_name"])), ",")
    return lin.select("model", "schema", "description", F.array_join("upstream_models", ",").alias("upstream_models"), sources.alias("upstream_sources"),
                      F.array_join("downstream_models", ",").alias("downstream_models"), "dependency_chain")


def q_upstream_details(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's upstream customer model with its schema, description and sources."""
    d = lineage.upstream_details(part_nodes_input(spark, sf)[0]).select("unique_id", F.explode("upstream_details").alias("d"))
    return d.select("unique_id", F.col("d.model").alias("up_model"), F.col("d.schema").alias("up_schema"), F.col("d.description").alias("up_description"),
                    F.array_join("d.depends_on_sources", ",").alias("up_sources"))


def q_metadata_targets(spark: SparkSession, sf: str) -> DataFrame:
    """The tables to inspect for every order and customer."""
    nodes, sources = part_nodes_input(spark, sf)
    return lineage.metadata_targets(lineage.lineage(nodes, sources), nodes)


# --- incident memory: maintenance, texts, search over a built store ------------------------------


def raw_incidents_input(spark: SparkSession, sf: str) -> DataFrame:
    """events as raw incident records under the alternative keys; some fields are absent."""
    ev = read(spark, sf, "events")
    k = F.col("event_id") % 4
    return ev.select(
        F.concat(F.when(k == 0, F.lit("SEED-")).otherwise(F.lit("INC-")), F.col("event_id").cast("string")).alias("incident_id"),
        F.col("ts").alias("created_at"), F.when(k == 1, "warning").alias("severity"), F.when(k == 2, "open").alias("status"),
        F.col("event_type").alias("failure_class"), F.col("event_type").alias("task_id"),
        F.when(k != 3, F.concat(F.lit("event "), F.col("event_id").cast("string"))).alias("summary"), F.col("props").alias("issue_summary"),
        F.when(F.col("user_id") % 2 == 0, F.col("props")).alias("root_cause"), F.when(k == 0, F.lit("restarted")).alias("fix_applied"),
        F.lit("patched").alias("fix_summary"), F.when(k == 1, F.col("value") / 500.0).alias("confidence"),
        F.array("event_type").alias("tags"), F.when(k == 2, False).alias("validated"))


def q_normalized_incidents(spark: SparkSession, sf: str) -> DataFrame:
    """Stored columns and defaults of raw records, and the text to embed."""
    n = memory.normalize_incidents(raw_incidents_input(spark, sf))
    return n.select("incident_id", "created_at", "severity", "status", "source", "failure_class", "issue_summary", "root_cause", "confidence", "fix_summary",
                    "evidence_json", "validated", memory.embedding_text(F.col("issue_summary"), F.col("root_cause")).alias("embedding_text"))


def q_maintained_store(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds kept, vectors set for one in three of them, one in five marked."""
    store = memory.clean_incidents(memory.normalize_incidents(raw_incidents_input(spark, sf)))
    number = F.substring_index("incident_id", "-", -1).cast("long")
    vectors = store.where(number % 3 == 0).select("incident_id", F.array(number.cast("float"), F.lit(1.0)).alias("embedding"))
    out = memory.mark_validated(memory.set_embeddings(store, vectors), store.where(number % 5 == 0).select("incident_id"), False)
    return out.select("incident_id", "validated", F.get("embedding", F.lit(0)).cast("double").alias("first_value"))


def vector_incidents_input(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as incidents with text ids; a vector is shared by four neighbours, so similarities tie."""
    e = read(spark, sf, "embeddings")
    shared = e.select(F.col("vec_id").alias("_id"), F.col("embedding").alias("_vector"))
    j = e.withColumn("_id", F.col("vec_id") - F.col("vec_id") % 4).join(shared, "_id")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in memory.INCIDENT_SCHEMA.fields}
    own = {"incident_id": F.concat(F.lit("INC-"), F.col("vec_id").cast("string")), "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"),
           "failure_class": F.concat(F.lit("class_"), F.col("label").cast("string")), "issue_summary": F.concat(F.lit("vector "), F.col("vec_id").cast("string")),
           "root_cause": F.concat(F.lit("label "), F.col("label").cast("string")), "fix_summary": F.when(F.col("label") % 2 == 0, "restart"),
           "confidence": F.col("label") / 10.0, "embedding": F.col("_vector").cast("array<float>")}
    return j.select(*[(own.get(c) if c in own else x).alias(c) for c, x in empty.items()])


def q_similar_from_store(spark: SparkSession, sf: str) -> DataFrame:
    """M1 then M2: search the store that upsert builds; a tenth of the queries have no class, a tenth an empty one."""
    store = memory.upsert(spark.createDataFrame([], memory.INCIDENT_SCHEMA), vector_incidents_input(spark, sf))
    e = read(spark, sf, "embeddings")
    cls = F.when(F.col("vec_id") % 10 == 1, F.lit("")).when(F.col("vec_id") % 10 != 0, F.concat(F.lit("class_"), F.col("label").cast("string")))
    queries = e.select(F.concat(F.lit("INC-"), F.col("vec_id").cast("string")).alias("query_id"), cls.alias("failure_class"), "embedding")
    return memory.search_similar(queries, store)


def q_stored_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The stored incidents as report rows."""
    r = reports.stored_reports(upserted_store(spark, sf))
    return r.select("incident_id", "severity", "failure_class", "what_failed", F.col("where_failed.task_id").alias("task_id"), F.col("where_failed.table").alias("table"),
                    "root_cause", "confidence", F.size("prevention").alias("preventions"), "validated")


def q_search_texts(spark: SparkSession, sf: str) -> DataFrame:
    """M4: the search text of every log's signals."""
    s = incidents.classify(log_signals(spark, sf))
    return s.select("log_id", memory.search_text(F.lit(None).cast("string"), F.when(F.length("log_id") % 2 == 0, F.col("error_message")), F.col("error_type"),
                                                 F.try_element_at("models", F.lit(1)), F.col("columns"), F.col("tables"), F.col("failure_class")).alias("search_text"))


# --- targets, confidence, runs -------------------------------------------------------------------


def target_signals_input(spark: SparkSession, sf: str) -> DataFrame:
    """events as log signals: the referenced table may be a temporary one or
    absent, the lineage of the model may have a source, a model or neither."""
    ev = read(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    table = F.concat(F.when(k % 3 == 0, F.lit("gold.")).when(k % 3 == 1, F.lit("")).otherwise(F.lit("silver.")), "event_type", F.when(k % 2 == 0, F.lit("__dbt_tmp")).otherwise(F.lit("")))
    source = F.struct(F.when(k % 4 == 0, F.lit("raw")).cast("string").alias("schema"), F.concat(F.lit("src_"), "event_type").alias("table_name"))
    model = F.concat(F.when(k % 8 < 4, F.lit("silver_")).otherwise(F.lit("stg_")), "event_type")
    no = F.array().cast("array<string>")
    return ev.select("event_id", F.when(k % 5 != 0, F.array(table)).otherwise(no).alias("tables"),
                     F.when(k % 7 < 4, F.array(F.lit("value"), F.lit("user_id"))).otherwise(no).alias("columns"),
                     F.when(k % 6 < 2, F.array(source)).otherwise(F.array().cast("array<struct<schema:string,table_name:string>>")).alias("upstream_sources"),
                     F.when(k % 6 < 4, F.array(model)).otherwise(no).alias("upstream_models"))


def q_resolve_target(spark: SparkSession, sf: str) -> DataFrame:
    """The target of every signal row, moved off temporary tables, and its layer."""
    t = incidents.redirect_target(incidents.resolve_target(target_signals_input(spark, sf)))
    return t.select("event_id", "schema", "table", "column", rules.infer_layer(F.col("schema")).alias("layer"))


def q_confidence_cap(spark: SparkSession, sf: str) -> DataFrame:
    """Capped confidence and its band for every event."""
    ev = read(spark, sf, "events")
    c = incidents.cap_confidence(F.least(F.col("value") / 100.0, F.lit(1.0)), F.col("user_id") % 3 != 0, F.col("event_id") % 4 != 0)
    return ev.select("event_id", c.alias("confidence"), incidents.confidence_band(c).alias("band"))


def q_manual_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Events as task instances of runs, one per user and day; every third run is manual."""
    ev = read(spark, sf, "events")
    runs = ev.select(F.col("event_type").alias("dag_id"), F.concat_ws("_", F.lit("run"), F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
                     F.when(F.col("user_id") % 3 == 0, "manual").otherwise("scheduled").alias("run_type"),
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("start_date"), (F.col("event_id") % 3).cast("int").alias("try_number"))
    return reports.latest_manual_runs(runs)


# --- layers and reports --------------------------------------------------------------------------


def q_safe_cast(spark: SparkSession, sf: str) -> DataFrame:
    """P5: drifted customer keys, cast or rejected."""
    ok, rejects = medallion.safe_cast(drifted_customers_input(spark, sf), {"customer_id": "int"})
    return ok.select(F.col("customer_id").cast("string").alias("customer_id"), "customer_name", F.lit("").alias("failed")) \
        .unionByName(rejects.select("customer_id", "customer_name", F.array_join("failed_columns", ",").alias("failed")))


def q_null_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Null rates of the bronze sales."""
    return contracts.null_rate_gate(bronze_sales_input(spark, sf), ["order_id", "customer_id", "order_date", "quantity"])


def q_dataset_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The columns and date range of the driver's tables."""
    from faultline.sources.files import profile_datasets
    tables = {f"driver.{t}": read(spark, sf, t) for t in ("orders", "events", "customer")}
    tables["bronze.sales"] = bronze_sales_input(spark, sf)
    p = profile_datasets(tables)
    return p.select("schema", "table", F.array_join("columns", ",").alias("columns"), "date_column", F.substring("min_value", 1, 10).alias("min_day"), F.substring("max_value", 1, 10).alias("max_day"))


def q_score_status(spark: SparkSession, sf: str) -> DataFrame:
    """V2: the status of each criterion of each report."""
    s = evaluate.score_reports(document_reports_input(spark, sf), evaluate.expected_df(spark))
    return evaluate.score_status(s, ["doc_id"])


def q_report_checks(spark: SparkSession, sf: str) -> DataFrame:
    """V4: validity of the stored incidents' reports."""
    store = upserted_store(spark, sf)
    r = reports.build_report(store.withColumn("evidence_chain", F.when(F.length("evidence_json") > 9, F.array("evidence_json"))).withColumn("confidence", F.col("confidence") * 2))
    return evaluate.report_checks(r)


# --- signals read by a model, parsed questions, digests ------------------------------------------


def q_merged_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Regex signals merged with stand-in model signals, which two of three logs have."""
    s = log_signals(spark, sf)
    n = F.length("log_id") % 3
    none = F.lit(None).cast("array<string>")
    s = s.select("*", F.when(n == 0, "timeout").when(n == 1, "").alias("llm_error_type"), F.when(n == 0, "57014").alias("llm_sql_state"),
                 F.when(n != 2, F.array(F.lit("bronze.extra"), F.coalesce(F.try_element_at("tables", F.lit(1)), F.lit("x.y")))).otherwise(none).alias("llm_tables"),
                 none.alias("llm_columns"), F.when(n == 1, F.array(F.lit("stg_orders"))).otherwise(none).alias("llm_models"))
    m = logs.merge_signals(s)
    return m.select("log_id", "error_type", "sql_state_code", *[F.array_join(c, ",").alias(c) for c in ("tables", "columns", "models")])


def q_question_targets(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as parsed questions; every fourth names no table, every third no date."""
    c = read(spark, sf, "conversations").where("role = 'user'")
    k = F.col("conv_id") % 4
    kinds = F.array(*[F.lit(x) for x in rules.QUESTION_PRIORITIES])
    table = F.struct(F.when(k != 1, F.concat(F.lit("layer_"), k.cast("string"))).cast("string").alias("schema"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("table"),
                     F.lit(None).cast("string").alias("layer"))
    date = F.struct(F.when(F.col("turn") % 2 == 0, "day").otherwise("").alias("column"), F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("2024-01-0"), (F.col("turn") % 9 + 1).cast("string"))).alias("value"))
    q = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("incident_id"),
                 F.get(kinds, ((F.col("conv_id") + F.col("turn")) % 7).cast("int")).alias("investigation_type"),
                 F.when(k != 0, F.array(table)).otherwise(F.array().cast("array<struct<schema:string,table:string,layer:string>>")).alias("t"), date.alias("d"))
    q = incidents.question_priorities(q)
    parsed = F.struct(F.col("t").alias("tables_to_check"), F.col("d").alias("date_filter"), F.array(F.lit("amount")).alias("columns_of_interest"), F.col("priorities").alias("check_priorities"))
    t = checks.plan_checks(incidents.resolve_question_target(q.withColumn("parsed", parsed)))
    return t.select("incident_id", "schema", "table", "column", "date_column", "date_value", F.array_join("check_priorities", ",").alias("priorities"), "strategy", "run_upstream")


def q_evidence_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The digest lines of every incident's scalar checks, by table."""
    p = class_plan(investigation_targets(spark, sf)).where(F.col("template").isin("row_count", "null_check", "duplicate_total"))
    return checks.evidence_digest(checks.run_plan(p, pipeline_tables(spark, sf))).select("incident_id", "context", "digest")


REGISTRY = {
    "fct_sales": q_fct_sales,
    "silver_sales": q_silver_sales,
    "silver_customers": q_silver_customers,
    "column_tests": q_column_tests,
    "contract_violations": q_contract_violations,
    "null_check": q_null_check,
    "table_profile": q_table_profile,
    "duplicate_check": q_duplicate_check,
    "duplicate_total": q_duplicate_total,
    "row_count": q_row_count,
    "freshness": q_freshness,
    "partition_check": q_partition_check,
    "invalid_cast_check": q_invalid_cast_check,
    "sample_rows": q_sample_rows,
    "split_lines": q_split_lines,
    "error_lines": q_error_lines,
    "relevant_lines": q_relevant_lines,
    "truncate_log": q_truncate_log,
    "signatures": q_signatures,
    "resolve_error": q_resolve_error,
    "referenced_objects": q_referenced_objects,
    "intake": q_intake,
    "classify": q_classify,
    "plan_checks": q_plan_checks,
    "run_checks": q_run_checks,
    "similar_incidents": q_similar_incidents,
    "similar_by_pivots": q_similar_by_pivots,
    "upsert_incidents": q_upsert_incidents,
    "recent_incidents": q_recent_incidents,
    "layer_checks": q_layer_checks,
    "origin_layer": q_origin_layer,
    "upstream_checks": q_upstream_checks,
    "score_reports": q_score_reports,
    "scorecard": q_scorecard,
    "reports": q_reports,
    "parse_responses": q_parse_responses,
    "pack_context": q_pack_context,
    "usage_cost": q_usage_cost,
    "format_drift": q_format_drift,
    "rolling_deviation": q_rolling_deviation,
    "missing_partitions": q_missing_partitions,
    "orphans": q_orphans,
    "grain": q_grain,
    "lineage": q_lineage,
    "upstream_details": q_upstream_details,
    "metadata_targets": q_metadata_targets,
    "normalized_incidents": q_normalized_incidents,
    "maintained_store": q_maintained_store,
    "similar_from_store": q_similar_from_store,
    "stored_reports": q_stored_reports,
    "search_texts": q_search_texts,
    "resolve_target": q_resolve_target,
    "confidence_cap": q_confidence_cap,
    "manual_runs": q_manual_runs,
    "safe_cast": q_safe_cast,
    "null_rates": q_null_rates,
    "dataset_profile": q_dataset_profile,
    "score_status": q_score_status,
    "report_checks": q_report_checks,
    "merged_signals": q_merged_signals,
    "question_targets": q_question_targets,
    "evidence_digest": q_evidence_digest,
}
