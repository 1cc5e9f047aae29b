"""DuckDB statements equal to the queries of ``catalog_sources``."""

from __future__ import annotations

from faultline.plans import oracle

ORACLE: dict[str, str] = {}

ORACLE["bronze_load"] = f"""
SELECT order_id, customer_id, order_date, product, quantity, unit_price, COUNT(*) OVER () AS rows_loaded FROM ({oracle._BRONZE_SALES})
"""

ORACLE["csv_headers"] = """
SELECT DISTINCT c_mktsegment AS segment, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'region' WHEN 'MACHINERY' THEN 'email' ELSE '' END AS missing,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'e_mail' ELSE '' END AS extra, c_mktsegment NOT IN ('HOUSEHOLD', 'MACHINERY') AS ok
FROM customer
"""

ORACLE["manifest_nodes"] = """
SELECT 'model' AS kind, 'model.tpch.customer_' || c_custkey AS unique_id, 'customer_' || c_custkey AS name, CASE WHEN c_custkey % 3 <> 0 THEN 'silver' END AS schema, c_mktsegment AS depends_on,
       CASE WHEN c_custkey % 2 = 0 THEN 'select ' || c_custkey ELSE 'old ' || c_custkey END AS about
FROM customer WHERE c_custkey % 10 <> 0
UNION ALL
SELECT 'source', 'source.tpch.supplier_' || s_suppkey, 'supplier_' || s_suppkey, 'raw', '', 'supplier' FROM supplier WHERE s_nationkey IN (SELECT c_nationkey FROM customer)
"""

ORACLE["run_results"] = """
SELECT 'model.tpch.order_' || o_orderkey AS unique_id, 'order_' || o_orderkey AS model, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'error' END AS status,
       o_totalprice AS execution_time, CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority ELSE '' END AS message, CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS failures
FROM orders JOIN customer ON o_custkey = c_custkey
"""

_TASK_LINES = """
SELECT 'run_' || user_id AS run_id, event_type AS task_id, CAST(event_id % 2 AS INTEGER) AS try_number,
       CAST(row_number() OVER (PARTITION BY user_id, event_type, event_id % 2 ORDER BY event_id) - 1 AS INTEGER) AS entry_no,
       CASE WHEN event_id % 13 = 0 THEN 'bare ' || event_id
            ELSE '[' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '] ' || CASE WHEN value > 100 THEN 'WARNING' ELSE 'INFO' END || ' - ' || CASE WHEN event_id % 11 <> 0 THEN 'event ' || event_id ELSE '' END END AS line
FROM events
"""
_KEPT_LINES = f"SELECT * FROM ({_TASK_LINES}) WHERE NOT (try_number = 1 AND task_id IN ('error', 'view'))"
ORACLE["task_log_lines"] = _KEPT_LINES
ORACLE["picked_logs"] = f"""
WITH t AS (SELECT run_id, task_id, try_number, string_agg(line, chr(10) ORDER BY entry_no) AS log_text FROM ({_KEPT_LINES}) GROUP BY ALL),
i AS (SELECT run_id, task_id, max(try_number) AS try_number FROM ({_TASK_LINES}) GROUP BY ALL)
SELECT i.run_id, i.task_id, i.try_number, coalesce(nullif(t.log_text, ''), CASE WHEN i.try_number <> 0 THEN z.log_text END, '') AS log_text
FROM i LEFT JOIN t ON t.run_id = i.run_id AND t.task_id = i.task_id AND t.try_number = i.try_number
LEFT JOIN t z ON z.run_id = i.run_id AND z.task_id = i.task_id AND z.try_number = 0
"""
ORACLE["task_statuses"] = """
SELECT event_type AS task_id, CASE WHEN max(event_id) % 3 = 0 THEN 'failed' ELSE 'success' END AS state, CAST(max(event_id % 2) AS INTEGER) AS try_number
FROM events WHERE user_id = (SELECT min(user_id) FROM events) GROUP BY event_type
"""
ORACLE["numbered_log"] = """
SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS line_no, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ' ' || event_type || ' ' || event_id AS line FROM events
"""

ORACLE["seed_incidents"] = """
SELECT 'SEED-' || doc_id AS incident_id, CASE WHEN toxic = 1 THEN 'access' ELSE 'data_quality' END AS failure_class, source AS pipeline_name,
       CASE WHEN quality = 1 THEN 'warning' ELSE 'error' END AS severity, 'resolved' AS status, 'seed' AS source, substr(text, 1, 40) AS issue_summary, lang AS root_cause,
       CAST(1.0 AS DOUBLE) AS confidence, source AS second_tag, true AS validated
FROM documents JOIN labels USING (doc_id)
"""
ORACLE["scenarios"] = """
SELECT source || '_' || lang AS scenario_id, upper(source || '_' || lang) AS scenario_name, 'run_' || max(doc_id) AS run_id, 'documents: ' || count(*) AS error_message,
       CASE WHEN lang = 'en' THEN 'data_quality' ELSE 'schema_drift' END AS failure_class, source AS tables, lang AS "column"
FROM documents GROUP BY source, lang
"""

_TRIGGER_ROWS = f"""
SELECT 'INC-' || user_id AS incident_id, 'run_' || event_id AS run_id, 'run_dbt_' || CASE WHEN {oracle._K} % 2 = 0 THEN 'fct_sales' ELSE 'other' END AS task_id,
       CASE WHEN value > 100 THEN 'critical' END AS severity,
       CASE {oracle._K} % 3 WHEN 0 THEN {oracle._ERR[0]} WHEN 1 THEN {oracle._ERR[4]} ELSE 'worker lost' END || ' #' || event_id AS error_message,
       strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS "timestamp", ts, event_id, {oracle._K} % 3 AS kind, day(ts) AS day
FROM events WHERE event_type = 'error'
"""
ORACLE["read_triggers"] = f"""
WITH t AS ({_TRIGGER_ROWS}), every AS (SELECT * FROM t UNION ALL SELECT * FROM t WHERE day BETWEEN 8 AND 10)
SELECT incident_id, run_id, task_id, severity, error_message, "timestamp" FROM every
"""
ORACLE["trigger_stream"] = f"""
WITH t AS ({_TRIGGER_ROWS}), u AS (
SELECT incident_id, arg_min(struct_pack(ts, severity, task_id, run_id), ts) AS f, arg_max(struct_pack(task_id, kind, error_message), ts) AS l FROM t GROUP BY incident_id)
SELECT incident_id, f.ts AS created_at, coalesce(f.severity, 'error') AS severity, f.task_id AS task_id, f.run_id AS run_id, replace(l.task_id, 'run_dbt_', '') AS dbt_model,
       CASE WHEN l.kind = 0 THEN 'gold.fct_sales' END AS target_table, CASE WHEN l.kind = 0 THEN 'customer_id' END AS target_column,
       CASE l.kind WHEN 0 THEN 'data_quality' WHEN 1 THEN 'access' ELSE 'unknown' END AS failure_class, l.error_message AS issue_summary
FROM u
"""

# documents as finished reports: fixed words of the stand-in input
_DOC_TEXT = """CASE WHEN lang = 'en' AND doc_id % 10 <> 0 THEN text || ' null customer_id after the join in bronze.sales breaks the not null constraint: filter them, add a not_null test and an alert'
 WHEN lang = 'fr' AND doc_id % 3 <> 0 THEN text || ' the cast of customer_id from text to integer in bronze.customers fails: remove the prefix, put the format under a schema contract' ELSE text END"""
_DOC_REPORTS = f"""
SELECT doc_id, 'INC-' || doc_id AS incident_id, lang, source, {_DOC_TEXT} AS body,
       CASE lang WHEN 'en' THEN 'null_join_key' WHEN 'fr' THEN 'schema_drift' WHEN 'de' THEN 'missing_partition' WHEN 'es' THEN 'missing_partition' END AS scenario,
       CASE lang WHEN 'en' THEN 'data_quality' WHEN 'fr' THEN 'schema_drift' WHEN 'de' THEN 'silent_correctness' WHEN 'es' THEN 'dependency' END AS failure_class
FROM documents
"""
_DOC_WHAT = "scenario || ' model failed' || CASE WHEN body <> '' THEN ' — ' || substr(substr(body, 1, 30), 1, 200) ELSE '' END"
ORACLE["report_sink"] = f"""
SELECT CASE WHEN doc_id % 2 = 1 THEN 'odd' ELSE 'even' END AS run_id, incident_id, {_DOC_WHAT} AS what_failed, failure_class, body AS root_cause, lang AS monitoring, source || ',' || lang AS prevention
FROM ({_DOC_REPORTS})
"""
ORACLE["incident_records"] = f"""
SELECT incident_id, 'error' AS severity, 'resolved' AS status, 'agent' AS source, scenario AS dbt_model, scenario AS target_table, failure_class AS target_column, failure_class,
       {_DOC_WHAT} AS issue_summary, CAST(0.5 AS DOUBLE) AS confidence, lang AS monitoring, CAST(doc_id % 3 AS BIGINT) AS evidence
FROM ({_DOC_REPORTS})
"""
ORACLE["evidence_table"] = f"""
WITH b AS ({oracle._BRONZE_CUSTOMERS}),
v AS (SELECT 'bronze.customers' AS context, 'row_count' AS template, COUNT(*) AS value FROM b
      UNION ALL SELECT 'bronze.customers', 'null_check', COUNT(*) - COUNT(customer_id) FROM b
      UNION ALL SELECT 'bronze.customers', 'duplicate_total', COUNT(*) FROM (SELECT customer_id FROM b GROUP BY 1 HAVING COUNT(*) > 1)
      UNION ALL SELECT 'upstream:tpch.orders', 'row_count', COUNT(*) FROM orders
      UNION ALL SELECT 'upstream:tpch.orders', 'null_check', COUNT(*) - COUNT(o_custkey) FROM orders
      UNION ALL SELECT 'upstream:tpch.orders', 'duplicate_total', COUNT(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING COUNT(*) > 1)),
s AS (SELECT DISTINCT c_mktsegment AS incident_id FROM customer)
SELECT run_id, incident_id, context, template, CAST(value AS VARCHAR) AS value FROM v, s, (SELECT unnest(['r1', 'r2']) AS run_id) WHERE run_id = 'r1' OR incident_id = 'BUILDING'
"""
ORACLE["point_lookup"] = f"""
SELECT incident_id, created_at, failure_class, issue_summary, confidence FROM ({oracle.UPSERTED})
WHERE incident_id = 'INC-' || (SELECT arg_max(user_id, struct_pack(ts, event_id)) FROM events) || '-view'
"""
ORACLE["bucketed_upsert"] = oracle.ORACLE["upsert_incidents"]

_FOUND = ["not_null_violation", "type_cast_failure", "relation_not_found", "relation_not_found", "permission_denied", "unique_violation", "dbt_compile_error", "dbt_database_error", "type_cast_failure"]
_MATCHES = [oracle._ERR[0], oracle._ERR[1], oracle._ERR[2], "'relation \"silver_sales\" does not exist'", "'permission denied for table sales'", "'duplicate key value violates unique constraint'",
            "'Compilation Error in model silver_customers'", "'Database Error in model fct_sales'", oracle._ERR[8]]


def _by_message(values: list[str]) -> str:
    return "CASE m " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


# of the nine messages the first and the sixth name a registered table; with its column the class's five checks run, without it two
ORACLE["investigations"] = f"""
WITH t AS (SELECT *, {oracle._K} % 9 AS m, CASE WHEN {oracle._K} % 2 = 0 THEN 'fct_sales' ELSE 'other' END AS model FROM events WHERE event_type = 'error'),
s AS (SELECT *, {_by_message([f"'{x}'" for x in _FOUND])} AS error_type, {_by_message(_MATCHES)} AS message, CASE m WHEN 0 THEN 5 WHEN 5 THEN 2 ELSE 0 END AS n FROM t),
c AS (SELECT *, {oracle._CLASS} AS failure_class FROM s),
old AS (SELECT ['data_quality', 'schema_drift', 'code_failure', 'access'][label % 4 + 1] AS failure_class, COUNT(*) AS stored FROM embeddings GROUP BY 1)
SELECT 'INC-' || event_id AS incident_id, 'sales_pipeline' AS pipeline_name, 'run_' || event_id AS run_id, model AS dbt_model,
       CASE WHEN m IN (0, 5) THEN 'fct_sales' WHEN m = 2 THEN 'silver_sales_' || user_id ELSE '' END AS target_table, CASE m WHEN 0 THEN 'customer_id' WHEN 3 THEN 'order_dt' ELSE '' END AS target_column,
       failure_class, model || ' model failed with ' || error_type || ' — ' || substr(message, 1, 200) AS issue_summary, CASE WHEN n > 0 THEN 0.9::double ELSE 0.5::double END AS confidence,
       CAST(n AS BIGINT) AS database_evidence_count, CAST(least(3, coalesce(stored, 0)) AS BIGINT) AS similar_incidents_count
FROM c LEFT JOIN old USING (failure_class)
"""

_HISTORY = """
SELECT 'supplier_' || l_suppkey AS dataset, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS captured_at, l_returnflag AS column_name,
       arg_max(l_linestatus, struct_pack(l_shipdate, l_orderkey, l_linenumber)) AS data_type
FROM lineitem GROUP BY 1, 2, 3
"""
_INTERVALS = f"""
SELECT dataset, column_name, any_value(data_type) AS data_type, min(captured_at) AS valid_from, arg_max(next_at, k) AS valid_to, COUNT(*) AS captures FROM (
  SELECT *, SUM(new) OVER (PARTITION BY dataset, column_name ORDER BY k) AS run FROM (
    SELECT h.*, k, next_at, CASE WHEN lag(k) OVER w = k - 1 AND lag(data_type) OVER w = data_type THEN 0 ELSE 1 END AS new
    FROM h JOIN (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY captured_at) AS k, lead(captured_at) OVER (PARTITION BY dataset ORDER BY captured_at) AS next_at
                 FROM (SELECT DISTINCT dataset, captured_at FROM h)) c USING (dataset, captured_at)
    WINDOW w AS (PARTITION BY dataset, column_name ORDER BY k)))
GROUP BY dataset, column_name, run
"""
# the last interval's next capture is null, which arg_max passes over: a one-entry list keeps it
_INTERVALS = _INTERVALS.replace("arg_max(next_at, k)", "list_extract(arg_max([next_at], k), 1)")
ORACLE["schema_validity"] = f"WITH h AS ({_HISTORY}) SELECT * FROM ({_INTERVALS})"
ORACLE["schema_as_of"] = f"""
WITH h AS ({_HISTORY}), v AS ({_INTERVALS}), m AS (SELECT DISTINCT dataset, make_date(year(captured_at), 6, 15) AS "at" FROM h)
SELECT v.dataset, "at", column_name, data_type FROM v JOIN m ON v.dataset = m.dataset AND valid_from <= "at" AND (valid_to IS NULL OR "at" < valid_to)
"""
ORACLE["schema_changes"] = f"""
WITH h AS ({_HISTORY}), t AS (SELECT dataset, captured_at, lead(captured_at) OVER (PARTITION BY dataset ORDER BY captured_at) AS next_at FROM (SELECT DISTINCT dataset, captured_at FROM h)),
before AS (SELECT h.dataset, column_name, next_at AS moment, data_type AS old_type FROM h JOIN t ON h.dataset = t.dataset AND h.captured_at = t.captured_at WHERE next_at IS NOT NULL),
after AS (SELECT h.dataset, column_name, h.captured_at AS moment, data_type AS new_type FROM h JOIN t ON h.dataset = t.dataset AND h.captured_at = t.next_at)
SELECT dataset, column_name, moment AS "at", CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' ELSE 'retyped' END AS change, old_type, new_type
FROM before FULL JOIN after USING (dataset, column_name, moment) WHERE old_type IS DISTINCT FROM new_type
"""


def _grain(columns: list[str]) -> str:
    g = ", ".join(columns)
    return (f"SELECT '{','.join(columns)}' AS grain, COUNT(*) AS violations, CAST(coalesce(SUM(n), 0) AS BIGINT) AS rows_in_violation, "
            f"coalesce(array_to_string(list_reverse_sort(list(n))[1:10], ','), '') AS most FROM (SELECT {g}, COUNT(*) AS n FROM lineitem GROUP BY {g} HAVING COUNT(*) > 1)")


ORACLE["duplicate_grains"] = " UNION ALL ".join(_grain(g) for g in (["l_orderkey", "l_linenumber"], ["l_orderkey"], ["l_partkey", "l_suppkey"], ["l_shipdate"], ["l_orderkey", "l_partkey"]))
