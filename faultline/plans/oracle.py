"""DuckDB statements equal to the registered queries (the correctness oracle)."""

from __future__ import annotations

_PG_INITCAP = ("array_to_string(list_transform(regexp_extract_all(lower({x}), "
               "'([[:alnum:]]+|[^[:alnum:]]+)', 1), lambda p: upper(p[1]) || p[2:]), '')")

SILVER_SALES = """
SELECT CAST(l_orderkey * 8 + l_linenumber AS INTEGER) AS order_id,
       CASE WHEN l_partkey % 100 <> 50 THEN CAST(l_suppkey AS INTEGER) END AS customer_id,
       CAST(l_shipdate AS DATE) AS order_date,
       'part-' || CAST(l_partkey AS VARCHAR) AS product,
       CAST(l_quantity AS INTEGER) AS quantity,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS unit_price,
       CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount
FROM lineitem WHERE l_linenumber <> 7
"""

SILVER_CUSTOMERS = f"""
SELECT DISTINCT ON (CAST(c_custkey AS INTEGER))
       CAST(c_custkey AS INTEGER) AS customer_id,
       {_PG_INITCAP.format(x="trim(' ' || arrived || ' ')")} AS customer_name,
       lower(trim(c_name || '@Example.COM')) AS email,
       upper(trim(' ' || lower(c_mktsegment))) AS region
FROM (SELECT c_custkey, c_mktsegment, c_name, unnest(CASE WHEN c_custkey % 5 = 0 THEN [lower(c_name), 'a ' || lower(c_name)] ELSE [lower(c_name)] END) AS arrived FROM customer)
ORDER BY 1, 2, 3, 4
"""

ORACLE: dict[str, str] = {}

ORACLE["fct_sales"] = """
SELECT o.o_custkey AS customer_id, c.c_name AS customer_name, c.c_mktsegment AS region,
       CAST(o.o_orderdate AS DATE) AS order_date, COUNT(*) AS order_count,
       CAST(SUM(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS daily_revenue
FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
GROUP BY 1, 2, 3, 4
"""

ORACLE["silver_sales"] = f"""
SELECT order_id, customer_id, order_date, product, quantity,
       CAST(unit_price AS DOUBLE) AS unit_price, CAST(total_amount AS DOUBLE) AS total_amount
FROM ({SILVER_SALES}) s
"""

ORACLE["silver_customers"] = SILVER_CUSTOMERS

ORACLE["column_tests"] = f"""
WITH ss AS ({SILVER_SALES}), sc AS ({SILVER_CUSTOMERS}),
t AS (
  SELECT 'silver_sales' AS model, 'order_id' AS column_name, 'unique' AS test,
         (SELECT COUNT(*) FROM (SELECT order_id FROM ss WHERE order_id IS NOT NULL
                                GROUP BY order_id HAVING COUNT(*) > 1)) AS failures
  UNION ALL SELECT 'silver_sales', 'order_id', 'not_null', (SELECT COUNT(*) FROM ss WHERE order_id IS NULL)
  UNION ALL SELECT 'silver_sales', 'order_date', 'not_null', (SELECT COUNT(*) FROM ss WHERE order_date IS NULL)
  UNION ALL SELECT 'silver_sales', 'total_amount', 'not_null', (SELECT COUNT(*) FROM ss WHERE total_amount IS NULL)
  UNION ALL SELECT 'silver_customers', 'customer_id', 'unique',
         (SELECT COUNT(*) FROM (SELECT customer_id FROM sc WHERE customer_id IS NOT NULL
                                GROUP BY customer_id HAVING COUNT(*) > 1))
  UNION ALL SELECT 'silver_customers', 'customer_id', 'not_null', (SELECT COUNT(*) FROM sc WHERE customer_id IS NULL)
  UNION ALL SELECT 'silver_customers', 'customer_name', 'not_null', (SELECT COUNT(*) FROM sc WHERE customer_name IS NULL)
)
SELECT model, column_name, test, CAST(failures AS BIGINT) AS failures,
       CASE WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status
FROM t
"""

ORACLE["contract_violations"] = """
WITH g AS (
  SELECT o.o_custkey AS customer_id, CAST(o.o_orderdate AS DATE) AS order_date
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  GROUP BY o.o_custkey, c.c_name, c.c_mktsegment, CAST(o.o_orderdate AS DATE)
)
SELECT 'type_mismatch' AS kind, 'customer_id' AS column_name, 'integer' AS expected,
       'bigint' AS actual, CAST(NULL AS BIGINT) AS rows
UNION ALL
SELECT * FROM (
  SELECT 'not_null_violation' AS kind, 'customer_id' AS column_name, 'not null' AS expected, 'null' AS actual,
         COUNT(*) FILTER (WHERE customer_id IS NULL) AS rows FROM g
  UNION ALL
  SELECT 'not_null_violation', 'order_date', 'not null', 'null', COUNT(*) FILTER (WHERE order_date IS NULL) FROM g
) x WHERE x.rows > 0
"""

_ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
_LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                  "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]

ORACLE["null_check"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count FROM orders"
    for c in _ORDERS_COLS)

ORACLE["table_profile"] = " UNION ALL ".join(
    ["SELECT 'row_count' AS template, NULL AS column_name, CAST(COUNT(*) AS VARCHAR) AS value, "
     "CAST(1 AS BIGINT) AS row_count FROM lineitem"]
    + [f"SELECT 'null_check', '{c}', CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS VARCHAR), 1 FROM lineitem"
       for c in _LINEITEM_COLS]
    + ["SELECT 'freshness', 'l_shipdate', CAST(MAX(l_shipdate) AS VARCHAR), 1 FROM lineitem",
       "SELECT 'partition_check', 'l_returnflag', CAST(COUNT(*) FILTER (WHERE l_returnflag = 'R') AS VARCHAR), 1 "
       "FROM lineitem",
       "SELECT 'duplicate_total', 'l_orderkey', CAST(COUNT(*) AS VARCHAR), 1 FROM "
       "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1)",
       "SELECT 'duplicate_check', 'l_orderkey', NULL, COUNT(*) FROM "
       "(SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY COUNT(*) DESC LIMIT 10)"])

ORACLE["duplicate_check"] = """
SELECT l_orderkey, COUNT(*) AS cnt FROM lineitem GROUP BY l_orderkey HAVING COUNT(*) > 1
ORDER BY cnt DESC, l_orderkey NULLS FIRST LIMIT 10
"""

ORACLE["duplicate_total"] = """
SELECT COUNT(*) AS duplicate_key_count FROM (
  SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING COUNT(*) > 1) sub
"""

ORACLE["row_count"] = "SELECT COUNT(*) AS total_rows FROM events"
ORACLE["freshness"] = "SELECT MAX(ts) AS latest_record FROM events"
ORACLE["partition_check"] = ("SELECT COUNT(*) AS partition_rows FROM orders "
                             "WHERE CAST(o_orderdate AS DATE) = DATE '1996-01-02'")

ORACLE["invalid_cast_check"] = """
SELECT customer_id FROM (
  SELECT CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN replace(c_name, 'Customer#', 'CUST-')
              ELSE CAST(c_custkey AS VARCHAR) END AS customer_id FROM customer) t
WHERE customer_id IS NOT NULL AND NOT regexp_matches(customer_id, '^[0-9]+$')
ORDER BY customer_id LIMIT 20
"""

ORACLE["sample_rows"] = "SELECT * FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 5"

# --- logs --------------------------------------------------------------------------------

_ERR = [
    "'null value in column \"customer_id\" of relation \"gold.fct_sales\" violates not-null constraint'",
    "'invalid input syntax for type integer: \"CUST-' || user_id || '\"'",
    "'relation \"silver.silver_sales_' || user_id || '\" does not exist'",
    "'column \"order_dt\" of relation \"silver_sales\" does not exist'",
    "'permission denied for table sales'",
    "'duplicate key value violates unique constraint \"orders_pkey\" on insert into gold.fct_sales'",
    "'Compilation Error in model silver_customers (models/silver/silver_customers.sql)'",
    "'Database Error in model fct_sales (models/gold/fct_sales.sql)'",
    "'invalid input syntax for type date: \"2026-13-' || user_id || '\"'",
]
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_MSG = ("CASE WHEN event_type = 'error' THEN CASE " +
        " ".join(f"WHEN {_K} % 9 = {i} THEN {m}" for i, m in enumerate(_ERR)) + " END "
        "WHEN event_type = 'view' THEN 'Reading rows from bronze.sales join bronze.customers' "
        "WHEN event_type = 'click' THEN 'Slow query on table silver.silver_customers (' || "
        "CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR) || ' ms)' "
        "WHEN event_type = 'signup' THEN 'Task started for model silver_sales' "
        "WHEN event_type = 'purchase' THEN 'Inserting batch into gold.fct_sales' END")
_LEVEL = "CASE WHEN event_type = 'error' AND value > 100 THEN 'ERROR' WHEN event_type = 'click' AND value > 150 THEN 'WARNING' ELSE 'INFO' END"
LOG_LINES = f"""
SELECT 'run_' || CAST(user_id AS VARCHAR) AS log_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no,
       '[' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '] ' || {_LEVEL} || ' - ' || {_MSG} AS line
FROM events
"""
LOG_TEXTS = f"""
SELECT log_id, string_agg(line, chr(10) ORDER BY line_no) AS log_text FROM ({LOG_LINES}) GROUP BY log_id
"""
_KW = "(" + " OR ".join(f"contains(line, '{k}')" for k in
                        ["ERROR", "FATAL", "WARNING", "EXCEPTION", "Traceback"]) + ")"
_LB = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"

ORACLE["split_lines"] = f"""
SELECT doc_id, generate_subscripts(arr, 1) - 1 AS line_no, unnest(arr) AS line FROM (
  SELECT doc_id, regexp_split_to_array(regexp_replace(text, '({_LB})$', ''), '{_LB}') AS arr
  FROM documents WHERE text <> '')
"""

ORACLE["error_lines"] = f"""
SELECT log_id, line_no, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line
FROM ({LOG_LINES}) WHERE {_KW}
"""

RELEVANT = f"""
SELECT log_id, line_no, line FROM (
  SELECT *, COUNT(*) OVER (PARTITION BY log_id) AS total,
         MAX(CASE WHEN {_KW} THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no
             ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near
  FROM ({LOG_LINES}))
WHERE total <= 50 OR line_no >= total - 50 OR near = 1
"""
ORACLE["relevant_lines"] = RELEVANT

ORACLE["truncate_log"] = f"""
SELECT log_id, string_agg(piece, chr(10) ORDER BY line_no) AS truncated FROM (
  SELECT log_id, line_no,
         CASE WHEN line_no - COALESCE(LAG(line_no) OVER (PARTITION BY log_id ORDER BY line_no), -1) - 1 > 0
              THEN '... (' || CAST(line_no - COALESCE(LAG(line_no) OVER (PARTITION BY log_id ORDER BY line_no), -1) - 1
                                   AS VARCHAR) || ' lines omitted) ...' || chr(10) || line
              ELSE line END AS piece
  FROM ({RELEVANT}))
GROUP BY log_id
"""

# fixed values: they must equal the reference's rules
_SIGS = [
    ("not_null_violation", r'null value in column "(\w+)".*not-null constraint', 1, "23502", "not_null_violation"),
    ("type_cast_failure", r'invalid input syntax for type (\w+): "([^"]+)"', 2, "22P02", "type_cast_failure"),
    ("relation_not_found", r'relation "([^"]+)" does not exist', 1, "42P01", "relation_not_found"),
    ("column_not_found", r'column "(\w+)" (?:of relation "(\w+)" )?does not exist', 2, "42703", "column_not_found"),
    ("permission_denied", r"permission denied for (\w+) (\w+)", 2, "42501", "permission_denied"),
    ("unique_violation", r"duplicate key value violates unique constraint", 0, "23505", "unique_violation"),
    ("dbt_compile_error", r"Compilation Error in model (\w+)", 1, None, "dbt_compile_error"),
    ("dbt_database_error", r"Database Error in model (\w+)", 1, None, "dbt_database_error"),
    ("invalid_date", r'invalid input syntax for type date: "([^"]+)"', 1, "22007", "type_cast_failure"),
]


def _q(s):
    return "'" + s.replace("'", "''") + "'"


SIG_ROWS = " UNION ALL ".join(
    f"SELECT log_id, {i} AS ordinal, '{n}' AS pattern, '{et}' AS error_type, "
    f"{_q(st) if st else 'NULL'} AS sql_state, "
    f"regexp_extract(log_text, {_q('(?i)' + p)}, 0) AS match, "
    f"{('nullif(regexp_extract(log_text, ' + _q('(?i)' + p) + ', 1), ' + _q('') + ')') if g >= 1 else 'NULL'} AS group1, "
    f"{('nullif(regexp_extract(log_text, ' + _q('(?i)' + p) + ', 2), ' + _q('') + ')') if g >= 2 else 'NULL'} AS group2 "
    f"FROM ({LOG_TEXTS})" for i, (n, p, g, st, et) in enumerate(_SIGS))

ORACLE["signatures"] = f"SELECT log_id, pattern, match, group1, group2 FROM ({SIG_ROWS}) WHERE match <> ''"

ORACLE["resolve_error"] = f"""
WITH m AS (SELECT * FROM ({SIG_ROWS}) WHERE match <> ''),
pick AS (
  SELECT log_id, arg_min(struct_pack(error_type, sql_state, match),
                         CASE WHEN sql_state IS NOT NULL THEN ordinal ELSE 100 + ordinal END) AS c
  FROM m GROUP BY log_id)
SELECT t.log_id, p.c.error_type AS error_type, p.c.sql_state AS sql_state_code, p.c.match AS error_message
FROM ({LOG_TEXTS}) t LEFT JOIN pick p ON t.log_id = p.log_id
"""


def _distinct_join(expr):
    return (f"array_to_string(list_filter({expr}, lambda x, i: list_position({expr}, x) = i), ',')")


# fixed values: they must equal the reference's rules
_TBL = r'(?i)(?:relation|table|from|join|into)\s+"?(\w+)"?\."?(\w+)"?'
ORACLE["referenced_objects"] = f"""
SELECT log_id,
       {_distinct_join("list_transform(regexp_extract_all(log_text, " + _q(_TBL) + ", 0), lambda m: regexp_extract(m, " + _q(_TBL) + ", 1) || '.' || regexp_extract(m, " + _q(_TBL) + ", 2))")} AS tables,
       {_distinct_join("regexp_extract_all(log_text, " + _q('(?i)column "(\\w+)"') + ", 1)")} AS columns,
       {_distinct_join("regexp_extract_all(log_text, " + _q('(?i)model (\\w+)') + ", 1)")} AS models
FROM ({LOG_TEXTS})
"""

# --- incidents, investigation, memory ---------------------------------------------------

# fixed values: they must equal the reference's rules
_TASKS = ["run_dbt_silver_sales", "run_dbt_silver_customers", "run_dbt_fct_sales", "run_dbt_tests",
          "ingest_raw_sales", "run_dbt_gold_orders"]
_TASK_CASE = "CASE " + " ".join(f"WHEN {_K} % 6 = {i} THEN '{t}'" for i, t in enumerate(_TASKS)) + " END"
TRIGGERS = f"""
SELECT CASE WHEN {_K} % 3 = 0 THEN NULL ELSE 'sales_pipeline' END AS pipeline_name,
       'sales_pipeline' AS dag_id, {_TASK_CASE} AS task_id, 'run_' || CAST(event_id AS VARCHAR) AS run_id,
       printf('event %d failed with value %.2f', event_id, value) AS error_message,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, ts
FROM events WHERE event_type = 'error'
"""
_MODEL = ("CASE task_id WHEN 'run_dbt_silver_sales' THEN 'silver_sales' "
          "WHEN 'run_dbt_silver_customers' THEN 'silver_customers' WHEN 'run_dbt_fct_sales' THEN 'fct_sales' "
          "WHEN 'run_dbt_tests' THEN NULL WHEN 'ingest_raw_sales' THEN NULL WHEN 'ingest_raw_customers' THEN NULL "
          "ELSE CASE WHEN starts_with(task_id, 'run_dbt_') THEN substr(task_id, 9) END END")
ORACLE["intake"] = f"""
SELECT 'INC-' || strftime(ts, '%Y%m%d%H%M%S') || '-' ||
       substr(md5(concat_ws('|', dag_id, task_id, run_id, error_message, '', ts_text)), 1, 16) AS incident_id,
       COALESCE(pipeline_name, dag_id) AS pipeline_name, 'error' AS severity, task_id,
       {_MODEL} AS dbt_model, run_id
FROM ({TRIGGERS})
"""

# fixed values: they must equal the reference's rules
_CLASS = ("CASE error_type WHEN 'not_null_violation' THEN 'data_quality' WHEN 'unique_violation' THEN 'data_quality' "
          "WHEN 'type_cast_failure' THEN 'schema_drift' WHEN 'relation_not_found' THEN 'code_failure' "
          "WHEN 'column_not_found' THEN 'code_failure' WHEN 'dbt_compile_error' THEN 'code_failure' "
          "WHEN 'dbt_database_error' THEN 'data_quality' WHEN 'permission_denied' THEN 'access' "
          "WHEN 'timeout' THEN 'resource' WHEN 'oom' THEN 'resource' ELSE 'unknown' END")
_PRIO = ("CASE failure_class WHEN 'data_quality' THEN 'null_check,duplicate_check,row_count' "
         "WHEN 'schema_drift' THEN 'column_presence,invalid_cast_check' "
         "WHEN 'code_failure' THEN 'code_inspection,lineage_check' WHEN 'access' THEN 'permission_check' "
         "WHEN 'resource' THEN 'row_count' WHEN 'unknown' THEN 'null_check,row_count,column_presence' "
         "ELSE '' END")
CLASSIFIED = f"""
SELECT log_id, error_type, {_CLASS} AS failure_class FROM ({ORACLE["resolve_error"]})
"""
ORACLE["classify"] = f"""
SELECT log_id, error_type, failure_class, 0.5 AS classification_confidence, {_PRIO} AS priorities
FROM ({CLASSIFIED})
"""

# fixed values: they must equal the reference's rules
_TEMPLATES = {
    "data_quality": ["null_check", "duplicate_check", "duplicate_total", "row_count", "freshness"],
    "schema_drift": ["column_presence", "invalid_cast_check"],
    "code_failure": ["sample_rows", "null_check", "row_count"],
    "dependency": ["partition_check", "row_count", "freshness"],
    "silent_correctness": ["row_count", "null_check", "duplicate_check"],
    "resource": ["row_count"],
    "access": ["column_presence"],
}
_CT = " UNION ALL ".join(f"SELECT '{c}' AS failure_class, {i} AS ordinal, '{t}' AS template"
                         for c, ts in _TEMPLATES.items() for i, t in enumerate(ts))
_NEEDS_COLUMN = "('null_check', 'duplicate_check', 'duplicate_total', 'invalid_cast_check')"
ORACLE["plan_checks"] = f"""
WITH tgt AS (
  SELECT c.log_id AS incident_id, c.failure_class,
         nullif(regexp_extract(t.log_text, {_q(_TBL)}, 1), '') AS schema,
         nullif(regexp_extract(t.log_text, {_q(_TBL)}, 2), '') AS "table",
         nullif(regexp_extract(t.log_text, {_q('(?i)column "(\\w+)"')}, 1), '') AS "column"
  FROM ({CLASSIFIED}) c JOIN ({LOG_TEXTS}) t ON c.log_id = t.log_id),
ct AS ({_CT}),
plan AS (
  SELECT tgt.*, ct.ordinal, ct.template FROM tgt JOIN ct ON tgt.failure_class = ct.failure_class
  UNION ALL
  SELECT tgt.*, 0, 'row_count' FROM tgt WHERE failure_class NOT IN (SELECT failure_class FROM ct))
SELECT incident_id, failure_class, schema, "table", "column", ordinal, template FROM plan
WHERE template NOT IN ('partition_check', 'sample_rows')
  AND NOT (template IN {_NEEDS_COLUMN} AND "column" IS NULL)
"""

ORACLE["similar_incidents"] = """
WITH e AS (SELECT vec_id, 'class_' || CAST(label AS VARCHAR) AS failure_class,
                  CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, s.vec_id AS incident_id, s.failure_class,
             list_cosine_similarity(q.v, s.v) AS sim
      FROM e q JOIN e s ON q.failure_class = s.failure_class AND q.vec_id <> s.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, incident_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, incident_id, failure_class, round(sim, 4) AS similarity_score
FROM r WHERE rank <= 3
"""
ORACLE["similar_by_pivots"] = ORACLE["similar_incidents"]

INCIDENT_ROWS = """
SELECT 'INC-' || CAST(user_id AS VARCHAR) || '-' || event_type AS incident_id, ts AS created_at,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'warning' END AS severity, 'open' AS status,
       'events' AS source, 'sales_pipeline' AS pipeline_name, 'sales_pipeline' AS dag_id, event_type AS task_id,
       'run_' || CAST(user_id AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS dbt_model, 'events' AS target_table,
       'value' AS target_column, event_type AS failure_class, 'event ' || CAST(event_id AS VARCHAR) AS issue_summary,
       props AS root_cause, value / 500.0 AS confidence, CAST(NULL AS VARCHAR) AS fix_summary,
       CAST(NULL AS VARCHAR) AS prevention_summary, props AS evidence_json, false AS validated, ts, event_id
FROM events
"""
UPSERTED = f"""
WITH b AS ({INCIDENT_ROWS}),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts, event_id) AS rn FROM b)
      WHERE rn = 1),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, event_id DESC) AS rn
      FROM b) WHERE rn = 1)
SELECT f.incident_id, f.created_at, f.severity, f.status, f.source, f.pipeline_name, f.dag_id, f.task_id, f.run_id,
       l.dbt_model, l.target_table, l.target_column, l.failure_class, l.issue_summary, l.root_cause, l.confidence,
       l.fix_summary, l.prevention_summary, l.evidence_json, f.validated
FROM f JOIN l ON f.incident_id = l.incident_id
"""
ORACLE["upsert_incidents"] = UPSERTED
ORACLE["recent_incidents"] = f"""
SELECT incident_id, created_at, pipeline_name, failure_class, severity, substr(issue_summary, 1, 200) AS summary,
       confidence, validated
FROM ({UPSERTED}) ORDER BY created_at DESC, incident_id LIMIT 20
"""

# --- layered questions -------------------------------------------------------------------

ORDER_GAPS = """
SELECT d FROM (
  SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders),
                                     (SELECT max(CAST(o_orderdate AS DATE)) FROM orders),
                                     INTERVAL 1 DAY)) AS DATE) AS d)
WHERE d NOT IN (SELECT DISTINCT CAST(o_orderdate AS DATE) FROM orders)
"""
_LAYERS = {"bronze": "bronze:bronze.orders", "silver": "silver:silver.silver_orders", "gold": "gold:gold.fct_orders"}
_LAYER_ROWS = {
    "bronze": "SELECT CAST(o_orderdate AS DATE) AS d FROM orders",
    "silver": "SELECT CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(CAST(o_orderdate AS DATE)) <> 13",
    "gold": "SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE day(CAST(o_orderdate AS DATE)) NOT IN (13, 27)",
}
_LAYER_PARTS = []
for _i, _l in enumerate(_LAYERS):
    _rows, _ctx = f"({_LAYER_ROWS[_l]})", _LAYERS[_l]
    _LAYER_PARTS += [
        f"SELECT incident_id, '{_l}' AS layer, {_i} AS ord, '{_ctx}' AS context, 'row_count' AS template, NULL AS column_name, CAST((SELECT COUNT(*) FROM {_rows}) AS VARCHAR) AS value FROM days",
        f"SELECT incident_id, '{_l}', {_i}, '{_ctx}', 'freshness', 'order_date', (SELECT CAST(MAX(d) AS VARCHAR) FROM {_rows}) FROM days",
        f"SELECT incident_id, '{_l}', {_i}, '{_ctx}', 'partition_check', 'order_date', CAST(coalesce(n, 0) AS VARCHAR) FROM days LEFT JOIN "
        f"(SELECT d, COUNT(*) AS n FROM {_rows} GROUP BY d) c ON c.d = days.d"]
LAYER_EVIDENCE = """
WITH days AS (SELECT 'Q-' || CAST(CAST(d AS DATE) AS VARCHAR) AS incident_id, CAST(d AS DATE) AS d FROM (
  SELECT unnest(generate_series((SELECT MIN(CAST(o_orderdate AS DATE)) FROM orders), (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS d))
""" + " UNION ALL ".join(_LAYER_PARTS)
ORACLE["layer_checks"] = f"SELECT incident_id, context, template, column_name, value FROM ({LAYER_EVIDENCE})"
ORACLE["origin_layer"] = f"""
WITH e AS (SELECT *, (template IN ('row_count', 'partition_check') AND value = '0')
                     OR (template = 'freshness' AND value IS NULL) AS bad FROM ({LAYER_EVIDENCE}))
SELECT incident_id, arg_min(layer, ord) FILTER (WHERE bad) AS origin_layer,
       COUNT(*) FILTER (WHERE bad) AS failing_checks, COUNT(*) AS checks,
       CASE arg_min(layer, ord) FILTER (WHERE bad) WHEN 'bronze' THEN 'ingestion'
            WHEN 'silver' THEN 'transformation' WHEN 'gold' THEN 'aggregation/join' END AS origin_stage
FROM e GROUP BY incident_id
"""

# --- reports and evaluation ----------------------------------------------------------------

from faultline.operators.evaluate import SCENARIOS as _SC  # noqa: E402


def _list(xs):
    return "[" + ", ".join(_q(x) for x in xs) + "]"


_EXPECTED = " UNION ALL ".join(
    f"SELECT '{n}' AS scenario, '{e['failure_class']}' AS expected_class, {_list(e['expected_tables'])} AS et, "
    f"'{e['expected_column']}' AS ec, {_list(e['root_cause_keywords'])} AS rk, {_list(e['fix_should_mention'])} AS fk, "
    f"{_list(e['prevention_should_mention'])} AS pk" for n, e in _SC.items())


def _hits(text, lst):
    return f"len(list_filter({lst}, lambda k: contains({text}, lower(k))))"


SCORES = f"""
WITH d AS (SELECT * REPLACE (text || CASE
    WHEN lang = 'en' AND doc_id % 10 <> 0 THEN ' null customer_id after the join in bronze.sales breaks the not null constraint: filter them, add a not_null test and an alert'
    WHEN lang = 'fr' AND doc_id % 3 <> 0 THEN ' the cast of customer_id from text to integer in bronze.customers fails: remove the prefix, put the format under a schema contract'
    ELSE '' END AS text) FROM documents),
r AS (
  SELECT doc_id, CASE lang WHEN 'en' THEN 'null_join_key' WHEN 'fr' THEN 'schema_drift'
                           WHEN 'de' THEN 'missing_partition' WHEN 'es' THEN 'missing_partition' END AS scenario,
         CASE lang WHEN 'en' THEN 'data_quality' WHEN 'fr' THEN 'schema_drift' WHEN 'de' THEN 'silent_correctness'
                   WHEN 'es' THEN 'dependency' END AS failure_class,
         lower(text) AS rc, lower(source) AS ev, lower(concat_ws(' ', text, '', lang)) AS fx,
         lower(source || ' ' || lang) AS pv
  FROM d),
x AS (SELECT r.*, e.*, concat_ws(' ', rc, ev, fx, pv) AS alltext, concat_ws(' ', fx, pv) AS pvt
      FROM r JOIN ({_EXPECTED}) e ON r.scenario = e.scenario),
s AS (
  SELECT doc_id, x.scenario,
    CASE WHEN failure_class = expected_class THEN 1.0
         WHEN expected_class = 'silent_correctness' AND failure_class IN ('data_quality', 'dependency') THEN 0.5
         ELSE 0.0 END AS classification,
    CASE WHEN {_hits('alltext', 'et')} > 0 THEN 1.0 ELSE 0.0 END AS table_identified,
    CASE WHEN contains(alltext, lower(ec)) THEN 1.0 ELSE 0.0 END AS column_identified,
    CASE WHEN {_hits('rc', 'rk')} / len(rk) >= 0.4 THEN 1.0 WHEN {_hits('rc', 'rk')} / len(rk) >= 0.2 THEN 0.5
         ELSE 0.0 END AS root_cause,
    CASE WHEN {_hits('fx', 'fk')} >= 2 THEN 1.0 WHEN {_hits('fx', 'fk')} >= 1 THEN 0.5 ELSE 0.0 END AS fix_actionable,
    CASE WHEN {_hits('pvt', 'pk')} >= 2 THEN 1.0 WHEN {_hits('pvt', 'pk')} >= 1 THEN 0.5 ELSE 0.0 END AS prevention
  FROM x)
SELECT *, classification + table_identified + column_identified + root_cause + fix_actionable + prevention AS total
FROM s
"""
ORACLE["score_reports"] = SCORES
ORACLE["scorecard"] = f"""
SELECT scenario, COUNT(*) AS reports, AVG(total) AS overall,
       CASE WHEN AVG(total) >= 5.0 THEN 'EXCELLENT' WHEN AVG(total) >= 4.0 THEN 'GOOD'
            WHEN AVG(total) >= 3.0 THEN 'FAIR' ELSE 'NEEDS WORK' END AS verdict
FROM ({SCORES}) GROUP BY scenario
"""

ORACLE["parse_responses"] = """
SELECT conv_id, turn, role IN ('assistant', 'system') AS parse_ok,
       CASE WHEN role IN ('assistant', 'system') THEN role END AS parsed_role,
       CASE WHEN role IN ('assistant', 'system') THEN CAST(length(text) AS INTEGER) END AS parsed_chars
FROM conversations
"""

_WORDS = "COALESCE(len(regexp_extract_all({x}, '[^ \\t\\n\\r\\f]+')), 0)"
ORACLE["usage_cost"] = f"""
WITH c AS (
  SELECT *, count(*) FILTER (role = 'assistant') OVER (
              PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS call
  FROM conversations),
u AS (SELECT conv_id, call,
             ['signal_extraction', 'classification', 'code_inspection', 'root_cause_reasoning', 'fix_generation'][call + 1] AS node,
             coalesce(sum({_WORDS.format(x='text')}) FILTER (role IS DISTINCT FROM 'assistant'), 0) AS input_tokens,
             coalesce(sum({_WORDS.format(x='text')}) FILTER (role = 'assistant'), 0) AS output_tokens FROM c GROUP BY conv_id, call)
SELECT conv_id, COUNT(*) AS calls, CAST(SUM(input_tokens) AS BIGINT) AS input_tokens,
       CAST(SUM(output_tokens) AS BIGINT) AS output_tokens,
       round(SUM(CASE WHEN node IN ('signal_extraction', 'classification')
                      THEN input_tokens * 0.15 / 1000000 + output_tokens * 0.60 / 1000000
                      ELSE input_tokens * 2.50 / 1000000 + output_tokens * 10.00 / 1000000 END), 9) AS cost_usd
FROM u GROUP BY conv_id
"""

# --- described controls ----------------------------------------------------------------------

_PAT = "regexp_replace(regexp_replace(props, '[0-9]', '9', 'g'), '[A-Za-z]', 'A', 'g')"
ORACLE["format_drift"] = f"""
WITH b AS (SELECT event_type, {_PAT} AS pattern, COUNT(*) AS n FROM events
           WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1, 2),
c AS (SELECT event_type, {_PAT} AS pattern, COUNT(*) AS n FROM events
      WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, 2)
SELECT COALESCE(b.event_type, c.event_type) AS event_type, COALESCE(b.pattern, c.pattern) AS pattern,
       COALESCE(b.n, 0) AS baseline_rows, COALESCE(c.n, 0) AS current_rows,
       b.n IS NULL AND c.n IS NOT NULL AS new_pattern
FROM b FULL OUTER JOIN c ON b.event_type = c.event_type AND b.pattern = c.pattern
"""

ORACLE["rolling_deviation"] = """
WITH n AS (SELECT event_type, CAST(ts AS DATE) AS day, COUNT(*) AS rows FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
cal AS (SELECT k.event_type, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day
        FROM (SELECT DISTINCT event_type FROM n) k, (SELECT min(day) AS lo, max(day) AS hi FROM n)),
d AS (SELECT cal.event_type, cal.day, COALESCE(rows, 0) AS rows FROM cal LEFT JOIN n USING (event_type, day)),
m AS (SELECT *, AVG(rows) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)
                AS trailing_mean FROM d)
SELECT event_type, day, rows, trailing_mean,
       CASE WHEN trailing_mean > 0 THEN (rows - trailing_mean) / trailing_mean END AS deviation,
       CASE WHEN trailing_mean = 0 THEN rows > 0
            ELSE COALESCE(abs((rows - trailing_mean) / trailing_mean) > 0.5, false) END AS flagged
FROM m
"""


def _gaps(table, col):
    return f"""
SELECT d AS day, '{table}' AS "table" FROM (
  SELECT CAST(unnest(generate_series((SELECT min(CAST({col} AS DATE)) FROM {table}),
                                     (SELECT max(CAST({col} AS DATE)) FROM {table}), INTERVAL 1 DAY)) AS DATE) AS d)
WHERE d NOT IN (SELECT DISTINCT CAST({col} AS DATE) FROM {table} WHERE {col} IS NOT NULL)"""


ORACLE["missing_partitions"] = _gaps("events", "ts") + " UNION ALL " + _gaps("orders", "o_orderdate")


def _orphans(fact, fk, dim, pk, rel):
    return (f"SELECT '{rel}' AS relation, COUNT(*) AS orphan_rows FROM {fact} f "
            f"WHERE f.{fk} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {dim} d WHERE d.{pk} = f.{fk})")


ORACLE["orphans"] = " UNION ALL ".join([
    _orphans("lineitem", "l_orderkey", "orders", "o_orderkey", "lineitem.l_orderkey->orders"),
    _orphans("lineitem", "l_partkey", "part", "p_partkey", "lineitem.l_partkey->part"),
    _orphans("lineitem", "l_suppkey", "supplier", "s_suppkey", "lineitem.l_suppkey->supplier"),
    _orphans("orders", "o_custkey", "customer", "c_custkey", "orders.o_custkey->customer"),
    _orphans("labels", "doc_id", "documents", "doc_id", "labels.doc_id->documents"),
    _orphans("orders", "o_custkey", "(SELECT * FROM customer WHERE c_acctbal > 0)", "c_custkey", "orders.o_custkey->customer in credit"),
    _orphans("documents", "doc_id", "labels", "doc_id", "documents.doc_id->labels")])


def _grain(table, cols):
    g = ", ".join(cols)
    return (f"SELECT '{table}' AS \"table\", '{','.join(cols)}' AS grain, COUNT(*) AS violations, "
            f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS rows_in_violation "
            f"FROM (SELECT {g}, COUNT(*) AS n FROM {table} GROUP BY {g} HAVING COUNT(*) > 1)")


ORACLE["grain"] = " UNION ALL ".join([_grain("lineitem", ["l_orderkey", "l_linenumber"]),
                                      _grain("lineitem", ["l_orderkey"]),
                                      _grain("conversations", ["conv_id", "turn"])])

# --- evidence, reports, context ----------------------------------------------------------------

_BRONZE_SALES = """SELECT CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS order_id, CASE WHEN l_partkey % 100 <> 50 THEN CAST(l_suppkey AS VARCHAR) END AS customer_id,
  CASE WHEN l_linenumber <> 7 THEN strftime(l_shipdate, '%Y-%m-%d') END AS order_date, 'part-' || CAST(l_partkey AS VARCHAR) AS product,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS unit_price FROM lineitem"""
_BRONZE_CUSTOMERS = """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, ' ' || arrived || ' ' AS customer_name,
  c_name || '@Example.COM' AS email, ' ' || lower(c_mktsegment) AS region
  FROM (SELECT *, unnest(CASE WHEN c_custkey % 5 = 0 THEN [lower(c_name), 'a ' || lower(c_name)] ELSE [lower(c_name)] END) AS arrived FROM customer)"""
_FCT = f"""SELECT s.customer_id, c.customer_name, c.region, s.order_date, COUNT(*) AS order_count, SUM(s.total_amount) AS daily_revenue
  FROM ({SILVER_SALES}) s LEFT JOIN ({SILVER_CUSTOMERS}) c USING (customer_id) GROUP BY 1, 2, 3, 4"""
# registered table -> statement, columns
_TABLES = {
    ("bronze", "sales"): (_BRONZE_SALES, ["order_id", "customer_id", "order_date", "product", "quantity", "unit_price"]),
    ("bronze", "customers"): (_BRONZE_CUSTOMERS, ["customer_id", "customer_name", "email", "region"]),
    ("silver", "silver_sales"): (SILVER_SALES, ["order_id", "customer_id", "order_date", "product", "quantity", "unit_price", "total_amount"]),
    ("silver", "silver_customers"): (SILVER_CUSTOMERS, ["customer_id", "customer_name", "email", "region"]),
    ("gold", "fct_sales"): (_FCT, ["customer_id", "customer_name", "region", "order_date", "order_count", "daily_revenue"]),
}


def _table_evidence(schema, table, sql, columns):
    """template, column, value and row count of every check that the table can have."""
    row = lambda template, column, value, n, rest: (
        f"SELECT '{schema}' AS schema, '{table}' AS \"table\", '{template}' AS template, {column} AS about, {value} AS value, {n} AS row_count {rest}")
    t = f"FROM (SELECT * FROM {schema}_{table})"
    out = [row("row_count", "NULL", "CAST(COUNT(*) AS VARCHAR)", "1", t), row("column_presence", "NULL", "NULL", str(len(columns)), "")]
    for c in columns:
        dup = f"FROM (SELECT COUNT(*) AS cnt FROM {schema}_{table} GROUP BY {c}) WHERE cnt > 1"
        out += [row("null_check", f"'{c}'", f"CAST(COUNT(*) FILTER ({c} IS NULL) AS VARCHAR)", "1", t),
                row("duplicate_total", f"'{c}'", "CAST(COUNT(*) AS VARCHAR)", "1", dup),
                row("duplicate_check", f"'{c}'", "NULL", "least(10, COUNT(*))", dup),
                row("invalid_cast_check", f"'{c}'", "NULL", f"least(20, COUNT(*) FILTER (NOT regexp_matches(CAST({c} AS VARCHAR), '^[0-9]+$')))", t)]
    if "order_date" in columns:
        out.append(row("freshness", "'order_date'", "CAST(MAX(order_date) AS VARCHAR)", "1", t))
    return out


_WITH_TABLES = ", ".join(f"{s}_{t} AS MATERIALIZED ({sql})" for (s, t), (sql, _) in _TABLES.items())
_EVIDENCE = " UNION ALL ".join(e for (s, t), (sql, cols) in _TABLES.items() for e in _table_evidence(s, t, sql, cols))
_KNOWN = ", ".join(f"('{s}', '{t}')" for s, t in _TABLES)
ORACLE["run_checks"] = f"""
WITH {_WITH_TABLES}, ev AS ({_EVIDENCE}),
p AS (SELECT DISTINCT incident_id, schema, "table", template,
             CASE template WHEN 'freshness' THEN 'order_date' WHEN 'row_count' THEN NULL WHEN 'column_presence' THEN NULL ELSE "column" END AS about
      FROM ({ORACLE["plan_checks"]}) WHERE "table" IS NOT NULL)
SELECT p.incident_id, p.schema, p."table", p.template, p.about AS column_name, ev.value, CAST(coalesce(ev.row_count, 0) AS BIGINT) AS row_count,
       CASE WHEN (p.schema, p."table") NOT IN ({_KNOWN}) THEN 'relation "' || p.schema || '.' || p."table" || '" does not exist'
            WHEN ev.template IS NULL THEN 'column "' || p.about || '" does not exist' END AS error
FROM p LEFT JOIN ev ON p.schema = ev.schema AND p."table" = ev."table" AND p.template = ev.template AND p.about IS NOT DISTINCT FROM ev.about
"""

ORACLE["reports"] = f"""
WITH r AS ({ORACLE["resolve_error"]}), txt AS ({LOG_TEXTS}),
facts AS (SELECT log_id, round(0.5 + COUNT(*) FILTER (contains(line, '] ERROR - ')) / COUNT(*), 4) AS stated, COUNT(*) >= 10 AS logs_available FROM ({LOG_LINES}) GROUP BY log_id),
ev AS (SELECT incident_id, COUNT(*) FILTER (error IS NULL) AS n FROM ({ORACLE["run_checks"]}) GROUP BY 1),
j AS (SELECT r.log_id, r.error_type, r.error_message, {_CLASS} AS failure_class, coalesce(ev.n, 0) AS n, stated, logs_available,
             nullif(regexp_extract(log_text, {_q('(?i)model (\\w+)')}, 1), '') AS model,
             nullif(regexp_extract(log_text, {_q(_TBL)}, 2), '') AS "table",
             nullif(regexp_extract(log_text, {_q('(?i)column "(\\w+)"')}, 1), '') AS "column"
      FROM r JOIN txt USING (log_id) JOIN facts USING (log_id) LEFT JOIN ev ON ev.incident_id = r.log_id),
c AS (SELECT *, least(stated, CASE WHEN logs_available THEN 1.0 ELSE 0.7 END, CASE WHEN n > 0 THEN 1.0 ELSE 0.5 END) AS confidence FROM j)
SELECT log_id AS incident_id, failure_class,
       coalesce(nullif(concat_ws(' ', model || ' model failed', CASE WHEN error_type <> '' AND error_type <> 'unknown' THEN 'with ' || error_type END,
                                 CASE WHEN error_message <> '' THEN '— ' || substr(error_message, 1, 200) END), ''), 'Pipeline failure detected') AS what_failed,
       coalesce(nullif(error_message, ''), 'Failure mechanism not determined') AS how_it_failed,
       coalesce("table", '') AS "table", coalesce("column", '') AS "column", CAST(n AS BIGINT) AS database_evidence_count, CAST(round(confidence, 4) AS DOUBLE) AS confidence,
       CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band
FROM c
"""

ORACLE["pack_context"] = f"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT doc_id, CAST(line_no AS INTEGER) AS ordinal, line, {_WORDS.format(x='line')} AS tokens FROM ({ORACLE["split_lines"]})),
f AS (
  SELECT doc_id, CAST(-1 AS INTEGER) AS ordinal, CAST(800 AS BIGINT) AS rest, CAST(0 AS BIGINT) AS keep FROM (SELECT DISTINCT doc_id FROM p)
  UNION ALL
  SELECT p.doc_id, p.ordinal,
         CAST(CASE WHEN line = '' THEN rest WHEN tokens <= rest THEN rest - tokens WHEN rest > 50 THEN 10 ELSE rest END AS BIGINT),
         CAST(CASE WHEN line = '' THEN 0 WHEN tokens <= rest THEN tokens WHEN rest > 50 THEN rest - 10 ELSE 0 END AS BIGINT)
  FROM f JOIN p ON p.doc_id = f.doc_id AND p.ordinal = f.ordinal + 1)
SELECT p.doc_id, p.ordinal, 'line_' || CAST(p.ordinal AS VARCHAR) AS label, keep AS kept_tokens,
       CASE WHEN keep <= 0 THEN '' WHEN keep >= tokens THEN line
            ELSE array_to_string(regexp_extract_all(line, '[^ \\t\\n\\r\\f]+')[1:keep], ' ') END AS packed_text
FROM p JOIN f ON p.doc_id = f.doc_id AND p.ordinal = f.ordinal
"""

# --- lineage ---------------------------------------------------------------------------------

NODES = """
SELECT 'model.tpch.order_' || o_orderkey AS unique_id, 'order_' || o_orderkey AS model, 'gold' AS schema, o_orderpriority AS description,
       ['silver_customer_' || o_custkey] AS upstream_models,
       coalesce((SELECT list('part_' || l_partkey ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), []) AS sources
FROM orders
UNION ALL
SELECT 'model.tpch.silver_customer_' || c_custkey, 'silver_customer_' || c_custkey, 'silver', c_mktsegment, [], ['nation_' || c_nationkey] FROM customer
"""
_PART_SCHEMA = "CASE WHEN starts_with(s, 'nation_') THEN 'bronze' WHEN CAST(substr(s, 6) AS INTEGER) % 7 <> 0 THEN 'raw' END"
LINEAGE = f"""
SELECT n.*, list_transform(sources, lambda s: struct_pack(schema := {_PART_SCHEMA}, "table" := s)) AS upstream_sources,
       CASE WHEN n.schema = 'silver' THEN coalesce((SELECT list('order_' || o_orderkey ORDER BY 'order_' || o_orderkey) FROM orders
                                                   WHERE 'silver_customer_' || o_custkey = n.model), []) ELSE [] END AS downstream_models
FROM ({NODES}) n
"""
ORACLE["lineage"] = f"""
SELECT model, schema, description, array_to_string(upstream_models, ',') AS upstream_models,
       array_to_string(list_transform(upstream_sources, lambda s: coalesce(s.schema, '-') || '.' || s."table"), ',') AS upstream_sources,
       array_to_string(downstream_models, ',') AS downstream_models,
       concat_ws(' → ', nullif(array_to_string(list_transform(upstream_sources, lambda s: coalesce(s.schema, 'bronze') || '.' || s."table"), ' + '), ''),
                 nullif(array_to_string(upstream_models, ' + '), ''), model, nullif(array_to_string(downstream_models, ' + '), '')) AS dependency_chain
FROM ({LINEAGE})
"""
ORACLE["upstream_details"] = f"""
SELECT n.unique_id, d.model AS up_model, d.schema AS up_schema, d.description AS up_description, array_to_string(d.sources, ',') AS up_sources
FROM ({NODES}) n JOIN ({NODES}) d ON d.model = n.upstream_models[1]
"""
ORACLE["metadata_targets"] = f"""
SELECT DISTINCT model, s.schema, s."table" FROM (SELECT model, unnest(upstream_sources) AS s FROM ({LINEAGE}))
UNION SELECT model, 'silver', unnest(upstream_models) FROM ({NODES})
"""
ORACLE["upstream_checks"] = f"""
WITH bad AS (SELECT * FROM ({LINEAGE}) WHERE description IN ('1-URGENT', 'BUILDING')),
up AS (SELECT DISTINCT unique_id, schema, coalesce(t.schema, 'bronze') AS s, t."table" AS t FROM (
         SELECT unique_id, schema, unnest(upstream_sources || list_transform(upstream_models, lambda m: struct_pack(schema := 'silver', "table" := m))) AS t FROM bad)),
known AS (
  SELECT 'raw' AS s, 'part_' || p_partkey AS t, COUNT(l_partkey) AS n, COUNT(l_partkey) - COUNT(l_quantity) AS nulls
  FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey
  UNION ALL SELECT 'bronze', 'nation_' || n_nationkey, COUNT(c_custkey), NULL FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey),
asked AS (SELECT *, 'row_count' AS template, NULL AS column_name FROM up
          UNION ALL SELECT *, 'null_check', 'l_quantity' FROM up WHERE schema = 'gold')
SELECT unique_id AS incident_id, 'upstream:' || a.s || '.' || a.t AS context, template, column_name,
       CASE WHEN template = 'row_count' THEN CAST(n AS VARCHAR) ELSE CAST(nulls AS VARCHAR) END AS value,
       CASE WHEN k.t IS NULL THEN 'relation "' || a.s || '.' || a.t || '" does not exist' END AS error
FROM asked a LEFT JOIN known k ON a.s = k.s AND a.t = k.t
"""

# --- incident memory, targets, runs, layers --------------------------------------------------------

ORACLE["normalized_incidents"] = """
SELECT CASE WHEN event_id % 4 = 0 THEN 'SEED-' ELSE 'INC-' END || event_id AS incident_id, ts AS created_at,
       CASE WHEN event_id % 4 = 1 THEN 'warning' ELSE 'error' END AS severity, CASE WHEN event_id % 4 = 2 THEN 'open' ELSE 'resolved' END AS status,
       'seed' AS source, event_type AS failure_class, CASE WHEN event_id % 4 <> 3 THEN 'event ' || event_id ELSE props END AS issue_summary,
       CASE WHEN user_id % 2 = 0 THEN props END AS root_cause, CASE WHEN event_id % 4 = 1 THEN value / 500.0 ELSE 1.0 END AS confidence,
       CASE WHEN event_id % 4 = 0 THEN 'restarted' ELSE 'patched' END AS fix_summary,
       '{"evidence_summary":"","tags":["' || event_type || '"]}' AS evidence_json, event_id % 4 <> 2 AS validated,
       CASE WHEN event_id % 4 <> 3 THEN 'event ' || event_id ELSE props END || chr(10) || chr(10) || 'Root cause: ' || CASE WHEN user_id % 2 = 0 THEN props ELSE '' END AS embedding_text
FROM events
"""
ORACLE["maintained_store"] = """
SELECT 'SEED-' || event_id AS incident_id, event_id % 5 <> 0 AS validated,
       CASE WHEN event_id % 3 = 0 THEN CAST(CAST(event_id AS FLOAT) AS DOUBLE) END AS first_value
FROM events WHERE event_id % 4 = 0
"""
ORACLE["similar_from_store"] = """
WITH q AS (SELECT vec_id, 'INC-' || vec_id AS query_id, CASE WHEN vec_id % 10 > 1 THEN 'class_' || label END AS cls, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT 'INC-' || a.vec_id AS incident_id, 'class_' || a.label AS failure_class, 'vector ' || a.vec_id AS summary, 'label ' || a.label AS root_cause,
             CASE WHEN a.label % 2 = 0 THEN 'restart' END AS fix_applied, a.label / 10.0 AS confidence, CAST(b.embedding AS DOUBLE[]) AS v
      FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 4),
p AS (SELECT q.query_id, s.*, round(list_cosine_similarity(q.v, s.v), 12) AS sim FROM q JOIN s ON (q.cls IS NULL OR q.cls = s.failure_class) AND q.query_id <> s.incident_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, incident_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, incident_id, failure_class, round(sim, 4) AS similarity_score, summary, root_cause, fix_applied, confidence
FROM r WHERE rank <= 3
"""
ORACLE["stored_reports"] = f"""
SELECT incident_id, severity, failure_class, issue_summary AS what_failed, task_id, target_table AS "table", root_cause, confidence,
       0 AS preventions, validated
FROM ({UPSERTED})
"""
ORACLE["search_texts"] = f"""
WITH t AS (SELECT r.log_id, error_type, error_message, {_CLASS} AS failure_class, o.tables, o.columns, split_part(o.models, ',', 1) AS model
           FROM ({ORACLE["resolve_error"]}) r JOIN ({ORACLE["referenced_objects"]}) o USING (log_id))
SELECT log_id, coalesce(nullif(concat_ws(' ', CASE WHEN length(log_id) % 2 = 0 THEN nullif(error_message, '') END, CASE WHEN error_type <> 'unknown' THEN nullif(error_type, '') END,
                                         'model: ' || nullif(model, ''), nullif(replace(columns, ',', ' '), ''), nullif(replace(tables, ',', ' '), '')), ''),
                        failure_class || ' failure in pipeline') AS search_text
FROM t
"""
_SIGNAL_K = f"({_K})"
ORACLE["resolve_target"] = f"""
WITH e AS (SELECT event_id, event_type, {_SIGNAL_K} AS k FROM events),
x AS (SELECT *, CASE WHEN k % 5 <> 0 THEN CASE k % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'public' ELSE 'silver' END END AS s0,
             CASE WHEN k % 5 <> 0 THEN event_type || CASE WHEN k % 2 = 0 THEN '__dbt_tmp' ELSE '' END END AS t0,
             k % 6 < 2 AS has_source, CASE WHEN k % 4 = 0 THEN 'raw' ELSE 'bronze' END AS src_schema, 'src_' || event_type AS src_table,
             CASE WHEN k % 6 < 4 THEN CASE WHEN k % 8 < 4 THEN 'silver_' ELSE 'stg_' END || event_type END AS model FROM e),
y AS (SELECT *, coalesce(s0, CASE WHEN has_source THEN src_schema END) AS s1, coalesce(t0, CASE WHEN has_source THEN src_table END) AS t1 FROM x),
z AS (SELECT *, ends_with(coalesce(t1, ''), '__dbt_tmp') AS tmp FROM y),
w AS (SELECT event_id, k, CASE WHEN NOT tmp THEN s1 WHEN has_source THEN src_schema WHEN starts_with(model, 'silver_') THEN 'silver' ELSE s1 END AS schema,
             CASE WHEN NOT tmp THEN t1 WHEN has_source THEN src_table WHEN model IS NOT NULL THEN model ELSE t1 END AS "table" FROM z)
SELECT event_id, schema, "table", CASE WHEN k % 7 < 4 THEN 'value' END AS "column",
       CASE schema WHEN 'raw' THEN 'bronze' ELSE schema END AS layer FROM w
"""
ORACLE["confidence_cap"] = """
WITH c AS (SELECT event_id, least(least(value / 100.0, 1.0), CASE WHEN user_id % 3 <> 0 THEN 1.0 ELSE 0.7 END, CASE WHEN event_id % 4 <> 0 THEN 1.0 ELSE 0.5 END) AS confidence FROM events)
SELECT event_id, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM c
"""
ORACLE["manual_runs"] = """
WITH r AS (SELECT event_type AS dag_id, 'run_' || user_id || '_' || strftime(ts, '%Y%m%d') AS run_id, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS started,
                  COUNT(*) AS tasks, COUNT(*) FILTER (event_id % 3 = 0) AS zero_attempts FROM events WHERE user_id % 3 = 0 GROUP BY 1, 2)
SELECT dag_id, run_id, started, tasks, zero_attempts FROM (SELECT *, row_number() OVER (PARTITION BY dag_id ORDER BY started DESC, run_id DESC) AS rn FROM r) WHERE rn = 1
"""
ORACLE["safe_cast"] = """
SELECT CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN replace(c_name, 'Customer#', 'CUST-') ELSE CAST(c_custkey AS VARCHAR) END AS customer_id,
       c_name AS customer_name, CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'customer_id' ELSE '' END AS failed FROM customer
"""
_RATES = [("order_id", "0"), ("customer_id", "COUNT(*) FILTER (l_partkey % 100 = 50)"), ("order_date", "COUNT(*) FILTER (l_linenumber = 7)"), ("quantity", "COUNT(*) FILTER (l_quantity IS NULL)")]
ORACLE["null_rates"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({n} AS BIGINT) AS nulls, COUNT(*) AS total_rows, CAST({n} AS DOUBLE) / COUNT(*) AS null_rate, CAST({n} AS DOUBLE) / COUNT(*) > 0.01 AS breach FROM lineitem" for c, n in _RATES)
ORACLE["dataset_profile"] = """
SELECT 'driver' AS schema, 'orders' AS "table", 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns, 'o_orderdate' AS date_column,
       strftime(MIN(o_orderdate), '%Y-%m-%d') AS min_day, strftime(MAX(o_orderdate), '%Y-%m-%d') AS max_day FROM orders
UNION ALL SELECT 'driver', 'events', 'event_id,ts,user_id,event_type,value,props', NULL, NULL, NULL
UNION ALL SELECT 'driver', 'customer', 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment', NULL, NULL, NULL
UNION ALL SELECT 'bronze', 'sales', 'order_id,customer_id,order_date,product,quantity,unit_price', 'order_date',
       strftime(MIN(l_shipdate) FILTER (l_linenumber <> 7), '%Y-%m-%d'), strftime(MAX(l_shipdate) FILTER (l_linenumber <> 7), '%Y-%m-%d') FROM lineitem
"""
ORACLE["score_status"] = f"""
SELECT doc_id, criterion, score, CASE WHEN score >= 1.0 THEN 'PASS' WHEN score >= 0.5 THEN 'PARTIAL' ELSE 'FAIL' END AS status
FROM (UNPIVOT (SELECT doc_id, classification, table_identified, column_identified, root_cause, fix_actionable, prevention FROM ({ORACLE["score_reports"]}))
      ON classification, table_identified, column_identified, root_cause, fix_actionable, prevention INTO NAME criterion VALUE score)
"""
ORACLE["report_checks"] = f"""
SELECT incident_id, failure_class <> 'unknown' AS has_class, length(coalesce(root_cause, '')) > 0 AS has_root_cause, confidence * 2 BETWEEN 0.0 AND 1.0 AS confidence_in_range,
       length(evidence_json) > 9 AS has_evidence_chain, false AS has_fix
FROM ({UPSERTED})
"""
_MERGED_TABLES = "(CASE WHEN n <> 2 THEN ['bronze.extra', coalesce(tables[1], 'x.y')] || tables ELSE tables END)"
ORACLE["merged_signals"] = f"""
WITH s AS (SELECT r.log_id, length(r.log_id) % 3 AS n, error_type, sql_state_code, string_split(nullif(o.tables, ''), ',') AS t0, o.columns, string_split(nullif(o.models, ''), ',') AS m0
           FROM ({ORACLE["resolve_error"]}) r JOIN ({ORACLE["referenced_objects"]}) o USING (log_id)),
x AS (SELECT *, coalesce(t0, []) AS tables, coalesce(m0, []) AS models FROM s)
SELECT log_id, CASE WHEN n = 0 THEN 'timeout' ELSE error_type END AS error_type, CASE WHEN n = 0 THEN '57014' ELSE sql_state_code END AS sql_state_code,
       {_distinct_join(_MERGED_TABLES)} AS tables, columns, {_distinct_join("(CASE WHEN n = 1 THEN ['stg_orders'] || models ELSE models END)")} AS models
FROM x
"""
ORACLE["question_targets"] = """
WITH q AS (SELECT conv_id || '-' || turn AS incident_id, conv_id % 4 AS k, conv_id, turn,
                  ['missing_data', 'wrong_values', 'unexpected_duplicates', 'metric_anomaly', 'stale_data', 'row_count_mismatch'][(conv_id + turn) % 7 + 1] AS kind
           FROM conversations WHERE role = 'user'),
p AS (SELECT *, CASE kind WHEN 'missing_data' THEN 'partition_check,row_count,freshness' WHEN 'wrong_values' THEN 'null_check,duplicate_check,row_count,invalid_cast_check'
                          WHEN 'unexpected_duplicates' THEN 'duplicate_check,row_count' WHEN 'metric_anomaly' THEN 'row_count,duplicate_check,null_check'
                          WHEN 'stale_data' THEN 'freshness,row_count' WHEN 'row_count_mismatch' THEN 'row_count,duplicate_check,partition_check' ELSE '' END AS priorities FROM q)
SELECT incident_id, CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN 'bronze' ELSE 'layer_' || k END AS schema, CASE WHEN k <> 0 THEN 't' || turn END AS "table", 'amount' AS "column",
       CASE WHEN turn % 2 = 0 THEN 'day' ELSE 'order_date' END AS date_column, CASE WHEN conv_id % 3 <> 0 THEN '2024-01-0' || (turn % 9 + 1) END AS date_value, priorities,
       CASE WHEN priorities <> '' AND k <> 0 THEN 'layered' WHEN k <> 0 THEN 'class' ELSE 'none' END AS strategy, NOT (priorities <> '' AND k <> 0) AS run_upstream
FROM p
"""
ORACLE["evidence_digest"] = f"""
WITH e AS (SELECT *, '[' || template || '] ' || CASE WHEN error IS NOT NULL THEN 'ERROR: ' || error
                     ELSE '{{"' || CASE template WHEN 'row_count' THEN 'total_rows' WHEN 'null_check' THEN 'null_count' ELSE 'duplicate_key_count' END || '":'
                          || CASE WHEN template = 'duplicate_total' THEN value ELSE '"' || value || '"' END || '}}' END AS line
           FROM ({ORACLE["run_checks"]}) WHERE template IN ('row_count', 'null_check', 'duplicate_total'))
SELECT incident_id, schema || '.' || "table" AS context, string_agg(line, chr(10) ORDER BY template, column_name NULLS FIRST, line) AS digest
FROM e GROUP BY 1, 2
"""
