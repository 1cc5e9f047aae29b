from pyspark.sql import functions as F

from faultline.operators import logs

NULL_LOG = "\n".join([
    "[2026-03-05T10:00:00] INFO - Running dbt model fct_sales",
    "[2026-03-05T10:00:01] INFO - Executing: insert into gold.fct_sales select ...",
    "[2026-03-05T10:00:02] ERROR - Database Error in model fct_sales (models/gold/fct_sales.sql)",
    '[2026-03-05T10:00:02] ERROR - null value in column "customer_id" of relation "fct_sales" violates '
    "not-null constraint",
    "[2026-03-05T10:00:02] INFO - DETAIL: Failing row contains (null, null, null, 2026-03-01, 2, 40.00)",
])
DRIFT_LOG = "\n".join([
    "[t] INFO - Running model silver_customers",
    '[t] ERROR - invalid input syntax for type integer: "CUST-001"',
    "[t] INFO - select * from bronze.customers",
])
PERM_LOG = "[t] ERROR - permission denied for table sales\n[t] INFO - done"
COLUMN_LOG = '[t] ERROR - column "order_dt" of relation "silver_sales" does not exist'
MODEL_LOG = "[t] WARNING - table model gold.fct_sales is stale"


def _signals(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return {r.id: r for r in logs.extract_signals(df, "text").collect()}


def test_error_types_and_states(spark):
    s = _signals(spark, [NULL_LOG, DRIFT_LOG, PERM_LOG, COLUMN_LOG, MODEL_LOG])
    assert (s[0].error_type, s[0].sql_state_code) == ("not_null_violation", "23502")
    assert s[0].columns == ["customer_id"]
    assert "gold.fct_sales" in s[0].tables
    assert "fct_sales" in s[0].models
    assert (s[1].error_type, s[1].sql_state_code) == ("type_cast_failure", "22P02")
    assert s[1].error_message == 'invalid input syntax for type integer: "CUST-001"'
    assert s[1].tables == ["bronze.customers"]
    assert (s[2].error_type, s[2].sql_state_code) == ("permission_denied", "42501")
    # relation_not_found is declared first and wins over column_not_found
    assert s[3].error_type == "relation_not_found"
    assert [m.pattern for m in s[3].regex_matches] == ["relation_not_found", "column_not_found"]
    assert s[4].models == ["gold"]
    assert s[4].error_type is None


def test_compile_error_without_state(spark):
    s = _signals(spark, ["Compilation Error in model silver_sales (x.sql)"])
    assert (s[0].error_type, s[0].sql_state_code) == ("dbt_compile_error", None)


def _long_log(spark):
    lines = []
    for i in range(200):
        lvl = "ERROR" if i == 50 else "FATAL" if i == 150 else "INFO"
        lines.append(f"[t] {lvl} - line {i}")
    df = spark.createDataFrame([("run_1", "\n".join(lines) + "\n")], "log_id string, text string")
    return logs.split_log_lines(df, ["log_id"], "text")


def test_relevant_lines_and_truncation(spark):
    lines = _long_log(spark)
    assert lines.count() == 200  # no trailing empty line
    kept = logs.relevant_lines(lines, ["log_id"])
    nums = sorted(r.line_no for r in kept.collect())
    assert nums == list(range(45, 56)) + list(range(145, 200))
    assert len(nums) == 66
    text = logs.truncate_log(kept, ["log_id"]).first().truncated
    assert text.startswith("... (45 lines omitted) ...\n[t] INFO - line 45")
    assert "... (89 lines omitted) ..." in text
    assert "ERROR" in text and "FATAL" in text
    assert len(text.split("\n")) == 68


def test_short_log_kept_whole_and_error_lines(spark):
    df = spark.createDataFrame([("a", NULL_LOG)], "log_id string, text string")
    lines = logs.split_log_lines(df, ["log_id"], "text")
    assert logs.relevant_lines(lines, ["log_id"]).count() == 5
    err = [r.line for r in logs.error_lines(lines).orderBy("line_no").collect()]
    assert len(err) == 2 and all("ERROR" in e for e in err)


def test_splitlines_semantics(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, "x y")], "id int, t string")
    got = {}
    for r in logs.split_log_lines(df, ["id"], "t").collect():
        got.setdefault(r.id, []).append((r.line_no, r.line))
    assert [x[1] for x in sorted(got[1])] == "a\r\nb\rc\n".splitlines()
    assert 2 not in got
    assert [x[1] for x in sorted(got[3])] == "x y".splitlines()


def test_merge_signals(spark):
    df = spark.createDataFrame([("not_null_violation", "23502", ["a.b"], ["c"], ["m"], None, None, ["x.y"], None,
                                 None)],
                               "error_type string, sql_state_code string, tables array<string>, columns array<string>, "
                               "models array<string>, llm_error_type string, llm_sql_state string, "
                               "llm_tables array<string>, llm_columns array<string>, llm_models array<string>")
    r = logs.merge_signals(df).first()
    assert r.error_type == "not_null_violation" and r.tables == ["x.y", "a.b"] and r.columns == ["c"]
    assert F is not None
