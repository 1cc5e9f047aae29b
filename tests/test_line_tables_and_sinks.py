"""Numbered rows and lines, signals of line tables, the stateful stream, replay-safe sinks, grains and histories."""

import json
import os
import random
import re

from pyspark.sql import functions as F

from faultline.operators import checks, contracts, logs, numbering, reports, schema_history
from faultline.session import build_session  # noqa: F401
from faultline.sources import files, lines
from faultline.streaming import triggers


def test_numbers_in_groups_with_nulls_and_a_hot_one(spark):
    rows = [("hot", i) for i in range(900)] + [(None, i) for i in range(20)] + [(f"k{i % 30}", i) for i in range(90)]
    random.Random(1).shuffle(rows)
    out = numbering.number_rows(spark.createDataFrame(rows, "k string, v int").repartition(5), ["k"], ["v"], "n", "total").collect()
    assert len(out) == len(rows)
    for key in {k for k, _ in rows}:
        own = sorted((r.v, r.n, r.total) for r in out if r.k == key)
        assert [n for _, n, _ in own] == list(range(len(own))) and {t for _, _, t in own} == {len(own)}
    assert numbering.number_rows(spark.createDataFrame([], "k string, v int"), ["k"], ["v"], "n").count() == 0


def test_lines_of_many_splits_are_numbered_as_one(spark, tmpdir_path):
    draw = random.Random(2)
    texts = {}
    for name, ending in (("a.log", "\n"), ("b.log", "\r\n"), ("c.log", "\n")):
        body = [("x" * draw.randrange(60)) + (f"\x0bv{i}" if name == "c.log" and i % 50 == 0 else "") + str(i) for i in range(800)]
        texts[name] = ending.join(body) + ending
        with open(os.path.join(tmpdir_path, name), "w", newline="") as f:
            f.write(texts[name])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = {}
        assert lines.numbered_lines(spark, tmpdir_path).rdd.getNumPartitions() >= 1
        for r in lines.numbered_lines(spark, tmpdir_path).collect():
            got.setdefault(r.file.rsplit("/", 1)[1], {})[r.line_no] = r.line
        assert spark.read.text(tmpdir_path).rdd.getNumPartitions() > 10
        for name, text in texts.items():
            assert [got[name][i] for i in range(len(got[name]))] == text.splitlines()
        one = sorted((r.line_no, r.line) for r in lines.numbered_lines(spark, tmpdir_path, across_files=True).collect())
        assert [x for _, x in one] == [x for name in sorted(texts) for x in texts[name].splitlines()] and [n for n, _ in one] == list(range(len(one)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


PIECES = ['null value in column "a" violates not-null constraint', 'NULL VALUE in column "b" x not-null constraint', 'invalid input syntax for type integer: "CUST-1"', 'relation "s.t" does not exist',
          'column "c" of relation "r" does not exist', 'column "d" does not exist', "permission denied for table sales", "Compilation Error in model m_1", "Database Error in model m_2",
          'invalid input syntax for type date: "2026"', "reading from bronze.sales join silver.x", "", "nothing", "model m_2 and model m_3", 'into "gold"."f"']


def test_signals_of_lines_equal_those_of_the_text(spark):
    draw = random.Random(3)
    texts = {f"log{i}": "\n".join(draw.choice(PIECES) for _ in range(draw.randrange(1, 40))) + "\nend" for i in range(60)}
    rows = [(k, n, line) for k, t in texts.items() for n, line in enumerate(t.split("\n"))]
    of_lines = logs.signals_of_lines(spark.createDataFrame(rows, "log_id string, line_no long, line string").repartition(4), ["log_id"])
    of_texts = logs.extract_signals(spark.createDataFrame(list(texts.items()), "log_id string, text string"), "text")
    columns = ["log_id", "regex_matches", "error_type", "sql_state_code", "error_message", "tables", "columns", "models"]
    plain = lambda df: sorted((json.loads(x) for x in df.select(*columns).toJSON().collect()), key=lambda r: r["log_id"])
    assert plain(of_lines) == plain(of_texts)


def _trigger(i, user, second, message="worker lost"):
    return {"dag_id": "d", "task_id": "run_dbt_fct_sales", "run_id": f"r{i}", "incident_id": f"INC-{user}", "error_message": f"{message} {i}", "timestamp": f"2026-03-05 10:00:{second:02d}"}


def test_stream_of_batches_equals_one_upsert(spark, tmpdir_path):
    src, store, ckpt = (os.path.join(tmpdir_path, n) for n in ("in", "store", "ckpt"))
    os.makedirs(src)

    def drop(name, rows):
        with open(os.path.join(src, name), "w") as f:
            f.write("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        triggers.start_upsert_stream(spark, src, store, ckpt, max_files=1).awaitTermination(120)
        return {r.incident_id: (r.run_id, r.issue_summary) for r in triggers.read_store(spark, store).collect()}

    drop("a.json", [_trigger(1, "x", 10), _trigger(2, "x", 20), _trigger(2, "x", 20), _trigger(3, "y", 5)])
    assert run() == {"INC-x": ("r1", "worker lost 2"), "INC-y": ("r3", "worker lost 3")}
    drop("b.json", [_trigger(4, "x", 1), _trigger(5, "z", 9)])  # a late one becomes the first
    assert run() == {"INC-x": ("r4", "worker lost 2"), "INC-y": ("r3", "worker lost 3"), "INC-z": ("r5", "worker lost 5")}
    drop("c.json", [_trigger(4, "x", 1), _trigger(5, "z", 9)])  # a replay changes nothing
    assert run() == {"INC-x": ("r4", "worker lost 2"), "INC-y": ("r3", "worker lost 3"), "INC-z": ("r5", "worker lost 5")}
    assert run()["INC-x"] == ("r4", "worker lost 2")  # no new files
    at_once = triggers.upserted(triggers.triggers_to_incidents(files.read_triggers(spark, src)))
    assert {r.incident_id: (r.run_id, r.issue_summary) for r in at_once.collect()} == {"INC-x": ("r4", "worker lost 2"), "INC-y": ("r3", "worker lost 3"), "INC-z": ("r5", "worker lost 5")}
    changed = [spark.read.parquet(f"{store}/batch={b}").count() for b in range(3)]
    assert changed == [2, 2, 2]  # a batch writes the ids it changed and no others


def test_a_repeated_run_replaces_its_rows(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    files.write_run(spark.range(5), path, "a")
    for n in (7, 3):
        files.write_run(spark.range(n), path, "b")
    assert {r.run_id: r["count"] for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {"a": 5, "b": 3}


def test_the_file_with_a_bad_header_is_named(spark, tmpdir_path):
    good = ",".join(files.BRONZE_CUSTOMERS.fieldNames())
    for name, head in (("a.csv", good), ("b.csv", good.replace("region", "area")), ("c.csv", '"customer_id",customer_name,email,region')):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(head + "\n" + "1,x,y,z\n" * 50)
    got = {r.file.rsplit("/", 1)[1]: (r.ok, r.missing, r.extra) for r in files.csv_headers(spark, tmpdir_path, files.BRONZE_CUSTOMERS).collect()}
    assert got == {"a.csv": (True, [], []), "b.csv": (False, ["region"], ["area"]), "c.csv": (True, [], [])}


def scans(df):
    """File scans of a plan; a reused exchange scans nothing."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return len(re.findall(r"FileScan|Scan parquet", plan)), plan


def test_one_scan_for_scalars_and_one_for_keys(spark):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    specs = [{"template": "row_count"}, {"template": "freshness", "timestamp_column": "l_shipdate"}, {"template": "partition_check", "date_column": "l_returnflag", "date_value": "R"},
             *({"template": "null_check", "column": c} for c in li.columns), *({"template": t, "column": c} for t in ("duplicate_total", "duplicate_check") for c in ("l_orderkey", "l_partkey", "l_returnflag"))]
    assert scans(checks.table_evidence(li, specs, "s", "t"))[0] == 2
    assert scans(contracts.run_tests(li, "t", [("l_orderkey", "unique"), ("l_partkey", "unique"), ("l_tax", "not_null")]))[0] == 2


def test_grains_with_nulls(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, None, "y"), (2, 5, "z"), (None, 5, "w"), (None, None, "v")], "a int, b int, c string")
    got = {r.grain: (r.violations, r.rows_in_violation, [json.loads(t)["cnt"] for t in r.top]) for r in checks.duplicate_grains(df, [["a"], ["b"], ["a", "b"], ["c"]]).collect()}
    assert got == {"a": (2, 4, [2, 2]), "b": (2, 5, [3, 2]), "a,b": (1, 2, [2]), "c": (0, 0, [])}
    unique = contracts.run_tests(df, "m", [("a", "unique"), ("b", "unique"), ("c", "unique")]).collect()
    assert {r.column_name: r.failures for r in unique} == {"a": 1, "b": 1, "c": 0}  # nulls aren't compared


def test_a_date_of_the_wrong_kind_is_an_error_row(spark):
    df = spark.sql("select date'2024-01-01' as d union all select date'2024-01-02'")
    ev = checks.table_evidence(df, [{"template": "partition_check", "date_column": "d", "date_value": v} for v in ("2024-01-01", "2024-02-02", "not a date")], "s", "t").collect()
    assert sorted((r.value, r.row_count, r.error) for r in ev if r.error is None) == [("0", 1, None), ("1", 1, None)]
    assert [(r.value, r.row_count, r.rows) for r in ev if r.error] == [(None, 0, [])]


def test_context_packing_has_no_python(spark):
    pieces = spark.createDataFrame([("p", i, f"l{i}", "w " * n, n) for i, n in enumerate([30, 0, 40, 500, 5, 9])] + [("q", 0, "l", None, 3)], "k string, ordinal int, label string, text string, tokens long")
    out = reports.pack_context(pieces, ["k"], 130)
    _, plan = scans(out)
    assert not re.search("Python|Arrow|Pandas", plan)
    assert [(r.k, r.ordinal, r.kept_tokens) for r in out.orderBy("k", "ordinal").collect()] == [("p", 0, 30), ("p", 1, 0), ("p", 2, 40), ("p", 3, 50), ("p", 4, 5), ("p", 5, 0), ("q", 0, 0)]


def test_history_intervals(spark):
    rows = [("d", "a", "int", 1), ("d", "b", "int", 1), ("d", "a", "int", 2), ("d", "a", "bigint", 3), ("d", "b", "int", 3), ("e", "x", "int", 2)]
    h = spark.createDataFrame(rows, "dataset string, column_name string, data_type string, t int").select("dataset", "column_name", "data_type", F.make_date(F.lit(2024), "t", F.lit(1)).alias("captured_at"))
    v = {(r.dataset, r.column_name, r.data_type, r.valid_from.month, r.valid_to and r.valid_to.month, r.captures) for r in schema_history.validity(h.union(h)).collect()}
    assert v == {("d", "a", "int", 1, 3, 2), ("d", "a", "bigint", 3, None, 1), ("d", "b", "int", 1, 2, 1), ("d", "b", "int", 3, None, 1), ("e", "x", "int", 2, None, 1)}
    c = {(r.column_name, r.at.month, r.change) for r in schema_history.changes(h).collect()}
    assert c == {("a", 3, "retyped"), ("b", 2, "removed"), ("b", 3, "added")}
    one, two = (h.where(F.month("captured_at") == m) for m in (1, 3))
    assert {(r.column_name, r.change) for r in schema_history.diff_snapshots(one, two).collect()} == {("a", "retyped")}


def test_families_give_a_relation_for_each_key(spark):
    rows = spark.createDataFrame([(1, 5, None), (1, 6, "x"), (2, None, None)], "k int, v int, w string")
    family = checks.Family("raw", "part_", rows, "k", spark.createDataFrame([(1,), (2,), (3,)], "key int"))
    plan = [("i", "raw", f"part_{k}", t, c) for k in (1, 2, 3, 9) for t, c in (("row_count", None), ("null_check", "w"), ("null_check", "nope"))] + [("j", "raw", "part_1", "row_count", None), ("i", "raw", "other", "row_count", None)]
    ev = checks.run_plan(spark.createDataFrame(plan, "incident_id string, schema string, table string, template string, column string"), {}, [family])
    got = {(r.incident_id, r.table, r.template, r.column_name): (r.value, r.error) for r in ev.collect()}
    assert len(got) == len(plan)
    assert got["i", "part_1", "row_count", None] == got["j", "part_1", "row_count", None] == ("2", None)
    assert got["i", "part_1", "null_check", "w"] == ("1", None) and got["i", "part_2", "null_check", "w"] == ("1", None) and got["i", "part_3", "row_count", None] == ("0", None)
    assert got["i", "part_3", "null_check", "w"] == ("0", None)
    assert got["i", "part_2", "null_check", "nope"] == (None, 'column "nope" does not exist')
    assert got["i", "part_9", "row_count", None] == (None, 'relation "raw.part_9" does not exist') and got["i", "other", "row_count", None] == (None, 'relation "raw.other" does not exist')


def test_bucketed_store_is_not_shuffled(spark, tmpdir_path):
    from faultline.operators import memory
    from faultline.plans import catalog
    from faultline.sources import buckets
    sf = "/root/testdata/sf0.001"
    first, second = (catalog.incident_batch_input(spark, sf, half) for half in (True, False))
    one = memory.upsert(spark.createDataFrame([], memory.INCIDENT_SCHEMA), first, ["ts", "event_id"])
    stored = buckets.save_bucketed(one, "bucketed_incidents", os.path.join(tmpdir_path, "t"), 8)
    some = one.first().incident_id
    assert buckets.look_up(spark, "bucketed_incidents", some).count() == 1
    # files of other buckets are left out in any case; the plan says so where the scan itself is bucketed
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 8" in buckets.look_up(spark, "bucketed_incidents", some)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    after = buckets.upsert_bucketed(stored, second, ["ts", "event_id"])
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(after) == rows(memory.upsert(one, second, ["ts", "event_id"]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = buckets.upsert_bucketed(stored, second, ["ts", "event_id"])._jdf.queryExecution().executedPlan().toString()
        before = plan[:plan.index("Bucketed: true")]
        assert "SortMergeJoin" in before and "Exchange" not in before[before.index("SortMergeJoin"):]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_investigations_of_odd_triggers(spark):
    from faultline.operators import investigate, memory
    schema = "pipeline_name string, dag_id string, task_id string, run_id string, severity string, error_message string, question string, timestamp string, incident_id string"
    message = 'column "b" of relation "r" does not exist in table s.t'
    rows = [(None, "d", "run_dbt_m", "r1", None, message, None, None, "I1"), (None, None, None, None, None, None, "why?", None, "I2"), (None, "d", "t", "r3", "critical", "", None, "2024-01-01 00:00:00", "I3")]
    t = spark.createDataFrame(rows, schema)
    tables = {"s.t": spark.createDataFrame([(1, None), (2, 3)], "a int, b int")}
    found = investigate.investigate(t, tables)
    r = {x.incident_id: x for x in reports.to_incident(found).collect()}
    assert (r["I1"].target_table, r["I1"].target_column, r["I1"].failure_class, r["I1"].dbt_model) == ("t", "b", "code_failure", "m")
    assert json.loads(r["I1"].evidence_json)["database_evidence_count"] == 2  # null_check and row_count
    assert r["I2"].issue_summary == "Investigation triggered by question: why?" and r["I3"].issue_summary and r["I3"].severity == "critical"
    store = spark.createDataFrame([], memory.INCIDENT_SCHEMA)
    twice = investigate.store_investigations(investigate.store_investigations(store, found), found)
    assert twice.count() == 3
    assert investigate.investigate(t.limit(0), tables).count() == 0
