"""Search over built stores, deep texts, log entries, manifests, evidence tables and shared folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from faultline import session
from faultline.operators import checks, incidents, memory, reports
from faultline.sources import files


def _store(spark, rows):
    schema = "incident_id string, failure_class string, embedding array<float>, issue_summary string, root_cause string, fix_summary string, confidence double"
    return spark.createDataFrame([(i, c, v, f"about {i}", "cause", None, 0.5) for i, c, v in rows], schema)


def test_search_with_text_ids_ties_and_empty_class(spark):
    same = [(f"INC-{i:03d}", "a" if i % 2 else "b", [1.0, 0.0]) for i in range(1, 201)]
    store = _store(spark, same + [("INC-999", "a", None), ("INC-998", "a", [0.0, 0.0])])
    queries = spark.createDataFrame([("q1", "a", [1.0, 0.0]), ("q2", "", [1.0, 0.0]), ("q3", None, [2.0, 0.0]), ("q4", "nothing", [1.0, 0.0]), ("INC-001", "", [1.0, 0.0])],
                                    "query_id string, failure_class string, embedding array<float>")
    for block in (7, 4096):
        got = {}
        for r in memory.search_similar(queries, store, block_rows=block).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.incident_id)
            assert (r.similarity_score, r.summary, r.root_cause, r.fix_applied, r.confidence) == (1.0, f"about {r.incident_id}", "cause", None, 0.5)
        assert got == {"q1": ["INC-001", "INC-003", "INC-005"], "q2": ["INC-001", "INC-002", "INC-003"], "q3": ["INC-001", "INC-002", "INC-003"],
                       "INC-001": ["INC-002", "INC-003", "INC-004"]}


def test_response_with_many_nested_objects(spark):
    deep = "see: {" + ",".join('"k%d": {}' % i for i in range(20_000)) + "} end"
    texts = [(1, deep), (2, "x {\"a\": 1} y {\"a\": 2}"), (3, "{" * 50_000), (4, "none"), (5, None)]
    out = {r.i: r for r in reports.parse_responses(spark.createDataFrame(texts, "i int, t string"), "t", "a int, k7 string").collect()}
    assert out[1].parse_ok and out[1].parsed.k7 == "{}"
    assert out[2].parse_ok and out[2].parsed.a == 1
    assert not any(out[i].parse_ok for i in (3, 4, 5))


def test_intake_replays_to_the_same_id(spark):
    schema = "incident_id string, pipeline_name string, dag_id string, task_id string, run_id string, severity string, error_message string, question string, timestamp string"
    rows = [(None, None, "d", "t", "r", None, "boom", None, None), (None, None, "d", "t", "r2", None, "boom", None, "2024-01-01 00:00:00")]
    ids = [sorted(r.incident_id for r in incidents.intake(spark.createDataFrame(rows, schema)).collect()) for _ in range(2)]
    assert ids[0] == ids[1] and len(set(ids[0])) == 2 and all(len(i.rsplit("-", 1)[1]) == 16 for i in ids[0])


def test_task_logs_of_every_shape(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "logs.json")
    base = {"dag_id": "d", "run_id": "r", "task_id": "t"}
    contents = [[{"timestamp": "T1", "level": "error", "event": "boom"}, "plain entry", {"event": "bare"}, {"event": ""}], "one string", None]
    with open(path, "w") as f:
        for n, c in enumerate(contents):
            f.write(json.dumps(base | {"try_number": n, "content": c}) + "\n")
    logs = files.read_task_logs(spark, path)
    lines = [(r.try_number, r.line) for r in files.task_log_lines(logs).orderBy("try_number", "entry_no").collect()]
    assert lines == [(0, "[T1] ERROR - boom"), (0, "plain entry"), (0, "bare"), (1, "one string")]
    texts = {r.try_number: r.log_text for r in files.task_log_texts(logs).collect()}
    assert texts[0] == "[T1] ERROR - boom\nplain entry\nbare" and texts[1] == "one string"


def test_manifest_config(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "manifest.json")
    node = {"name": "m", "resource_type": "model", "schema": "s", "config": {"materialized": "table", "tags": ["x"]}}
    with open(path, "w") as f:
        json.dump({"nodes": {"model.p.m": node, "model.p.n": {"name": "n", "resource_type": "model"}}, "sources": {}}, f)
    got = {r.name: r.config for r in files.read_nodes(spark, path).collect()}
    assert got["m"] == {"materialized": "table", "tags": '["x"]'} and got["n"] == {}


def test_evidence_table_grows_by_appends(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "evidence")
    tables = {"s.t": spark.range(3).withColumnRenamed("id", "a")}
    plan = spark.createDataFrame([("i1", "s", "t", "row_count", None), ("i2", "s", "u", "row_count", None)], "incident_id string, schema string, table string, template string, column string")
    ev = checks.run_plan(plan, tables)
    both = checks.all_evidence(ev, ev.withColumn("context", F.concat(F.lit("upstream:"), "context")))
    checks.append_evidence(both, path, "r1")
    for _ in range(2):  # a repeated run replaces its rows
        checks.append_evidence(ev, path, "r2")
    assert spark.read.parquet(path).count() == 6
    flags = {r.incident_id: (r.database_evidence_count, r.db_evidence_available) for r in checks.evidence_available(plan.select("incident_id").union(spark.createDataFrame([("i3",)], "i string")), ev).collect()}
    assert flags == {"i1": (1, True), "i2": (0, False), "i3": (0, False)}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def _json(path, value):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        json.dump(value, f)
    return path


def test_run_results_and_statuses(spark, tmpdir_path):
    path = _json(os.path.join(tmpdir_path, "run_results.json"), {"results": [
        {"unique_id": "model.p.fct_sales", "status": "error", "execution_time": 1.5, "message": "boom", "failures": None},
        {"unique_id": "test.p.not_null", "status": "fail", "failures": 3}]})
    got = {r.model: (r.status, r.message, r.failures) for r in files.read_run_results(spark, path).collect()}
    assert got == {"fct_sales": ("error", "boom", None), "not_null": ("fail", "", 3)}
    path = os.path.join(tmpdir_path, "instances.json")
    with open(path, "w") as f:
        for dag, run, task, state, n in [("d", "r", "a", "success", 1), ("d", "r", "b", "failed", None), ("d", "r2", "a", "failed", 2)]:
            f.write(json.dumps({"dag_id": dag, "run_id": run, "task_id": task, "state": state, "try_number": n}) + "\n")
    instances = files.read_task_instances(spark, path)
    assert {tuple(r) for r in files.task_statuses(instances, "d", "r").collect()} == {("a", "success", 1), ("b", "failed", None)}
    texts = spark.createDataFrame([("d", "r", "a", 1, ""), ("d", "r", "a", 0, "from try 0"), ("d", "r", "b", 0, "zero"), ("d", "r2", "a", 2, "second"), ("d", "r2", "a", 0, "first")],
                                  "dag_id string, run_id string, task_id string, try_number int, log_text string")
    picked = {(r.run_id, r.task_id): r.log_text for r in files.pick_log(texts, instances).collect()}
    assert picked == {("r", "a"): "from try 0", ("r", "b"): "zero", ("r2", "a"): "second"}


def test_seeds_scenarios_triggers_and_reports(spark, tmpdir_path):
    seeds = _json(os.path.join(tmpdir_path, "seed.json"), [{"incident_id": "SEED-001", "failure_class": "data_quality", "summary": "nulls", "tags": ["a", "b"], "evidence_summary": "e"},
                                                           {"incident_id": "SEED-002"}])
    rows = {r.incident_id: r for r in memory.normalize_incidents(files.read_seed_incidents(spark, seeds)).collect()}
    assert rows["SEED-001"].issue_summary == "nulls" and json.loads(rows["SEED-001"].evidence_json) == {"evidence_summary": "e", "tags": ["a", "b"]}
    assert (rows["SEED-002"].severity, rows["SEED-002"].status, rows["SEED-002"].confidence, rows["SEED-002"].validated) == ("error", "resolved", 1.0, True)
    assert memory.get_incident(memory.normalize_incidents(files.read_seed_incidents(spark, seeds)), "SEED-002").count() == 1
    for n, kind in ((1, "null_key"), (2, "drift")):
        _json(os.path.join(tmpdir_path, "scenarios", f"tc00{n}_{kind}.json"), {"scenario_id": f"TC-00{n}", "trigger": {"dag_id": "d"}, "expected": {"failure_class": kind, "expected_tables": ["t"]}})
    pattern = os.path.join(tmpdir_path, "scenarios", "*.json")
    assert {r.scenario_id: r.expected.failure_class for r in files.read_scenarios(spark, pattern).collect()} == {"TC-001": "null_key", "TC-002": "drift"}
    assert [r.file for r in files.read_scenarios(spark, pattern, "drift").collect()] == ["tc002_drift.json"]
    trigger = _json(os.path.join(tmpdir_path, "triggers", "a.json"), {"dag_id": "d", "task_id": "run_dbt_fct_sales", "timestamp": "2026-03-05 10:00:00"})
    one = incidents.intake(files.read_triggers(spark, trigger)).first()
    assert one.incident_id.startswith("INC-20260305100000-") and one.dbt_model == "fct_sales" and one.pipeline_name == "d"
    out = os.path.join(tmpdir_path, "reports")
    report = reports.build_report(spark.createDataFrame([("i1", "data_quality", 0.9)], "incident_id string, failure_class string, confidence double"))
    for _ in range(2):
        files.write_reports(report.select("report.*"), out, "r1")
    back = spark.read.json(out).collect()
    assert len(back) == 1 and back[0].incident_id == "i1" and back[0].what_failed == "Pipeline failure detected"
