import json
import os

from pyspark.sql import functions as F

from faultline.operators import evaluate, lineage, reports, schema_history
from faultline.sources import files


def _brute_pack(pieces, budget):
    rem, out = budget, []
    for text, tokens in pieces:
        if not text:
            out.append(0)
        elif tokens <= rem:
            out.append(tokens)
            rem -= tokens
        elif rem > 50:
            out.append(rem - 10)
            rem = 10
        else:
            out.append(0)
    return out


def test_pack_context_matches_fold(spark):
    cases = {1: ([("a " * 30, 30), ("b " * 100, 100), ("c " * 5, 5)], 100),
             2: ([("x", 1), ("", 0), ("y " * 900, 900), ("z " * 5, 5), ("w " * 20, 20)], 800)}
    rows = [(cid, i, f"p{i}", t, n, b) for cid, (ps, b) in cases.items() for i, (t, n) in enumerate(ps)]
    df = spark.createDataFrame(rows, "cid int, ordinal int, label string, text string, tokens long, budget long")
    for cid, (ps, b) in cases.items():
        got = reports.pack_context(df.where(F.col("cid") == cid).drop("budget"), ["cid"], b) \
            .orderBy("ordinal").collect()
        assert [r.kept_tokens for r in got] == _brute_pack(ps, b)
    one = reports.pack_context(df.where("cid = 1").drop("budget"), ["cid"], 100).orderBy("ordinal").collect()
    assert [r.kept_tokens for r in one] == [30, 60, 5]
    assert len(one[1].packed_text.split()) == 60


def test_scoring_rubric(spark):
    rep = spark.createDataFrame([(
        "null_join_key", "data_quality",
        "Null customer_id values in bronze sales break the join; the NOT NULL constraint fails",
        ["bronze.sales has 15 null keys"],
        ("Filter rows WHERE customer_id IS NOT NULL", "add not_null test", "alert"),
        ["add a not_null test", "validation before load"])],
        "scenario string, failure_class string, root_cause string, evidence_chain array<string>, "
        "fix struct<immediate:string,preventive:string,monitoring:string>, prevention array<string>")
    s = evaluate.score_reports(rep, evaluate.expected_df(spark)).first()
    assert s.total == 6.0
    card = evaluate.scorecard(evaluate.score_reports(rep, evaluate.expected_df(spark))).first()
    assert card.verdict == "EXCELLENT"
    st = evaluate.score_status(evaluate.score_reports(rep, evaluate.expected_df(spark)), ["scenario"])
    assert {r.status for r in st.collect()} == {"PASS"}
    partial = rep.withColumn("scenario", F.lit("missing_partition"))
    p = evaluate.score_reports(partial, evaluate.expected_df(spark)).first()
    assert p.classification == 0.5


def test_reports_are_not_shuffled_by_scenario(spark, capsys):
    rep = spark.range(3).selectExpr("id", "if(id = 0, 'schema_drift', 'null_join_key') scenario", "'x' failure_class", "'t' root_cause", "array('e') evidence_chain",
                                    "named_struct('immediate', 'i', 'preventive', 'p', 'monitoring', 'm') fix", "array('p') prevention")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the reports are many
    try:
        evaluate.score_reports(rep, evaluate.expected_df(spark)).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_report_texts(spark):
    df = spark.createDataFrame([(None, "fct_sales", "not_null_violation", "x" * 300),
                                ("Why is 03-04 missing?", None, None, None),
                                (None, None, "unknown", None)],
                               "question string, dbt_model string, error_type string, error_message string")
    out = [r[0] for r in df.select(reports.what_failed(F.col("question"), F.col("dbt_model"), F.col("error_type"),
                                                       F.col("error_message"))).collect()]
    assert out[0] == "fct_sales model failed with not_null_violation — " + "x" * 200
    assert out[1] == "Investigation triggered by question: Why is 03-04 missing?"
    assert out[2] == "Pipeline failure detected"


def test_parse_responses(spark):
    df = spark.createDataFrame([("```json\n{\"a\": 1}\n```",), ("noise {\"a\": 2, \"b\": {\"c\": 1}} tail",),
                                ("no json here",)], "t string")
    got = [(r.parse_ok, r.parsed.a if r.parsed else None) for r in reports.parse_responses(df, "t", "a int").collect()]
    assert got == [(True, 1), (True, 2), (False, None)]


def test_lineage_and_chain(spark, tmpdir_path):
    manifest = {
        "nodes": {
            "model.p.silver_sales": {"name": "silver_sales", "resource_type": "model", "schema": "silver",
                                     "depends_on": {"nodes": ["source.p.bronze.sales"]}, "raw_sql": "select 1"},
            "model.p.silver_customers": {"name": "silver_customers", "resource_type": "model", "schema": "silver",
                                         "depends_on": {"nodes": ["source.p.bronze.customers"]}},
            "model.p.fct_sales": {"name": "fct_sales", "resource_type": "model", "schema": "gold",
                                  "depends_on": {"nodes": ["model.p.silver_sales", "model.p.silver_customers"]}},
            "test.p.not_null": {"name": "not_null", "resource_type": "test", "depends_on": {"nodes": []}},
        },
        "sources": {
            "source.p.bronze.sales": {"source_name": "bronze", "name": "sales", "schema": "bronze"},
            "source.p.bronze.customers": {"source_name": "bronze", "name": "customers", "schema": "bronze"},
        },
    }
    path = os.path.join(tmpdir_path, "manifest.json")
    with open(path, "w") as f:
        json.dump(manifest, f)
    nodes = files.read_nodes(spark, path)
    assert nodes.count() == 3
    assert nodes.where("name = 'silver_sales'").first().raw_sql == "select 1"
    lin = lineage.dependency_chain(lineage.lineage(nodes, files.read_sources(spark, path)))
    ch = {r.model: r.dependency_chain for r in lin.collect()}
    assert ch["fct_sales"] == "silver_sales + silver_customers → fct_sales"
    assert ch["silver_sales"] == "bronze.sales → silver_sales → fct_sales"
    tg = {(r.schema, r.table) for r in lineage.metadata_targets(lin, nodes).where("model = 'fct_sales'").collect()}
    assert tg == {("silver", "silver_sales"), ("silver", "silver_customers")}
    det = lineage.upstream_details(nodes).where("unique_id = 'model.p.fct_sales'").first().upstream_details
    assert {d.model: d.depends_on_sources for d in det} == {"silver_sales": ["sales"], "silver_customers": ["customers"]}


def test_schema_diff(spark):
    a = spark.createDataFrame([], "customer_id string, name string")
    b = spark.createDataFrame([], "customer_id int, email string")
    old = schema_history.snapshot(spark, {"bronze.customers": a}, "2026-03-01")
    new = schema_history.snapshot(spark, {"bronze.customers": b}, "2026-03-02")
    d = {r.column_name: r.change for r in schema_history.diff_snapshots(old, new).collect()}
    assert d == {"customer_id": "retyped", "name": "removed", "email": "added"}
    pres = schema_history.column_presence(new, "bronze.customers", ["customer_id", "region"]).collect()
    assert {(r.column_name, r.present) for r in pres} == {("customer_id", True), ("email", True), ("region", False)}
    hist = old.unionByName(new)
    assert schema_history.latest(hist).count() == 2
