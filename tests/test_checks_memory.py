import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import checks, incidents, memory


def test_table_evidence_fuses_and_reports_errors(spark):
    df = spark.createDataFrame([(1, None, "2026-03-01"), (1, "a", "2026-03-02"), (2, "b", "2026-03-02")],
                               "k int, v string, d string")
    specs = [{"template": "row_count"}, {"template": "null_check", "column": "v"},
             {"template": "duplicate_check", "column": "k"}, {"template": "duplicate_total", "column": "k"},
             {"template": "partition_check", "date_column": "d", "date_value": "2026-03-04"},
             {"template": "freshness", "timestamp_column": "d"},
             {"template": "null_check", "column": "missing"}]
    ev = {(r.template, r.column_name): r for r in checks.table_evidence(df, specs, "s", "t").collect()}
    assert ev[("row_count", None)].value == "3"
    assert ev[("null_check", "v")].value == "1"
    assert ev[("duplicate_total", "k")].value == "1"
    assert ev[("duplicate_check", "k")].row_count == 1
    assert ev[("partition_check", "d")].value == "0"
    assert ev[("freshness", "d")].value == "2026-03-02"
    assert ev[("null_check", "missing")].error == 'column "missing" does not exist'
    # one aggregation pass for all scalar checks: a single scan of the table
    agg = df.agg(F.count(F.lit(1)))
    assert agg is not None


def test_expand_checks_skip_rule(spark):
    t = spark.createDataFrame([("i1", "data_quality", "s", "t", "c", "order_date", None, "order_date", None),
                               ("i2", "mystery", "s", "t", None, "order_date", None, "order_date", None),
                               ("i3", "dependency", "s", "t", None, "order_date", "2026-03-04", "order_date", None)],
                              "incident_id string, failure_class string, schema string, table string, column string, "
                              "date_column string, date_value string, timestamp_column string, condition string")
    p = checks.expand_checks(t)
    got = {}
    for r in p.orderBy("ordinal").collect():
        got.setdefault(r.incident_id, []).append(r.template)
    assert got["i1"] == ["null_check", "duplicate_check", "duplicate_total", "row_count", "freshness"]
    assert got["i2"] == ["row_count"]
    assert got["i3"] == ["partition_check", "row_count", "freshness"]


def test_origin_layer_finds_transformation_loss(spark):
    bronze = spark.createDataFrame([("2026-03-04",), ("2026-03-05",)], "order_date string")
    silver = spark.createDataFrame([("2026-03-05",)], "order_date string").select(F.col("order_date").cast("date"))
    q = spark.createDataFrame(
        [("q1", ["partition_check", "row_count"],
          [("bronze", "sales", None), ("silver", "silver_sales", None)], None, "order_date", "2026-03-04",
          "order_date")],
        "incident_id string, check_priorities array<string>, "
        "layer_tables array<struct<schema:string,table:string,layer:string>>, column string, date_column string, "
        "date_value string, timestamp_column string")
    ev = checks.layer_checks(q, {"bronze.sales": bronze, "silver.silver_sales": silver})
    o = checks.origin_layer(ev).first()
    assert (o.origin_layer, o.origin_stage, o.failing_checks, o.checks) == ("silver", "transformation", 1, 4)


def test_upsert_semantics(spark):
    store = memory.normalize_incidents(spark.createDataFrame(
        [("SEED-1", "data_quality", "old summary", "root", "pipe")],
        "incident_id string, failure_class string, summary string, root_cause string, pipeline_name string"))
    batch = store.limit(0).unionByName(memory.normalize_incidents(spark.createDataFrame(
        [("SEED-1", "schema_drift", "new", None, "other", 1), ("SEED-1", "access", "newer", None, "x", 2),
         ("INC-2", "resource", "n", "r", "p", 1)],
        "incident_id string, failure_class string, summary string, root_cause string, pipeline_name string, "
        "seq int").drop("seq")).withColumn("seq", F.lit(0)).drop("seq"))
    batch = batch.withColumn("seq", F.monotonically_increasing_id())
    out = {r.incident_id: r for r in memory.upsert(store, batch, ["seq"]).collect()}
    assert out["SEED-1"].failure_class == "access"       # last batch row wins for the ten
    assert out["SEED-1"].root_cause is None               # a null does overwrite
    assert out["SEED-1"].pipeline_name == "pipe"          # kept column
    assert out["INC-2"].issue_summary == "n"
    assert memory.clean_incidents(memory.upsert(store, batch, ["seq"])).count() == 1


def test_search_matches_brute_force(spark):
    rng = np.random.default_rng(7)
    n, d = 60, 8
    vecs = rng.normal(size=(n, d)).astype(np.float32)
    cls = ["a" if i % 3 else "b" for i in range(n)]
    rows = [(i, cls[i], vecs[i].tolist()) for i in range(n)]
    q = spark.createDataFrame(rows, "query_id long, failure_class string, embedding array<float>")
    s = spark.createDataFrame(rows, "incident_id long, failure_class string, embedding array<float>")
    got = memory.search_similar(q, s, k=3, block_rows=7).collect()
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    expect = {}
    for i in range(n):
        cand = [(float(unit[i].astype(np.float64) @ unit[j].astype(np.float64)), j) for j in range(n)
                if j != i and cls[j] == cls[i]]
        cand.sort(key=lambda x: (-x[0], x[1]))
        expect[i] = [j for _, j in cand[:3]]
    have = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        have.setdefault(r.query_id, []).append(r.incident_id)
    assert have == expect
    nocls = memory.search_similar(q, s, k=2, by_class=False, block_rows=5)
    assert nocls.count() == n * 2


def test_rules(spark):
    df = spark.createDataFrame([("run_dbt_fct_sales",), ("run_dbt_tests",), ("run_dbt_new_model",), ("other",)],
                               "task_id string")
    m = {r.task_id: r.dbt_model for r in incidents.resolve_model(df).collect()}
    assert m == {"run_dbt_fct_sales": "fct_sales", "run_dbt_tests": None, "run_dbt_new_model": "new_model",
                 "other": None}
    c = spark.createDataFrame([(0.9, True, True), (0.9, False, True), (0.9, True, False)],
                              "c double, l boolean, d boolean")
    capped = [r[0] for r in c.select(incidents.cap_confidence(F.col("c"), F.col("l"), F.col("d"))).collect()]
    assert capped == pytest.approx([0.9, 0.7, 0.5])
    bands = [r[0] for r in c.select(incidents.confidence_band(F.lit(0.79))).limit(1).collect()]
    assert bands == ["medium"]


def test_scoring_a_block_is_bounded_in_memory():
    import tracemalloc

    import numpy as np
    import pandas as pd

    draw = np.random.default_rng(3)
    units = draw.normal(size=(6000, 16))
    units[10:40] = units[5]  # ties
    units /= np.linalg.norm(units, axis=1)[:, None]
    block = pd.DataFrame({"_id": [f"i{i:05d}" for i in range(len(units))], "unit": list(units)})
    tracemalloc.start()
    got = memory.block_scorer(3, True)(block.copy(), block.copy())
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6  # all similarities at once are 288 MB
    for i in (5, 12, 39, 4321):
        sim = np.round(units @ units[i], 12)
        want = sorted((-v, f"i{j:05d}") for j, v in enumerate(sim) if j != i)[:3]
        mine = got[got["query_id"] == f"i{i:05d}"]
        assert list(mine["incident_id"]) == [x for _, x in want]
        assert np.allclose(mine["similarity"], [-v for v, _ in want], atol=2e-12)


def test_blocks_of_vectors_follow_their_size(spark, monkeypatch):
    """9,000 vectors of few dimensions are one block: no vector is copied to further ones."""
    seen = []
    monkeypatch.setattr(memory, "dealt", lambda df, keys, groups: seen.append(groups) or df)
    v = spark.range(9000).selectExpr("id", "'a' failure_class", "array(cast(id % 97 as float), cast(id % 89 as float), 1f) embedding")
    memory.search_similar(v.withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "incident_id"), k=1)
    assert seen == [1, 1]


def test_upstream_checks_shuffle_the_plan_once(spark, capsys):
    """The rows of the plan are made distinct by what reads them, not on their way into the plan; the result has no repeats."""
    inc = spark.createDataFrame([("i1", "m", "c"), ("i1", "m", "c")], "incident_id string, model string, column string")
    lin = spark.createDataFrame([("m", [("raw", "t"), ("raw", "t")], [])], "model string, upstream_sources array<struct<schema:string,table_name:string>>, upstream_models array<string>")
    tables = {"raw.t": spark.createDataFrame([(1,), (None,)], "c int")}
    got = sorted((r.incident_id, r.context, r.template, r.value) for r in checks.upstream_checks(inc, lin, tables).collect())
    assert got == [("i1", "upstream:raw.t", "null_check", "1"), ("i1", "upstream:raw.t", "row_count", "2")]
    assert checks.upstream_plan(inc, lin).count() == 2
    checks._upstream_rows(inc, lin).explain()
    assert "Aggregate" not in capsys.readouterr().out
