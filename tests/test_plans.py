import os

from pyspark.sql import functions as F

from faultline.operators import checks, medallion


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_fused_profile_is_one_pruned_scan(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "t")
    spark.range(100).selectExpr("id", "id % 7 AS k", "CAST(NULL AS STRING) AS v", "'x' AS unused") \
        .write.parquet(path)
    df = spark.read.parquet(path)
    specs = [{"template": "row_count"}, {"template": "null_check", "column": "v"},
             {"template": "null_check", "column": "k"}, {"template": "freshness", "timestamp_column": "id"}]
    plan = _plan(checks.table_evidence(df, specs, "s", "t"))
    assert plan.count("FileScan") == 1
    assert "unused" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_small_dimension_is_broadcast(spark):
    sales = spark.range(1000).selectExpr("CAST(id % 10 AS INT) AS customer_id", "current_date() AS order_date",
                                         "CAST(1.00 AS DECIMAL(10,2)) AS total_amount")
    dim = spark.range(10).selectExpr("CAST(id AS INT) AS customer_id", "'n' AS customer_name", "'r' AS region")
    g = medallion.fct_sales(sales, dim)
    g.collect()
    assert "BroadcastHashJoin" in _plan(g) or "Broadcast" in _plan(g)


def test_sales_are_summed_below_the_join(spark):
    sales = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN CAST(id % 10 AS INT) END AS customer_id", "current_date() AS order_date", "CAST(1.00 AS DECIMAL(10,2)) AS total_amount")
    dim = spark.range(10).selectExpr("CAST(id AS INT) AS customer_id", "'n' AS customer_name", "'r' AS region")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = medallion.fct_sales(sales, dim)._jdf.queryExecution().sparkPlan().toString().split("\n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = next(i for i, x in enumerate(lines) if "Join" in x)
    assert any("HashAggregate" in x for x in lines[join:])


def test_any_number_of_dates_is_one_grouped_count(spark):
    df = spark.range(100).selectExpr("id", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS day")

    def plan(n):
        specs = [{"template": "partition_check", "date_column": "day", "date_value": f"{2000 + i}-01-01"} for i in range(n)]
        return checks.table_evidence(df, specs, "s", "t")._jdf.queryExecution().sparkPlan().toString()

    assert plan(10).count("HashAggregate") == plan(1000).count("HashAggregate")
    specs = [{"template": "partition_check", "date_column": "day", "date_value": v} for v in ("2024-01-05", "1999-01-01", "no date")]
    got = {r.spec_key.rsplit("|", 1)[1]: (r.value, r.error) for r in checks.table_evidence(df, specs, "s", "t").collect()}
    assert got["2024-01-05"] == ("1", None) and got["1999-01-01"] == ("0", None) and got["no date"][0] is None and "invalid value" in got["no date"][1]


def test_unknown_relations_and_columns_never_reach_the_driver(spark):
    tables = {"s.t": spark.range(5).withColumnRenamed("id", "a")}
    plan = spark.range(3000).selectExpr("concat('i', id) AS incident_id", "'s' AS schema", "concat('t', nullif(id % 1000, 0)) AS table",
                                        "'null_check' AS template", "CASE WHEN id < 2000 THEN 'a' ELSE 'b' END AS column")
    plan = plan.withColumn("table", F.coalesce("table", F.lit("t"))).withColumn("schema", F.when(F.col("incident_id") != "i1", F.col("schema")))
    rows = {r.incident_id: r for r in checks.run_plan(plan, tables).collect()}
    assert len(rows) == 3000 and rows["i0"].value == "0" and rows["i0"].error is None
    assert rows["i2000"].error == 'column "b" does not exist' and rows["i1"].schema is None
    assert rows["i5"].error == 'relation "s.t5" does not exist'
