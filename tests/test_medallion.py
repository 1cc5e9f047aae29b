import os

import pytest
from pyspark.sql import functions as F

from faultline.operators import contracts, medallion
from faultline.sources import files

SALES = ["order_id", "customer_id", "order_date", "product", "quantity", "unit_price"]


def _sales(spark, rows):
    return spark.createDataFrame(rows, files.BRONZE_SALES)


def _customers(spark, rows):
    return spark.createDataFrame(rows, files.BRONZE_CUSTOMERS)


def test_null_join_key_survives_and_breaks_contract(spark):
    s = _sales(spark, [("1", "1", "2026-03-01", "Widget A", "2", "10.50"),
                       ("2", None, "2026-03-01", "Widget B", "1", "9.995"),
                       ("3", "2", "2026-03-02", "Gadget Y", "3", "1.10"),
                       ("4", "9", "2026-03-02", "Gadget Y", "1", "5.00")])
    c = _customers(spark, [("1", " ada lovelace ", "ADA@X.COM ", " north"), ("2", "o'brien mary-jane", "m@x", "south")])
    ss, sc = medallion.silver_sales(s), medallion.silver_customers(c)
    assert ss.where("customer_id IS NULL").count() == 1
    assert ss.where("order_id = 2").first()["unit_price"] == pytest.approx(10.00)  # 9.995 rounds half up
    g = medallion.fct_sales(ss, sc)
    assert g.count() == 4
    assert g.where("customer_id IS NULL").first()["order_count"] == 1
    assert g.where("customer_id = 9").first()["customer_name"] is None
    v = contracts.contract_violations(g, medallion.FCT_SALES_CONTRACT).collect()
    kinds = {(r.kind, r.column_name) for r in v}
    assert ("not_null_violation", "customer_id") in kinds
    with pytest.raises(contracts.ContractViolation):
        contracts.enforce_contract(g, medallion.FCT_SALES_CONTRACT)
    names = {r.customer_id: r.customer_name for r in sc.collect()}
    assert names == {1: "Ada Lovelace", 2: "O'Brien Mary-Jane"}
    assert sc.where("customer_id = 1").first()["email"] == "ada@x.com"
    assert sc.where("customer_id = 1").first()["region"] == "NORTH"


def test_schema_drift_fails_typed_layer_and_safe_cast_splits(spark):
    c = _customers(spark, [("CUST-001", "a", "a@x", "n"), ("2", "b", "b@x", "s"), (None, "c", "c@x", "s")])
    with pytest.raises(Exception):
        medallion.silver_customers(c).collect()
    ok, rejects = medallion.safe_cast(c, {"customer_id": "int"})
    assert sorted(r.customer_id for r in ok.collect() if r.customer_id is not None) == [2]
    assert ok.count() == 2  # the null key is not a cast failure
    r = rejects.collect()
    assert len(r) == 1 and r[0].failed_columns == ["customer_id"]


def test_dedup_keeps_one_row_per_key(spark):
    c = _customers(spark, [("1", "b", "b@x", "n"), ("1", "a", "a@x", "n"), ("2", "z", "z@x", "s")])
    out = {r.customer_id: r.customer_name for r in medallion.silver_customers(c).collect()}
    assert out == {1: "A", 2: "Z"}


def test_column_tests(spark):
    s = medallion.silver_sales(_sales(spark, [("1", "1", "2026-03-01", "p", "1", "1.00"),
                                              ("1", "2", "2026-03-01", "p", "1", "1.00"),
                                              ("2", "2", "2026-03-02", "p", "1", "1.00")]))
    t = contracts.run_tests(s, "silver_sales", [("order_id", "unique"), ("order_id", "not_null")])
    res = {(r.column_name, r.test): (r.failures, r.status) for r in t.collect()}
    assert res[("order_id", "unique")] == (1, "fail")
    assert res[("order_id", "not_null")] == (0, "pass")


def test_bronze_csv_load(spark, tmpdir_path):
    good = os.path.join(tmpdir_path, "good.csv")
    with open(good, "w") as f:
        f.write(",".join(SALES) + "\n1,,2026-03-01,Widget A,2,10.50\n2,3,2026-03-02,Widget B,1,3.00\n")
    df = files.read_bronze_csv(spark, good, files.BRONZE_SALES)
    rows = df.orderBy("order_id").collect()
    assert rows[0].customer_id is None and rows[1].customer_id == "3"
    assert files.check_csv_header(spark, good, files.BRONZE_SALES)["ok"]
    path, n = files.load_bronze(spark, good, files.BRONZE_SALES, os.path.join(tmpdir_path, "bronze_sales"))
    assert n == 2 and spark.read.parquet(path).count() == 2
    assert files.current_version(spark, os.path.join(tmpdir_path, "bronze_sales")) == path
    bad = os.path.join(tmpdir_path, "bad.csv")
    with open(bad, "w") as f:
        f.write(",".join(SALES) + ",extra\n1,2,2026-03-01,W,1,1.00,x\n")
    with pytest.raises(Exception):
        files.read_bronze_csv(spark, bad, files.BRONZE_SALES).collect()
    assert not files.check_csv_header(spark, bad, files.BRONZE_SALES)["ok"]


def test_missing_partition_is_silent(spark):
    rows = [(str(i), "1", d, "p", "1", "1.00") for i, d in enumerate(
        ["2026-03-01", "2026-03-02", "2026-03-03", "2026-03-05"])]
    g = medallion.fct_sales(medallion.silver_sales(_sales(spark, rows)),
                            medallion.silver_customers(_customers(spark, [("1", "a", "a@x", "n")])))
    assert g.where(F.col("order_date") == "2026-03-04").count() == 0
    assert g.count() == 4


def test_fct_sales_sums_once_and_counts_repeated_customers(spark, capsys):
    """A customer that the dimension holds twice under one name counts twice, under two names once each; the join is followed by no further sums."""
    sales = spark.createDataFrame([(1, "2026-03-01", "2.50"), (1, "2026-03-01", "1.00"), (2, "2026-03-01", None), (3, "2026-03-01", "4.00"), (None, "2026-03-01", "1.00")],
                                  "customer_id int, order_date string, total_amount string").withColumn("total_amount", F.col("total_amount").cast("decimal(21,2)"))
    dim = spark.createDataFrame([(1, "a", "n"), (1, "a", "n"), (2, "b", "n"), (2, "c", "n"), (None, "z", "n")], "customer_id int, customer_name string, region string")
    g = medallion.fct_sales(sales, dim)
    assert dict(g.dtypes)["daily_revenue"] == "decimal(38,2)" and dict(g.dtypes)["order_count"] == "bigint"
    rows = {(r.customer_id, r.customer_name): (r.order_count, None if r.daily_revenue is None else float(r.daily_revenue)) for r in g.collect()}
    assert rows == {(1, "a"): (4, 7.0), (2, "b"): (1, None), (2, "c"): (1, None), (3, None): (1, 4.0), (None, None): (1, 1.0)}
    g.explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and "HashAggregate" in plan and plan.index("Join") < plan.index("HashAggregate")


def test_small_tasks_bound_a_task_whatever_the_cores(spark):
    from faultline.session import SMALL_TASKS, small_tasks
    before = {k: spark.conf.get(k, None) for k in SMALL_TASKS}
    with pytest.raises(ValueError):
        with small_tasks(spark):
            assert {k: spark.conf.get(k) for k in SMALL_TASKS} == SMALL_TASKS
            raise ValueError
    assert {k: spark.conf.get(k, None) for k in SMALL_TASKS} == before
