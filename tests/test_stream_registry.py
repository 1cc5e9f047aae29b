import datetime
import decimal
import json
import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as E
from faultline.plans.tables import DRIVER_TABLES
from faultline.sources import files, store
from faultline.streaming import triggers


def test_trigger_stream_upserts(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "triggers")
    os.makedirs(src)
    t1 = {"dag_id": "sales_pipeline", "task_id": "run_dbt_fct_sales", "run_id": "r1", "incident_id": "INC-1",
          "error_message": 'null value in column "customer_id" of relation "gold.fct_sales" violates not-null '
                           "constraint", "timestamp": "2026-03-05 10:00:00"}
    t2 = dict(t1, incident_id="INC-2", task_id="run_dbt_silver_customers", run_id="r2",
              error_message='invalid input syntax for type integer: "CUST-001"')
    with open(os.path.join(src, "a.json"), "w") as f:
        f.write(json.dumps(t1) + "\n")
    store = os.path.join(tmpdir_path, "store")
    q = triggers.start_upsert_stream(spark, src, store, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    with open(os.path.join(src, "b.json"), "w") as f:
        f.write(json.dumps(t2) + "\n" + json.dumps(dict(t1, run_id="r1b")) + "\n")
    q = triggers.start_upsert_stream(spark, src, store, os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(120)
    rows = {r.incident_id: r for r in triggers.read_store(spark, store).collect()}
    assert set(rows) == {"INC-1", "INC-2"}
    assert rows["INC-1"].failure_class == "data_quality"
    assert rows["INC-1"].run_id == "r1"  # kept from the first insert
    assert rows["INC-2"].failure_class == "schema_drift"
    assert rows["INC-1"].dbt_model == "fct_sales"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["customer_id", "customer_name", "region", "order_date", "order_count", "daily_revenue"]


def _value(v):
    """A cell as both engines can be compared by: dates and times as text, numbers to nine digits."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


# Every registered query of this library at sf0.001, value by value against its oracle.
_OWN = [n for n in sorted(E.queries()) if n != "pipeline" and not re.match(r"op\d+_", n)]


@pytest.mark.parametrize("name", _OWN)
def test_registered_query_values(spark, name):
    sf = "/root/testdata/sf0.001"
    df = E.queries()[name](spark, sf)
    columns = sorted(df.columns)
    rows = [tuple(_value(r[c]) for c in columns) for r in df.collect()]
    sql = E.oracle_sql()[name]
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    place = [rel.columns.index(c) for c in columns]
    expected = [tuple(_value(r[i]) for i in place) for r in rel.fetchall()]
    assert sorted(rows, key=str) == sorted(expected, key=str)


def test_second_refresh_replaces_the_first(spark, tmpdir_path):
    for n in (10, 10, 7):
        files.write_versioned(spark.range(n), os.path.join(tmpdir_path, "bronze", "t"))
        assert files.table(spark, tmpdir_path, "bronze", "t").count() == n
    assert files.table(spark, tmpdir_path, "bronze", "t").columns == ["id"]
    with pytest.raises(FileNotFoundError):
        files.table(spark, tmpdir_path, "bronze", "none")
