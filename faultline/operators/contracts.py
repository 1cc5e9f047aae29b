"""Column tests and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators.checks import grain_counts

# Contract type names -> Spark type predicates.
_TYPE_OK = {
    "integer": lambda t: isinstance(t, T.IntegerType),
    "int": lambda t: isinstance(t, T.IntegerType),
    "bigint": lambda t: isinstance(t, T.LongType),
    "text": lambda t: isinstance(t, T.StringType),
    "string": lambda t: isinstance(t, T.StringType),
    "date": lambda t: isinstance(t, T.DateType),
    "numeric": lambda t: isinstance(t, T.DecimalType),
    "double": lambda t: isinstance(t, T.DoubleType),
    "boolean": lambda t: isinstance(t, T.BooleanType),
    "timestamp": lambda t: isinstance(t, (T.TimestampType, T.TimestampNTZType)),
}


class ContractViolation(Exception):
    pass


def run_tests(df: DataFrame, model: str, spec: list[tuple[str, str]]) -> DataFrame:
    """``not_null`` / ``unique`` tests, one result row per (column, test).

    All not_null tests share one aggregation pass, all unique tests another one
    over their grouped counts (GROUPING SETS, pre-counted map-side, so a hot key
    never lands whole in one task). failures = null rows / duplicated key values.
    """
    spark = df.sparkSession
    parts = []
    nn = [c for c, t in spec if t == "not_null"]
    if nn:
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in nn])
        stack = ", ".join(f"'{c}', `{c}`" for c in nn)
        parts.append(agg.selectExpr(f"stack({len(nn)}, {stack}) as (column_name, failures)")
                     .withColumn("test", F.lit("not_null")))
    unique = list(dict.fromkeys(c for c, t in spec if t == "unique"))
    if unique:
        again = grain_counts(df, [[c] for c in unique]).where("cnt > 1")
        agg = again.agg(*[F.count_if((F.col("grain") == c) & F.col("key")[c].isNotNull()).alias(c) for c in unique])
        stack = ", ".join(f"'{c}', `{c}`" for c in unique)
        parts.append(agg.selectExpr(f"stack({len(unique)}, {stack}) as (column_name, failures)").withColumn("test", F.lit("unique")))
    if not parts:
        return spark.createDataFrame([], "model string, column_name string, test string, failures bigint, status string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(model).alias("model"), "column_name", "test",
                      F.col("failures").cast("bigint").alias("failures"),
                      F.when(F.col("failures") == 0, "pass").otherwise("fail").alias("status"))


def contract_violations(df: DataFrame, contract: list[tuple[str, str, bool]]) -> DataFrame:
    """Schema diff against the contract plus NOT NULL counts.

    Name/type checks read only the schema; the NOT NULL counts are one
    aggregation over the constrained columns. Returns one row per violation
    (kind, column_name, expected, actual, rows).
    """
    spark = df.sparkSession
    fields = {f.name: f.dataType for f in df.schema.fields}
    rows = []
    for name, typ, _ in contract:
        if name not in fields:
            rows.append(("missing_column", name, typ, None, None))
        elif not _TYPE_OK.get(typ, lambda t: False)(fields[name]):
            rows.append(("type_mismatch", name, typ, fields[name].simpleString(), None))
    declared = {c for c, _, _ in contract}
    for name in fields:
        if name not in declared:
            rows.append(("extra_column", name, None, fields[name].simpleString(), None))
    schema = "kind string, column_name string, expected string, actual string, rows bigint"
    out = spark.createDataFrame(rows, schema)
    nn = [c for c, _, req in contract if req and c in fields]
    if nn:
        agg = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in nn])
        stack = ", ".join(f"'{c}', `{c}`" for c in nn)
        nulls = agg.selectExpr(f"stack({len(nn)}, {stack}) as (column_name, rows)") \
            .where("rows > 0") \
            .select(F.lit("not_null_violation").alias("kind"), "column_name",
                    F.lit("not null").alias("expected"), F.lit("null").alias("actual"),
                    F.col("rows").cast("bigint").alias("rows"))
        out = out.unionByName(nulls)
    return out


def enforce_contract(df: DataFrame, contract: list[tuple[str, str, bool]]) -> DataFrame:
    """Raise when any violation exists; otherwise return ``df`` unchanged."""
    v = contract_violations(df, contract)
    bad = v.collect()  # a few rows for each contract column
    if bad:
        raise ContractViolation("; ".join(f"{r.kind}:{r.column_name}" for r in bad))
    return df


def null_rate_gate(df: DataFrame, columns: list[str], threshold: float = 0.01) -> DataFrame:
    """Null rate per column in one pass; ``breach`` when above threshold."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return agg.selectExpr("_n", f"stack({len(columns)}, {stack}) as (column_name, nulls)").select(
        "column_name", F.col("nulls").cast("bigint").alias("nulls"),
        F.col("_n").cast("bigint").alias("total_rows"),
        F.when(F.col("_n") > 0, F.col("nulls") / F.col("_n")).otherwise(F.lit(0.0)).alias("null_rate"),
        (F.when(F.col("_n") > 0, F.col("nulls") / F.col("_n")).otherwise(F.lit(0.0)) > threshold).alias("breach"))
