"""Data-quality checks.

Design: the reference runs one SQL statement per check. Here every scalar
check on one table (null counts, row count, partition rows, freshness) is
fused into a single aggregation pass, and the grouped checks on one key
(duplicate top-k and duplicate total) share one grouped DataFrame. A check
plan is a DataFrame of specs. Relations, columns and date values that don't
exist become error rows in DataFrames; only distinct checks of registered
tables and their own columns reach the driver to build the jobs, and the dates
that partition checks ask for never do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.plans import rules
from faultline.session import written
from faultline.sources import files

EVIDENCE_SCHEMA = T.StructType([
    T.StructField("context", T.StringType()),
    T.StructField("layer", T.StringType()),
    T.StructField("schema", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("template", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("row_count", T.LongType()),
    T.StructField("rows", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
    T.StructField("spec_key", T.StringType()),
])

SCALAR = {"null_check", "row_count", "freshness", "duplicate_total"}


# --- single checks as DataFrames (A2-A8, P6, Q6) ------------------------------------


def null_check(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(F.col(column).isNull()).cast("bigint").alias("null_count"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias("total_rows"))


def partition_check(df: DataFrame, date_column: str, date_value: str) -> DataFrame:
    return df.agg(F.count_if(F.col(date_column) == F.lit(date_value)).cast("bigint").alias("partition_rows"))


def freshness(df: DataFrame, timestamp_column: str) -> DataFrame:
    return df.agg(F.max(timestamp_column).alias("latest_record"))


def key_counts(df: DataFrame, column: str) -> DataFrame:
    """Shared grouped DataFrame for duplicate_check / duplicate_total. NULL is a
    group, as in SQL GROUP BY. Partial aggregation runs map-side, so a hot key
    is pre-counted before the shuffle."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def grain_counts(df: DataFrame, grains: list[list[str]]) -> DataFrame:
    """Counts of the keys of several grains from one scan: (grain, key, cnt).

    One Expand and one aggregation (GROUPING SETS); ``key`` is a struct of all
    columns of the grains, with nulls in those that aren't the grain's. NULL is a
    group, as in SQL GROUP BY.
    """
    columns = list(dict.fromkeys(c for g in grains for c in g))
    sets = [[F.col(c) for c in g] for g in grains]
    # bit i of grouping_id, from the right, is 1 where the i-th column from the end isn't in the grain
    number = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in g): ",".join(g) for g in grains}
    name = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])
    counted = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().cast("int").alias("_grain"), F.count(F.lit(1)).alias("cnt"))
    # the name depends on the count, so that a filter on it stays above the aggregation and all readers share one
    return counted.select(F.when(F.col("cnt") > 0, name[F.col("_grain")]).alias("grain"), F.struct(*columns).alias("key"), "cnt")


def duplicate_grains(df: DataFrame, grains: list[list[str]], k: int = rules.DUPLICATE_TOP) -> DataFrame:
    """X6/A3/A4 for several grains: (grain, violations, rows_in_violation, top), the k most frequent keys as JSON with their counts.

    One scan and one aggregation, read twice; top keys are ranked behind a
    per-task limit. A grain without duplicates has zeros and no keys.
    """
    again = grain_counts(df, grains).where("cnt > 1")
    sums = again.groupBy("grain").agg(F.count(F.lit(1)).alias("violations"), F.sum("cnt").alias("rows_in_violation"))
    rank = F.row_number().over(Window.partitionBy("grain").orderBy(F.desc("cnt"), "key"))
    top = again.withColumn("rank", rank).where(F.col("rank") <= k)
    top = top.groupBy("grain").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "key", "cnt"))), lambda x: F.to_json(F.struct(x["key"].alias("key"), x["cnt"].alias("cnt")))).alias("top"))
    names = df.sparkSession.createDataFrame([(",".join(g),) for g in grains], "grain string")
    out = F.broadcast(names).join(sums, "grain", "left").join(top, "grain", "left")
    zero = F.lit(0).cast("bigint")
    return out.select("grain", F.coalesce("violations", zero).alias("violations"), F.coalesce("rows_in_violation", zero).alias("rows_in_violation"), F.coalesce("top", F.array().cast("array<string>")).alias("top"))


def duplicate_check(df: DataFrame, column: str, k: int = rules.DUPLICATE_TOP,
                    counts: DataFrame | None = None) -> DataFrame:
    """Top-k duplicated keys by count (ties broken by key; the reference leaves
    ties unordered). Planned as TakeOrderedAndProject: each task keeps k rows."""
    c = counts if counts is not None else key_counts(df, column)
    return c.where("cnt > 1").orderBy(F.desc("cnt"), F.asc_nulls_first(column)).limit(k)


def duplicate_total(df: DataFrame, column: str, counts: DataFrame | None = None) -> DataFrame:
    c = counts if counts is not None else key_counts(df, column)
    return c.where("cnt > 1").agg(F.count(F.lit(1)).cast("bigint").alias("duplicate_key_count"))


def invalid_cast_check(df: DataFrame, column: str, limit: int = rules.INVALID_CAST_LIMIT) -> DataFrame:
    """Up to ``limit`` non-null values that are not plain digits (negatives and
    decimals are flagged too). Ordered before the limit so results repeat."""
    v = F.col(column).cast("string")
    return df.where(F.col(column).isNotNull() & ~v.rlike(rules.INTEGER_PATTERN)) \
        .select(F.col(column)).orderBy(F.col(column)).limit(limit)


def sample_rows(df: DataFrame, condition: str, order_by: list[str] | None = None,
                limit: int = rules.SAMPLE_LIMIT) -> DataFrame:
    out = df.where(F.expr(condition))
    if order_by:
        out = out.orderBy(*order_by)
    return out.limit(limit)


def column_presence(df: DataFrame, expected: list[str] | None = None) -> DataFrame:
    """Name and type of each column, plus expected columns that are missing."""
    spark = df.sparkSession
    rows = [(f.name, f.dataType.simpleString(), True) for f in df.schema.fields]
    rows += [(c, None, False) for c in (expected or []) if c not in df.columns]
    return spark.createDataFrame(rows, "column_name string, data_type string, present boolean")


# --- fused per-table evidence (A10) --------------------------------------------------


def _spec_key(s: dict) -> str:
    t = s["template"]
    extra = s.get("date_value") if t == "partition_check" else s.get("condition") if t == "sample_rows" else ""
    return "|".join(str(x or "") for x in (t, spec_column(s), extra))


def _wanted_date(spec: dict, df: DataFrame) -> Column:
    return F.lit(spec["date_value"]).try_cast(df.schema[spec["date_column"]].dataType)


def _bad_date(spec: dict, df: DataFrame) -> Column:
    """The error of a partition check whose date is no value of the column's type."""
    if spec["template"] != "partition_check":
        return F.lit(None).cast("string")
    return F.when(_wanted_date(spec, df).isNull(), F.lit(f'invalid value "{spec["date_value"]}" for column "{spec["date_column"]}"'))


def _scalar_expr(spec: dict, df: DataFrame) -> Column:
    t = spec["template"]
    if t == "partition_check":
        return F.count_if(F.col(spec["date_column"]) == _wanted_date(spec, df)).cast("string")
    if t == "null_check":
        return F.count_if(F.col(spec["column"]).isNull()).cast("string")
    if t == "row_count":
        return F.count(F.lit(1)).cast("string")
    if t == "freshness":
        return F.max(spec["timestamp_column"]).cast("string")
    raise ValueError(t)


_SCALAR_FIELD = {"null_check": "null_count", "row_count": "total_rows",
                 "partition_check": "partition_rows", "freshness": "latest_record",
                 "duplicate_total": "duplicate_key_count"}


def spec_column(spec: dict):
    """The column a check is about (its evidence key next to the template)."""
    t = spec["template"]
    if t == "partition_check":
        return spec.get("date_column")
    if t == "freshness":
        return spec.get("timestamp_column")
    if t in ("row_count", "column_presence"):
        return None
    return spec.get("column")


def spec_column_expr() -> Column:
    t = F.col("template")
    return (F.when(t == "partition_check", F.col("date_column"))
            .when(t == "freshness", F.col("timestamp_column"))
            .when(t.isin("row_count", "column_presence"), F.lit(None).cast("string"))
            .otherwise(F.col("column")))


def _missing_columns(df: DataFrame, spec: dict) -> list[str]:
    cols = set(df.columns)
    need = [spec.get(p) for p in ("column", "date_column", "timestamp_column")
            if p in rules.TEMPLATE_PARAMS.get(spec["template"], [])]
    return [c for c in need if c and c not in cols]


def partition_evidence(df: DataFrame, date_column: str, wanted: DataFrame) -> DataFrame:
    """Partition rows of every wanted date (column date_value, text) in one pass.

    One grouped count of the date column joined with the wanted dates, so any
    number of dates costs one scan and one aggregate; an absent date has 0
    rows, a value that is no date of the column's type gives an error row.
    """
    kind = df.schema[date_column].dataType
    counts = df.groupBy(F.col(date_column).alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    w = wanted.select("date_value").distinct().withColumn("_want", F.col("date_value").try_cast(kind))
    j = w.join(counts, F.col("_want") == F.col("_day"), "left")
    bad = F.col("_want").isNull()
    value = F.when(~bad, F.coalesce("_n", F.lit(0)).cast("string"))
    return j.select(
        F.lit("partition_check").alias("template"), F.lit(date_column).alias("column_name"), value.alias("value"),
        F.when(bad, 0).otherwise(1).cast("bigint").alias("row_count"),
        F.when(bad, F.array().cast("array<string>")).otherwise(
            F.array(F.to_json(F.create_map(F.lit(_SCALAR_FIELD["partition_check"]), value)))).alias("rows"),
        F.when(bad, F.concat(F.lit('invalid value "'), "date_value", F.lit(f'" for column "{date_column}"'))).alias("error"),
        F.concat(F.lit(f"partition_check|{date_column}|"), "date_value").alias("spec_key"))


def table_evidence(df: DataFrame, specs: list[dict], schema: str, table: str,
                   context: str | None = None, layer: str | None = None,
                   dates: dict[str, DataFrame] | None = None) -> DataFrame:
    """Evidence rows for all ``specs`` on one table.

    One aggregation pass for every scalar check, fixed dates included; one for
    the counts of all key columns (GROUPING SETS), shared by duplicate_check and
    duplicate_total; a grouped count for each date column whose wanted dates are a
    DataFrame; bounded row sets (first 20, 5 samples) for the others. A column the table does not have gives an error
    row instead of a failed job. ``dates`` maps a date column to the wanted
    dates (column date_value), beside those given in ``specs``.
    """
    spark = df.sparkSession
    ctx = context or f"{schema}.{table}"
    parts: list[DataFrame] = []
    errors = []
    scalar = []
    uniq: dict[str, dict] = {}
    for s in specs:
        uniq.setdefault(_spec_key(s), s)
    specs = list(uniq.values())
    for s in specs:
        miss = _missing_columns(df, s)
        if miss:
            errors.append((s["template"], spec_column(s), f'column "{miss[0]}" does not exist', _spec_key(s)))
            continue
        if s["template"] in SCALAR and s["template"] != "duplicate_total":
            scalar.append(s)
    asked: dict[str, list] = {}
    wanted = dict(dates or {})
    for s in specs:
        if s["template"] != "partition_check" or _missing_columns(df, s):
            continue
        if s["date_column"] in wanted:
            asked.setdefault(s["date_column"], []).append((s["date_value"],))
        else:  # a fixed date is counted in the scalar pass
            scalar.append(s)
    for c, values in asked.items():
        own = spark.createDataFrame(values, "date_value string")
        wanted[c] = wanted[c].select("date_value").union(own)
    if scalar:
        agg = df.agg(*[_scalar_expr(s, df).alias(f"c{i}") for i, s in enumerate(scalar)])
        arr = F.array(*[F.struct(F.lit(s["template"]).alias("template"),
                                 F.lit(spec_column(s)).cast("string").alias("column_name"),
                                 F.col(f"c{i}").alias("value"),
                                 F.lit(_SCALAR_FIELD[s["template"]]).alias("field"),
                                 _bad_date(s, df).alias("error"),
                                 F.lit(_spec_key(s)).alias("spec_key"))
                        for i, s in enumerate(scalar)])
        parts.append(agg.select(F.inline(arr)).select(
            "template", "column_name", F.when(F.col("error").isNull(), F.col("value")).alias("value"), F.when(F.col("error").isNull(), 1).otherwise(0).cast("bigint").alias("row_count"),
            F.when(F.col("error").isNull(), F.array(F.to_json(F.create_map(F.col("field"), F.col("value"))))).otherwise(F.array().cast("array<string>")).alias("rows"), "error", "spec_key"))
    keyed = sorted({s["column"] for s in specs if s["template"] in ("duplicate_check", "duplicate_total") and not _missing_columns(df, s)})
    grouped = grain_counts(df, [[c] for c in keyed]) if keyed else None
    for s in specs:
        t = s["template"]
        if t in ("row_count", "null_check", "partition_check", "freshness") or _missing_columns(df, s):
            continue
        col = s.get("column")
        if t in ("duplicate_check", "duplicate_total"):
            counts = grouped.where(F.col("grain") == col).select(F.col("key")[col].alias(col), "cnt")
            if t == "duplicate_total":
                d = duplicate_total(df, col, counts)
                parts.append(d.select(F.lit(t).alias("template"), F.lit(col).alias("column_name"),
                                      F.col("duplicate_key_count").cast("string").alias("value"),
                                      F.lit(1).cast("bigint").alias("row_count"),
                                      F.array(F.to_json(F.struct("duplicate_key_count"))).alias("rows"),
                                      F.lit(_spec_key(s)).alias("spec_key")))
                continue
            rowset = duplicate_check(df, col, counts=counts)
        elif t == "invalid_cast_check":
            rowset = invalid_cast_check(df, col)
        elif t == "sample_rows":
            rowset = sample_rows(df, s["condition"])
        elif t == "column_presence":
            rowset = column_presence(df)
        else:
            errors.append((t, col, f"Unknown template: {t}", _spec_key(s)))
            continue
        packed = rowset.agg(F.count(F.lit(1)).cast("bigint").alias("row_count"),
                            F.collect_list(F.to_json(F.struct(*rowset.columns))).alias("rows"))
        parts.append(packed.select(F.lit(t).alias("template"), F.lit(spec_column(s)).cast("string").alias("column_name"),
                                   F.lit(None).cast("string").alias("value"), "row_count", "rows",
                                   F.lit(_spec_key(s)).alias("spec_key")))
    parts = [p if "error" in p.columns else p.withColumn("error", F.lit(None).cast("string")) for p in parts]
    parts += [partition_evidence(df, c, w) for c, w in wanted.items()]
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    if errors:
        e = spark.createDataFrame(errors, "template string, column_name string, error string, spec_key string").select(
            "template", "column_name", F.lit(None).cast("string").alias("value"),
            F.lit(0).cast("bigint").alias("row_count"), F.array().cast("array<string>").alias("rows"), "error",
            "spec_key")
        out = e if out is None else out.unionByName(e)
    if out is None:
        return spark.createDataFrame([], EVIDENCE_SCHEMA)
    return out.select(F.lit(ctx).alias("context"), F.lit(layer).cast("string").alias("layer"),
                      F.lit(schema).alias("schema"), F.lit(table).alias("table"),
                      "template", "column_name", "value", "row_count", "rows", "error", "spec_key")


def anomaly(ev: DataFrame) -> Column:
    """Whether an evidence row shows a problem (drives the origin layer)."""
    t, v, n = F.col("template"), F.col("value"), F.col("row_count")
    return (F.when(F.col("error").isNotNull(), True)
            .when(t.isin("null_check", "duplicate_total"), v.try_cast("bigint") > 0)
            .when(t.isin("row_count", "partition_check"), v.try_cast("bigint") == 0)
            .when(t == "freshness", v.isNull())
            .when(t.isin("duplicate_check", "invalid_cast_check", "sample_rows"), n > 0)
            .otherwise(False))


# --- plans: class-selected checks (J8, C8, A13) --------------------------------------


def expand_checks(targets: DataFrame) -> DataFrame:
    """Failure class -> templates (unknown class -> row_count), dropping
    templates whose parameters the target lacks.

    ``targets`` has incident_id, failure_class, schema, table, column,
    date_column, date_value, timestamp_column, condition (nullable strings).
    One broadcast join with the (small, fixed) class table, then an explode
    bounded by the template list.
    """
    spark = targets.sparkSession
    ct = spark.createDataFrame(list(rules.CLASS_TEMPLATES.items()), "failure_class string, templates array<string>")
    default = F.array(*[F.lit(t) for t in rules.DEFAULT_TEMPLATES])
    plan = targets.join(F.broadcast(ct), "failure_class", "left") \
        .select("*", F.posexplode(F.coalesce("templates", default)).alias("ordinal", "template")) \
        .drop("templates")
    present = F.array_compact(F.array(*[F.when(F.col(p).isNotNull() & (F.col(p) != ""), F.lit(p))
                                        for p in ("column", "date_column", "date_value",
                                                  "timestamp_column", "condition")]))
    req = F.broadcast(rules.template_params_df(spark))
    return plan.join(req, "template", "left") \
        .where(F.size(F.array_except(F.coalesce("required", F.array().cast("array<string>")), present)) == 0) \
        .drop("required")


def plan_checks(targets: DataFrame) -> DataFrame:
    """Strategy per incident. ``layered`` when there are question priorities
    and layer tables; ``class`` when a target table exists; else ``none``."""
    has_layers = (F.size(F.coalesce("check_priorities", F.array())) > 0) & \
                 (F.size(F.coalesce("layer_tables", F.array())) > 0)
    return targets.withColumn(
        "strategy",
        F.when(has_layers, "layered")
        .when(F.coalesce(F.col("table"), F.lit("")) != "", "class")
        .otherwise("none")) \
        .withColumn("run_upstream", ~has_layers)


@dataclass(frozen=True)
class Family:
    """Relations that are parts of one table: ``schema.prefix<key>`` holds the rows whose ``key`` column has that value.

    ``members`` (column ``key``) lists the relations that exist; one without rows has zeros.
    """

    schema: str
    prefix: str
    rows: DataFrame
    key: str
    members: DataFrame


def family_evidence(family: Family, specs: DataFrame) -> DataFrame:
    """Row counts and null counts of any number of a family's relations, from one grouped aggregate of its table.

    specs: schema, table, template, _about, spec_key of relations with the family's name. One that isn't a member, a
    column that isn't there and any other template give error rows.
    """
    columns = family.rows.columns
    key = F.col(family.key).cast("string")
    counts = family.rows.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.count_if(F.col(c).isNull()) for c in columns])).alias("_nulls"))
    members = family.members.select(F.col("key").cast("string").alias("_member")).distinct()
    own = specs.withColumn("_name", F.expr(f"substring(table, {len(family.prefix) + 1})"))
    j = own.join(members, F.col("_name") == F.col("_member"), "left").join(counts, F.col("_name") == F.col("_key"), "left")
    zero = F.lit(0).cast("bigint")
    field = F.when(F.col("template") == "row_count", _SCALAR_FIELD["row_count"]).otherwise(_SCALAR_FIELD["null_check"])
    value = F.when(F.col("template") == "row_count", F.coalesce("_n", zero)).otherwise(F.coalesce(F.try_element_at("_nulls", F.col("_about")), zero)).cast("string")
    error = F.when(F.col("_member").isNull(), F.concat(F.lit('relation "'), "schema", F.lit("."), "table", F.lit('" does not exist'))) \
        .when(~F.col("template").isin("row_count", "null_check"), F.concat(F.lit("Unknown template: "), "template")) \
        .when(F.col("_about").isNotNull() & ~F.col("_about").isin(*columns), F.concat(F.lit('column "'), "_about", F.lit('" does not exist')))
    j = j.withColumn("error", error)
    good = F.col("error").isNull()
    return j.select(F.concat_ws(".", "schema", "table").alias("context"), F.lit(None).cast("string").alias("layer"), "schema", "table", "template", F.col("_about").alias("column_name"),
                    F.when(good, value).alias("value"), F.when(good, 1).otherwise(0).cast("bigint").alias("row_count"),
                    F.when(good, F.array(F.to_json(F.create_map(field, value)))).otherwise(F.array().cast("array<string>")).alias("rows"), "error", "spec_key")


def run_plan(plan: DataFrame, tables: dict[str, DataFrame], families: list[Family] | None = None) -> DataFrame:
    """Execute a check plan against named tables and join the evidence back
    to every incident that asked for it.

    The plan's relations and columns come from data (log text, questions), so
    they are resolved in DataFrames against the list of registered columns:
    what does not exist gives error rows. The driver receives the distinct
    (table, template, columns, condition) of checks on registered columns, a
    number bounded by the registered columns (and the settings' conditions);
    wanted dates stay in a DataFrame.
    """
    keys = ["schema", "table", "template", "column", "date_column", "date_value",
            "timestamp_column", "condition"]
    for k in keys:
        if k not in plan.columns:
            plan = plan.withColumn(k, F.lit(None).cast("string"))
    spark = plan.sparkSession
    extra = F.when(F.col("template") == "partition_check", F.col("date_value")) \
        .when(F.col("template") == "sample_rows", F.col("condition"))
    plan = plan.withColumn("_about", spec_column_expr()).withColumn("spec_key", F.concat_ws(
        "|", "template", F.coalesce("_about", F.lit("")), F.coalesce(extra, F.lit(""))))
    # the plan is read several times below: its lineage (logs, signals, targets) runs once; what reads it takes distinct rows
    plan = written(plan.select("incident_id", *keys, "_about", "spec_key"), "check-plan")
    specs = written(plan.select(*keys, "_about", "spec_key").distinct(), "check-specs")
    registered = spark.createDataFrame([(n.partition(".")[0], n.partition(".")[2], list(df.columns)) for n, df in tables.items()],
                                       "schema string, table string, _columns array<string>")
    parts = []
    for f in families or []:
        named = F.coalesce((F.col("schema") == f.schema) & F.col("table").startswith(f.prefix), F.lit(False))
        parts.append(family_evidence(f, specs.where(named).select("schema", "table", "template", "_about", "spec_key").distinct()))
        specs = specs.where(~named)
    resolved = specs.join(F.broadcast(registered), ["schema", "table"], "left")
    relation = F.concat(F.lit('relation "'), F.coalesce("schema", F.lit("")), F.lit("."), F.coalesce("table", F.lit("")), F.lit('" does not exist'))
    error = F.when(F.col("_columns").isNull(), relation) \
        .when(F.col("_about").isNotNull() & ~F.array_contains("_columns", F.col("_about")),
              F.concat(F.lit('column "'), "_about", F.lit('" does not exist')))
    resolved = resolved.withColumn("error", error)
    ev = resolved.where("error is not null").select(
        F.concat_ws(".", "schema", "table").alias("context"), F.lit(None).cast("string").alias("layer"), "schema", "table", "template",
        F.col("_about").alias("column_name"), F.lit(None).cast("string").alias("value"), F.lit(0).cast("bigint").alias("row_count"),
        F.array().cast("array<string>").alias("rows"), "error", "spec_key").dropDuplicates(["schema", "table", "spec_key"])
    for p in parts:
        ev = ev.unionByName(p)
    good = resolved.where("error is null")
    asked = good.select(*[k for k in keys if k != "date_value"]).distinct().collect()  # registered columns only
    by_table: dict[tuple, list[dict]] = {}
    for r in asked:
        by_table.setdefault((r["schema"], r["table"]), []).append(r.asDict())
    for (schema, table), ss in by_table.items():
        days = {s["date_column"] for s in ss if s["template"] == "partition_check"}
        wanted = {c: good.where((F.col("schema") == schema) & (F.col("table") == table) & (F.col("template") == "partition_check")
                                & (F.col("date_column") == c)).select("date_value") for c in sorted(days)}
        e = table_evidence(tables[f"{schema}.{table}"], [s for s in ss if s["template"] != "partition_check"], schema, table, dates=wanted)
        ev = ev.unionByName(e)
    want = plan.select("incident_id", "schema", "table", "spec_key").distinct()
    e = ev.select(*[F.col(c).alias(f"_{c}") if c in ("schema", "table", "spec_key") else F.col(c) for c in ev.columns])
    same = F.col("schema").eqNullSafe(F.col("_schema")) & F.col("table").eqNullSafe(F.col("_table")) & (F.col("spec_key") == F.col("_spec_key"))
    return want.join(e, same, "inner").select("incident_id", "schema", "table", *[c for c in ev.columns if c not in ("schema", "table", "spec_key")])


# --- layered checks (J9, A12, C11) ---------------------------------------------------


def expand_layer_checks(questions: DataFrame) -> DataFrame:
    """Every priority on every question table; priorities outside the seven
    layer checks are dropped. Fan-out is bounded by the question's own lists."""
    t = questions.select("*", F.posexplode("layer_tables").alias("table_ordinal", "lt"))
    t = t.select("*", F.posexplode("check_priorities").alias("priority_ordinal", "template"))
    t = t.where(F.col("template").isin(rules.LAYER_CHECKS))
    return t.select(
        "incident_id", "table_ordinal", "priority_ordinal", "template",
        F.col("lt.schema").alias("schema"), F.col("lt.table").alias("table"),
        F.coalesce(F.col("lt.layer"), rules.infer_layer(F.col("lt.schema"))).alias("layer"),
        "column", "date_column", "date_value", "timestamp_column")


def layer_checks(questions: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Checks on every layer table, context ``layer:schema.table``.
    Checks missing a parameter are skipped, as in the reference."""
    exp = expand_layer_checks(questions)
    present = F.array_compact(F.array(*[F.when(F.col(p).isNotNull() & (F.col(p) != ""), F.lit(p))
                                        for p in ("column", "date_column", "date_value", "timestamp_column")]))
    req = F.broadcast(rules.template_params_df(questions.sparkSession))
    exp = exp.join(req, "template", "left") \
        .where(F.size(F.array_except(F.coalesce("required", F.array().cast("array<string>")), present)) == 0) \
        .drop("required")
    ev = run_plan(exp.withColumn("condition", F.lit(None).cast("string")), tables)
    lay = exp.select("incident_id", "schema", "table", "layer", "table_ordinal").distinct()
    return ev.drop("layer", "context").join(lay, ["incident_id", "schema", "table"], "inner") \
        .withColumn("context", F.concat(F.col("layer"), F.lit(":"), F.col("schema"), F.lit("."), F.col("table")))


def origin_layer(evidence: DataFrame) -> DataFrame:
    """C11: the lowest layer whose evidence shows the problem, and the stage it
    points at (bronze -> ingestion, silver -> transformation, gold ->
    aggregation/join). One aggregation per incident over its evidence rows."""
    stage = None
    for layer, s in rules.LAYER_STAGE.items():
        stage = F.when(F.col("origin_layer") == layer, s) if stage is None else \
            stage.when(F.col("origin_layer") == layer, s)
    e = evidence.withColumn("_bad", anomaly(evidence)).withColumn("_ord", rules.layer_ordinal(F.col("layer")))
    agg = e.groupBy("incident_id").agg(
        F.min(F.when(F.col("_bad"), F.struct("_ord", "layer"))).alias("_first"),
        F.count_if("_bad").cast("bigint").alias("failing_checks"),
        F.count(F.lit(1)).cast("bigint").alias("checks"))
    return agg.select("incident_id", F.col("_first.layer").alias("origin_layer"), "failing_checks", "checks") \
        .withColumn("origin_stage", stage)


# --- upstream checks (A11), evidence table (E12, U1) and roll-up (A16, C14) ------------


def _upstream_rows(incidents: DataFrame, lineage: DataFrame) -> DataFrame:
    up = incidents.select("incident_id", "model", "column").join(lineage.select("model", "upstream_sources", "upstream_models"), "model")
    schema = lambda m: F.when(m.startswith("silver_"), F.lit("silver")).otherwise(F.lit(rules.DEFAULT_SCHEMA))
    tables = F.concat(
        F.transform("upstream_sources", lambda s: F.struct(F.coalesce(s["schema"], F.lit(rules.DEFAULT_SOURCE_SCHEMA)).alias("schema"), s["table_name"].alias("table"))),
        F.transform("upstream_models", lambda m: F.struct(schema(m).alias("schema"), m.alias("table"))))
    t = up.select("incident_id", "column", F.explode(tables).alias("t")).where("t.table is not null and t.table <> ''")
    templates = F.when(F.coalesce("column", F.lit("")) != "", F.array(F.lit("row_count"), F.lit("null_check"))).otherwise(F.array(F.lit("row_count")))
    return t.select("incident_id", F.col("t.schema").alias("schema"), F.col("t.table").alias("table"), "column", F.explode(templates).alias("template"))


def upstream_plan(incidents: DataFrame, lineage: DataFrame) -> DataFrame:
    """The checks of every incident's upstream tables, from lineage.

    incidents: incident_id, model, column; lineage: model, upstream_sources,
    upstream_models (``lineage.lineage``). Sources keep their schema (default
    bronze), ``silver_`` models are in schema silver and others in public.
    row_count on each, null_check too when a column is known.
    """
    return _upstream_rows(incidents, lineage).distinct()


def upstream_checks(incidents: DataFrame, lineage: DataFrame, tables: dict[str, DataFrame], families: list[Family] | None = None) -> DataFrame:
    """Evidence of ``upstream_plan``, context ``upstream:schema.table``."""
    return run_plan(_upstream_rows(incidents, lineage), tables, families) \
        .withColumn("context", F.concat(F.lit("upstream:"), "schema", F.lit("."), "table"))


def all_evidence(direct: DataFrame, upstream: DataFrame) -> DataFrame:
    """Direct and upstream evidence of all incidents in one table."""
    return direct.unionByName(upstream, allowMissingColumns=True)


def append_evidence(evidence: DataFrame, path: str, run_id: str) -> None:
    """Add a run's evidence rows to the evidence table (one row per check),
    with the time of writing. The table is partitioned by run and a run replaces
    its own rows, so a repeated or half-failed write never doubles any."""
    files.write_run(evidence.withColumn("recorded_at", F.localtimestamp()), path, run_id)


def evidence_digest(evidence: DataFrame) -> DataFrame:
    """One line per check (error / rows / no anomalies), grouped per
    incident and context in a fixed order, plus the evidence-available flag."""
    line = F.when(F.col("error").isNotNull(), F.format_string("[%s] ERROR: %s", "template", "error")) \
        .when(F.size("rows") > 0, F.format_string("[%s] %s", F.col("template"), F.array_join("rows", ", "))) \
        .otherwise(F.format_string("[%s] no anomalies", "template"))
    per_ctx = evidence.groupBy("incident_id", "context").agg(
        F.sort_array(F.collect_list(F.struct("template", "column_name", line.alias("line")))).alias("items"))
    return per_ctx.select("incident_id", "context",
                          F.array_join(F.transform("items", lambda x: x["line"]), "\n").alias("digest"),
                          F.lit(True).alias("db_evidence_available"))


def evidence_available(incidents: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every incident with its number of evidence rows that are no
    errors, and whether there is one; an incident without evidence has 0."""
    n = evidence.groupBy("incident_id").agg(F.count_if(F.col("error").isNull()).alias("_n"))
    return incidents.select("incident_id").distinct().join(n, "incident_id", "left").select(
        "incident_id", F.coalesce("_n", F.lit(0)).cast("bigint").alias("database_evidence_count"),
        (F.coalesce("_n", F.lit(0)) > 0).alias("db_evidence_available"))
