"""Incident rules as column expressions and broadcast lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import empty_to_null
from faultline.plans import rules


def resolve_model(df: DataFrame, task_col: str = "task_id") -> DataFrame:
    """Explicit task map first (an entry may map to no model), else strip
    the ``run_dbt_`` prefix, else null. One broadcast join with the fixed map."""
    m = F.broadcast(rules.task_model_df(df.sparkSession).withColumn("_mapped", F.lit(True)))
    j = df.join(m, df[task_col] == m["task_id"], "left") if task_col != "task_id" else df.join(m, "task_id", "left")
    t = F.col(task_col)
    model = F.when(F.col("_mapped"), F.col("mapped_model")) \
        .when(t.startswith(rules.TASK_MODEL_PREFIX), F.substring(t, len(rules.TASK_MODEL_PREFIX) + 1, 1 << 30))
    return j.withColumn("dbt_model", model).drop("_mapped", "mapped_model")


def intake(triggers: DataFrame) -> DataFrame:
    """Keep a given incident id or derive ``INC-<yyyyMMddHHmmss>-<16 hex>``
    from the trigger time and a hash of the payload (``INC-<16 hex>`` without a
    time), so a replay gives the same id and distinct payloads distinct ones; pipeline name falls back to the dag id, then ``unknown``; severity
    defaults to ``error``; the model comes from J6."""
    payload = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in
                                 ("dag_id", "task_id", "run_id", "error_message", "question", "timestamp")])
    ts = F.date_format(F.try_to_timestamp(F.col("timestamp")), "yyyyMMddHHmmss")
    new_id = F.concat_ws("-", F.lit("INC"), ts, F.substring(F.md5(payload), 1, 16))
    out = triggers.withColumn("incident_id", F.coalesce(empty_to_null(F.col("incident_id")), new_id)) \
        .withColumn("pipeline_name", F.coalesce(empty_to_null(F.col("pipeline_name")), F.col("dag_id"),
                                                F.lit("unknown"))) \
        .withColumn("severity", F.coalesce(F.col("severity"), F.lit("error")))
    return resolve_model(out.withColumn("task_id", F.coalesce(F.col("task_id"), F.lit(""))))


def classify(signals: DataFrame) -> DataFrame:
    """Error type -> failure class (else unknown) -> priorities, with the
    rule confidence. Two broadcast joins with fixed tables."""
    spark = signals.sparkSession
    ec = F.broadcast(rules.error_class_df(spark))
    cp = F.broadcast(rules.class_priorities_df(spark))
    j = signals.join(ec, "error_type", "left") \
        .withColumn("failure_class", F.coalesce(F.col("failure_class"), F.lit("unknown")))
    return j.join(cp, "failure_class", "left") \
        .withColumn("investigation_priorities", F.coalesce("priorities", F.array().cast("array<string>"))) \
        .drop("priorities") \
        .withColumn("classification_confidence", F.lit(rules.RULE_CONFIDENCE))


def resolve_target(df: DataFrame) -> DataFrame:
    """C4: target from log signals. First referenced table, split at the first
    dot (schema ``public`` if none); else the first upstream source; first
    referenced column; date and timestamp columns default to order_date."""
    first_tbl = F.try_element_at(F.col("tables"), F.lit(1))
    src = F.try_element_at(F.col("upstream_sources"), F.lit(1)) if "upstream_sources" in df.columns else None
    has_dot = F.instr(first_tbl, ".") > 0
    schema = F.when(first_tbl.isNotNull(), F.when(has_dot, F.substring_index(first_tbl, ".", 1))
                    .otherwise(F.lit(rules.DEFAULT_SCHEMA)))
    table = F.when(first_tbl.isNotNull(), F.when(has_dot, F.expr("substr(tables[0], instr(tables[0], '.') + 1)"))
                   .otherwise(first_tbl))
    if src is not None:
        schema = F.coalesce(schema, F.when(src.isNotNull(), F.coalesce(src["schema"], F.lit(rules.DEFAULT_SOURCE_SCHEMA))))
        table = F.coalesce(table, F.when(src.isNotNull(), F.coalesce(src["table_name"], F.lit(""))))
    return df.withColumn("schema", schema).withColumn("table", table) \
        .withColumn("column", F.try_element_at(F.col("columns"), F.lit(1))) \
        .withColumn("date_column", F.lit(rules.DEFAULT_DATE_COLUMN)) \
        .withColumn("timestamp_column", F.lit(rules.DEFAULT_DATE_COLUMN))


def resolve_question_target(df: DataFrame) -> DataFrame:
    """Target from a parsed question (struct column ``parsed``)."""
    t0 = F.try_element_at(F.col("parsed.tables_to_check"), F.lit(1))
    date_col = F.coalesce(empty_to_null(F.col("parsed.date_filter.column")), F.lit(rules.DEFAULT_DATE_COLUMN))
    return df.withColumn("schema", F.when(t0.isNotNull(), F.coalesce(t0["schema"], F.lit("bronze")))) \
        .withColumn("table", F.when(t0.isNotNull(), F.coalesce(t0["table"], F.lit("")))) \
        .withColumn("column", F.try_element_at(F.col("parsed.columns_of_interest"), F.lit(1))) \
        .withColumn("date_value", empty_to_null(F.col("parsed.date_filter.value"))) \
        .withColumn("date_column", date_col) \
        .withColumn("timestamp_column", date_col) \
        .withColumn("check_priorities", F.coalesce(F.col("parsed.check_priorities"), F.array().cast("array<string>"))) \
        .withColumn("layer_tables", F.coalesce(F.col("parsed.tables_to_check"),
                                               F.array().cast("array<struct<schema:string,table:string,layer:string>>")))


def redirect_target(df: DataFrame) -> DataFrame:
    """A ``*__dbt_tmp`` target moves to the first upstream source, else
    the first upstream model (``silver_`` models live in schema silver); an
    empty column falls back to the first referenced column."""
    tmp = F.coalesce(F.col("table"), F.lit("")).endswith(rules.TEMP_TABLE_SUFFIX)
    src = F.try_element_at(F.col("upstream_sources"), F.lit(1))
    mdl = F.try_element_at(F.col("upstream_models"), F.lit(1))
    new_schema = F.when(src.isNotNull(), F.coalesce(src["schema"], F.lit("bronze"))) \
        .when(mdl.isNotNull() & mdl.startswith("silver_"), F.lit("silver")).otherwise(F.col("schema"))
    new_table = F.when(src.isNotNull(), F.coalesce(src["table_name"], F.lit(""))) \
        .when(mdl.isNotNull(), mdl).otherwise(F.col("table"))
    out = df.withColumn("schema", F.when(tmp, new_schema).otherwise(F.col("schema"))) \
        .withColumn("table", F.when(tmp, new_table).otherwise(F.col("table")))
    return out.withColumn("column", F.coalesce(empty_to_null(F.col("column")),
                                               F.try_element_at(F.col("columns"), F.lit(1))))


def question_priorities(df: DataFrame, type_col: str = "investigation_type") -> DataFrame:
    """Investigation type -> check priorities (broadcast lookup)."""
    qp = F.broadcast(rules.question_priorities_df(df.sparkSession))
    return df.join(qp, df[type_col] == qp["investigation_type"], "left") \
        .drop(qp["investigation_type"]) \
        .withColumn("priorities", F.coalesce("priorities", F.array().cast("array<string>")))


def cap_confidence(conf: Column, logs_available: Column, db_available: Column) -> Column:
    """At most 0.7 without logs, at most 0.5 without database evidence."""
    return F.least(conf.cast("double"),
                   F.when(logs_available, F.lit(1.0)).otherwise(F.lit(rules.CAP_NO_LOGS)),
                   F.when(db_available, F.lit(1.0)).otherwise(F.lit(rules.CAP_NO_EVIDENCE)))


def confidence_band(conf: Column) -> Column:
    """High >= 0.8, medium >= 0.5, else low."""
    return F.when(conf >= rules.BAND_HIGH, "high").when(conf >= rules.BAND_MEDIUM, "medium").otherwise("low")
