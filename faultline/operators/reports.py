"""Reports, stored model responses, context packing and usage cost."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.jsontext import BALANCED_OBJECT, is_json_object, strip_fences
from faultline.functions.text import first_words
from faultline.plans import rules


# The sentences of R1 and R2 are fixed texts: reports must read as the reference's do.


def _nonempty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def what_failed(question: Column, model: Column, error_type: Column, message: Column) -> Column:
    """The question wins; else model / type / message (first 200 chars)
    joined by spaces; else a default."""
    parts = F.array_compact(F.array(
        F.when(_nonempty(model), F.concat(model, F.lit(" model failed"))),
        F.when(_nonempty(error_type) & (error_type != "unknown"), F.concat(F.lit("with "), error_type)),
        F.when(_nonempty(message), F.concat(F.lit("— "), F.substring(message, 1, rules.MESSAGE_CUT)))))
    return F.when(_nonempty(question), F.concat(F.lit("Investigation triggered by question: "), question)) \
        .when(F.size(parts) > 0, F.array_join(parts, " ")) \
        .otherwise(F.lit("Pipeline failure detected"))


def how_failed(finding: Column, message: Column, question: Column) -> Column:
    """R2: primary finding, else the error message, else the question default."""
    return F.when(_nonempty(finding), finding).when(_nonempty(message), message) \
        .when(_nonempty(question),
              F.lit("Silent correctness issue — pipeline succeeded but data may be incorrect.")) \
        .otherwise(F.lit("Failure mechanism not determined"))


def build_report(df: DataFrame) -> DataFrame:
    """Nested report struct per incident from the investigation columns."""
    def c(name, default=None, typ="string"):
        return F.col(name) if name in df.columns else F.lit(default).cast(typ)

    report = F.struct(
        c("incident_id", "").alias("incident_id"),
        F.coalesce(c("severity"), F.lit("error")).alias("severity"),
        F.coalesce(c("failure_class"), F.lit("unknown")).alias("failure_class"),
        what_failed(c("question"), c("dbt_model"), c("error_type"), c("error_message")).alias("what_failed"),
        F.struct(F.coalesce(c("dag_id"), F.lit("")).alias("dag_id"),
                 F.coalesce(c("task_id"), F.lit("")).alias("task_id"),
                 F.coalesce(c("dbt_model"), F.lit("")).alias("model"),
                 F.coalesce(c("table"), F.lit("")).alias("table"),
                 F.coalesce(c("column"), F.lit("")).alias("column")).alias("where_failed"),
        how_failed(c("primary_finding"), c("error_message"), c("question")).alias("how_it_failed"),
        F.coalesce(c("root_cause"), F.lit("")).alias("root_cause"),
        F.coalesce(c("evidence_chain", None, "array<string>"), F.array().cast("array<string>")).alias("evidence_chain"),
        F.coalesce(c("confidence", None, "double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(c("alternative_causes", None, "array<string>"), F.array().cast("array<string>"))
        .alias("alternative_causes_considered"),
        c("fix", None, "struct<immediate:string,preventive:string,monitoring:string>").alias("fix"),
        F.coalesce(c("prevention", None, "array<string>"), F.array().cast("array<string>")).alias("prevention"))
    return df.withColumn("report", report)


def to_incident(df: DataFrame) -> DataFrame:
    """The stored incident row for a report (then upsert with M1)."""
    r = F.col("report")
    ev = F.to_json(F.struct(
        r["evidence_chain"].alias("evidence_chain"),
        r["alternative_causes_considered"].alias("alternative_causes"),
        F.coalesce(F.col("database_evidence_count"), F.lit(0)).alias("database_evidence_count")
        if "database_evidence_count" in df.columns else F.lit(0).alias("database_evidence_count"),
        F.coalesce(F.col("code_findings_count"), F.lit(0)).alias("code_findings_count")
        if "code_findings_count" in df.columns else F.lit(0).alias("code_findings_count"),
        F.coalesce(F.col("similar_incidents_count"), F.lit(0)).alias("similar_incidents_count")
        if "similar_incidents_count" in df.columns else F.lit(0).alias("similar_incidents_count")))
    return df.select(
        r["incident_id"].alias("incident_id"), F.localtimestamp().alias("created_at"),
        r["severity"].alias("severity"), F.lit("resolved").alias("status"), F.lit("agent").alias("source"),
        *[F.coalesce(F.col(c) if c in df.columns else F.lit(None).cast("string"), F.lit("")).alias(c)
          for c in ("pipeline_name", "dag_id", "task_id", "run_id")],
        r["where_failed"]["model"].alias("dbt_model"), r["where_failed"]["table"].alias("target_table"),
        r["where_failed"]["column"].alias("target_column"), r["failure_class"].alias("failure_class"),
        r["what_failed"].alias("issue_summary"), r["root_cause"].alias("root_cause"),
        r["confidence"].alias("confidence"), F.to_json(r["fix"]).alias("fix_summary"),
        F.to_json(r["prevention"]).alias("prevention_summary"), ev.alias("evidence_json"),
        F.lit(False).alias("validated"), F.lit(None).cast("array<float>").alias("embedding"))


def parse_responses(df: DataFrame, text: str, schema: T.StructType | str) -> DataFrame:
    """Stored model responses -> struct. Strip code fences and parse; else
    parse the first object with at most one nested level; else no result
    (``parsed`` null, ``parse_ok`` false)."""
    cleaned = strip_fences(F.col(text))
    found = F.regexp_extract(F.col(text), "(?s)" + BALANCED_OBJECT, 0)
    pick = F.when(is_json_object(cleaned), cleaned).when(is_json_object(found), found)
    return df.withColumn("_json", pick) \
        .withColumn("parsed", F.from_json(F.col("_json"), schema)) \
        .withColumn("parse_ok", F.col("_json").isNotNull()).drop("_json")


def pack_context(pieces: DataFrame, keys: list[str], budget: int = rules.DEFAULT_BUDGET) -> DataFrame:
    """Fit ordered context pieces into a token budget.

    pieces: keys + ordinal, label, text, tokens (token counts are an input).
    In order: an empty text stays empty; a piece that fits is kept whole; else
    if more than 50 tokens remain it is cut to remaining-10 tokens and the
    remainder drops to 10; else it is emptied. A fold over each context's token
    counts (a prompt-sized list) keeps the remainder and how much of each piece
    stays; texts are not gathered but cut where they are.
    """
    piece = F.struct(F.col("ordinal").cast("int").alias("ordinal"), F.when(F.coalesce("text", F.lit("")) == "", F.lit(0)).otherwise(F.col("tokens")).cast("long").alias("tokens"))
    lists = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(piece)).alias("_pieces"))

    def step(state: Column, x: Column) -> Column:
        left, n = state["left"], x["tokens"]
        fits, cut = n <= left, left > rules.PACK_MIN_REMAINING
        keep = F.when(fits, n).when(cut, left - rules.PACK_HEADROOM).otherwise(F.lit(0).cast("long"))
        rest = F.when(fits, left - n).when(cut, F.lit(rules.PACK_HEADROOM).cast("long")).otherwise(left)
        return F.struct(rest.alias("left"), F.concat(state["kept"], F.array(F.struct(x["ordinal"].alias("ordinal"), keep.alias("keep")))).alias("kept"))

    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<ordinal:int,keep:bigint>>").alias("kept"))
    kept = lists.select(*keys, F.inline(F.aggregate("_pieces", start, step)["kept"])).withColumnRenamed("keep", "_keep")
    j = pieces.withColumn("ordinal", F.col("ordinal").cast("int")).join(kept, [*keys, "ordinal"])
    text = F.when(F.col("_keep") <= 0, F.lit("")).when(F.col("_keep") >= F.col("tokens"), F.col("text")) \
        .otherwise(first_words(F.col("text"), F.col("_keep")))
    return j.select(*keys, "ordinal", "label", F.col("_keep").alias("kept_tokens"), text.alias("packed_text"))


def usage_cost(usage: DataFrame, keys: list[str]) -> DataFrame:
    """Cost per call (small-model price for the first two stages, large
    otherwise) rolled up per key."""
    small = F.col("node").isin(rules.SMALL_MODEL_NODES)
    pin = F.when(small, rules.PRICE_SMALL[0]).otherwise(rules.PRICE_LARGE[0])
    pout = F.when(small, rules.PRICE_SMALL[1]).otherwise(rules.PRICE_LARGE[1])
    cost = F.col("input_tokens") * pin / 1_000_000 + F.col("output_tokens") * pout / 1_000_000
    return usage.withColumn("cost", cost).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.sum("cost").alias("cost_usd"))


def stored_reports(store: DataFrame) -> DataFrame:
    """Stored incidents as report rows, the whole table at once. Fix and
    prevention texts are the stored JSON; an absent text is empty."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return store.select(
        "incident_id", F.coalesce("severity", F.lit("error")).alias("severity"),
        F.coalesce("failure_class", F.lit("unknown")).alias("failure_class"), text("issue_summary").alias("what_failed"),
        F.struct(text("dag_id").alias("dag_id"), text("task_id").alias("task_id"), text("dbt_model").alias("model"),
                 text("target_table").alias("table"), text("target_column").alias("column")).alias("where_failed"),
        text("root_cause").alias("root_cause"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.from_json("fix_summary", "immediate string, preventive string, monitoring string").alias("fix"),
        F.coalesce(F.from_json("prevention_summary", "array<string>"), F.array().cast("array<string>")).alias("prevention"),
        F.coalesce("validated", F.lit(False)).alias("validated"))


def latest_manual_runs(instances: DataFrame) -> DataFrame:
    """The latest manual run of each pipeline (dag), with its number of
    task instances and of those whose log attempt is 0. An aggregation per
    run, then the newest run per dag."""
    manual = instances.where(F.col("run_type") == "manual")
    runs = manual.groupBy("dag_id", "run_id").agg(
        F.max("start_date").alias("started"), F.count(F.lit(1)).alias("tasks"),
        F.count_if(F.coalesce("try_number", F.lit(0)) == 0).alias("zero_attempts"))
    newest = runs.groupBy("dag_id").agg(F.max(F.struct("started", "run_id", "tasks", "zero_attempts")).alias("r"))
    return newest.select("dag_id", "r.run_id", "r.started", F.col("r.tasks").cast("bigint").alias("tasks"), F.col("r.zero_attempts").cast("bigint").alias("zero_attempts"))
