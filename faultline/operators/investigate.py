"""From triggers to stored incidents: intake, signals, checks, similar incidents, report, upsert.

All triggers are investigated at once, each step being a join or an aggregation over
all of them; what is read by more than one step is written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import checks, incidents, logs, memory, reports
from faultline.session import written


def class_plan(targets: DataFrame) -> DataFrame:
    """C8 then J8: incidents whose strategy is ``class`` get their class's checks; those without a target get none."""
    t = targets.withColumn("check_priorities", F.array().cast("array<string>")) \
        .withColumn("layer_tables", F.array().cast("array<struct<schema:string,table:string,layer:string>>"))
    return checks.expand_checks(checks.plan_checks(t).where("strategy = 'class'"))


def targets_of(triggers: DataFrame) -> DataFrame:
    """A row for each trigger with its signals, class and target."""
    t = incidents.intake(triggers).withColumn("trigger_message", F.col("error_message"))
    c = incidents.classify(logs.extract_signals(t, "error_message"))
    c = incidents.resolve_target(c)
    none = {"upstream_sources": "array<struct<schema:string,table_name:string>>", "upstream_models": "array<string>", "date_value": "string", "condition": "string"}
    for name, kind in none.items():
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    return incidents.redirect_target(c)


def similar_counts(targets: DataFrame, store: DataFrame) -> DataFrame:
    """M2 for incidents with a vector: (incident_id, similar_incidents_count, most_similar)."""
    found = memory.search_similar(targets.select(F.col("incident_id").alias("query_id"), "failure_class", "embedding"), store)
    return found.groupBy(F.col("query_id").alias("incident_id")).agg(F.count(F.lit(1)).alias("similar_incidents_count"), F.min_by("incident_id", "rank").alias("most_similar"))


def investigate(triggers: DataFrame, tables: dict[str, DataFrame], store: DataFrame | None = None, families: list[checks.Family] | None = None) -> DataFrame:
    """The report of every trigger, with what it rests on.

    triggers: the columns of a trigger, and where there are any ``embedding`` (its
    vector, for the search of similar incidents in ``store``) and ``confidence`` (what
    the investigator states; 0 without). A trigger without a message counts as
    one without logs.
    """
    t = written(targets_of(triggers), "investigation-targets")
    evidence = checks.run_plan(class_plan(t), tables, families)
    r = t.join(checks.evidence_available(t, evidence), "incident_id")
    if store is not None and "embedding" in t.columns:
        r = r.join(similar_counts(t, store), "incident_id", "left")
    else:
        r = r.withColumn("similar_incidents_count", F.lit(0).cast("bigint")).withColumn("most_similar", F.lit(None).cast("string"))
    r = r.withColumn("similar_incidents_count", F.coalesce("similar_incidents_count", F.lit(0)))
    stated = F.col("confidence") if "confidence" in t.columns else F.lit(0.0)
    r = r.withColumn("confidence", incidents.cap_confidence(stated, F.coalesce("trigger_message", F.lit("")) != "", F.col("db_evidence_available")))
    return reports.build_report(r.withColumn("dbt_model", F.coalesce("dbt_model", F.try_element_at("models", F.lit(1)))))


def store_investigations(store: DataFrame, investigated: DataFrame) -> DataFrame:
    """The store after the reports' incidents are upserted."""
    return memory.upsert(store, reports.to_incident(investigated))
