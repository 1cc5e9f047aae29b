"""Report scoring against expected answers (V1-V4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.functions.text import keyword_hits
from faultline.plans import rules

# --- fixed values: expected answers of the three evaluation scenarios -------------------
SCENARIOS = {
    "null_join_key": {
        "failure_class": "data_quality",
        "expected_tables": ["bronze.sales", "silver_sales", "fct_sales"],
        "expected_column": "customer_id",
        "root_cause_keywords": ["null", "customer_id", "join", "bronze", "NOT NULL", "constraint"],
        "fix_should_mention": ["filter", "not_null", "WHERE", "IS NOT NULL"],
        "prevention_should_mention": ["test", "validation", "alert", "not_null"],
    },
    "schema_drift": {
        "failure_class": "schema_drift",
        "expected_tables": ["bronze.customers", "silver_customers"],
        "expected_column": "customer_id",
        "root_cause_keywords": ["type", "cast", "integer", "CUST", "format", "non-numeric"],
        "fix_should_mention": ["cast", "text", "remove", "handle", "regex"],
        "prevention_should_mention": ["schema", "contract", "drift", "alert", "test", "numeric"],
    },
    "missing_partition": {
        "failure_class": "silent_correctness",
        "expected_tables": ["bronze.sales", "silver.silver_sales", "gold.fct_sales"],
        "expected_column": "order_date",
        "root_cause_keywords": ["missing", "bronze", "sales", "order_date", "2026-03-04", "source", "zero", "0"],
        "fix_should_mention": ["backfill", "bronze", "sales", "order_date", "missing", "reprocess"],
        "prevention_should_mention": ["alert", "zero", "row", "count", "monitor", "missing", "partition"],
    },
}
# --- end of fixed values ---------------------------------------------------------------

CRITERIA = ["classification", "table_identified", "column_identified", "root_cause", "fix_actionable", "prevention"]


def expected_df(spark) -> DataFrame:
    """The fixed answers, a row for each scenario, marked for a broadcast: a shuffle would bring the
    texts of all reports together by their few scenarios."""
    rows = [(name, e["failure_class"], e["expected_tables"], e["expected_column"], e["root_cause_keywords"],
             e["fix_should_mention"], e["prevention_should_mention"]) for name, e in SCENARIOS.items()]
    return F.broadcast(spark.createDataFrame(rows, "scenario string, expected_class string, expected_tables array<string>, "
                                                   "expected_column string, root_cause_keywords array<string>, "
                                                   "fix_should_mention array<string>, prevention_should_mention array<string>"))


def _hits_score(hits: Column, n: Column) -> Column:
    return F.when(n == 0, 1.0).when(hits >= 2, 1.0).when(hits >= 1, 0.5).otherwise(0.0)


def score_reports(reports: DataFrame, expected: DataFrame, on: str = "scenario") -> DataFrame:
    """V1: six criteria per report joined to its expected answer.

    reports: on, failure_class, root_cause, evidence_chain array<string>,
             fix struct<immediate,preventive,monitoring>, prevention array<string>
    """
    j = reports.join(expected, on, "inner")
    rc = F.lower(F.coalesce(F.col("root_cause"), F.lit("")))
    ev = F.lower(F.array_join(F.coalesce("evidence_chain", F.array().cast("array<string>")), " "))
    fx = F.lower(F.concat_ws(" ", F.coalesce(F.col("fix.immediate"), F.lit("")),
                             F.coalesce(F.col("fix.preventive"), F.lit("")),
                             F.coalesce(F.col("fix.monitoring"), F.lit(""))))
    pv = F.lower(F.array_join(F.coalesce("prevention", F.array().cast("array<string>")), " "))
    # Lower-case every text once, count each keyword list once.
    j = j.withColumn("_rc", rc).withColumn("_fx", fx).withColumn("_pv0", pv).withColumn("_ev", ev)
    j = j.withColumn("_all", F.concat_ws(" ", "_rc", "_ev", "_fx", "_pv0")) \
        .withColumn("_pv", F.concat_ws(" ", "_fx", "_pv0"))
    j = j.withColumn("_tbl_hits", keyword_hits(F.col("_all"), F.col("expected_tables"), lowered=True)) \
        .withColumn("_rc_hits", keyword_hits(F.col("_rc"), F.col("root_cause_keywords"), lowered=True)) \
        .withColumn("_fx_hits", keyword_hits(F.col("_fx"), F.col("fix_should_mention"), lowered=True)) \
        .withColumn("_pv_hits", keyword_hits(F.col("_pv"), F.col("prevention_should_mention"), lowered=True))
    partial = None
    for exp_cls, actual in rules.PARTIAL_CLASS_CREDIT.items():
        c = (F.col("expected_class") == exp_cls) & F.col("failure_class").isin(actual)
        partial = c if partial is None else (partial | c)
    cls = F.when(F.col("failure_class") == F.col("expected_class"), 1.0).when(partial, 0.5).otherwise(0.0)
    tbl = F.when(F.col("_tbl_hits") > 0, 1.0).otherwise(0.0)
    col = F.when(F.coalesce(F.col("expected_column"), F.lit("")) == "", 1.0) \
        .when(F.col("_all").contains(F.lower(F.col("expected_column"))), 1.0).otherwise(0.0)
    n_rc = F.size(F.coalesce("root_cause_keywords", F.array().cast("array<string>")))
    ratio = F.col("_rc_hits") / F.greatest(n_rc, F.lit(1))
    root = F.when(n_rc == 0, 1.0).when(ratio >= rules.ROOT_CAUSE_FULL, 1.0) \
        .when(ratio >= rules.ROOT_CAUSE_HALF, 0.5).otherwise(0.0)
    fix = _hits_score(F.col("_fx_hits"), F.size(F.coalesce("fix_should_mention", F.array().cast("array<string>"))))
    prev = _hits_score(F.col("_pv_hits"),
                       F.size(F.coalesce("prevention_should_mention", F.array().cast("array<string>"))))
    out = j.withColumn("classification", cls).withColumn("table_identified", tbl) \
        .withColumn("column_identified", col).withColumn("root_cause", root) \
        .withColumn("fix_actionable", fix).withColumn("prevention", prev)
    total = sum((F.col(c) for c in CRITERIA[1:]), F.col(CRITERIA[0]))
    keep = [c for c in reports.columns if c not in ("root_cause", "prevention", "fix", "evidence_chain",
                                                    "failure_class")]
    return out.select(*keep, *CRITERIA, total.alias("total"))


def score_status(scores: DataFrame, keys: list[str]) -> DataFrame:
    """V2: one row per criterion with PASS (1.0) / PARTIAL (>= 0.5) / FAIL."""
    stack = ", ".join(f"'{c}', `{c}`" for c in CRITERIA)
    s = scores.selectExpr(*keys, f"stack({len(CRITERIA)}, {stack}) as (criterion, score)")
    return s.withColumn("status", F.when(F.col("score") >= 1.0, "PASS").when(F.col("score") >= 0.5, "PARTIAL")
                        .otherwise("FAIL"))


def scorecard(scores: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """V3: mean total and verdict (>= 5 excellent, >= 4 good, >= 3 fair)."""
    g = scores.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("reports"), F.avg("total").alias("overall"))
    v = None
    for th, name in rules.VERDICTS:
        v = F.when(F.col("overall") >= th, name) if v is None else v.when(F.col("overall") >= th, name)
    return g.withColumn("verdict", v.otherwise(rules.VERDICT_DEFAULT))


def report_checks(reports: DataFrame) -> DataFrame:
    """V4: validity of finished reports (class set, root cause present,
    confidence in [0, 1], evidence chain and fix present)."""
    r = F.col("report")
    return reports.select(
        r["incident_id"].alias("incident_id"),
        (F.coalesce(r["failure_class"], F.lit("unknown")) != "unknown").alias("has_class"),
        (F.length(F.coalesce(r["root_cause"], F.lit(""))) > 0).alias("has_root_cause"),
        r["confidence"].between(0.0, 1.0).alias("confidence_in_range"),
        (F.size(F.coalesce(r["evidence_chain"], F.array())) > 0).alias("has_evidence_chain"),
        r["fix"].isNotNull().alias("has_fix"))
