"""Described controls (X2-X6): format drift, metric deviation, empty partitions,
referential integrity and grain. Each is an ordinary aggregation/join job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_pattern(c: Column) -> Column:
    """Shape of a value: digits -> 9, ASCII letters -> A, the rest kept."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), "[0-9]", "9"), "[A-Za-z]", "A")


def format_drift(baseline: DataFrame, current: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Value-shape counts per key in baseline vs current; ``new_pattern``
    marks shapes never seen in the baseline. Two partial aggregations and one
    full outer join of the (small) shape tables."""
    def prof(df, name):
        return df.groupBy(*keys, value_pattern(F.col(column)).alias("pattern")) \
            .agg(F.count(F.lit(1)).alias(name))
    j = prof(baseline, "baseline_rows").join(prof(current, "current_rows"), keys + ["pattern"], "full")
    return j.select(*keys, "pattern",
                    F.coalesce("baseline_rows", F.lit(0)).cast("bigint").alias("baseline_rows"),
                    F.coalesce("current_rows", F.lit(0)).cast("bigint").alias("current_rows"),
                    (F.col("baseline_rows").isNull() & F.col("current_rows").isNotNull()).alias("new_pattern"))


def rolling_deviation(df: DataFrame, keys: list[str], ts: str, window_days: int = 7,
                      threshold: float = 0.5) -> DataFrame:
    """Daily row counts against the mean of the previous ``window_days``
    days of the same key. Every key has a row for each day between the table's
    first and last one, with 0 rows where it has none, so an empty day is
    compared like any other. A mean of 0 gives no deviation; rows after such
    days are flagged. The window runs over the daily aggregate, never over raw
    rows."""
    daily = df.where(F.col(ts).isNotNull()).groupBy(*keys, F.to_date(F.col(ts)).alias("day")).agg(F.count(F.lit(1)).alias("rows"))
    span = daily.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).where("lo IS NOT NULL")
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("day"))
    every = daily.select(*keys).distinct().join(F.broadcast(days.agg(F.collect_list("day").alias("_days")))) \
        .select(*keys, F.explode("_days").alias("day"))
    same = F.col("e.day") == F.col("d.day")
    for k in keys:
        same = same & F.col(f"e.{k}").eqNullSafe(F.col(f"d.{k}"))
    filled = every.alias("e").join(daily.alias("d"), same, "left") \
        .select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.day").alias("day"), F.coalesce("d.rows", F.lit(0)).cast("bigint").alias("rows"))
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(-window_days, -1)
    out = filled.withColumn("trailing_mean", F.avg("rows").over(w))
    dev = F.when(F.col("trailing_mean") > 0, (F.col("rows") - F.col("trailing_mean")) / F.col("trailing_mean"))
    flagged = F.when(F.col("trailing_mean") == 0, F.col("rows") > 0).otherwise(F.coalesce(F.abs(dev) > threshold, F.lit(False)))
    return out.withColumn("deviation", dev).withColumn("flagged", flagged)


def missing_partitions(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    """Days in [start, end] (default: the data's own min..max) with zero rows.
    The calendar is one row per day of the span (bounded by the span, not by
    the data); distinct days of the data are a partial aggregation; the anti
    join finds the gaps."""
    days = df.select(F.to_date(F.col(ts)).alias("day")).where("day IS NOT NULL").distinct()
    bounds = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    if start is not None:
        bounds = bounds.withColumn("lo", F.lit(start).cast("date"))
    if end is not None:
        bounds = bounds.withColumn("hi", F.lit(end).cast("date"))
    span = bounds.select("lo", F.datediff("hi", "lo").alias("n")).where("n IS NOT NULL")
    cal = span.select(F.explode(F.sequence(F.col("lo"), F.date_add(F.col("lo"), F.col("n")))).alias("day"))
    return cal.join(days, "day", "left_anti")


def orphans(fact: DataFrame, fk: str, dim: DataFrame, pk: str, relation: str) -> DataFrame:
    """Fact rows whose non-null key has no dimension row. Rows are counted
    per key first (a hot key is one row of the anti join)."""
    keys = fact.where(F.col(fk).isNotNull()).groupBy(fk).agg(F.count(F.lit(1)).alias("_n"))
    bad = keys.join(dim.select(F.col(pk).alias(fk)), fk, "left_anti")
    return bad.agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("orphan_rows")) \
        .select(F.lit(relation).alias("relation"), "orphan_rows")


def grain_violations(df: DataFrame, grain: list[str], table: str) -> DataFrame:
    """Number of grain keys that occur more than once."""
    g = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return g.agg(F.count(F.lit(1)).cast("bigint").alias("violations"),
                 F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows_in_violation")) \
        .select(F.lit(table).alias("table"), F.lit(",".join(grain)).alias("grain"), "violations",
                "rows_in_violation")
