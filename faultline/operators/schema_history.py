"""Schema snapshots as tables (Q1, Q6, Q7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT_SCHEMA = ("dataset string, column_name string, ordinal int, data_type string, nullable boolean, "
                   "captured_at timestamp")


def snapshot(spark: SparkSession, datasets: dict[str, DataFrame], captured_at=None) -> DataFrame:
    """Q1: one row per (dataset, column) from the DataFrames' schemas (driver
    metadata only, no data is read)."""
    rows = []
    for name, df in datasets.items():
        for i, f in enumerate(df.schema.fields):
            rows.append((name, f.name, i, f.dataType.simpleString(), f.nullable))
    out = spark.createDataFrame(rows, "dataset string, column_name string, ordinal int, data_type string, "
                                      "nullable boolean")
    ts = F.lit(captured_at).cast("timestamp") if captured_at is not None else F.current_timestamp()
    return out.withColumn("captured_at", ts)


def append_snapshot(snap: DataFrame, path: str) -> None:
    """Q1: add captures to the history, partitioned by capture time: a repeated capture replaces itself."""
    snap.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("captured_at").parquet(path)


def latest(history: DataFrame) -> DataFrame:
    """Latest capture per dataset: max capture time per dataset (a partial
    aggregation) joined back to the history."""
    last = history.groupBy("dataset").agg(F.max("captured_at").alias("captured_at"))
    return history.join(last, ["dataset", "captured_at"], "inner")


def diff_snapshots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Q7: added / removed / retyped columns between two captures."""
    o = old.select("dataset", "column_name", F.col("data_type").alias("old_type"))
    n = new.select("dataset", "column_name", F.col("data_type").alias("new_type"))
    j = o.join(n, ["dataset", "column_name"], "full")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed") \
        .when(F.col("old_type") != F.col("new_type"), "retyped")
    return j.withColumn("change", change).where(F.col("change").isNotNull())


def column_presence(snap: DataFrame, dataset: str, expected: list[str] | None = None) -> DataFrame:
    """Q6: name and type of each column of a dataset, and missing expected ones."""
    cur = snap.where(F.col("dataset") == dataset).select("column_name", "data_type", F.lit(True).alias("present"))
    if not expected:
        return cur
    exp = snap.sparkSession.createDataFrame([(c,) for c in expected], "column_name string")
    missing = exp.join(cur, "column_name", "left_anti").select(
        "column_name", F.lit(None).cast("string").alias("data_type"), F.lit(False).alias("present"))
    return cur.unionByName(missing)



# --- a whole history ------------------------------------------------------------------


def validity(history: DataFrame) -> DataFrame:
    """One row for each time a column was there with one type, instead of one for each capture.

    history: dataset, column_name, data_type, captured_at. Returns dataset,
    column_name, data_type, valid_from (first capture that has it so), valid_to (the
    dataset's first capture that hasn't, null while it stands) and captures. Rows of
    a column are compared with its own last capture; windows hold one column's, or
    one dataset's, captures.
    """
    times = history.select("dataset", "captured_at").distinct()
    by_time = Window.partitionBy("dataset").orderBy("captured_at")
    times = times.select("dataset", "captured_at", F.row_number().over(by_time).alias("k"), F.lead("captured_at").over(by_time).alias("next_at"))
    rows = history.select("dataset", "column_name", "data_type", "captured_at").distinct().join(times, ["dataset", "captured_at"])
    own = Window.partitionBy("dataset", "column_name").orderBy("k")
    new = F.coalesce((F.lag("k").over(own) != F.col("k") - 1) | ~F.lag("data_type").over(own).eqNullSafe(F.col("data_type")), F.lit(True))
    rows = rows.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(own))
    return rows.groupBy("dataset", "column_name", "run").agg(F.first("data_type").alias("data_type"), F.min("captured_at").alias("valid_from"), F.max(F.struct("k", "next_at")).alias("last"),
                                                             F.count(F.lit(1)).alias("captures")) \
        .select("dataset", "column_name", "data_type", "valid_from", F.col("last.next_at").alias("valid_to"), "captures")


def as_of(intervals: DataFrame, moments: DataFrame) -> DataFrame:
    """The columns of each dataset at each moment (dataset, at), from its intervals."""
    m = moments.select(F.col("dataset").alias("_dataset"), "at").distinct()
    inside = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    return intervals.join(m, (F.col("dataset") == F.col("_dataset")) & inside).select("dataset", "at", "column_name", "data_type")


def changes(history: DataFrame) -> DataFrame:
    """Every change of the history: (dataset, column_name, at, change, old_type, new_type).

    A column is added where an interval begins without another that ends there,
    removed where one ends without another that begins there, else retyped; the
    columns of a dataset's first capture are no change.
    """
    v = validity(history)
    first = history.groupBy("dataset").agg(F.min("captured_at").alias("first_at"))
    ends = v.where("valid_to is not null").select("dataset", "column_name", F.col("valid_to").alias("at"), F.col("data_type").alias("old_type"))
    begins = v.select("dataset", "column_name", F.col("valid_from").alias("at"), F.col("data_type").alias("new_type"))
    both = ends.join(begins, ["dataset", "column_name", "at"], "full").join(first, "dataset").where("at > first_at")
    kind = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("retyped")
    return both.select("dataset", "column_name", "at", kind.alias("change"), "old_type", "new_type")
