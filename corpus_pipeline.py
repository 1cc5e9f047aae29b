"""A corpus pipeline of five stages over the documents table.

Each stage reads what its predecessor kept and returns the documents' columns
(the last adds its copies' number); ``run`` writes every stage's rows as
Parquet into the cluster's shared folder and reads them back for the next.
Texts that a stage has no reason to change pass through unchanged.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import decontaminate, jaccard_join, mixing, substring_dedup, toxicity
from faultline.llm.storage import table, written
from faultline.session import apply_session_conf


#: Columns added beside a document's own while a stage works.
ROW, SCORE = "__row", "__toxicity"


def _stage(function):
    """The stage under the library's session defaults."""
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        apply_session_conf(spark)
        return function(spark, docs, sf_dir)
    return run_stage


@_stage
def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose deobfuscated text scores below 0.5."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, docs.columns, SCORE).where(F.col(SCORE) < 0.5).drop(SCORE)


@_stage
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: that of least id (a null id is last), of several texts with that id the one of least hash, of equal rows any one.

    Rows are told apart by a hash of id and text, so a row stays though another
    with its id goes. Documents without words are all kept.
    """
    named = docs.withColumn(ROW, F.xxhash64("doc_id", "text"))
    groups = jaccard_join.near_duplicates(named.select(F.col(ROW).alias("doc_id"), "text")).where("n_shingles > 0")
    groups = groups.groupBy(F.col("doc_id").alias(ROW)).agg(F.first("component_id").alias("group"), F.count(F.lit(1)).alias("equal"))
    members = written(named.select(ROW, "doc_id").distinct().join(groups, ROW), "near-members")
    least = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(ROW).alias("row"))).alias("least"))
    # only rows with something to decide: others of their group, and those that occur more than once
    decided = written(members.join(least, "group").select(F.col(ROW).alias("_decided"), (F.col(ROW) == F.col("least.row")).alias("_stays"), "equal")
                      .where("not _stays or equal > 1").select("_decided", "_stays"), "near-decided")
    judged = named.join(decided, F.col(ROW) == F.col("_decided"), "left")
    alone, repeated = judged.where("_decided is null"), judged.where("_stays").dropDuplicates([ROW])
    return alone.select(*docs.columns).union(repeated.select(*docs.columns))


@_stage
def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; one that has no word left goes, one without repeats keeps its text."""
    out = substring_dedup.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.where("n_removed = 0 or n_removed < n_words").withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    out = decontaminate.judge(docs, table(spark, sf_dir, "benchmark"))
    return out.where("not contaminated").select(*docs.columns)


@_stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy of a document."""
    return mixing.mix(docs)


STAGES = [("toxicity", without_toxic), ("near copies", one_of_near_copies), ("repeated passages", without_repeated_passages),
          ("benchmark", without_benchmark), ("mixing", mixed)]

#: The first stage is a fitted model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
