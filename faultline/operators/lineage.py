"""Lineage over model artifacts.

Nodes come from ``sources.files.read_nodes``; edges are the exploded
``depends_on`` lists. Every operator is a join or aggregation over the edge
table, for all models at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARROW = " → "


def edges(nodes: DataFrame) -> DataFrame:
    """(parent, child, parent_kind) with child = model unique_id."""
    e = nodes.select(F.col("unique_id").alias("child"), F.posexplode("depends_on").alias("position", "parent"))
    return e.withColumn("parent_kind", F.substring_index("parent", ".", 1))


def _in_order(value):
    """The values of a group in declaration order, whatever order a shuffle leaves."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.col("position"), value.alias("value")))), lambda x: x["value"])


def _short(c):
    return F.element_at(F.split(c, "[.]"), -1)


def upstream_models(e: DataFrame) -> DataFrame:
    """Model parents of each model, by name, in declaration order."""
    m = e.where(F.col("parent").startswith("model."))
    return m.groupBy("child").agg(_in_order(_short(F.col("parent"))).alias("upstream_models"))


def upstream_sources(e: DataFrame, sources: DataFrame) -> DataFrame:
    """Source parents joined to their source entries."""
    s = e.where(F.col("parent").startswith("source.")).join(
        sources.withColumnRenamed("unique_id", "parent"), "parent", "inner")
    return s.groupBy("child").agg(_in_order(F.struct("source_name", "table_name", "schema")).alias("upstream_sources"))


def upstream(e: DataFrame, sources: DataFrame) -> DataFrame:
    """J3 and J4 in one pass over the edges: a child's model parents and its source entries, in declaration order."""
    entry = F.struct("source_name", "table_name", F.col("s_schema").alias("schema"))
    s = sources.select(F.col("unique_id").alias("parent"), "source_name", "table_name", F.col("schema").alias("s_schema"), F.lit(True).alias("listed"))
    j = e.join(s, "parent", "left")

    def values(when, value):
        own = F.sort_array(F.collect_list(F.when(when, F.struct("position", value.alias("value")))))
        return F.transform(own, lambda x: x["value"])

    return j.groupBy("child").agg(values(F.col("parent").startswith("model."), _short(F.col("parent"))).alias("upstream_models"),
                                  values(F.col("parent").startswith("source.") & F.col("listed"), entry).alias("upstream_sources"))


def downstream_models(e: DataFrame) -> DataFrame:
    """Model children of each node (the reversed edges)."""
    d = e.select(F.col("parent").alias("unique_id"), F.col("child"))
    return d.where(F.col("child").startswith("model.")).groupBy("unique_id") \
        .agg(F.sort_array(F.collect_list(_short(F.col("child")))).alias("downstream_models"))


def lineage(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """G1: one lineage record per model."""
    e = edges(nodes)
    base = nodes.select("unique_id", F.col("name").alias("model"), "schema", "description")
    out = base.join(upstream(e, sources).withColumnRenamed("child", "unique_id"), "unique_id", "left") \
        .join(downstream_models(e), "unique_id", "left")
    empty_s = F.array().cast("array<string>")
    return out.select("unique_id", "model", "schema", "description",
                      F.coalesce("upstream_models", empty_s).alias("upstream_models"),
                      F.coalesce("upstream_sources", F.array().cast(
                          "array<struct<source_name:string,table_name:string,schema:string>>")).alias("upstream_sources"),
                      F.coalesce("downstream_models", empty_s).alias("downstream_models"))


def dependency_chain(lin: DataFrame) -> DataFrame:
    """``sources → upstream models → model → downstream`` with `` + ``
    inside a step; empty steps are left out."""
    src = F.array_join(F.transform("upstream_sources", lambda s: F.concat(
        F.coalesce(s["schema"], F.lit("bronze")), F.lit("."), F.coalesce(s["table_name"], F.lit("?")))), " + ")
    parts = F.array(F.when(F.size("upstream_sources") > 0, src),
                    F.when(F.size("upstream_models") > 0, F.array_join("upstream_models", " + ")),
                    F.col("model"),
                    F.when(F.size("downstream_models") > 0, F.array_join("downstream_models", " + ")))
    return lin.withColumn("dependency_chain", F.array_join(F.array_compact(parts), ARROW))


def upstream_details(nodes: DataFrame) -> DataFrame:
    """For each model, its upstream models with schema, description and
    their own source tables."""
    e = edges(nodes)
    own_src = e.where(F.col("parent").startswith("source.")).groupBy("child") \
        .agg(_in_order(_short(F.col("parent"))).alias("depends_on_sources"))
    det = nodes.select(F.col("unique_id").alias("parent"), F.col("name").alias("up_model"),
                       F.col("schema").alias("up_schema"), F.col("description").alias("up_description")) \
        .join(own_src.withColumnRenamed("child", "parent"), "parent", "left")
    j = e.where(F.col("parent").startswith("model.")).join(det, "parent", "inner")
    return j.groupBy(F.col("child").alias("unique_id")).agg(_in_order(F.struct(
        F.col("up_model").alias("model"), F.col("up_schema").alias("schema"),
        F.col("up_description").alias("description"),
        F.coalesce("depends_on_sources", F.array().cast("array<string>")).alias("depends_on_sources")))
        .alias("upstream_details"))


def metadata_targets(lin: DataFrame, nodes: DataFrame) -> DataFrame:
    """Tables to inspect for a model: its sources and its upstream models
    (with their schema)."""
    s = lin.select("model", F.explode("upstream_sources").alias("s")).select(
        "model", F.col("s.schema").alias("schema"), F.col("s.table_name").alias("table"))
    m = lin.select("model", F.explode("upstream_models").alias("up")).join(
        nodes.select(F.col("name").alias("up"), F.col("schema")), "up", "inner") \
        .select("model", "schema", F.col("up").alias("table"))
    return s.unionByName(m).distinct()
