"""Incident memory: upsert store and exact similar-incident search.

Scale notes
- Upsert (M1) is one aggregation keyed by incident_id over store + batch rows:
  map-side partial aggregation merges a hot id before the shuffle, and there
  is no join to skew.
- Search (M2) is exact. Queries and stored vectors are cut into blocks of
  ``BLOCK_VALUES`` numbers on average per class; each (query block, store block)
  pair is one ``cogroup`` group that scores slices of the queries with numpy and
  keeps k rows per query. No pair rows are materialised, and no task holds more
  than two blocks and one slice's similarities, however large a class is. A final top-k per query (planned with a
  partial window group limit) merges the per-block winners.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions.text import empty_to_null
from faultline.functions.vectors import norm, normalize
from faultline.plans import rules
from faultline.session import written

# The ten columns an upsert overwrites; all others keep their first value.
UPSERT_COLUMNS = ["dbt_model", "target_table", "target_column", "failure_class", "issue_summary",
                  "root_cause", "confidence", "fix_summary", "prevention_summary", "evidence_json"]

INCIDENT_SCHEMA = T.StructType([
    T.StructField("incident_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("pipeline_name", T.StringType()),
    T.StructField("dag_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("dbt_model", T.StringType()),
    T.StructField("target_table", T.StringType()),
    T.StructField("target_column", T.StringType()),
    T.StructField("failure_class", T.StringType()),
    T.StructField("issue_summary", T.StringType()),
    T.StructField("root_cause", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("fix_summary", T.StringType()),
    T.StructField("prevention_summary", T.StringType()),
    T.StructField("evidence_json", T.StringType()),
    T.StructField("validated", T.BooleanType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


# --- ingest normalisation (P9) ---------------------------------------------------------


def normalize_incidents(raw: DataFrame) -> DataFrame:
    """Alternative keys and defaults, as the store's insert applies them.
    Absent keys arrive as null columns; a present value wins over its
    alternative."""
    def col(c):
        return F.col(c) if c in raw.columns else F.lit(None)

    evidence = F.coalesce(col("evidence_json").cast("string"), F.to_json(F.struct(
        F.coalesce(col("evidence_summary").cast("string"), F.lit("")).alias("evidence_summary"),
        F.coalesce(col("tags").cast("array<string>"), F.array().cast("array<string>")).alias("tags"))))
    return raw.select(
        col("incident_id").cast("string").alias("incident_id"),
        F.coalesce(col("created_at").cast("timestamp_ntz"), F.localtimestamp()).alias("created_at"),
        F.coalesce(col("severity").cast("string"), F.lit("error")).alias("severity"),
        F.coalesce(col("status").cast("string"), F.lit("resolved")).alias("status"),
        F.coalesce(col("source").cast("string"), F.lit("seed")).alias("source"),
        *[col(c).cast("string").alias(c) for c in ("pipeline_name", "dag_id", "task_id", "run_id",
                                                   "dbt_model", "target_table", "target_column", "failure_class")],
        F.coalesce(col("summary"), col("issue_summary")).cast("string").alias("issue_summary"),
        col("root_cause").cast("string").alias("root_cause"),
        F.coalesce(col("confidence").cast("double"), F.lit(1.0)).alias("confidence"),
        F.coalesce(col("fix_applied"), col("fix_summary")).cast("string").alias("fix_summary"),
        F.coalesce(col("prevention_added"), col("prevention_summary")).cast("string").alias("prevention_summary"),
        evidence.alias("evidence_json"),
        F.coalesce(col("validated").cast("boolean"), F.lit(True)).alias("validated"),
        col("embedding").cast("array<float>").alias("embedding"))


# --- upsert (M1) and updates (M5, M6) --------------------------------------------------


def upsert(store: DataFrame, batch: DataFrame, order_cols: list[str] | None = None) -> DataFrame:
    """M1: insert new ids; on conflict overwrite exactly the ten upsert columns
    (a null in the new row does overwrite) and keep everything else.

    Within a batch, rows apply in ``order_cols`` order: the first row of an id
    sets the kept columns, the last sets the ten. Store rows come before all
    batch rows. One grouped aggregation, no join.
    """
    order_cols = order_cols or []
    cols = [f.name for f in INCIDENT_SCHEMA.fields]
    keep = [c for c in cols if c not in UPSERT_COLUMNS and c != "incident_id"]
    # Store rows: tier 0, no order values; batch rows: tier 1 then order_cols.
    s_ord = F.struct(F.lit(0).alias("tier"),
                     *[F.lit(None).cast(batch.schema[c].dataType).alias(f"o{i}") for i, c in enumerate(order_cols)])
    b_ord = F.struct(F.lit(1).alias("tier"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_cols)])
    u = store.select(*cols, s_ord.alias("_ord")).unionByName(batch.select(*cols, b_ord.alias("_ord")))
    agg = u.groupBy("incident_id").agg(
        F.min_by(F.struct(*keep), "_ord").alias("_k"),
        F.max_by(F.struct(*UPSERT_COLUMNS), "_ord").alias("_u"))
    return agg.select("incident_id", *[F.col(f"_k.{c}").alias(c) for c in keep],
                      *[F.col(f"_u.{c}").alias(c) for c in UPSERT_COLUMNS]).select(*cols)


def set_embeddings(store: DataFrame, vectors: DataFrame) -> DataFrame:
    """M5: replace the embedding of the given ids (vectors: incident_id, embedding)."""
    v = vectors.select("incident_id", F.col("embedding").cast("array<float>").alias("_new"), F.lit(True).alias("_hit"))
    return store.join(v, "incident_id", "left") \
        .withColumn("embedding", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("embedding"))) \
        .drop("_new", "_hit")


def mark_validated(store: DataFrame, ids: DataFrame, validated: bool = True) -> DataFrame:
    """M6: set ``validated`` for the listed ids."""
    i = ids.select("incident_id").distinct().withColumn("_hit", F.lit(True))
    return store.join(i, "incident_id", "left") \
        .withColumn("validated", F.when(F.col("_hit"), F.lit(validated)).otherwise(F.col("validated"))).drop("_hit")


def get_incident(store: DataFrame, incident_id: str) -> DataFrame:
    """Point lookup (a pushed-down equality filter on Parquet)."""
    return store.where(F.col("incident_id") == incident_id)


def clean_incidents(store: DataFrame, remove_all: bool = False) -> DataFrame:
    """Keep only ``SEED-`` incidents, or none."""
    return store.limit(0) if remove_all else store.where(F.col("incident_id").startswith("SEED-"))


def recent_incidents(store: DataFrame, n: int = rules.RECENT_LIMIT) -> DataFrame:
    """P10/O1: newest n incidents (ties by id), summary cut to 200 characters.
    The limit is the feature; it plans as TakeOrderedAndProject."""
    return store.orderBy(F.desc("created_at"), F.asc("incident_id")).limit(n).select(
        "incident_id", "created_at", "pipeline_name", "failure_class", "severity",
        F.substring("issue_summary", 1, rules.SUMMARY_CUT).alias("summary"), "confidence", "validated")


# --- texts (M3, M4) ---------------------------------------------------------------------


def embedding_text(summary, root_cause):
    """M3: ``summary\\n\\nRoot cause: cause``."""
    return F.concat(F.coalesce(summary, F.lit("")), F.lit("\n\nRoot cause: "), F.coalesce(root_cause, F.lit("")))


def search_text(question, message, error_type, model, columns, tables, failure_class):
    """M4: question, message, type unless unknown, ``model: m``, columns,
    tables; when all are empty, ``<class> failure in pipeline``."""
    e = F.array().cast("array<string>")
    parts = F.concat(
        F.array(F.when(F.coalesce(question, F.lit("")) != "", question)),
        F.array(F.when(F.coalesce(message, F.lit("")) != "", message)),
        F.array(F.when((F.coalesce(error_type, F.lit("")) != "") & (error_type != "unknown"), error_type)),
        F.array(F.when(F.coalesce(model, F.lit("")) != "", F.concat(F.lit("model: "), model))),
        F.coalesce(columns, e), F.coalesce(tables, e))
    parts = F.array_compact(parts)
    fallback = F.concat(F.coalesce(failure_class, F.lit("unknown")), F.lit(" failure in pipeline"))
    return F.when(F.size(parts) > 0, F.array_join(parts, " ")).otherwise(fallback)


# --- vector search (M2, M7) ---------------------------------------------------------------


def normalize_vectors(df: DataFrame, col: str = "embedding", out: str = "unit") -> DataFrame:
    """M7: unit vectors, prepared once per store; null/zero vectors drop out."""
    return df.withColumn(out, normalize(F.col(col))).where(F.col(out).isNotNull())


def _sizes(df: DataFrame, name: str, *more: Column) -> DataFrame:
    return df.groupBy("_part").agg(F.count(F.lit(1)).alias(name), *more)


def winners_schema(queries: DataFrame, store: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType),
                         T.StructField("incident_id", store.schema["incident_id"].dataType), T.StructField("similarity", T.DoubleType())])


#: Numbers a block of vectors may hold, and similarities computed at a time.
BLOCK_VALUES = 1 << 21


def block_rows_of(dims: Column) -> Column:
    """Rows of a block of vectors of that many dimensions."""
    return F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.lit(1), dims)))


def unit_rows(df: pd.DataFrame) -> np.ndarray:
    """The unit vectors of a block: its column ``unit``, or ``vector`` divided by ``norm``."""
    if "unit" in df.columns:
        return np.vstack(df["unit"].to_numpy()).astype("float64")
    return np.vstack(df["vector"].to_numpy()).astype("float64") / df["norm"].to_numpy(dtype="float64")[:, None]


def best_of(sim: np.ndarray, q: np.ndarray, s: np.ndarray, rank: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, similarities) of each row's k best, ties to the least ``rank`` of the column.

    ``sim`` holds the products in single precision, -inf where a pair takes no part. All pairs
    that its error leaves within reach of the k-th value are computed again in double.
    """
    n, dims = sim.shape[1], q.shape[1]
    kk = min(k, n)
    least, width = sim, 32
    if n >= 2 * width * kk:
        # columns are grouped: the k-th largest of the groups' maxima is no more than the k-th value
        m = n // width
        least = sim[:, :m * width].reshape(len(sim), width, m).max(axis=1)
    least = np.partition(least, least.shape[1] - kk, axis=1)[:, least.shape[1] - kk]
    near = least - np.float32(2 * (dims + 4) * 2.0 ** -23 + 1e-7)
    rows, cols = np.nonzero((sim >= near[:, None]) & (sim > -np.inf))
    vals = np.empty(len(rows))
    step = max(1, BLOCK_VALUES // max(1, dims))
    for i in range(0, len(rows), step):
        at = slice(i, i + step)
        vals[at] = np.einsum("ij,ij->i", q[rows[at]], s[cols[at]])
    vals = np.round(vals, 12)
    order = np.lexsort((rank[cols], -vals, rows))
    rows, cols, vals = rows[order], cols[order], vals[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < kk
    return rows[keep], cols[keep], vals[keep]


def id_places(ids: list) -> dict:
    """The places of each id."""
    places: dict = {}
    for i, x in enumerate(ids):
        places.setdefault(x, []).append(i)
    return places


def winners(qids: np.ndarray, sids: np.ndarray, found: list) -> pd.DataFrame:
    rows, cols, vals = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"query_id": qids[rows], "incident_id": sids[cols], "similarity": vals})


def block_scorer(k: int, exclude_self: bool):
    """A function over a block of queries and one of stored vectors: each query's k best there, ties to the smallest id.

    Similarities are computed for a slice of the queries at a time, ``BLOCK_VALUES`` of them at most.
    """
    def score(qdf: pd.DataFrame, sdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or sdf.empty:
            return pd.DataFrame({"query_id": [], "incident_id": [], "similarity": np.empty(0)})
        sdf = sdf.sort_values("_id", kind="stable")  # of equal similarities the smallest id comes first
        q, s = unit_rows(qdf), unit_rows(sdf)
        qids, sids = qdf["_id"].to_numpy(), sdf["_id"].to_numpy()
        places = id_places(sids.tolist()) if exclude_self else {}
        q32, s32, rank = q.astype("float32"), s.astype("float32"), np.arange(len(s))
        whole = bool(np.isfinite(q).all() and np.isfinite(s).all())
        found, step = [], max(1, BLOCK_VALUES // len(s))
        for i in range(0, len(q), step):
            sim = q32[i:i + step] @ s32.T
            if not whole:
                sim[~np.isfinite(sim)] = -np.inf
            for row, x in enumerate(qids[i:i + step].tolist()):
                if x in places:
                    sim[row, places[x]] = -np.inf
            rows, cols, vals = best_of(sim, q[i:i + step], s, rank, k)
            found.append((rows + i, cols, vals))
        return winners(qids, sids, found)
    return score


def dealt(df: DataFrame, keys: list[str], groups: int) -> DataFrame:
    """Deals the rows of many groups to as many tasks (4,096 at most); few groups go as the session's shuffles do."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(groups, 4096), *keys) if groups > least else df


def best_with_details(cand: DataFrame, store: DataFrame, k: int) -> DataFrame:
    """Each query's k best of the blocks' winners, with what the store says about them."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("incident_id"))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    named = {"issue_summary": "summary", "root_cause": "root_cause", "fix_summary": "fix_applied", "confidence": "confidence"}
    more = [F.col(c).alias(n) for c, n in named.items() if c in store.columns]
    about = store.where(F.col("embedding").isNotNull()).select("incident_id", "failure_class", *more)
    return top.join(about, "incident_id").select("query_id", "rank", "incident_id", "failure_class", F.round("similarity", 4).alias("similarity_score"),
                                                 *[n for c, n in named.items() if c in store.columns])


def search_similar(queries: DataFrame, store: DataFrame, k: int = rules.SIMILAR_TOP_K,
                   by_class: bool = True, exclude_self: bool = True, block_rows: int | None = None) -> DataFrame:
    """M2: exact cosine top-k per query among stored vectors, optionally only
    within the query's class (``unknown`` is a real class; a null or empty
    class disables the filter for that query). Ties go to the smallest id.
    Similarity = 1 - cosine distance, rounded to 4.

    queries: query_id, failure_class, embedding
    store:   incident_id, failure_class, embedding, and where it has them
             issue_summary, root_cause, fix_summary, confidence
    returns: query_id, rank, incident_id, failure_class, similarity_score, and
             of the latter columns those the store has (summary, root_cause,
             fix_applied, confidence), joined to the winners only

    Ids may be of any type. Rows are spread over blocks of ``block_rows`` on
    average (without it ``BLOCK_VALUES`` numbers) by a hash of their id; exact
    search costs queries x stored vectors of a class, and both sides are copied
    to the other's blocks, as they came and with their norm.
    """
    own_norm = norm(F.col("embedding"))
    some = F.col("norm").isNull() | (F.col("norm") != 0)  # null and zero vectors take no part
    q = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").alias("_id"), empty_to_null(F.col("failure_class")).alias("failure_class"), F.col("embedding").alias("vector"), own_norm.alias("norm")).where(some)
    s = store.where(F.col("embedding").isNotNull()).select(F.col("incident_id").alias("_id"), "failure_class", F.col("embedding").alias("vector"), own_norm.alias("norm")).where(some)
    every = F.lit("\u0000all")
    own = F.coalesce(F.col("failure_class"), every) if by_class else every
    q = q.withColumn("_part", own)
    # stored rows are in the partition of their class and in that of all; the
    # join with the queries' partitions keeps those that are asked for
    s = s.withColumn("_part", F.explode(F.array_distinct(F.array(own, every))))
    sizes = _sizes(q, "_nq").join(_sizes(s, "_ns", F.max(F.size("vector")).alias("_dims")), "_part")
    size = F.lit(block_rows) if block_rows else block_rows_of(F.col("_dims"))
    blocks = written(sizes.select("_part", *[F.greatest(F.lit(1), F.ceil(F.col(n) / size)).cast("int").alias(b) for n, b in (("_nq", "_bq"), ("_ns", "_bs"))]), "search-blocks")
    pairs = blocks.agg(F.sum(F.col("_bq").cast("bigint") * F.col("_bs"))).first()[0] or 0

    def block(n):
        return F.pmod(F.xxhash64(F.col("_id")), F.col(n)).cast("int")

    def others(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    key = ["_part", "_qb", "_sb"]
    qx = q.join(blocks, "_part").select("_part", block("_bq").alias("_qb"), others("_bs").alias("_sb"), "_id", "vector", "norm")
    sx = s.join(blocks, "_part").select("_part", block("_bs").alias("_sb"), others("_bq").alias("_qb"), "_id", "vector", "norm")
    score, out_schema = block_scorer(k, exclude_self), winners_schema(queries, store)
    cand = dealt(qx, key, pairs).groupBy(*key).cogroup(dealt(sx, key, pairs).groupBy(*key)) \
        .applyInPandas(score, out_schema)
    return best_with_details(cand, store, k)
