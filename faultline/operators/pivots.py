"""Exact similar-incident search that leaves out cells by pivot distances (M2, O3).

Stored vectors belong to the cell of their nearest pivot; a cell's radius is
the largest angle between a member and its pivot. A query searches the cell of
its own nearest pivot first. The k-th similarity found there bounds all others:
by the triangle inequality of angles no member of a cell is nearer to the query
than its angle to the pivot less the radius, so cells that cannot reach the
k-th value are never sent to the query.

Pivots are the unit vectors of least id hash, ``pivots`` of them at most, so what
is broadcast has a fixed size. The cells of a class follow each other and are cut
into bins as large as a block of the plain search, so that small cells share
one: a query goes once to each bin that holds a cell in its reach and meets
only those cells there. No task holds more than a bin and a block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.text import empty_to_null
from faultline.operators.memory import BLOCK_VALUES, best_of, best_with_details, block_scorer, dealt, id_places, normalize_vectors, unit_rows, winners, winners_schema
from faultline.plans import rules
from faultline.session import written

#: What rounding may add to an angle.
SLACK = 1e-6


def _angles(units, matrix: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.vstack(units) @ matrix.T, -1, 1))


def _with_cell(df: DataFrame, pivots) -> DataFrame:
    """Adds the nearest pivot's number and the angle to it."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                apart = _angles(batch["unit"], pivots.value)
                cell = apart.argmin(axis=1)
                yield batch.assign(cell=cell.astype("int32"), angle=apart[np.arange(len(cell)), cell])
    return df.mapInPandas(assign, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, cell int, angle double")


def _wanted(asked: DataFrame, pivots, bins: bool = False) -> DataFrame:
    """(_part, _id, unit, cell) for each cell besides the query's own that may hold one of its k best; with ``bins``
    a row for each bin that holds such a cell, with the columns ``bin``, ``cell`` (the query's own) and ``least``."""
    kept = ["_part", "_id", "unit", "cell", "least"] if bins else ["_part", "_id", "unit"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.select(*kept).schema)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            apart = _angles(batch["unit"], pivots.value)
            far = np.arccos(np.clip(batch["least"].to_numpy(), -1, 1)) + SLACK
            cells = [[c for c in others if c["cell"] != own and a[c["cell"]] - c["radius"] <= f]
                     for others, own, a, f in zip(batch["cells"], batch["cell"], apart, far)]
            wanted = [sorted({b for c in x for b in range(c["first"], c["last"] + 1)}) for x in cells] if bins else [[c["cell"] for c in x] for x in cells]
            yield batch[kept].assign(wanted=wanted)
    return asked.mapInPandas(bound, f"{schema}, wanted array<int>").select(*kept, F.explode("wanted").alias("bin" if bins else "cell"))


def bin_scorer(k: int, exclude_self: bool, pivots):
    """A function over a block of queries and one bin of whole or cut cells: each query's k best in the cells
    that may hold one, ties to the smallest id. Its own cell takes no part."""
    def score(qdf: pd.DataFrame, sdf: pd.DataFrame) -> pd.DataFrame:
        if qdf.empty or sdf.empty:
            return pd.DataFrame({"query_id": [], "incident_id": [], "similarity": np.empty(0)})
        sdf = sdf.sort_values("_id", kind="stable")
        sdf = sdf.assign(_rank=np.arange(len(sdf))).sort_values("cell", kind="stable")
        q, s = unit_rows(qdf), unit_rows(sdf)
        qids, sids, rank = qdf["_id"].to_numpy(), sdf["_id"].to_numpy(), sdf["_rank"].to_numpy()
        cells, start = np.unique(sdf["cell"].to_numpy(), return_index=True)
        radius, end = np.maximum.reduceat(sdf["angle"].to_numpy(), start), np.append(start[1:], len(s))
        far = np.arccos(np.clip(qdf["least"].to_numpy(), -1, 1)) + SLACK
        wanted = (_angles(q, pivots.value[cells]) - radius <= far[:, None]) & (qdf["cell"].to_numpy()[:, None] != cells)
        places = id_places(sids.tolist()) if exclude_self else {}
        q32, s32 = q.astype("float32"), s.astype("float32")
        whole = bool(np.isfinite(q).all() and np.isfinite(s).all())
        found, step = [], max(1, BLOCK_VALUES // len(s))
        for i in range(0, len(q), step):
            block = q32[i:i + step]
            sim = np.full((len(block), len(s)), -np.inf, dtype="float32")
            for c, (a, b) in enumerate(zip(start, end)):
                some = np.flatnonzero(wanted[i:i + step, c])
                if len(some):
                    sim[some, a:b] = block[some] @ s32[a:b].T
            if not whole:
                sim[~np.isfinite(sim)] = -np.inf
            for row, x in enumerate(qids[i:i + step].tolist()):
                if x in places:
                    sim[row, places[x]] = -np.inf
            rows, cols, vals = best_of(sim, q[i:i + step], s, rank, k)
            found.append((rows + i, cols, vals))
        return winners(qids, sids, found)
    return score


def search_by_pivots(queries: DataFrame, store: DataFrame, k: int = rules.SIMILAR_TOP_K, by_class: bool = True, exclude_self: bool = True,
                     block_rows: int | None = None, pivots: int = 256) -> DataFrame:
    """The rows of ``memory.search_similar``, ties included; arguments and result are the same.

    ``pivots`` bounds the number of cells of a class. Null and zero vectors
    take no part; a class without stored vectors gives no rows; ids must be
    unique within queries and within the store.
    """
    q = normalize_vectors(queries).select(F.col("query_id").alias("_id"), empty_to_null(F.col("failure_class")).alias("failure_class"), "unit")
    s = normalize_vectors(store).select(F.col("incident_id").alias("_id"), "failure_class", "unit")
    chosen = s.orderBy(F.xxhash64("_id"), "_id").limit(pivots).select("unit").collect()  # at most ``pivots`` rows
    if not chosen:
        return best_with_details(store.sparkSession.createDataFrame([], winners_schema(queries, store)), store, k)
    spread = store.sparkSession.sparkContext.broadcast(np.array([r.unit for r in chosen]))
    size = block_rows or max(1, BLOCK_VALUES // max(1, len(chosen[0].unit)))
    every = F.lit("\u0000all")
    own = F.coalesce(F.col("failure_class"), every) if by_class else every
    q = written(_with_cell(q.select(own.alias("_part"), "_id", "unit"), spread), "pivot-queries")
    s = written(_with_cell(s.select(F.explode(F.array_distinct(F.array(own, every))).alias("_part"), "_id", "unit")
                           .join(q.select("_part").distinct(), "_part", "left_semi"), spread), "pivot-store")
    # the cells of a class (``pivots`` at most) follow each other and are cut into bins of ``size`` rows: small cells share one
    cells = s.groupBy("_part", "cell").agg(F.count(F.lit(1)).alias("_ns"), F.max("angle").alias("radius"))
    before = Window.partitionBy("_part").orderBy("cell")
    cells = written(cells.withColumn("_before", F.sum("_ns").over(before) - F.col("_ns")), "pivot-cells")
    out_schema = winners_schema(queries, store)

    def blocks(n):
        return F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(size))).cast("int")

    def others(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def block(n):
        return F.pmod(F.xxhash64(F.col("_id")), F.col(n)).cast("int")

    def bin_of(place):
        return F.floor((F.col("_before") + place) / F.lit(size)).cast("int")

    def met(left: DataFrame, right: DataFrame, key: list[str], score, groups: int) -> DataFrame:
        return dealt(left, key, groups).groupBy(*key).cogroup(dealt(right, key, groups).groupBy(*key)).applyInPandas(score, out_schema)

    # first each query's own cell
    sizes = q.groupBy("_part", "cell").agg(F.count(F.lit(1)).alias("_nq")).join(cells, ["_part", "cell"])
    sizes = written(sizes.select("_part", "cell", blocks("_nq").alias("_bq"), blocks("_ns").alias("_bs")), "pivot-own-blocks")
    left = q.join(sizes, ["_part", "cell"]).select("_part", "cell", block("_bq").alias("_qb"), others("_bs").alias("_sb"), "_id", "unit")
    right = s.join(sizes, ["_part", "cell"]).select("_part", "cell", block("_bs").alias("_sb"), others("_bq").alias("_qb"), "_id", "unit")
    near = written(met(left, right, ["_part", "cell", "_qb", "_sb"], block_scorer(k, exclude_self), 0), "pivot-own")
    # a query that found fewer than k has no bound yet
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"))
    kth = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("similarity").alias("least"))
    # then the bins that hold a cell in reach
    bins = cells.select("_part", F.struct("cell", "radius", bin_of(F.lit(0)).alias("first"), bin_of(F.col("_ns") - 1).alias("last")).alias("c"))
    of_part = bins.groupBy("_part").agg(F.collect_list("c").alias("cells"))  # at most ``pivots`` a class
    parts = q.groupBy("_part").agg(F.count(F.lit(1)).alias("_nq"))
    parts = written(parts.join(cells.groupBy("_part").agg(F.sum("_ns").alias("_ns")), "_part").select("_part", blocks("_nq").alias("_bq"), blocks("_ns").alias("_bs")), "pivot-bins")
    groups = parts.agg(F.sum(F.col("_bq").cast("bigint") * F.col("_bs"))).first()[0] or 0
    asked = q.join(kth, "_id", "left").join(of_part, "_part").select("_part", "_id", "unit", "cell", F.coalesce("least", F.lit(-1.0)).alias("least"), "cells")
    left = _wanted(asked, spread, bins=True).join(parts, "_part").select("_part", block("_bq").alias("_qb"), "bin", "_id", "unit", "cell", "least")
    right = s.join(cells, ["_part", "cell"]).join(parts, "_part").select("_part", others("_bq").alias("_qb"), bin_of(F.pmod(F.xxhash64("_id"), F.col("_ns"))).alias("bin"), "_id", "unit", "cell", "angle")
    far = met(left, right, ["_part", "_qb", "bin"], bin_scorer(k, exclude_self, spread), groups)
    return best_with_details(near.union(far), store, k)
