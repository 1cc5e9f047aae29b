"""Exact top-k inner products by a KD-tree in each shard.

Components are scaled to integers, floor(1024 * x), and scores are exact integer
products. Vectors are dealt into shards of some ``SHARD_ROWS`` rows by a hash
of their place in the input, so equal ids or equal vectors do not meet in one. A
shard's tree halves its rows at the median of the widest dimension until
``LEAF_ROWS`` are left, and every node has the tight box of its rows. The best
score that a query can have inside a box is

    sum over dimensions of max(q * low, q * high),

which orders the nodes of a best-first traversal; it ends where no open box can
reach the k-th score. That score travels: a block of queries first searches one
shard, and its k-th scores then are the limits with which all other shards begin.
A box that can equal the limit is still opened, so ties go to the smaller id.

Queries go to the shards in blocks, one row for each (block, shard); a tree is read
by as many tasks as there are blocks of queries. Shards are rows of a table in the
shared folder and of bounded size.

Defined cases: vectors that are null, or hold a null, a NaN or an infinity, take no
part; a shorter vector counts as padded with zeros (an empty one scores 0 with
all); a null id is no query and stands last among ties; rows with one id are rows of
their own, and a query's candidates are all rows but its own; fewer than k
candidates give fewer rows; no queries or no vectors give no rows. Products too
large for exact 64-bit floats are computed with whole numbers of any size and
cut to the range of a long. Other columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.packing import pack, unpack
from faultline.llm.storage import written

SHARD_ROWS = 4096
LEAF_ROWS = 128
BLOCK_SHARDS = 12
SCALE = 1024
EXACT = float(1 << 53)
LONG = (1 << 63) - 1

SHARD = "shard long, n int, wide int, ids binary, named binary, points binary, ends binary, low binary, high binary, asked binary"
SHARD_ARROW = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("wide", pa.int32()), *((c, pa.binary()) for c in ("ids", "named", "points", "ends", "low", "high", "asked"))])
FOUND = "block long, origin long, place int, query_id long, vec_id long, score long"
FOUND_ARROW = pa.schema([("block", pa.int64()), ("origin", pa.int64()), ("place", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


class Tree:
    """Rows in the order of the leaves; nodes with their row range, children and box, the root first."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(points))
        ends, low, high = [], [], []
        open_nodes = [(0, len(points))]
        for begin, end in open_nodes:  # grows while it is read: nodes in level order
            own = points[order[begin:end]]
            low.append(own.min(0) if len(own) else np.zeros(points.shape[1]))
            high.append(own.max(0) if len(own) else np.zeros(points.shape[1]))
            left = -1
            if end - begin > leaf_rows and points.shape[1]:
                middle = (end - begin) // 2
                wide = int(np.argmax(high[-1] - low[-1]))
                order[begin:end] = order[begin:end][np.argpartition(own[:, wide], middle)]
                left = len(open_nodes)
                open_nodes += [(begin, begin + middle), (begin + middle, end)]
            ends.append((begin, end, left))
        self.order, self.points = order, points[order]
        self.ends, self.low, self.high = np.array(ends, np.int64).reshape(-1, 3), np.array(low), np.array(high)


def narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    most = np.abs(values).max(initial=0)
    return values.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.float64)


def packed(values: np.ndarray) -> bytes:
    flat = narrow(values)
    return flat.dtype.char.encode() + pack(flat.ravel())


def unpacked(blob: bytes, wide: int) -> np.ndarray:
    return unpack(blob[1:], np.dtype(blob[:1].decode())).astype(np.float64).reshape(-1, wide)


def scaled(column: pa.Array) -> np.ndarray:
    """floor(1024 * x) of a list column, short rows padded with zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    flat = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _shard(queries_every: int):
    def build(table: pa.Table) -> pa.Table:
        """One shard's rows -> its tree, and the places of its queries."""
        table = table.combine_chunks()
        ids = table.column("vec_id").combine_chunks()
        tree = Tree(scaled(table.column("x").combine_chunks()))
        named = ids.is_valid().to_numpy(zero_copy_only=False)[tree.order]
        ids = ids.fill_null(0).to_numpy()[tree.order]
        asked = np.flatnonzero(named & (ids % queries_every == 0))
        row = [table.column("shard")[0].as_py(), len(ids), tree.points.shape[1], pack(ids), pack(named.astype(np.uint8)), packed(tree.points), pack(tree.ends.ravel()),
               packed(tree.low), packed(tree.high), pack(asked)]
        return pa.table([pa.array([v], f.type) for v, f in zip(row, SHARD_ARROW)], schema=SHARD_ARROW)
    return build


def shards(vectors: DataFrame, id_column: str, column: str, every: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index: a row for each shard with its tree."""
    whole = F.forall(F.col("x"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x")).where(F.col("x").isNotNull() & whole)
    n = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("long"))
    return written(rows.groupBy("shard").applyInArrow(_shard(every), SHARD), "kd-shards")


def _blocks(block_shards: int):
    def block(table: pa.Table) -> pa.Table:
        """The queries of some shards side by side: where each comes from, its id and vector."""
        origin, place, ids, parts = [], [], [], []
        for r in table.to_pylist():
            asked = unpack(r["asked"], np.int64)
            origin.append(np.full(len(asked), r["shard"]))
            place.append(asked)
            ids.append(unpack(r["ids"], np.int64)[asked])
            parts.append(unpacked(r["points"], r["wide"])[asked] if r["wide"] else np.zeros((len(asked), 0)))
        wide = max(p.shape[1] for p in parts)
        points = np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1]))) for p in parts])
        row = [table.column("shard")[0].as_py() // block_shards, len(points), wide, pack(np.concatenate(origin)), pack(np.concatenate(place)), pack(np.concatenate(ids)), packed(points)]
        return pa.table([pa.array([v], f.type) for v, f in zip(row, BLOCK_ARROW)], schema=BLOCK_ARROW)
    return block


BLOCK = "block long, queries int, q_wide int, origin binary, place binary, query_ids binary, q_points binary"
BLOCK_ARROW = pa.schema([("block", pa.int64()), ("queries", pa.int32()), ("q_wide", pa.int32()), *((c, pa.binary()) for c in ("origin", "place", "query_ids", "q_points"))])


def _whole(points: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in points.tolist()], object).reshape(points.shape)


def search(points: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, named: np.ndarray, queries: np.ndarray, k: int,
           limits: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of the rows that may be among a query's k best.

    ``limits``: the k-th scores known so far (-inf if none); ``own``: the place of the query's own row, or -1.
    """
    most = np.abs(points).max(initial=0) * np.abs(queries).max(initial=0) * max(1, points.shape[1])
    if most < EXACT:
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    else:  # whole numbers of any size, and no box is left out
        points, queries, bounds = _whole(points), _whole(queries), np.full((len(queries), len(ends)), np.inf)
    nodes = ends.tolist()
    for i, (query, limit, mine) in enumerate(zip(queries, limits.tolist(), own.tolist())):
        bound = bounds[i]
        best_at, best = np.empty(0, np.int64), np.empty(0, points.dtype)
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= limit:
            begin, end, left = nodes[heapq.heappop(heap)[1]]
            if left >= 0:
                for child in (left, left + 1):
                    if bound[child] >= limit:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            scores = points[begin:end] @ query
            good = np.flatnonzero(scores >= limit)
            if begin <= mine < end:
                good = good[good != mine - begin]
            if not len(good):
                continue
            best_at, best = np.concatenate([best_at, good + begin]), np.concatenate([best, scores[good]])
            if len(best) >= k:
                first = sorted(range(len(best)), key=lambda j: (-best[j], not named[best_at[j]], ids[best_at[j]]))[:k]
                best_at, best = best_at[first], best[first]
                limit = max(limit, best[-1])
        if len(best):
            yield i, best_at, best


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                wide = max(r["wide"], r["q_wide"])
                padded = lambda blob, own: np.pad(unpacked(blob, own) if own else np.zeros((0, 0)), ((0, 0), (0, wide - own)))
                queries = padded(r["q_points"], r["q_wide"]) if r["q_wide"] else np.zeros((r["queries"], wide))
                points = padded(r["points"], r["wide"]) if r["wide"] else np.zeros((r["n"], wide))
                ends = unpack(r["ends"], np.int64).reshape(-1, 3)
                low, high = ((padded(r[c], r["wide"]) if r["wide"] else np.zeros((len(ends), wide))) for c in ("low", "high"))
                ids, named = unpack(r["ids"], np.int64), unpack(r["named"], np.uint8) > 0
                origin, place, query_ids = (unpack(r[c], np.int64) for c in ("origin", "place", "query_ids"))
                limits = np.full(len(queries), -np.inf)
                for x in r["limits"] or []:
                    limits[x["q"]] = x["score"]
                own = np.where(origin == r["shard"], place, -1)
                out = [(i, at, np.clip(s, -LONG, LONG).astype(np.int64)) for i, at, s in search(points, ends, low, high, ids, named, queries, k, limits, own)]
                if not out:
                    continue
                q = np.repeat([i for i, *_ in out], [len(at) for _, at, _ in out])
                at = np.concatenate([at for _, at, _ in out])
                columns = [np.full(len(q), r["block"]), origin[q], place[q].astype(np.int32), query_ids[q]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(ids[at], mask=~named[at]), pa.array(np.concatenate([s for *_, s in out]))], schema=FOUND_ARROW)
    return run


def top_products(vectors: DataFrame, id_column: str, column: str, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS, block_shards: int = BLOCK_SHARDS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best rows for each query, the rows whose id is divisible by ``every``."""
    index = shards(vectors, id_column, column, every, shard_rows)
    n = index.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0] + 1
    asked = index.select("shard", "wide", "ids", "points", "asked")
    blocks = asked.groupBy(F.floor(F.col("shard") / block_shards).cast("long")).applyInArrow(_blocks(block_shards), BLOCK).where("queries > 0")
    # a block begins in one shard, all others follow with its k-th scores
    blocks = written(blocks.withColumn("seed", F.col("block") * block_shards), "kd-blocks")
    tree = index.drop("asked")
    none = F.lit(None).cast("array<struct<q:int,score:long>>").alias("limits")
    first = blocks.withColumn("shard", F.col("seed")).join(tree, "shard").select("*", none).drop("seed")
    first = written(first.mapInArrow(_searched(k), FOUND), "kd-first")
    place = F.row_number().over(Window.partitionBy("block", "origin", "place").orderBy(F.desc("score")))
    kth = first.withColumn("rank", place).where(F.col("rank") == k).select("block", "origin", "place", "score")
    numbers = blocks.select("block", "origin", "place").mapInArrow(_numbers, "block long, origin long, place int, q int")
    limits = kth.join(numbers, ["block", "origin", "place"]).groupBy("block").agg(F.collect_list(F.struct("q", "score")).alias("limits"))  # a block's queries
    pairs = blocks.join(limits, "block", "left").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, n - 1)).cast("long")))).where("shard <> seed").drop("seed")
    rest = pairs.join(tree, "shard").mapInArrow(_searched(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("origin", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return first.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each query of a block with its number there."""
    for batch in batches:
        for r in batch.to_pylist():
            origin, place = unpack(r["origin"], np.int64), unpack(r["place"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(origin), r["block"])), pa.array(origin), pa.array(place.astype(np.int32)), pa.array(np.arange(len(origin), dtype=np.int32))],
                                             names=["block", "origin", "place", "q"])
