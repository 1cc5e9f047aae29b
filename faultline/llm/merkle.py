"""Merkle manifest of a table, and a proof for every row.

Each row is a leaf: the SHA-256 of its columns, each as ``-`` if null, else its
UTF-8 byte count, ``:`` and its value. Within a group the leaves stand in order;
while several nodes remain, every ``fanout`` consecutive ones (the last run may
have fewer, even one) become the hash of their hex digests side by side. The
groups' subroots, in the order of the groups, make one tree more, whose top is
the root.

Proofs come by pointer jumping. A node above the leaves points at its parent
and holds one segment, the siblings that lead there. Each round joins the nodes
with themselves: a node takes over the pointer of the node it points at and
appends that node's segments, so the distance covered doubles and the number of
rounds is the logarithm of the height. The nodes above the leaves are a
``fanout``-th of the rows; the leaves join last, each with a parent whose
pointer has reached the root, so no leaf carries a path through a shuffle.

Order is dealt by ranges and counted per range: no group is gathered, and a
group that holds most rows is spread like any other. Only digests and ids are
shuffled, never texts; every level and every round is a table in the shared
folder.

Defined cases: a null group is a group of its own and comes first, null order
keys come first, rows with equal keys stand by their leaves, equal rows are
leaves of their own; a group of one row has that leaf as its subroot, a single
subroot is the root; an empty table has no rows and no root (null). Texts of any
length are hashed whole, where they are read. Other columns of the input, whatever
their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.storage import written

FANOUT = 8
WIDE = 32
TOP = -1
# monotonically_increasing_id puts the partition above this bit and the row's place in it below
PLACE_BITS = 33


def digest(value: Column) -> Column:
    """The 32 bytes of SHA-256."""
    return F.unhex(F.sha2(value.cast("binary"), 256))


def hex_of(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf(columns: Sequence[Column]) -> Column:
    """A row's digest from its columns in the order given."""
    texts = [c.cast("string") for c in columns]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]))


def _placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by ranges of (group, order) with their number ``at`` over all of them, and (part, group, low, n, before).

    ``before`` counts the rows of the group in earlier parts, so a row's place in its group is at - low + before.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order]]
    sorted_rows = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*keys, F.col("salt")).sortWithinPartitions(*keys)
    placed = written(sorted_rows.drop("salt").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", PLACE_BITS)), name)
    blocks = placed.groupBy("part", *group).agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part and group
    return placed, blocks.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their place ``at`` from 0 over all of them."""
    placed, blocks = _placed(rows, [], order, name)
    return placed.join(blocks.select("part", "low", "before"), "part").withColumn("at", F.col("at") - F.col("low") + F.col("before")).drop("part", "low", "before")


def _levels(leaves: DataFrame, fanout: int, name: str) -> list[DataFrame]:
    """(tree, idx, size, digest) -> for each level above: (tree, level, idx, size, digest, children), ``size`` being its nodes."""
    out: list[DataFrame] = []
    now = leaves
    most = leaves.agg(F.max("size")).first()[0] or 0
    while most > 1:
        runs = (now.where("size > 1").select("tree", F.expr(f"idx div {fanout}").alias("run"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size"), "idx", "digest")
                .groupBy("tree", F.col("run").alias("idx"), "size").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("k"), "digest"))).alias("own")))
        runs = runs.withColumn("children", F.aggregate("own", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["digest"])))
        runs = runs.select("tree", F.lit(len(out) + 1).alias("level"), "idx", "size", digest(hex_of(F.col("children"))).alias("digest"), "children")
        now = written(runs, f"{name}-{len(out) + 1}")
        out.append(now)
        most = -(-most // fanout)
    return out


def _pointed(nodes: DataFrame, trees: int, fanout: int) -> DataFrame:
    """Adds the parent (up_tree, up_level, up_idx) and the place ``pos`` in its run; the root has nulls."""
    inside, top = F.col("size") > 1, (F.col("tree") != TOP) & F.lit(trees > 1)
    idx = F.when(inside, F.col("idx")).when(top, F.col("tree"))
    return nodes.withColumns({"up_tree": F.when(inside, F.col("tree")).when(top, F.lit(TOP)), "up_level": F.when(inside, F.col("level") + 1).when(top, F.lit(1)),
                              "up_idx": F.floor(idx / fanout).cast("long"), "pos": (idx % fanout).cast("int")})


def _segment(children: Column, pos: Column) -> Column:
    """The place of a node in its run, and the digests of the run's others side by side."""
    at = pos * WIDE
    others = F.concat(F.substring(children, F.lit(1), at), F.substring(children, at + WIDE + 1, F.length(children)))
    return F.struct(pos.alias("pos"), others.alias("others"))


def fold(start: Column, path: Column) -> Column:
    """The digest that a leaf and the segments of its path lead to."""
    def up(below: Column, step: Column) -> Column:
        at = step["pos"] * WIDE
        return digest(hex_of(F.concat(F.substring(step["others"], F.lit(1), at), below, F.substring(step["others"], at + 1, F.length(step["others"])))))
    return F.aggregate(path, start, up)


def siblings_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, as hex text."""
    return digest(hex_of(F.aggregate(path, F.unhex(F.lit("")), lambda a, s: F.concat(a, s["others"]))))


def _jumped(nodes: DataFrame, trees: int, fanout: int, height: int) -> DataFrame:
    """(tree, level, idx) -> children and ``path``, the segments up to the root, of every node above the leaves."""
    parents = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("children").alias("run"))
    own = _pointed(nodes.select("tree", "level", "idx", "size", "children"), trees, fanout).join(parents, ["up_tree", "up_level", "up_idx"], "left")
    empty = F.lit(None).cast("array<struct<pos:int,others:binary>>")
    path = F.when(F.col("run").isNotNull(), F.array(_segment(F.col("run"), F.col("pos")))).otherwise(F.coalesce(empty, F.array().cast("array<struct<pos:int,others:binary>>")))
    now = written(own.select("tree", "level", "idx", "children", "up_tree", "up_level", "up_idx", path.alias("path")), "merkle-jump")
    covered = 1
    while covered < height:
        # what is pointed at lies above `covered` levels of some tree or in the top one: a small part of the nodes
        above = now.where((F.col("level") > covered) | (F.col("tree") == TOP))
        above = above.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), F.col("path").alias("more"),
                             F.struct("up_tree", "up_level", "up_idx").alias("next"))
        joined = now.join(above, ["up_tree", "up_level", "up_idx"], "left")
        now = written(joined.select("tree", "level", "idx", "children", *[F.col("next")[c].alias(c) for c in ("up_tree", "up_level", "up_idx")],
                                    F.when(F.col("more").isNotNull(), F.concat("path", "more")).otherwise(F.col("path")).alias("path")), "merkle-jump")
        covered *= 2
    return now


@dataclass
class Manifest:
    """``leaves`` (key, others, leaf, tree, idx, size), ``nodes`` of all levels above, ``subroots`` (tree, subroot), the root as hex (null without rows), and the height."""

    leaves: DataFrame
    nodes: DataFrame | None
    subroots: DataFrame
    root: str | None
    trees: int
    height: int
    fanout: int


def manifest(rows: DataFrame, columns: Sequence[str], group: str, key: str, fanout: int = FANOUT, others: Mapping[str, Column] | None = None) -> Manifest:
    """The tree over ``rows``: leaves of ``columns``, one tree a value of ``group``, in the order of ``key``.

    ``others`` are columns to keep beside each leaf, computed where the rows are read.
    """
    others = dict(others or {})
    flat = rows.select(F.col(key).alias("key"), F.col(group).alias("grp"), leaf([F.col(c) for c in columns]).alias("leaf"),
                       F.struct(*[c.alias(n) for n, c in others.items()]).alias("others") if others else F.lit(None).cast("string").alias("others"))
    placed, blocks = _placed(written(flat, "merkle-leaves"), ["grp"], ["key", "leaf"], "merkle-sorted")
    blocks = written(blocks, "merkle-blocks")
    groups = _in_order(blocks.groupBy("grp").agg(F.sum("n").alias("size")), ["grp"], "merkle-groups").withColumnRenamed("at", "tree")
    blocks = blocks.alias("b").join(groups.alias("g"), F.col("b.grp").eqNullSafe(F.col("g.grp"))).select(F.col("b.part").alias("b_part"), F.col("b.grp").alias("b_grp"), "low", "before", "tree", "size")
    leaves = placed.join(blocks, (F.col("part") == F.col("b_part")) & F.col("grp").eqNullSafe(F.col("b_grp")))
    leaves = leaves.select("key", "others", "leaf", "tree", (F.col("at") - F.col("low") + F.col("before")).alias("idx"), "size")
    leaves = written(leaves, "merkle-placed")
    inner = _levels(leaves.select("tree", "idx", "size", F.col("leaf").alias("digest")), fanout, "merkle-level")
    subroots = leaves.where("size = 1").select("tree", F.col("leaf").alias("subroot"))
    for level in inner:
        subroots = subroots.union(level.where("size = 1").select("tree", F.col("digest").alias("subroot")))
    subroots = written(subroots, "merkle-subroots")
    trees = subroots.count()
    top = _levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(trees).cast("long").alias("size"), F.col("subroot").alias("digest")), fanout, "merkle-top")
    nodes = None
    for level in [*inner, *top]:
        nodes = level if nodes is None else nodes.union(level)
    last = top[-1].select("digest") if top else subroots.select("subroot")
    root = last.select(hex_of(F.col(last.columns[0]))).first()
    return Manifest(leaves, nodes, subroots, root and root[0], trees, len(inner) + len(top), fanout)


def proofs(tree: Manifest) -> DataFrame:
    """key, others, leaf, subroot (binary) and ``path`` (segments from the leaf to the root) of every leaf."""
    leaves = _pointed(tree.leaves.withColumn("level", F.lit(0)), tree.trees, tree.fanout)
    kind = "array<struct<pos:int,others:binary>>"
    if tree.nodes is None:  # at most one leaf
        return leaves.select("key", "others", "leaf", F.col("leaf").alias("subroot"), F.array().cast(kind).alias("path"))
    jumped = _jumped(tree.nodes, tree.trees, tree.fanout, tree.height).where("level = 1")
    parents = jumped.join(tree.subroots, "tree", "left").select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), "children", "subroot", F.col("path").alias("more"))
    joined = leaves.join(parents, ["up_tree", "up_level", "up_idx"], "left")
    path = F.when(F.col("children").isNotNull(), F.concat(F.array(_segment(F.col("children"), F.col("pos"))), F.col("more"))).otherwise(F.array().cast(kind))
    return joined.select("key", "others", "leaf", F.coalesce("subroot", "leaf").alias("subroot"), path.alias("path"))


def verified(tree: Manifest, start: Column) -> DataFrame:
    """Every leaf with its proof's digest, the root folded from ``start`` (of the proofs' columns), and whether that is the manifest's root; digests as hex."""
    out = proofs(tree).select("key", "others", "leaf", "subroot", siblings_digest(F.col("path")).alias("proof"), fold(start, F.col("path")).alias("folded"))
    hexed = {c: hex_of(F.col(c)) for c in ("leaf", "subroot", "proof", "folded")}
    return out.withColumns(hexed).withColumn("root", F.lit(tree.root).cast("string")).withColumn("verified", F.col("folded") == F.col("root"))
