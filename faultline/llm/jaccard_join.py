"""Near-duplicate documents by an exact n-gram Jaccard self-join with PartEnum signatures.

A document's set holds its distinct five-word shingles; two documents link
when ``100 * |A & B| >= 80 * |A | B|``. Documents are banded by set size
(bands of ratio 1.25, so that linked sets lie in one band or in neighbouring
ones), and every set is signed in its own band and in the one above. For a
band whose pairs differ in at most k elements the feature domain is cut twice
by hash: into k // 2 + 1 + slack partitions, and each of these into three parts.
The subsets of two parts of a partition are enumerated, and the content of each
gives one signature. A partition without a common subset holds two differences
or more, so two linked sets share a signature in at least slack + 1 partitions.

Signatures of weak subsets (both parts empty, or of very frequent shingles only)
would join unrelated texts. A partition is weak if one of its subsets is; a set
with at most ``slack`` weak partitions leaves weak subsets out: it still shares a
signature with any linked set in a partition that isn't weak. Sets with more are
signed again under other cuts of the domain, and under the last one with their
weak subsets too: two linked sets that share weak signatures only both have more
than ``slack`` weak partitions, so no link is lost.

Sets that share a signature are first compared with the least of them (a star,
not all pairs; the least is found per task before the shuffle). Only groups
whose members are not yet connected are opened: their members in different
components are compared by parity sketches, a bound on how far the sets
differ, and then exactly. Equal sets are one node throughout.

Defined cases: no words or null text give an empty set, linked with nothing; a
document of fewer than five words has its whole sequence as one shingle;
repeated rows and ids get equal rows; a null doc_id takes part in links but is
never a component's id unless all are null. Shingles and sets are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import tokens
from faultline.llm.bitmaps import bitmap_of, may_hold
from faultline.llm.components import components
from faultline.llm.packing import pack, unpack
from faultline.llm.storage import buckets_for, trimmed, written

SHINGLE = 5
NUM, DEN = 80, 100
CUTS = 6
#: Parts of a partition; the subsets without one of them are enumerated.
PARTS = 3
#: A shingle is frequent if more than 1 / RARE of all shingles are copies of it: at most RARE shingles.
RARE = 200_000
SKETCH_BITS = 1024
POSTINGS = 1_000_000
#: Text bytes whose signatures share a bucket.
BUCKET_BYTES = 16 << 20
BLOCK_NODES = 2048

KEYS = "kind int, doc_id long, n long, key long"
KEYS_ARROW = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])


def band_tops() -> list[int]:
    """The largest size of each band: sizes over a band's top differ by 1.25 at most."""
    tops = [3]
    while tops[-1] < 1 << 40:
        tops.append((tops[-1] + 1) * DEN // NUM)
    return tops


TOPS = np.array(band_tops(), np.int64)


def band_partitions(band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partitions, slack) of a band's scheme: pairs lie in the band or one of them in the band below."""
    k = 2 * (DEN - NUM) * TOPS[band] // (DEN + NUM)  # |A ^ B| <= (1-g)/(1+g) * (|A| + |B|)
    slack = np.where(k < 8, 0, 1 + k // 18)
    return k // 2 + 1 + slack, slack


def set_keys(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One hash of each text's set (0 for an empty set)."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens.mix64(flat ^ np.uint64(0x5851F42D4C957F2D)))])
    n = np.diff(first)
    keys = tokens.mix64(sums[first[1:]] - sums[first[:-1]] + n.astype(np.uint64))
    return np.where(n > 0, keys, np.uint64(0))


def sets_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    words = tokens.hashed_words(batch.column("text"), lower=True)
    return tokens.set_hashes(words, SHINGLE)


def _keys_and_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0), and counts of shingles that are frequent among some 4 MB of text (kind 1)."""
    for part in tokens.gathered(batches, "text", 4 << 20):
        flat, first = sets_of(part)
        n = np.diff(first)
        keys = set_keys(flat, first)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), np.int32)), part.column("doc_id").cast(pa.int64()), pa.array(n.astype(np.int64)),
                                          pa.array(keys.view(np.int64))], schema=KEYS_ARROW)
        # equal sets count once here, as they are one node later
        _, kept = np.unique(keys, return_index=True)
        chosen = np.zeros(len(n), bool)
        chosen[kept] = True
        values, counts = np.unique(flat[np.repeat(chosen, n)], return_counts=True)
        often = counts > max(1, counts.sum() // RARE)
        if often.any():
            m = int(often.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), pa.nulls(m, pa.int64()), pa.array(counts[often].astype(np.int64)),
                                              pa.array(values[often].view(np.int64))], schema=KEYS_ARROW)


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of at most ``RARE`` frequent shingles."""
    total = rows.where("kind = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = rows.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, total // RARE)).select("key").toArrow()
    return np.sort(often["key"].to_numpy().view(np.uint64))


def signatures(flat: np.ndarray, first: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, text) of every set, without those of weak parts where they aren't needed."""
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
        rare = frequent[at] != flat
    else:
        rare = np.ones(len(flat), bool)
    sigs, owners = [], []
    own_band = np.searchsorted(TOPS, n)
    for up in (0, 1):
        band = own_band + up
        partitions, slack = band_partitions(band)
        todo = np.flatnonzero(n >= 4)  # smaller sets link only with equal ones
        for cut in range(CUTS):
            if not len(todo):
                break
            base = np.zeros(len(n) + 1, np.int64)
            here = np.zeros(len(n), np.int64)
            here[todo] = partitions[todo]
            np.cumsum(here, out=base[1:])
            mask = here[text] > 0
            h, t = flat[mask], text[mask]
            mixed = tokens.mix64(h + np.uint64(0x9E3779B97F4A7C15 * (cut + 1) % (1 << 64)))
            slot = PARTS * base[t] + ((mixed >> np.uint64(33)).astype(np.int64) % (PARTS * here[t]))
            total = int(base[-1])
            value = tokens.mix64(mixed ^ h)
            low = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), PARTS * total)
            high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), PARTS * total)
            content = tokens.mix64(low.astype(np.uint64) + tokens.mix64(high.astype(np.uint64)))
            del low, high, value, mixed
            owner = np.repeat(np.arange(len(n)), here)
            place = tokens.mix64(((band[owner] * CUTS + cut) << 40).astype(np.uint64) + (np.arange(total) - base[owner]).astype(np.uint64))
            # each part's content under its place, so that a sum tells which parts it is of
            content = tokens.mix64(content.reshape(total, PARTS) + np.arange(1, PARTS + 1, dtype=np.uint64)) ^ place[:, None]
            content = tokens.mix64(content)
            strong = (np.bincount(slot, rare[mask], PARTS * total) > 0).reshape(total, PARTS)
            sig = tokens.mix64(content.sum(axis=1, dtype=np.uint64)[:, None] - content)  # without one part
            of_subset = strong.sum(axis=1)[:, None] > strong  # whether one of the others is strong
            weak = np.bincount(owner, ~of_subset.all(axis=1), len(n))
            again = here.astype(bool) & (weak > slack)
            keep = of_subset | (again[owner] if cut == CUTS - 1 else np.zeros(total, bool))[:, None]
            sigs.append(sig[keep])
            owners.append(np.broadcast_to(owner[:, None], keep.shape)[keep])
            todo = np.flatnonzero(again)
    return (np.concatenate(sigs), np.concatenate(owners)) if sigs else (np.empty(0, np.uint64), np.empty(0, np.int64))


BLOCK = "bucket int, sigs binary, names binary, places binary, links binary"
BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("names", pa.binary()), ("places", pa.binary()), ("links", pa.binary())])
MEMBER = "sig long, node long, head long"
MEMBER_ARROW = pa.schema([("sig", pa.int64()), ("node", pa.int64()), ("head", pa.int64())])


def heads_of(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (sig, node), and the least node of each row's group."""
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[keep], node[keep]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    head = node[new][np.cumsum(new) - 1] if len(sig) else node
    return sig, node, head


def _signer(frequent, buckets: int):
    def flush(sig: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        sig, node, head = heads_of(sig, node)
        ahead = node == head  # one posting a group goes on; the others are linked to it here
        names, places = np.unique(node, return_inverse=True)
        bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [[], [], [], [], []]
        for b in np.flatnonzero(np.diff(edges)).tolist():
            i, j = edges[b], edges[b + 1]
            lead = ahead[i:j]
            s = sig[i:j][lead]
            local, place = np.unique(places[i:j][lead], return_inverse=True)
            rows[0].append(b)
            rows[1].append(pack(np.diff(s, prepend=np.uint64(0))))
            rows[2].append(pack(names[local]))
            rows[3].append(pack(place.astype(np.uint32)))
            rest = ~lead
            rows[4].append(pack(np.concatenate([sig[i:j][rest], node[i:j][rest], head[i:j][rest]])))
            if len(rows[0]) == 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, BLOCK_ARROW)], schema=BLOCK_ARROW)
                rows = [[], [], [], [], []]
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, BLOCK_ARROW)], schema=BLOCK_ARROW)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        sigs, nodes, held = [], [], 0
        for part in tokens.gathered(batches, "text", 4 << 20):
            flat, first = sets_of(part)
            keys = set_keys(flat, first)
            _, kept = np.unique(keys, return_index=True)  # equal sets are signed once
            chosen = np.zeros(len(keys), bool)
            chosen[kept] = True
            n = np.where(chosen, np.diff(first), 0)
            sig, owner = signatures(flat[np.repeat(chosen, np.diff(first))], np.concatenate([[0], np.cumsum(n)]), often)
            sigs.append(sig)
            nodes.append(keys[owner])
            held += len(sig)
            if held >= POSTINGS:
                yield from flush(np.concatenate(sigs), np.concatenate(nodes))
                sigs, nodes, held = [], [], 0
        if held:
            yield from flush(np.concatenate(sigs), np.concatenate(nodes))
    return trimmed(sign)


def _meet(table: pa.Table) -> pa.Table:
    """One bucket's postings -> the members of each signature that several sets share."""
    sigs, nodes, links = [], [], []
    for s, names, places, link in zip(*(table.column(c).to_pylist() for c in ("sigs", "names", "places", "links"))):
        sigs.append(np.cumsum(unpack(s, np.uint64)))
        nodes.append(unpack(names, np.uint64)[unpack(places, np.uint32)])
        links.append(unpack(link, np.uint64).reshape(3, -1))
    sig, node, head = heads_of(np.concatenate(sigs), np.concatenate(nodes))
    rest = node != head
    out = np.concatenate([np.stack([sig[rest], node[rest], head[rest]]), *links], axis=1).view(np.int64)
    return pa.table([pa.array(c) for c in out], schema=MEMBER_ARROW)


SET = "key long, n long, items binary, sketch binary, wide binary"
SET_ARROW = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("items", pa.binary()), ("sketch", pa.binary()), ("wide", pa.binary())])


def parity_sketch(items: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Each element flips one bit: two sketches differ in no more bits than the sets in elements."""
    return np.packbits(np.bincount((items >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).tobytes()


def wide_sketch(items: np.ndarray) -> bytes:
    """A parity sketch of four bits an element or more, a power of two."""
    return parity_sketch(items, max(SKETCH_BITS, 1 << (4 * len(items) - 1).bit_length()))


def sketch_distance(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches; the longer one is folded to the length of the other."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _set_writer(wanted, with_items: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for part in tokens.gathered(batches, "text", 2 << 20):
            ids = part.column("doc_id").cast(pa.int64())
            hit = may_hold(bitmap, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)
            if not hit.any():
                continue
            part = part.filter(pa.array(hit))
            flat, first = sets_of(part)
            keys = set_keys(flat, first).view(np.int64)
            own = [flat[first[t]: first[t + 1]] for t in range(part.num_rows)]
            columns = [[pack(np.diff(x, prepend=np.uint64(0))) for x in own], None, None] if with_items else \
                [None, [parity_sketch(x) for x in own], [wide_sketch(x) for x in own]]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.diff(first).astype(np.int64)),
                                              *(pa.nulls(len(own), pa.binary()) if c is None else pa.array(c, pa.binary()) for c in columns)], schema=SET_ARROW)
    return trimmed(write)


def sets_of_nodes(texts: DataFrame, keys: DataFrame, nodes: DataFrame, with_items: bool, name: str) -> DataFrame:
    """A row (key, n, and its items or its sketches) for each of the nodes, from one document of each."""
    chosen = written(keys.join(nodes, "key").groupBy("key").agg(F.min("doc_id").alias("doc_id")), f"{name}-documents")
    wanted = texts.sparkSession.sparkContext.broadcast(bitmap_of(chosen, "doc_id"))
    found = texts.mapInArrow(_set_writer(wanted, with_items), SET)
    return written(found.join(chosen.select("key"), "key", "left_semi").dropDuplicates(["key"]), name)


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return DEN * shared >= NUM * (len(a) + len(b) - shared)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist()
        ok = [linked(np.cumsum(unpack(x, np.uint64)), np.cumsum(unpack(y, np.uint64))) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(len(n_a), -1) for c in ("sketch_a", "sketch_b"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near_enough(x, y, n_a, n_b)))


def near_enough(x: np.ndarray, y: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Which sketches don't rule a link out: linked sets differ in at most (1 - g) / (1 + g) of their sizes' sum."""
    apart = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
    return (DEN * np.minimum(n_a, n_b) >= NUM * np.maximum(n_a, n_b)) & ((DEN + NUM) * apart <= (DEN - NUM) * (n_a + n_b))


def _may_link_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        apart = [sketch_distance(x, y) for x, y in zip(batch.column("wide_a").to_pylist(), batch.column("wide_b").to_pylist())]
        total = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
            pa.array((DEN + NUM) * np.array(apart, np.int64) <= (DEN - NUM) * total))


def not_ruled_out(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes, small sketches and then wide ones allow a link."""
    for sketch, check in (("sketch", _may_link), ("wide", _may_link_wide)):
        small = sketches.select("key", "n", sketch)
        for side in ("a", "b"):
            pairs = pairs.join(small.select(F.col("key").alias(side), F.col("n").alias(f"n_{side}"), F.col(sketch).alias(f"{sketch}_{side}")), side)
        pairs = pairs.mapInArrow(check, "a long, b long")
    return pairs


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets link."""
    with_a = pairs.join(sets.select(F.col("key").alias("a"), F.col("items").alias("items_a")), "a")
    return with_a.join(sets.select(F.col("key").alias("b"), F.col("items").alias("items_b")), "b").mapInArrow(trimmed(_verify), "a long, b long")


def _open_pairs(table: pa.Table) -> pa.Table:
    """Pairs of nodes of a signature's two blocks that are in different components and may link; pairs with a node's head have been compared."""
    sig, low, high, own, node, head, comp = (table.column(c).to_numpy() for c in ("sig", "low", "high", "own", "node", "head", "comp"))
    n = table.column("n").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(len(sig), -1)
    order = np.lexsort((high, low, sig))
    new = np.ones(len(order) + 1, bool)
    new[1:-1] = np.any([c[order][1:] != c[order][:-1] for c in (sig, low, high)], axis=0)
    edges = np.flatnonzero(new)
    found = [np.empty((2, 0), np.int64)]
    for i, j in zip(edges[:-1], edges[1:]):
        group = order[i:j]
        one = low[group[0]] == high[group[0]]
        left = group[own[group] == low[group[0]]]
        right = group[own[group] == high[group[0]]]
        for x, p in enumerate(left):
            rest = right[x + 1:] if one else right
            rest = rest[(comp[rest] != comp[p]) & (head[rest] != node[p]) & (node[rest] != head[p])]
            rest = rest[near_enough(sketch[rest], sketch[p], n[rest], n[p])]
            if len(rest):
                found.append(np.stack([np.minimum(node[rest], node[p]), np.maximum(node[rest], node[p])]))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def open_pairs(marked: DataFrame, sketches: DataFrame, buckets: int, block: int = BLOCK_NODES) -> DataFrame:
    """Pairs (a, b) of nodes that share a signature, aren't connected and may link.

    ``marked``: sig, node, head and their components. A signature of one pair
    has been decided; one of more members is open if they aren't all
    connected. Its members are split into blocks of ``block`` nodes on
    average, and each two blocks are compared in a group of their own, so no
    group grows with the number of sets that share a signature. Signatures of
    one head go to a few buckets together, as their members form the same pairs.
    """
    size = F.count(F.lit(1)) + 1
    open_sigs = (marked.groupBy("sig").agg(F.max((F.col("comp") != F.col("head_comp")).cast("int")).alias("apart"), F.min("node").alias("x"), F.max("node").alias("y"),
                                           F.ceil(size / F.lit(block)).cast("int").alias("blocks"), F.min("head").alias("first"))
                 .where("apart = 1 and x <> y").select("sig", "blocks", "first"))
    left = marked.join(open_sigs, "sig")
    left = left.select("sig", "blocks", "first", "node", "head", "comp").union(left.select("sig", "blocks", "first", "head", "head", "head_comp")).distinct()
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    left = left.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
    left = left.withColumn("bucket", F.pmod(F.xxhash64("first", F.pmod("sig", F.lit(4)), "low", "high"), F.lit(buckets)))
    left = left.select("bucket", "sig", "low", "high", "own", "node", "head", "comp").join(sketches.select(F.col("key").alias("node"), "n", "sketch"), "node")
    return left.groupBy("bucket").applyInArrow(_open_pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (the set's hash), component_id of every document."""
    spark = docs.sparkSession
    buckets = buckets_for(docs, "text", BUCKET_BYTES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    rows = written(texts.mapInArrow(trimmed(_keys_and_frequent), KEYS), "set-keys")
    keys = rows.where("kind = 0").select("doc_id", "n", "key")
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows))  # at most RARE hashes

    blocks = texts.mapInArrow(_signer(frequent, buckets), BLOCK)
    members = written(blocks.groupBy("bucket").applyInArrow(_meet, MEMBER), "shared-signatures")
    pairs = written(members.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), "candidates")

    # sketches of all candidates, whole sets only of those that the sketches leave
    sketches = sets_of_nodes(texts, keys, ends_of(pairs), False, "sketches")
    close = written(not_ruled_out(pairs, sketches), "close-pairs")
    links = written(verified(close, sets_of_nodes(texts, keys, ends_of(close), True, "sets")), "links")
    roots = components(links)
    marked = _with_root(_with_root(members, roots, "node", "comp"), roots, "head", "head_comp")
    marked = written(marked, "marked-signatures")
    # a signature of one pair has been decided; one of more members is open if they aren't all connected
    compared = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = written(open_pairs(marked, sketches, buckets).join(compared, ["a", "b"], "left_anti"), "open-pairs")
    final = roots
    if not more.isEmpty():
        more = written(not_ruled_out(more, sketches), "open-close-pairs")
        extra = written(verified(more, sets_of_nodes(texts, keys, ends_of(more), True, "open-sets")), "open-links")
        final = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(extra))

    rooted = _with_root(keys, final, "key", "root")
    ids = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("_least"))
    out = rooted.join(ids.withColumnRenamed("root", "_root"), (F.col("root") == F.col("_root")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "key",
                      F.when(F.col("n") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_root(df: DataFrame, roots: DataFrame, column: str, name: str) -> DataFrame:
    r = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(r, F.col(column) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", column)).drop("_node", "_root")
