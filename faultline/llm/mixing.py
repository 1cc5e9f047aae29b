"""Mixing sources to target weights.

Each source's words are summed, targets are the weighted shares of the whole
mix with a cap per source (water filling: the excess of a capped source is
shared again by weight until none is above), and every document is emitted
floor(rate) times plus one hash-seeded Bernoulli copy with probability equal
to the fraction. The draw depends on the document id and the seed alone, so
reruns, retries and other partitionings give the same mix.

Defined cases: null or empty text has size 0 and is emitted like any other
document; a null source is a source of its own, ordered last; a source whose
documents are all empty has target 0 and rate 0; repeated rows share one draw;
an empty table gives an empty mix. Columns named like the added ones are
replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.storage import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5,
                   cap: float = 2.0) -> DataFrame:
    """(source, size) rows -> one row per source: source, source_size, weight, target.

    Weights repeat over the sources in code point order, null last. The order
    comes from a distributed sort (row numbers inside a partition plus the
    offsets of the partitions before it), so the number of sources is not
    bounded by one task; a round of resharing is one aggregation to three
    numbers.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    ordered = written(sums.orderBy(F.col("source").asc_nulls_last())
                      .withColumn("_id", F.monotonically_increasing_id()), "source-sizes")
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33)).withColumn("_row", F.col("_id").bitwiseAND((1 << 33) - 1))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per sort partition
    offsets, before = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in counts):
        offsets.append((part, before))
        before += n
    if not offsets:
        return ordered.select("source", "source_size", F.lit(0).alias("weight"), F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for pair in offsets for x in pair])
    rank = offset[F.col("_part")] + F.col("_row")
    turns = F.array(*[F.lit(w) for w in weights])
    ranked = written(ordered.select("source", "source_size", F.get(turns, (rank % len(weights)).cast("int")).alias("weight")),
                     "source-weights")
    total, all_weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, below = share * total / all_weight, -1
    while True:
        at_cap = cap * F.col("source_size") <= F.lit(level) * F.col("weight")
        n, capped, free = ranked.agg(F.count(F.when(at_cap, 1)),
                                     F.coalesce(F.sum(F.when(at_cap, F.col("source_size"))), F.lit(0)),
                                     F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0))).first()
        if n == below or not free:
            break
        below, level = n, (share * total - cap * capped) / free
    return ranked.withColumn("target", F.least(cap * F.col("source_size"), F.lit(level) * F.col("weight")))


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) fixed by the id, the text and the seed (52 bits of an MD5), so rows without ids have draws of their own."""
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), own).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
                seed: str = "mix-1:") -> DataFrame:
    """Every document with size, source_size, target, rate and copies (0 or more)."""
    sized = docs.withColumn("size", word_count(F.col("text")))
    targets = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, share, cap)
    # a row per source; the documents' side of a hot source is split by AQE, or
    # not shuffled at all when the sources' table is under Spark's own limit
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = sized.drop("source_size", "target", "rate", "copies").join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate")
    extra = (draw(F.col("doc_id"), F.col("text"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("rate", rate).withColumn("copies", (whole + extra).cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: a row per emitted copy, with the documents' columns and ``copy`` (from 1)."""
    chosen = with_copies(docs, **options).where(F.col("copies") > 0)
    columns = [F.col(c) for c in docs.columns if c != "copy"]
    return chosen.select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
