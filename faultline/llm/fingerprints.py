"""Winnowed document fingerprints, with DataFrame functions only.

A text's words are hashed, every run of ``k`` words has a hash of theirs, and
of each window of ``w`` runs the least is chosen, the rightmost of equal ones;
positions are kept, so any passage of at least ``w + k - 1`` words that two
texts share is met by a chosen run of both. Window minima are found by
doubling: the choice of a window of 2m is the better of two windows of m.
A word of more than ``LONG_WORD`` characters counts as its characters, so a text in
a script without spaces, or of encoded data, has runs like any other. Texts of at
most ``SHORT`` characters have a second fingerprint of the same kind over their
characters, as words are too coarse for them.

Two fingerprints' likeness is the Jaccard index of their chosen hashes (over
characters if both texts are short, else over words); 1 for two texts without
words, and for equal texts.

The next document (descending doc_id, after the last the first) is found
inside buckets of id ranges; the first document of each range is also sent to
the range before it, so no window spans the table and each text is shuffled
once. The ranges come from approximate quantiles of the ids, at most
``MOST_BUCKETS`` of them.

Defined cases: null text is empty; a text of fewer than k words has one run of
all its words, an empty one none; a null doc_id comes last, by its text's
hash; rows of equal doc_id are ordered by their text's hash; a single row is
its own next document; an empty table gives no rows; texts of any length are read
whole; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS_K, WORDS_W = 5, 4
CHARS_K, CHARS_W = 6, 4
SHORT = 600
LONG_WORD = 24
MOST_BUCKETS = 4096
LEAST_ID = -(1 << 63)


def _steps(w: int) -> list[int]:
    """How far apart the two windows joined in each step are."""
    steps, have = [], 1
    while have < w:
        steps.append(min(have, w - have))
        have += steps[-1]
    return steps


def _places(n: Column) -> Column:
    """0 to n - 1, or nothing."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))


def with_winnowed(df: DataFrame, tokens: Column, name: str, k: int, w: int) -> DataFrame:
    """Adds ``name``: array of (place, hash), the chosen runs of ``tokens`` (an array of strings) in order."""
    h, g, a = F.col("_h"), F.col("_g"), F.col("_a")
    others = df.columns
    df = df.withColumn("_h", F.transform(tokens, lambda t: F.xxhash64(t)))
    runs = F.greatest(F.size(h) - (k - 1), F.least(F.size(h), F.lit(1)))
    df = df.withColumn("_g", F.transform(_places(runs), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))
    df = df.withColumn("_a", _places(F.size(g)))
    for step in _steps(w):
        def better(i, x, step=step):
            y = F.get(a, i + step)
            return F.when(F.get(g, y) <= F.get(g, x), y).otherwise(x)
        # a window that begins less than ``step`` before the end keeps its own choice
        df = df.withColumn("_a", F.transform(a, lambda x, i: better(i, x)))
    chosen = F.array_distinct(F.slice(a, F.lit(1), F.greatest(F.size(a) - (w - 1), F.least(F.size(a), F.lit(1)))))
    return df.select(*others, F.transform(chosen, lambda p: F.struct(p.alias("place"), F.get(g, p).alias("hash"))).alias(name))


def units(text: Column) -> Column:
    """A text's words; one of more than ``LONG_WORD`` characters, as in a script without spaces, counts as its characters."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    spelled = F.flatten(F.transform(words, lambda x: F.when(F.length(x) > LONG_WORD, F.filter(F.split(x, ""), lambda c: c != "")).otherwise(F.array(x))))
    return F.when(F.exists(words, lambda x: F.length(x) > LONG_WORD), spelled).otherwise(words)


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``name``: struct of words and chars (null for long texts), each an array of (place, hash)."""
    others = df.columns
    df = with_winnowed(df, units(F.col(text)), "_words", WORDS_K, WORDS_W)
    characters = F.when(F.length(text) <= SHORT, F.filter(F.split(F.col(text), ""), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    df = with_winnowed(df, characters, "_chars", CHARS_K, CHARS_W)
    return df.select(*others, F.struct(F.col("_words").alias("words"), F.when(F.length(text) <= SHORT, F.col("_chars")).alias("chars")).alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two fingerprints' hashes."""
    def index(x: Column, y: Column) -> Column:
        either = F.size(F.array_union(x["hash"], y["hash"]))
        return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x["hash"], y["hash"])) / either)
    both_short = a["chars"].isNotNull() & b["chars"].isNotNull()
    return F.when(both_short, index(a["chars"], b["chars"])).otherwise(index(a["words"], b["words"]))


def digest(fingerprint: Column) -> Column:
    """A hash of the chosen runs and their places."""
    return F.sha2(F.to_json(fingerprint).cast("binary"), 256)


def in_ranges(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, order, extra, bucket): ranges of ids in descending order, with the next range's first row as an extra."""
    n = min(MOST_BUCKETS, 4 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.coalesce("doc_id", F.lit(LEAST_ID).cast("long") + F.pmod(F.xxhash64("text"), F.lit(1 << 40))))
    shares = F.array(*[F.lit((i + 1) / n) for i in range(n - 1)])
    bounds = sorted(set(rows.agg(F.percentile_approx("order", shares, F.lit(100 * n))).first()[0] or []))
    placed = rows.withColumn("bucket", F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b < F.col("order"))))
    firsts = sorted(placed.groupBy("bucket").agg(F.max("order")).collect())  # a row for each range
    # in descending order a range is followed by the range below it, the lowest by the highest
    follows = [(firsts[i][1], firsts[(i + 1) % len(firsts)][0]) for i in range(len(firsts))]
    placed = placed.withColumn("extra", F.lit(False))
    if not follows:
        return placed
    heads = docs.sparkSession.createDataFrame(follows, "_head long, _to int")
    extra = placed.join(F.broadcast(heads), F.col("order") == F.col("_head")).select("doc_id", "text", "order", F.col("_to").alias("bucket"), F.lit(True).alias("extra"))
    return placed.unionByName(extra)


def edited(text: Column, after: Column) -> Column:
    """The text with its last third replaced by as many first characters of another, or all."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(after, F.lit(1), third))


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next of every row."""
    order = Window.partitionBy("bucket").orderBy("extra", F.col("order").desc(), F.xxhash64("text"))
    rows = in_ranges(docs).withColumn("after", F.lead("text").over(order))
    rows = with_fingerprint(rows, "text", "fingerprint")
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(order)).where("not extra")
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("after")))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                       "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
