"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact join.

The filter has blocks of 512 bits (eight longs), as many as the list asks for
and at most ``MOST_BLOCKS``. A key's hash picks one block and ``PROBES`` bits in
it, so a probe reads one block. Building is a grouped ``bit_or`` and probing a
join with the block table, whose size is bounded by ``MOST_BLOCKS`` whatever the
list holds (so it may be broadcast); false positives are removed by the exact
join that follows. Only possible hits are shuffled.

Rules (host, path prefix, verdict) come first: the longest rule that fits wins.

Columns of the input named like the added ones are replaced; names that begin
with an underscore are the operator's own.

Defined cases: a null URL or one without ``://`` has empty host and path, has
no canonical form and is never listed; repeated rows are judged alike; an
empty list allows what no rule blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PROBES = 6
BLOCK_LONGS = 8
LEAST_BLOCKS, MOST_BLOCKS = 1 << 10, 1 << 19


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def after_scheme(url: Column) -> Column:
    return F.when(F.locate("://", F.coalesce(url, F.lit(""))) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))


def with_parts(df: DataFrame) -> DataFrame:
    """Adds host and path, and the canonical URL (null when there is no host).

    Canonical: lower-case host without a leading ``www.`` and a default port,
    the path (``/`` when empty), the query without ``utm_`` parameters; no
    scheme and no fragment.
    """
    rest = after_scheme(F.col("url"))
    query = F.regexp_extract("_rest", r"^[^?#]*\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    host = F.regexp_replace(F.regexp_replace("host", r"^www\.", ""), r":(80|443)$", "")
    return (df.drop("host", "path", "canonical").withColumn("_rest", rest)
            .withColumn("host", lower_ascii(F.regexp_extract("_rest", r"^[^/?#]*", 0)))
            .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
            .withColumn("_query", kept)
            .withColumn("canonical", F.when(F.col("host") != "", F.concat(
                host, F.when(F.col("path") == "", F.lit("/")).otherwise(F.col("path")),
                F.when(F.col("_query") == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.col("_query"))))))
            .drop("_rest", "_query"))


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int")


def _bits(key: Column) -> Column:
    """The positions (0 to 511) of a key's bits, from a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    return F.array(*[F.shiftrightunsigned(h, 9 * i).bitwiseAND(511).cast("int") for i in range(PROBES)])


def build_filter(keys: DataFrame, key: str, n_blocks: int = 1 << 15) -> DataFrame:
    """Blocks that have a bit: block, w0..w7. At most ``n_blocks`` rows."""
    bits = keys.where(F.col(key).isNotNull()).select(_block(F.col(key), n_blocks).alias("block"), F.explode(_bits(F.col(key))).alias("bit"))
    word = F.shiftright("bit", 6)
    mask = F.expr("shiftleft(1L, bit & 63)")
    return bits.groupBy("block").agg(*[F.coalesce(F.bit_or(F.when(word == w, mask)), F.lit(0).cast("long")).alias(f"w{w}") for w in range(BLOCK_LONGS)])


def with_possible(df: DataFrame, key: str, blocks: DataFrame, n_blocks: int = 1 << 15) -> DataFrame:
    """Adds ``possible``: false only when the key is certainly not listed."""
    probe = df.withColumn("_block", _block(F.col(key), n_blocks)).withColumn("_bits", _bits(F.col(key)))
    words = F.array(*[F.col(f"_w{w}") for w in range(BLOCK_LONGS)])
    hit = F.forall("_bits", lambda b: F.get(words, F.shiftright(b, 6)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(63))) != 0)
    named = blocks.select(F.col("block").alias("_filter_block"), *[F.col(f"w{w}").alias(f"_w{w}") for w in range(BLOCK_LONGS)])
    joined = probe.join(F.broadcast(named), F.col("_block") == F.col("_filter_block"), "left")
    return joined.withColumn("possible", F.col(key).isNotNull() & F.col("_filter_block").isNotNull() & F.coalesce(hit, F.lit(False))).select(*df.columns, "possible")


def fitting_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits host and path, else nulls.

    A rule (host, path, verdict) fits its host and all subdomains when the
    path starts with the rule's. The rules are a short list of settings.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def blocks_for(n_keys: int) -> int:
    """Blocks that give a list some 16 bits a key: a power of two, at most ``MOST_BLOCKS`` (a filter of 32 MB)."""
    blocks = LEAST_BLOCKS
    while blocks < MOST_BLOCKS and blocks * 512 < 16 * n_keys:
        blocks *= 2
    return blocks


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], n_blocks: int | None = None) -> DataFrame:
    """Adds host, path, canonical, rule, listed and verdict to every row with a ``url``.

    ``listed`` has a ``url`` column. Only possible hits of the Bloom filter go
    to the exact join on the canonical URL; the other rows are not shuffled. The
    filter's size follows the list's (``blocks_for``), so that a few in a
    thousand of the other URLs pass while the list has up to some 17 million keys;
    a longer one lets more pass, and the join still decides.
    """
    block_list = with_parts(listed.select("url")).select("canonical").where(F.col("canonical").isNotNull())
    n_blocks = n_blocks or blocks_for(block_list.distinct().count())
    rule, verdict = fitting_rule(rules)
    judged = with_parts(pages.drop("rule", "listed", "verdict", "possible"))
    judged = with_possible(judged, "canonical", build_filter(block_list, "canonical", n_blocks), n_blocks)
    exact = block_list.distinct().select(F.col("canonical").alias("_exact"))
    hits = judged.where("possible").join(exact, F.col("canonical") == F.col("_exact"), "left").withColumn("listed", F.col("_exact").isNotNull()).drop("_exact")
    rest = judged.where(~F.col("possible")).withColumn("listed", F.lit(False))
    return (hits.unionByName(rest).drop("possible").withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))))
