"""One registered query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import alignment, decontaminate, fingerprints, jaccard_join, kd_search, lattice_lm, merkle, mixing, quality, substring_dedup, toxicity, url_filter, warc
from faultline.llm.storage import table
from faultline.llm.tokenizers_dir import tokenizer_file

# Fixed rules of the contract: (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Words of a host label that put a page's URL on the stand-in block list.
LISTED_LABELS = ["ads", "adult", "bet", "bets", "casino", "malware", "pills", "poker", "porn", "spam", "tracker", "viagra"]


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in block list: the URLs of pages on hosts with a listed word in a label."""
    pages = table(spark, sf_dir, "pages").select("url")
    host = url_filter.lower_ascii(F.regexp_extract(url_filter.after_scheme(F.col("url")), r"^[^/?#]*", 0))
    return pages.where(F.arrays_overlap(F.split(host, r"[.-]"), F.array(*[F.lit(w) for w in LISTED_LABELS])))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, listed_urls(spark, sf_dir), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "listed")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprints.compared(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", "edited_sha256", fingerprints.digest(F.col("fingerprint")).alias("fingerprint"),
                      fingerprints.digest(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.scored(table(spark, sf_dir, "documents"), tokenizer_file(spark, "piece_bpe_32k.model"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding", every=100, k=10)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_file(spark, "byte_bpe_50k.json"), tokenizer_file(spark, "piece_bpe_32k.model"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = table(spark, sf_dir, "documents").select(*columns)
    lowered = merkle.leaf([url_filter.lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in columns])
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    tree = merkle.manifest(docs, columns, "lang", "doc_id", others={"tampered": F.when(hit, lowered)})
    out = merkle.verified(tree, F.coalesce(F.col("others")["tampered"], F.col("leaf")))
    return out.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), "verified")


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_fingerprints, op3_decontamination, op4_warc, op5_quality, op6_toxicity, op7_lattice_lm, op8_substring_dedup, op9_jaccard_join, op10_mixing, op11_kd_search, op12_alignment, op13_merkle_manifest)}
