import re

from pyspark.sql import Row

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, key long, row long, score double, size int"


def docs_frame(spark, rows, partitions=3):
    """Rows (doc_id, text) or (doc_id, text, source) as documents with columns whose names clash with the operators' own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", None, -1, -2, -3, -4.0, -5) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA).repartition(partitions)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_az(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def as_tuples(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


__all__ = ["Row", "docs_frame", "words_of", "lower_az", "as_tuples"]
