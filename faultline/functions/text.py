"""Text column helpers that stay inside Spark's JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.splitlines() line boundaries, as one Java regex alternation.
LINE_BREAK = "\\r\\n|[\\n\\r\\u000B\\u000C\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"

# Token = run of non-whitespace (space, tab, newline, carriage return, form feed).
WORD = "[^ \\t\\n\\r\\f]+"


def pg_initcap(c: Column) -> Column:
    """INITCAP with PostgreSQL semantics: upper-case the first letter of every
    run of letters/digits, lower-case the rest (Spark's initcap only splits on
    spaces, so `o'brien` would stay `O'brien`)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit("(?U)([\\p{Alnum}]+|[^\\p{Alnum}]+)"), 1)
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)),
                                                             F.substring(p, 2, 1 << 30))), ""))


def split_lines(text: Column) -> Column:
    """Lines of a text as str.splitlines() gives them: no trailing empty line
    after a final line break, and no lines at all for an empty text."""
    stripped = F.regexp_replace(text, "(" + LINE_BREAK + ")\\z", "")
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")) \
        .otherwise(F.split(stripped, LINE_BREAK))


def word_count(text: Column) -> Column:
    """Whitespace-separated token count (bigint); 0 for empty or null text."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), 0)).cast("bigint"),
                      F.lit(0).cast("bigint"))


def first_words(text: Column, n: Column) -> Column:
    """The first n whitespace tokens of a text, joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), 0), 1,
                                F.greatest(n, F.lit(0)).cast("int")), " ")


def contains_any(text: Column, needles: list[str]) -> Column:
    """Case-sensitive substring test against a fixed list of needles."""
    cond = None
    for n in needles:
        c = text.contains(n)
        cond = c if cond is None else (cond | c)
    return cond


def keyword_hits(text: Column, keywords: Column, lowered: bool = False) -> Column:
    """How many keywords (array<string>) occur in text, case-insensitively.
    Pass ``lowered=True`` when ``text`` is already lower-case."""
    low = text if lowered else F.lower(text)
    return F.coalesce(F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
                      .cast("bigint"), F.lit(0).cast("bigint"))


def empty_to_null(c: Column) -> Column:
    return F.when(c == "", F.lit(None)).otherwise(c)
