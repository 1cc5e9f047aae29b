"""Benchmark decontamination by a prefix-filtered join of word windows.

Every benchmark item gives windows of ten consecutive words (one window of all
its words when it has fewer). A window's tokens are its shingles of
``SHINGLE`` words (all its words when it has fewer), ordered by how often they
occur in the documents. A document passage that holds a window holds all of
its shingles, so the prefix that must be joined is one token, the rarest.

A bitmap of those tokens (bounded size) sieves the documents' shingles in the
scan; the ones that pass are joined with the windows on the token, placed by
the token's offset, bounded by the document's ends, and compared word by word.
A hot token's rows are spread over salts. Words are runs of ASCII letters and
digits and of any character beyond ASCII, after A-Z are lower-cased.

Defined cases: null or empty text has no words and is clean; an item without
words has no window; repeated rows are judged alike; items that repeat count
each by their item_id; no benchmark leaves all documents clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import tokens
from faultline.llm.bitmaps import bitmap_of, may_hold
from faultline.llm.storage import trimmed, written

WINDOW = 10
SHINGLE = 5
SALTS = 16

ITEM = "item_id string, words string, size int, token long, offset int, width int"
ITEM_ARROW = pa.schema([("item_id", pa.string()), ("words", pa.string()), ("size", pa.int32()), ("token", pa.int64()), ("offset", pa.int32()), ("width", pa.int32())])
HIT = "row long, token long, place int, context string, before int"
HIT_ARROW = pa.schema([("row", pa.int64()), ("token", pa.int64()), ("place", pa.int32()), ("context", pa.string()), ("before", pa.int32())])
COUNT = "token long, n long"
COUNT_ARROW = pa.schema([("token", pa.int64()), ("n", pa.int64())])


def _words(column: pa.Array) -> tokens.Words:
    return tokens.hashed_words(column, lower=True, breaks=tokens.NOT_ALNUM)


def _token(words: tokens.Words, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; runs of another width hash differently."""
    return tokens.mix64(tokens.window_hashes(words.hashes, width) + np.uint64(width))


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each token of each window of each item."""
    for batch in batches:
        for part in tokens.slices(batch, "text", 1 << 20):
            words = _words(part.column("text"))
            by_width = {w: _token(words, w).view(np.int64) for w in range(1, SHINGLE + 1)}
            out = [[] for _ in ITEM_ARROW]
            for t, item in enumerate(part.column("item_id").to_pylist()):
                a, b = int(words.first[t]), int(words.first[t + 1])
                if a == b:
                    continue
                own = [words.data[words.starts[i]: words.ends[i]].tobytes().decode() for i in range(a, b)]
                size = min(WINDOW, b - a)
                width = min(SHINGLE, size)
                for s in range(b - a - size + 1):
                    text = " ".join(own[s:s + size])
                    for o in range(size - width + 1):
                        for column, value in zip(out, (item, text, size, int(by_width[width][a + s + o]), o, width)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, ITEM_ARROW)], schema=ITEM_ARROW)


def _passing(part: pa.RecordBatch, bitmaps: dict[int, np.ndarray]) -> Iterator[tuple[int, tokens.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """For each width: the words, the passing word numbers, their texts and their tokens."""
    words = _words(part.column("text"))
    for width, bitmap in bitmaps.items():
        token = _token(words, width)
        if not len(token):
            continue
        at = np.flatnonzero(may_hold(bitmap, token))
        text = np.searchsorted(words.first, at, "right") - 1
        inside = at + width <= words.first[text + 1]
        yield width, words, at[inside], text[inside], token[at[inside]].view(np.int64)


def _counter(sent):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.gathered(batches, "text", 4 << 20):
            for _, _, _, _, token in _passing(part, sent.value):
                values, n = np.unique(token, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(n.astype(np.int64))], schema=COUNT_ARROW)
    return trimmed(count)


def _finder(sent):
    """Passing tokens with the words around them, enough for any window that holds the token."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tokens.gathered(batches, "text", 4 << 20):
            rows = part.column("_row").to_numpy()
            for width, words, at, text, token in _passing(part, sent.value):
                reach = WINDOW - width
                low = np.maximum(at - reach, words.first[text])
                high = np.minimum(at + WINDOW, words.first[text + 1])
                for i in range(0, len(at), 4096):
                    j = slice(i, i + 4096)
                    context = [" ".join(words.data[words.starts[k]: words.ends[k]].tobytes().decode() for k in range(a, b)) for a, b in zip(low[j].tolist(), high[j].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(rows[text[j]]), pa.array(token[j]), pa.array((at[j] - words.first[text[j]]).astype(np.int32)),
                                                      pa.array(context, pa.string()), pa.array((at[j] - low[j]).astype(np.int32))], schema=HIT_ARROW)
    return trimmed(find)


def _bitmaps(keys: DataFrame) -> dict[int, np.ndarray]:
    """A bitmap of the tokens of each width that occurs (1 to ``SHINGLE``)."""
    widths = [r[0] for r in keys.select("width").distinct().collect()]
    return {w: bitmap_of(keys.where(F.col("width") == w).select("token").distinct(), "token") for w in sorted(widths)}


def occurrences(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, start, size, words): places of windows in documents; (words, item_id): the windows' items.

    ``docs`` has text and _row; a row for each place once, however many items share the window.
    """
    context = docs.sparkSession.sparkContext
    windows = written(items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(_item_windows, ITEM), "windows")
    bitmaps = _bitmaps(windows)
    docs = docs.select("_row", "text")
    counts = docs.select("text").mapInArrow(_counter(context.broadcast(bitmaps)), COUNT).groupBy("token").agg(F.sum("n").alias("n"))
    tokens_of = windows.select("words", "size", "token", "offset", "width").distinct().join(counts, "token", "left")
    # the rarest token of each window; a window with a token that occurs nowhere occurs nowhere
    prefix = (tokens_of.groupBy("words", "size").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset", "width")).alias("p"))
              .where("p.n > 0").select("words", "size", "p.token", "p.offset", "p.width"))
    prefix = written(prefix, "prefixes")
    found = docs.mapInArrow(_finder(context.broadcast(_bitmaps(prefix))), HIT).distinct().withColumn("salt", F.pmod(F.xxhash64("row", "place"), F.lit(SALTS)).cast("int"))
    salted = prefix.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    around = F.split("context", " ")
    begin = F.col("before") - F.col("offset")
    places = (found.join(salted, ["token", "salt"]).where((begin >= 0) & (begin + F.col("size") <= F.size(around)))
              .where(F.array_join(F.slice(around, begin + 1, F.col("size")), " ") == F.col("words"))
              .select("row", (F.col("place") - F.col("offset")).alias("start"), "size", "words").distinct())
    return places, windows.select("words", "item_id").distinct()


def _counter_of_words(columns: list[str]):
    """The columns and n_words; the text's bytes are classed by a table, which costs a fraction of a regular expression."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", 4 << 20):
                words = tokens.split_words(part.column("text"), True, tokens.NOT_ALNUM)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(np.diff(words.first).astype(np.int64))], names=[*columns, "n_words"])
    return trimmed(count)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """_row, n_hit, items (sorted ids as strings) of every contaminated row of ``docs`` (text, _row)."""
    places, owners = occurrences(docs, items)
    places = written(places, "places")
    # covered words: a text's spans, each place once, are summed where they begin a new stretch
    ordered = F.array_sort(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("stop"))))
    covered = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("reach")),
                          lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["reach"], x["start"]))).alias("n"),
                                                F.greatest(s["reach"], x["stop"]).alias("reach")))["n"]
    hit = places.groupBy("row").agg(ordered.alias("spans")).select("row", covered.cast("long").alias("n_hit"))
    salted = owners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    held = places.select("row", "words").distinct().withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    names = held.join(salted, ["words", "salt"]).select("row", "item_id").distinct().groupBy("row").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    return hit.join(names, "row").select(F.col("row").alias("_row"), "n_hit", "items")


def judge(docs: DataFrame, items: DataFrame, keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with n_words, n_hit, items and contaminated.

    Without ``keep_text`` the text is dropped before the hits are joined.
    """
    columns = [c for c in docs.columns if c not in ("_row", "n_words", "n_hit", "items", "contaminated")]
    rows = docs.select(*columns).withColumn("_row", F.xxhash64("text"))
    hits = contamination(rows, items).withColumnRenamed("_row", "_hit_row")
    if not keep_text:
        columns.remove("text")
    kept = [*columns, "_row"]
    schema = rows.select(*kept).schema.add("n_words", "long")
    counted = rows.mapInArrow(_counter_of_words(kept), schema)
    joined = counted.join(hits, F.col("_row") == F.col("_hit_row"), "left")
    return joined.select(*columns, "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                         F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.col("n_hit").isNotNull().alias("contaminated"))
