"""Exact substring deduplication with super-k-mer partitioning.

A window is 20 consecutive words. Its minimiser is the three-word run of least
hash in it; consecutive windows that share one travel as one packed string
(their words joined by a space) to the minimiser's bucket, where the windows'
hashes are sorted and equal ones compared word by word. Every window but the
first (smallest doc_id, then earliest start) covers words to remove.

Copies inside some 3 MB of text are found before the shuffle, which carries a
window once for each such piece, so a passage that a third of the documents
share does not pile up in its bucket. A bitmap of the documents with a
repeated window (bounded size) decides which texts meet their intervals in a
join; the join decides exactly.

Defined cases: null or empty text has no words; a text of fewer than 20 words
has no window and is kept; a null doc_id sorts before all others; rows with
the same doc_id are ordered by their text's hash, and rows equal in both are
one document (none is removed for the other's sake). Columns of the input
named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import tokens
from faultline.llm.bitmaps import bitmap_of, may_hold
from faultline.llm.storage import buckets_for, release_memory, trimmed, written

WINDOW = 20
MINIMISER = 3
PIECE = 3 << 20
LEVEL = 6
BUCKET_BYTES = 4 << 20
#: A bucket is counted in so many parts, one after the other, to hold a part's arrays only.
PARTS = 8
NO_ID = np.iinfo(np.int64).min

PACKED = "bucket int, texts binary, heads binary, doc long, row long, start int, stop int"
PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("texts", pa.binary()), ("heads", pa.binary()), ("doc", pa.int64()), ("row", pa.int64()),
                          ("start", pa.int32()), ("stop", pa.int32())])
SPANS = "row long, start int, stop int"
SPANS_ARROW = pa.schema([("row", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of each run of ``size`` values."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def window_starts(first: np.ndarray) -> np.ndarray:
    """The word numbers at which a window of some text starts."""
    n = np.diff(first)
    counts = np.maximum(n - WINDOW + 1, 0)
    total = int(counts.sum())
    at = np.repeat(first[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total) + at


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 of each run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined_words(words: tokens.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by one space each, and their first and last + 1 bytes there."""
    lengths = words.ends - words.starts
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(lengths) else np.empty(0, np.int64)
    out = np.full(int(lengths.sum() + len(lengths)), 0x20, np.uint8)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts] += 1
    inside[words.ends] -= 1
    mask = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    target = np.ones(len(out), bool)
    target[starts + lengths] = False
    out[target] = words.data[mask]
    return out.tobytes(), starts, starts + lengths


def repeats(hashes: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, same) -> np.ndarray:
    """Which windows have an equal one with a smaller (doc, row, start).

    ``same(i, j)`` compares the words of windows i and j; windows of equal hash
    that differ are told apart by it.
    """
    order = np.lexsort((start, row, doc, hashes))
    sorted_hashes = hashes[order]
    new = np.ones(len(order), bool)
    new[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    rest = ~new
    later, first = order[rest], head[rest]
    out = np.zeros(len(order), bool)
    strictly = (doc[later] != doc[first]) | (row[later] != row[first]) | (start[later] != start[first])
    later, first = later[strictly], first[strictly]
    equal = same(later, first)
    out[later[equal]] = True
    if not equal.all():  # different words of equal hash: each by its own first
        for h in np.unique(hashes[later[~equal]]):
            seen = {}
            for i in order[np.searchsorted(sorted_hashes, h, "left"): np.searchsorted(sorted_hashes, h, "right")]:
                for j in seen.get("heads", []):
                    if same(np.array([i]), np.array([j]))[0]:
                        out[i] = (doc[i], row[i], start[i]) != (doc[j], row[j], start[j])
                        break
                else:
                    seen.setdefault("heads", []).append(i)
                    out[i] = False
    return out


def _bytes_equal(text: bytes, begin: np.ndarray, end: np.ndarray):
    """A comparison of windows by their bytes in ``text``; runs of windows that move on together are compared at once."""
    def same(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(a), bool)
        if not len(a):
            return ok
        by = np.argsort(a, kind="stable")
        x, y = a[by], b[by]
        cut = np.ones(len(x), bool)
        # the next window is one word on, in both places, and overlaps this one
        cut[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1) | (begin[x[1:]] >= end[x[:-1]]) | (begin[y[1:]] >= end[y[:-1]])
        heads = np.flatnonzero(cut)
        tails = np.append(heads[1:], len(x))
        for i, j in zip(heads.tolist(), tails.tolist()):
            if text[begin[x[i]]: end[x[j - 1]]] == text[begin[y[i]]: end[y[j - 1]]]:
                ok[by[i:j]] = True
            elif j - i > 1:
                for k in range(i, j):
                    ok[by[k]] = text[begin[x[k]]: end[x[k]]] == text[begin[y[k]]: end[y[k]]]
        return ok
    return same


def _packer(buckets: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = pa.Codec("zstd", compression_level=LEVEL)
        for part in tokens.gathered(batches, "text", PIECE):
            words = tokens.hashed_words(part.column("text"))
            at = window_starts(words.first)
            if not len(at):
                continue
            text, first_byte, last_byte = joined_words(words)
            text_of = np.searchsorted(words.first, at, "right") - 1
            ids = part.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            rows = part.column("_row").to_numpy()
            start = (at - words.first[text_of]).astype(np.int32)
            doc, row = ids[text_of], rows[text_of]
            hashes = tokens.window_hashes(words.hashes, WINDOW)[at]
            begin, end = first_byte[at], last_byte[at + WINDOW - 1]
            again = repeats(hashes, doc, row, start, _bytes_equal(text, begin, end))
            out = [[] for _ in PACKED_ARROW]

            # repeats found here: spans of words, which only pass through; they are spread by their rows
            new_text = np.zeros(len(at), bool)
            new_text[1:] = text_of[1:] != text_of[:-1]
            for i, j in zip(*_runs_within(again, new_text)):
                for column, value in zip(out, (int(row[i] % buckets), None, None, doc[i], row[i], start[i], start[j - 1] + WINDOW)):
                    column.append(value)

            # the others: super-k-mers, by the word number of their minimiser
            small = tokens.window_hashes(words.hashes, MINIMISER, 0xD1342543DE82EF95)
            least = sliding_min(small, WINDOW - MINIMISER + 1)[at]
            left = np.flatnonzero(~again)
            if len(left):
                cut = np.ones(len(left), bool)
                cut[1:] = (left[1:] != left[:-1] + 1) | new_text[left[1:]] | (least[left[1:]] != least[left[:-1]])
                heads = left[cut]
                tails = left[np.append(np.flatnonzero(cut)[1:], len(left)) - 1]
                place = (tokens.mix64(least[heads]) % np.uint64(buckets * PARTS)).astype(np.int64)
                by = np.argsort(place, kind="stable")
                place = place[by]
                edges = np.searchsorted(place, np.arange(buckets + 1) * PARTS)
                b0, e0 = begin[heads[by]].tolist(), end[tails[by]].tolist()
                for b in np.flatnonzero(np.diff(edges)).tolist():
                    i, j = edges[b], edges[b + 1]
                    packed = b"\n".join([text[x:y] for x, y in zip(b0[i:j], e0[i:j])])
                    h = heads[by[i:j]]
                    parts = np.searchsorted(place[i:j], b * PARTS + np.arange(PARTS + 1))
                    about = np.concatenate([parts, doc[h], row[h], start[h].astype(np.int64)]).tobytes()
                    for column, value in zip(out, (b, len(packed).to_bytes(8, "little") + zstd.compress(packed, asbytes=True),
                                                   zstd.compress(about, asbytes=True), None, None, j - i, None)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, PACKED_ARROW)], schema=PACKED_ARROW)
    return trimmed(pack)


def _runs_within(flags: np.ndarray, new_text: np.ndarray) -> tuple[list, list]:
    """Runs of flagged windows that stay in one text."""
    i, j = runs(flags)
    inner = np.flatnonzero(new_text & flags)
    inner = inner[flags[inner - 1]]
    return np.sort(np.concatenate([i, inner])).tolist(), np.sort(np.concatenate([j, inner])).tolist()


def _part_spans(texts: list[bytes], doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Spans (row, start, stop) of the repeated windows of some super-k-mers, given with their documents, rows and first words."""
    whole = b"\n".join(texts)
    data = np.frombuffer(whole, np.uint8)
    breaks = np.concatenate([[-1], np.flatnonzero(data == 0x0A), [len(data)]])
    offsets = pa.py_buffer(np.append(breaks[:-1] + 1, len(data)).astype(np.int64))  # a string holds its closing line feed, which is no word
    words = tokens.hashed_words(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(breaks) - 1, [None, offsets, pa.py_buffer(whole)]))
    at = window_starts(words.first)
    string = np.searchsorted(words.first, at, "right") - 1
    doc, row, start = doc[string], row[string], start[string] + at - words.first[string]
    begin, end, hashes = words.starts[at], words.ends[at + WINDOW - 1], tokens.window_hashes(words.hashes, WINDOW)[at]
    del words
    again = repeats(hashes, doc, row, start, _bytes_equal(whole, begin, end))
    new = np.zeros(len(at), bool)
    new[1:] = string[1:] != string[:-1]
    i, j = (np.array(x, np.int64) for x in _runs_within(again, new))
    return [row[i], start[i], start[j - 1] + WINDOW]


def _count(table: pa.Table) -> pa.Table:
    """One bucket's super-k-mers -> spans of the repeated windows in it, and the spans that came along.

    Windows of one minimiser are in one part, and the parts are counted one after the other.
    """
    known = table.filter(pc.is_null(table.column("texts")))
    blocks = []
    packed = table.filter(pc.is_valid(table.column("texts")))
    for blob, about, n in zip(packed.column("texts").to_pylist(), packed.column("heads").to_pylist(), packed.column("start").to_pylist()):
        numbers = np.frombuffer(pa.decompress(about, decompressed_size=8 * (PARTS + 1 + 3 * n), codec="zstd", asbytes=True), np.int64)
        lines = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
        ends = np.append(np.flatnonzero(np.frombuffer(lines, np.uint8) == 0x0A), len(lines))
        blocks.append((lines, np.concatenate([[0], ends + 1]), numbers[:PARTS + 1], *numbers[PARTS + 1:].reshape(3, n)))
    found = []
    for k in range(PARTS):
        own = [(lines[at[p[k]]:at[p[k + 1]] - 1], doc[p[k]:p[k + 1]], row[p[k]:p[k + 1]], start[p[k]:p[k + 1]]) for lines, at, p, doc, row, start in blocks if p[k] < p[k + 1]]
        if own:
            texts, *places = zip(*own)
            found.append(_part_spans(texts, *map(np.concatenate, places)))
    spans = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
    out = pa.table([pa.array(np.asarray(c, np.int64)).cast(f.type) for c, f in zip(spans, SPANS_ARROW)], schema=SPANS_ARROW)
    out = pa.concat_tables([out, known.select(["row", "start", "stop"])])
    del blocks, found, own
    release_memory()
    return out


def _removed(part: pa.RecordBatch, columns: list[str]) -> pa.RecordBatch:
    """The columns, n_words, n_removed and kept_text; ``_spans`` holds (start, stop) pairs or null."""
    words = tokens.split_words(part.column("text"))
    n = np.diff(words.first)
    gone = np.zeros(len(words.starts) + 1, np.int64)
    if "_spans" in part.schema.names:
        for t, own in enumerate(part.column("_spans").to_pylist()):
            for span in own or ():
                gone[words.first[t] + span["start"]] += 1
                gone[words.first[t] + span["stop"]] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    counts = np.concatenate([[0], np.cumsum(gone)])
    removed = counts[words.first[1:]] - counts[words.first[:-1]]
    text, begin, end = joined_words(words)
    kept = []
    for t in range(part.num_rows):
        a, b = words.first[t], words.first[t + 1]
        if a == b:
            kept.append("")
            continue
        i, j = runs(~gone[a:b])
        kept.append(b" ".join([text[begin[a + x]: end[a + y - 1]] for x, y in zip(i.tolist(), j.tolist())]).decode())
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())],
                                      names=[*columns, "n_words", "n_removed", "kept_text"])


def _remover(columns: list[str]):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", 2 << 20):
                yield _removed(part, columns)
    return trimmed(remove)


def _of_bitmap(columns: list[str], sent, hit: bool):
    """Rows that may have a repeated window as they are, or all others finished at once."""
    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", 2 << 20):
                part = part.filter(pa.array(may_hold(sent.value, part.column("_row").to_numpy()) == hit))
                if part.num_rows:
                    yield part if hit else _removed(part, columns)
    return trimmed(choose)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(row, start, stop): spans of words covered by repeated windows; ``docs`` has doc_id, text and _row."""
    buckets = max(buckets_for(docs, "text", BUCKET_BYTES), 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_row").mapInArrow(_packer(buckets), PACKED)
    return packed.groupBy("bucket").applyInArrow(_count, SPANS)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with n_words, n_removed and kept_text (the kept words joined by a space)."""
    columns = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_text", "_row", "_spans")]
    rows = docs.select(*columns).withColumn("_row", F.xxhash64("doc_id", "text"))
    spans = written(repeated_spans(rows), "repeated-spans")
    bitmap = docs.sparkSession.sparkContext.broadcast(bitmap_of(spans.select("row").distinct(), "row"))

    own = spans.groupBy(F.col("row").alias("_span_row")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))  # at most a text's windows
    hits = rows.mapInArrow(_of_bitmap(columns, bitmap, True), rows.schema)
    hits = hits.join(own, F.col("_row") == F.col("_span_row"), "left").select(*columns, "_spans")
    schema = T.StructType([*[rows.schema[c] for c in columns], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return hits.mapInArrow(_remover(columns), schema).unionByName(rows.mapInArrow(_of_bitmap(columns, bitmap, False), schema))
