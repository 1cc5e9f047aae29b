"""Alignment of two tokenizers' tokens over a corpus, by inverted pair bitmaps.

Every text is encoded by a byte-level BPE (A) and by a sentencepiece model (B).
A token of A and one of B are linked where their bytes overlap; the byte offsets
where tokens of both end cut the text into groups. How many documents hold an
id pair linked is counted over the corpus, and each document gets its links'
counts back.

The index is inverted: some ``PIECE_BYTES`` of texts are a piece, and a piece
keeps for each of its id pairs a compressed bitmap of its documents, in planes of
the multiplicity (`pair_bitmaps`). A pair's document count is the popcount of
its planes' union, its link count that of the planes by weight. Only pairs with
these counts are shuffled and summed over the corpus. The counts then return to
the postings, in ``BUCKETS`` by A id so that an A id's highest count is decided
in one place; postings add them up by document.

Texts are encoded in segments: a cut before each space that follows a character
that is no white space. No token of A, whose pattern lets a space begin a token
only, and none of B, whose pieces have the space mark only in front, spans such a
cut, so segments give the whole text's tokens (a vocabulary with other pieces is
refused). A task encodes and aligns a segment once. Segments are told apart by
64-bit hashes.

Defined cases: a text that is null or empty, or whose joined tokens of A or B are
not the bytes of space+text, has no tokens: zeros and an empty digest. Strings of
special tokens in a text are plain text. Repeated rows, rows with equal or null
ids are documents of their own and count each. An empty table gives no rows.
Texts and segments of any length are encoded whole. Other columns of the input are
not looked at.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm import pair_bitmaps as bitmaps
from faultline.llm import tokens
from faultline.llm.packing import pack, unpack
from faultline.llm.storage import written

BUCKETS = 32
PIECES_A_SLICE = 256
PIECE_BYTES = 4 << 20
MOST_SEGMENTS = 400_000
CALL_BYTES = 1 << 15
ID_BITS = 20
SPACE = 0x20


def byte_of_letter() -> dict[str, int]:
    """Byte-level BPE writes each byte as a visible letter: itself where printable, else the next one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoders:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = byte_of_letter()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{b_path} has pieces with an inner space: texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"ids beyond {ID_BITS} bits")

    def encode(self, texts: list[bytes]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B for texts that begin with a space (B adds its own)."""
        spelled = [t.decode() for t in texts]
        return [e.ids for e in self.a.encode_batch_fast(spelled, add_special_tokens=False)], self.b.encode([t[1:] for t in spelled], num_threads=1)


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> Encoders:
    return Encoders(a_path, b_path)


def surely_no_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is surely no white space."""
    b1 = data[at - 1]
    b2, b3, b4 = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (2, 3, 4))
    inner2, inner3 = (b2 >= 0x80) & (b2 < 0xC0), (b3 >= 0x80) & (b3 < 0xC0)
    # white space of two bytes begins C2, of three E1 to E3
    wide = ((b2 >= 0xC3) & (b2 <= 0xDF)) | (inner2 & (b3 >= 0xE4) & (b3 <= 0xEF)) | (inner2 & inner3 & (b4 >= 0xF0))
    return ((b1 > SPACE) & (b1 < 0x7F)) | ((b1 >= 0x80) & wide)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where a segment begins inside a text: at a space after a character that is surely no white space."""
    at = np.flatnonzero(data[1:] == SPACE) + 1
    return at[surely_no_space(data, at)]


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    if not len(sizes):
        return np.empty(0, np.int64)
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))


class Side:
    """The tokens of one tokenizer: their bytes, and their ids as text before each mark that can follow."""

    def __init__(self, spelled: list[bytes], last: str):
        self.sizes = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.inner = np.array([f"{i}," for i in range(len(spelled))], object)
        self.last = np.array([f"{i}{last}" for i in range(len(spelled))], object)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.first[ids], self.sizes[ids])]


class Segments:
    """Segments met in a task: counts, groups as text, and links as distinct pairs with their multiplicity."""

    def __init__(self, coders: Encoders):
        self.coders, self.a, self.b = coders, Side(coders.a_bytes, "|"), Side(coders.b_bytes, ";")
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.groups: list[str] = []
        self.counts = np.empty((0, 4), np.int64)  # tokens of A, of B, groups, links; -1 without valid tokens
        self.first, self.pairs, self.times = np.zeros(1, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: tuple[list, list, list, list] = ([], [], [], [])

    def known(self, hashes: np.ndarray, spelled) -> np.ndarray:
        """The places of segments by hash; ``spelled`` gives the bytes of the i-th."""
        if len(self.place) + len(hashes) > MOST_SEGMENTS:
            self.forget()
        keys = hashes.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.place]
        if new:
            base = len(self.groups)
            self.place.update((keys[new[i]], base + k) for k, i in enumerate(self.add([spelled(i) for i in new])))
        return np.fromiter((self.place[h] for h in keys), np.int64, len(keys))

    def add(self, segments: list[bytes]) -> list[int]:
        """Encode and store; returns the segments' order in the store.

        Segments side by side are cut like one text, so many are encoded by one
        call; one that ends in white space is a text of its own, and so are those
        of a text whose tokens are not its bytes.
        """
        data = np.frombuffer(b"".join(segments), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
        sure = surely_no_space(data, ends)
        order, alone = [], np.flatnonzero(~sure).tolist()
        chosen = np.flatnonzero(sure)
        sizes = np.diff(ends, prepend=0)[chosen]
        borders = np.flatnonzero(np.diff(np.cumsum(sizes) // CALL_BYTES, prepend=-1)).tolist() + [len(chosen)]
        chunks = [chosen[i:j].tolist() for i, j in zip(borders[:-1], borders[1:])]
        texts = [b"".join([segments[i] for i in own]) for own in chunks]
        for own, text, a, b in zip(chunks, texts, *self.coders.encode(texts)):
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            if self.store(np.frombuffer(text, np.uint8), np.cumsum([len(segments[i]) for i in own]), a, b):
                order += own
            else:
                alone += own
        for i, a, b in zip(alone, *self.coders.encode([segments[i] for i in alone])):
            if not self.store(np.frombuffer(segments[i], np.uint8), np.array([len(segments[i])]), np.array(a, np.int64), np.array(b, np.int64)):
                self.groups.append("")
                self.keep([np.full((1, 4), -1)], [np.zeros(1, np.int64)], [], [])
            order.append(i)
        self.flush()
        return order

    def keep(self, counts, sizes, pairs, times) -> None:
        for kept, more in zip(self.waiting, (counts, sizes, pairs, times)):
            kept += more

    def flush(self) -> None:
        counts, sizes, pairs, times = self.waiting
        self.counts = np.concatenate([self.counts, *counts])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate([np.empty(0, np.int64), *sizes]))])
        self.pairs, self.times = np.concatenate([self.pairs, *pairs]), np.concatenate([self.times, *times])
        self.waiting = ([], [], [], [])

    def store(self, data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
        """Align the segments that end at ``ends`` of ``data``; False if some token spans an end or the tokens aren't the bytes."""
        if not (np.array_equal(self.a.joined(a), data) and np.array_equal(self.b.joined(b), data)):
            return False
        ea, eb = np.cumsum(self.a.sizes[a]), np.cumsum(self.b.sizes[b])
        n = len(ends)
        to_a, to_b = np.searchsorted(ea, ends, "right"), np.searchsorted(eb, ends, "right")
        if not ((ea[to_a - 1] == ends) & (eb[to_b - 1] == ends)).all():
            return False
        low = np.searchsorted(eb, ea - self.a.sizes[a], "right")
        wide = np.searchsorted(eb, ea, "left") - low + 1
        na, nb = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        segment = np.repeat(np.arange(n), na)
        links = (np.repeat(a, wide) << ID_BITS) | b[ranges(low, wide)]
        of = np.repeat(segment, wide)
        order = np.lexsort((links, of))
        links, of = links[order], of[order]
        first = np.flatnonzero((np.diff(links, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
        # groups end where both have an end; tokens as text, those of A before those of B in each group
        at = np.searchsorted(eb, ea, "left")
        a_last = eb[at] == ea
        common = ea[a_last]
        b_last = np.zeros(len(b), bool)
        b_last[at[a_last]] = True
        group_a, group_b = np.searchsorted(common, ea, "left"), np.searchsorted(common, eb, "left")
        before_b = np.concatenate([[0], np.searchsorted(eb, common, "right")])
        after_a = np.searchsorted(ea, common, "right")
        spelled = np.empty(len(a) + len(b), object)
        spelled[np.arange(len(a)) + before_b[group_a]] = np.where(a_last, self.a.last[a], self.a.inner[a])
        spelled[np.arange(len(b)) + after_a[group_b]] = np.where(b_last, self.b.last[b], self.b.inner[b])
        spelled, stops = spelled.tolist(), (to_a + to_b).tolist()
        self.groups += ["".join(spelled[i:j])[:-1] for i, j in zip([0, *stops], stops)]
        counts = np.column_stack([na, nb, np.diff(np.searchsorted(common, ends, "right"), prepend=0), np.bincount(segment, wide, n).astype(np.int64)])
        self.keep([counts], [np.bincount(of[first], minlength=n)], [links[first]], [np.diff(first, append=len(links))])
        return True


def bucket_of(pairs: np.ndarray) -> np.ndarray:
    return (tokens.mix64((pairs >> ID_BITS).astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


POSTINGS = "piece string, bucket int, docs int, pairs binary, at array<binary>, value array<binary>, ids binary, numbers binary, sha array<string>"
POSTINGS_ARROW = pa.schema([("piece", pa.string()), ("bucket", pa.int32()), ("docs", pa.int32()), ("pairs", pa.binary()), ("at", pa.list_(pa.binary())), ("value", pa.list_(pa.binary())),
                            ("ids", pa.binary()), ("numbers", pa.binary()), ("sha", pa.list_(pa.string()))])


def _piece(rows: pa.RecordBatch, segments: Segments) -> pa.RecordBatch:
    """A piece's documents (bucket -1), and its postings by bucket."""
    raw, offsets = tokens.text_bytes(rows.column("text"))
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes > 0)
    # each text after a space
    begins = np.concatenate([[0], np.cumsum(sizes[full] + 1)])
    data = np.full(int(begins[-1]), SPACE, np.uint8)
    data[ranges(begins[:-1] + 1, sizes[full])] = raw[ranges(offsets[full], sizes[full])]
    border = np.zeros(len(data) + 2, bool)
    border[begins] = True
    inner = cuts(data) if len(data) else begins[:0]
    begun = border.copy()
    begun[inner[~border[inner + 1]]] = True  # a space that ends a text is no segment of its own: B has no token for an empty text
    starts = np.flatnonzero(begun[:len(data)])
    words = tokens.Words(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts, np.searchsorted(starts, begins))
    hashes, chosen, inverse = np.unique(tokens.hash_words(words), return_index=True, return_inverse=True)
    place = segments.known(hashes, lambda i: data[starts[chosen[i]]:words.ends[chosen[i]]].tobytes())[inverse]
    doc = words.text_of
    counts = segments.counts[place]
    bad = np.bincount(doc, counts[:, 0] < 0, len(full)) > 0
    numbers = np.zeros((rows.num_rows, 4), np.int64)
    for k in range(4):
        numbers[full, k] = np.where(bad, 0, np.bincount(doc, counts[:, k], len(full)).astype(np.int64))
    sha = [""] * rows.num_rows
    first, spelled = words.first.tolist(), place.tolist()
    for k, i in enumerate(full.tolist()):
        if not bad[k]:
            sha[i] = hashlib.sha256(";".join([segments.groups[j] for j in spelled[first[k]:first[k + 1]]]).encode()).hexdigest()
    ids = rows.column("doc_id").cast(pa.int64())
    piece = uuid.uuid4().hex
    out = [[piece, -1, rows.num_rows, None, None, None, pack(ids.fill_null(0).to_numpy()), pack(np.column_stack([numbers, ids.is_valid().to_numpy(zero_copy_only=False)]).ravel()), sha]]
    # postings: each (document, segment) once with its times, then its pairs
    held = ~bad[doc]
    keys, n = np.unique(full[doc[held]] * max(1, len(segments.groups)) + place[held], return_counts=True)
    of, at = np.divmod(keys, max(1, len(segments.groups)))
    wide = segments.first[at + 1] - segments.first[at]
    where = ranges(segments.first[at], wide)
    pairs, times, of = segments.pairs[where], segments.times[where] * np.repeat(n, wide), np.repeat(of, wide)
    own, row = np.unique(pairs, return_inverse=True)
    order = np.argsort(bucket_of(own), kind="stable")
    own, rank = own[order], np.argsort(order)
    cells, cell = np.unique(rank[row] * rows.num_rows + of, return_inverse=True)
    times = np.bincount(cell, times, len(cells)).astype(np.int64)
    row, of = np.divmod(cells, max(1, rows.num_rows))
    edges = np.searchsorted(bucket_of(own), np.arange(BUCKETS + 1))
    cell_edges = np.searchsorted(row, edges)
    width = -(-rows.num_rows // 8)
    for b in np.flatnonzero(np.diff(edges)).tolist():
        i, j = cell_edges[b], cell_edges[b + 1]
        planes = bitmaps.planes_of(row[i:j] - edges[b], of[i:j], times[i:j], width)
        out.append([piece, b, rows.num_rows, pack(np.diff(own[edges[b]:edges[b + 1]], prepend=0)), *bitmaps.packed_planes(planes), None, None, None])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), POSTINGS_ARROW)], schema=POSTINGS_ARROW)


def _postings(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = None
        for rows in tokens.gathered(batches, "text", PIECE_BYTES):
            segments = segments or Segments(encoders(a_path, b_path))
            yield _piece(rows, segments)
    return run


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, docs, links) of a task's postings."""
    kept: list[tuple[np.ndarray, ...]] = []

    def summed() -> pa.RecordBatch:
        pairs, place = np.unique(np.concatenate([k[0] for k in kept]), return_inverse=True)
        sums = [bitmaps.exact_sums(place, np.concatenate([k[c] for k in kept]), len(pairs)) for c in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(pairs), *map(pa.array, sums)], names=["pair", "docs", "links"])

    for batch in batches:
        for r in batch.to_pylist():
            pairs, width = np.cumsum(unpack(r["pairs"], np.int64)), -(-r["docs"] // 8)
            planes = bitmaps.unpacked_planes(r["at"], r["value"])
            links = sum(p.popcounts(width, len(pairs)) << j for j, p in enumerate(planes))
            kept.append((pairs, bitmaps.Plane.union(planes).popcounts(width, len(pairs)), links))
            if sum(len(k[0]) for k in kept) > 1 << 21:
                yield summed()
                kept.clear()
    if kept:
        yield summed()


COUNTS = "bucket int, known binary, counts binary, best binary"
COUNTS_ARROW = pa.schema([("bucket", pa.int32()), ("known", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])


def _packed_counts(table: pa.Table) -> pa.Table:
    """A bucket's pairs with their counts in one row: as many as the vocabularies link, however many documents there are."""
    table = table.sort_by("pair")
    pairs = table.column("pair").to_numpy()
    row = [int(bucket_of(pairs[:1])[0]), pack(np.diff(pairs, prepend=0)), pack(table.column("docs").to_numpy()), pack(table.column("best").to_numpy().astype(np.uint8))]
    return pa.table([pa.array([v], f.type) for v, f in zip(row, COUNTS_ARROW)], schema=COUNTS_ARROW)


SCORES = "piece string, bucket int, docs int, best binary, total binary"
SCORES_ARROW = pa.schema([("piece", pa.string()), ("bucket", pa.int32()), ("docs", pa.int32()), ("best", pa.binary()), ("total", pa.binary())])


def _returned(postings: pa.Table, counts: pa.Table) -> pa.Table:
    """Postings of one bucket and the counts of its pairs -> what each piece's documents get from them."""
    out = []
    for c in counts.to_pylist():
        known, count, best = np.cumsum(unpack(c["known"], np.int64)), unpack(c["counts"], np.int64), unpack(c["best"], np.uint8).astype(np.int64)
        for k in range(postings.num_rows):
            r = postings.slice(k, 1).to_pylist()[0]
            at, width = np.searchsorted(known, np.cumsum(unpack(r["pairs"], np.int64))), -(-r["docs"] // 8)
            total, high = np.zeros(r["docs"], np.int64), np.zeros(r["docs"], np.int64)
            for j, plane in enumerate(bitmaps.unpacked_planes(r["at"], r["value"])):
                row, doc = plane.bits(width)
                total += bitmaps.exact_sums(doc, count[at[row]], r["docs"]) << j
                high += bitmaps.exact_sums(doc, best[at[row]], r["docs"]) << j
            out.append([r["piece"], r["bucket"], r["docs"], pack(high), pack(total)])
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), SCORES_ARROW)] if out else [pa.array([], f.type) for f in SCORES_ARROW], schema=SCORES_ARROW)


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
ALIGNED_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])


def _merged(table: pa.Table) -> pa.Table:
    """A piece's documents with the sums over its buckets."""
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    head, rest = rows[0], rows[1:]
    best, total = (sum((unpack(r[c], np.int64) for r in rest), np.zeros(head["docs"], np.int64)) for c in ("best", "total"))
    numbers = unpack(head["numbers"], np.int64).reshape(-1, 5)
    ids = pa.array(unpack(head["ids"], np.int64), mask=numbers[:, 4] == 0)
    return pa.table([ids, *(pa.array(numbers[:, k]) for k in range(4)), pa.array(best), pa.array(total), pa.array(head["sha"], pa.string())], schema=ALIGNED_ARROW)


def pair_counts(postings: DataFrame) -> DataFrame:
    """(pair, docs, links, best): in how many documents a pair is linked and how often, and whether no pair of its A id is in more."""
    rows = postings.where("bucket >= 0").select("docs", "pairs", "at", "value").mapInArrow(_pair_counts, "pair long, docs long, links long")
    rows = rows.groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links"))
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", ID_BITS)))  # as many rows as B ids at most
    return rows.withColumn("best", F.col("docs") == most)


def postings_of(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """The inverted index of ``docs`` (doc_id, text), written once."""
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_postings(a_path, b_path), POSTINGS), "pair-postings")


def aligned(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``."""
    postings = postings_of(docs, a_path, b_path)
    counts = written(pair_counts(postings), "pair-counts")
    packed = counts.mapInArrow(_with_bucket, "bucket int, pair long, docs long, best boolean").groupBy("bucket").applyInArrow(_packed_counts, COUNTS)
    slices = max(1, -(-postings.where("bucket < 0").count() // PIECES_A_SLICE))
    left = postings.where("bucket >= 0").select("piece", "bucket", "docs", "pairs", "at", "value").withColumn("slice", F.pmod(F.xxhash64("piece"), F.lit(slices)).cast("int"))
    right = packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    scores = left.groupBy("bucket", "slice").cogroup(right.groupBy("bucket", "slice")).applyInArrow(_returned, SCORES)
    heads = postings.where("bucket < 0").select("piece", "bucket", "docs", F.lit(None).cast("binary").alias("best"), F.lit(None).cast("binary").alias("total"), "ids", "numbers", "sha")
    return heads.unionByName(scores, allowMissingColumns=True).groupBy("piece").applyInArrow(_merged, ALIGNED)


def _with_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bucket = bucket_of(batch.column("pair").to_numpy()).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), *(batch.column(c) for c in ("pair", "docs", "best"))], names=["bucket", "pair", "docs", "best"])
