"""Language-model scores from subword lattices.

An existing vocabulary gives pieces and scores. Every way to cut a word into
pieces is a path through its lattice; the paths' weights are summed by a
forward recursion in log space, so a text's probability is the marginal over
all segmentations. The vocabulary's scores are the first weights; ``rounds``
expectation steps over all training documents then bring them to the corpus
(the pieces stay as they are, and the vocabulary's weights remain as a prior).
A word seen in training has one more path, an arc of its own, with the word's
frequency; the share of words seen once is what the pieces' paths get. Weights
and word arcs are kept for each of the ``parts`` largest values of a column
(lang) and one for the rest, and a text's probability is the sum over these
parts: the text's own value of the column is not looked at.

Beside it stands a word model with additive smoothing. All counts are exact
over all training documents: a piece of some 4 MB of text sends each of its
distinct words once, with its counts there, to the word's bucket, and gets the
word's totals back; so a word that a third of all tokens are costs no more
than any other.

Defined cases: null or empty text has the end alone; repeated rows are scored
alike and counted each; a row with a null doc_id trains; without training
documents the pieces alone weigh and no word is known. Words are 64-bit hashes
in the counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import tokens
from faultline.llm.labelled import held_out
from faultline.llm.packing import pack, unpack
from faultline.llm.storage import buckets_for, trimmed, written

SPACE = "▁".encode()
PRIOR = 1_000.0
FIXED = 1 << 10
MOST_WORDS = 30_000
SLOT_BITS = 20
STEP_BYTES = 1 << 20
BUCKET_BYTES = 16 << 20


def vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces as bytes and their log weights.

    A unigram vocabulary's scores are log probabilities. One that was built by
    merges has ranks as scores, and rank r weighs 1 / (r + 3). Single bytes that
    are no piece of their own weigh least.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights: dict[bytes, float] = {}
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    ranks = all(float(s).is_integer() for s in scores.values())
    for piece, score in scores.items():
        if score > -1e8:
            weights[piece.encode()] = -np.log(3.0 - score) if ranks else score
    least = min(weights.values(), default=0.0)
    for b in range(256):
        weights.setdefault(bytes([b]), least - 3.0)
    logs = np.array([*weights.values()])
    return [*weights], logs - np.logaddexp.reduce(logs)


class Lattice:
    """Forward and backward sums over the segmentations of many words at once."""

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        """``logs``: a row of the pieces' log weights for each part."""
        self.logs, self.longest = logs, max(map(len, pieces))
        self.values, self.odd = tokens._base(0)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        worth = self.values[np.frombuffer(b"".join(pieces), np.uint8)] * tokens._powers(self.odd, tokens.SPAN, False)[place]
        self.hashes = np.add.reduceat(worth, np.cumsum(sizes) - sizes)
        # a slot by the hash's high bits, and from each piece the next one of its slot
        slot = self._slot(self.hashes)
        order = np.argsort(slot, kind="stable")
        self.table, self.after = np.full(1 << SLOT_BITS, -1, np.int32), np.full(len(pieces) + 1, -1, np.int32)
        same = slot[order][1:] == slot[order][:-1]
        self.after[order[1:][same]] = order[:-1][same]
        self.table[slot[order]] = order  # the last of a slot stays

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)

    def pieces_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, piece) of the hashes that are pieces."""
        piece = self.table[self._slot(h)]
        at = np.flatnonzero(piece >= 0)
        piece = piece[at]
        rows, found = [], []
        while len(at):
            hit = self.hashes[piece] == h[at]
            rows.append(at[hit])
            found.append(piece[hit])
            piece = self.after[piece]
            more = piece >= 0
            at, piece = at[more], piece[more]
        return np.concatenate(rows or [at]), np.concatenate(found or [piece])

    def arcs(self, letters: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, words, pieces) of words of one length, a row each; by their ends."""
        n, size = letters.shape
        sums = np.zeros((size + 1, n), np.uint64)
        powers, inverse = tokens._powers(self.odd, tokens.SPAN, False), tokens._powers(self.odd, tokens.SPAN, True)
        np.cumsum(self.values[letters.T] * powers[:size, None], axis=0, out=sums[1:])
        out = []
        for end in range(1, size + 1):
            for begin in range(max(0, end - self.longest), end):
                if 0 < begin < len(SPACE) and end > begin + 1:
                    continue  # inside the space mark only single bytes are pieces
                rows, piece = self.pieces_of((sums[end] - sums[begin]) * inverse[begin])
                if len(rows):
                    out.append((begin, end, rows, piece))
        return out

    def forward(self, arcs, n: int, size: int, part: int) -> np.ndarray:
        logs = self.logs[part]
        total = np.full((size + 1, n), -np.inf)
        total[0] = 0.0
        for begin, end, rows, piece in arcs:
            total[end, rows] = np.logaddexp(total[end, rows], total[begin, rows] + logs[piece])
        return total

    def expected(self, arcs, forward: np.ndarray, counts: np.ndarray, out: np.ndarray, part: int) -> None:
        """Adds to ``out`` how often each piece is used, weighted by the words' counts."""
        logs = self.logs[part]
        size = len(forward) - 1
        back = np.full_like(forward, -np.inf)
        back[size] = 0.0
        for begin, end, rows, piece in reversed(arcs):
            through = logs[piece] + back[end, rows]
            back[begin, rows] = np.logaddexp(back[begin, rows], through)
            out += np.bincount(piece, np.exp(forward[begin, rows] + through - forward[size, rows]) * counts[rows], len(out))

    def batches(self, words: tokens.Words, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions in chosen, letters with the space mark) of words of one length."""
        lengths = (words.ends - words.starts)[chosen]
        order = np.argsort(lengths, kind="stable")
        edges = np.flatnonzero(np.diff(lengths[order], prepend=-1, append=-1))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            size = int(lengths[order[i]])
            step = max(1, min(MOST_WORDS, 2_000_000 // (size + 3)))
            for k in range(i, j, step):
                rows = order[k:min(j, k + step)]
                letters = np.empty((len(rows), size + len(SPACE)), np.uint8)
                letters[:, :len(SPACE)] = np.frombuffer(SPACE, np.uint8)
                letters[:, len(SPACE):] = words.data[words.starts[chosen[rows]][:, None] + np.arange(size)]
                yield rows, letters

    def pieces_of_long(self, letters: np.ndarray) -> Iterator[np.ndarray]:
        """Words as they are, or a very long one in runs of ``LONG_WORD`` bytes whose lattices meet at their ends."""
        for i in range(0, letters.shape[1], tokens.LONG_WORD):
            yield letters[:, i:i + tokens.LONG_WORD]

    def log_probabilities(self, words: tokens.Words, chosen: np.ndarray) -> np.ndarray:
        """The chosen words' log probabilities, a row for each part."""
        result = np.zeros((len(self.logs), len(chosen)))
        for rows, letters in self.batches(words, chosen):
            for run in self.pieces_of_long(letters):
                arcs = self.arcs(run)
                for part in range(len(self.logs)):
                    result[part, rows] += self.forward(arcs, *run.shape, part)[-1]
        return result

    def count(self, words: tokens.Words, chosen: np.ndarray, counts: np.ndarray, out: np.ndarray, part: int) -> None:
        """Adds to ``out`` the expected uses of the pieces in the chosen words of one part."""
        for rows, letters in self.batches(words, chosen):
            for run in self.pieces_of_long(letters):
                arcs = self.arcs(run)
                self.expected(arcs, self.forward(arcs, *run.shape, part), counts[rows], out, part)


class Known:
    """Words met in a task, sorted by hash, with values each; forgotten when there are more than ``most``."""

    def __init__(self, wide: int = 0, most: int = 500_000):
        self.most, self.wide = most, wide
        self.hashes, self.values = np.empty(0, np.uint64), np.empty((0, wide), np.float32)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, whether it holds the hash) for each of the hashes."""
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return at, self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)

    def add(self, hashes: np.ndarray, values: np.ndarray) -> None:
        if len(self.hashes) + len(hashes) > self.most:
            self.hashes, self.values = np.empty(0, np.uint64), np.empty((0, self.wide), np.float32)
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.values = np.insert(self.hashes, at, hashes), np.insert(self.values, at, values, axis=0)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, word, n): the distinct words of each piece of some 4 MB of text."""
    for rows in tokens.gathered(batches, "text"):
        words = tokens.hashed_words(rows.column("text"), lower=True)
        part_of = rows.column("part").to_numpy()[words.text_of]
        for part in np.unique(part_of).tolist():
            own = np.flatnonzero(part_of == part)
            _, first, n = np.unique(words.hashes[own], return_index=True, return_counts=True)
            chosen = own[first]
            # a few MB of words at a time, as a word may be as long as a text
            cuts = np.flatnonzero(np.diff(np.cumsum((words.ends - words.starts)[chosen]) >> 20, prepend=0)).tolist()
            for i, j in zip([0, *cuts], [*cuts, len(chosen)]):
                if i < j:
                    spelled = [words.data[x:y].tobytes() for x, y in zip(words.starts[chosen[i:j]].tolist(), words.ends[chosen[i:j]].tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part)), pa.array(spelled, pa.binary()), pa.array(n[i:j])], names=["part", "word", "n"])


def _expectation(sent):
    """Rows (part, piece, n): expected uses of each piece in words with their counts, in 1 / FIXED."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*sent.value)
        total = np.zeros_like(lattice.logs)
        for rows in tokens.gathered(batches, "word", STEP_BYTES):  # many words at once: a call's cost is by their lengths
            data, offsets = tokens.text_bytes(rows.column("word"))
            words = tokens.Words(data, offsets[:-1], offsets[1:], np.arange(len(offsets)))
            part_of, n = rows.column("part").to_numpy(), rows.column("n").to_numpy().astype(np.float64)
            for part in np.unique(part_of).tolist():
                own = np.flatnonzero(part_of == part)
                lattice.count(words, own, n[own], total[part], part)
        used = np.rint(total * FIXED).astype(np.int64)
        part, piece = np.nonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(piece), pa.array(used[part, piece])], names=["part", "piece", "n"])
    return trimmed(step)


def fitted(docs: DataFrame, pieces: list[bytes], logs: np.ndarray, parts: int, rounds: int = 2) -> np.ndarray:
    """Log weights, a row for each part, after ``rounds`` expectation steps over ``docs`` (text, part).

    A part's prior are the weights of all parts together, theirs the vocabulary's.
    A step reads each distinct word of a part once, with its count over all of ``docs``.
    """
    prior = np.exp(logs)
    weights = np.tile(logs, (parts, 1))
    counts = docs.select("text", "part").mapInArrow(_word_counts, "part long, word binary, n long").groupBy("part", "word").agg(F.sum("n").alias("n"))
    if rounds > 1:
        counts = written(counts, "lm-words")
    for _ in range(rounds):
        sent = docs.sparkSession.sparkContext.broadcast((pieces, weights))
        rows = counts.mapInArrow(_expectation(sent), "part long, piece long, n long").groupBy("part", "piece").agg(F.sum("n").alias("n")).toArrow()  # a row for each part and piece
        uses = np.zeros((parts, len(pieces)))
        uses[rows["part"].to_numpy(), rows["piece"].to_numpy()] = rows["n"].to_numpy() / FIXED
        pooled = (uses.sum(0) + PRIOR * prior) / (uses.sum() + PRIOR)
        weights = np.log((uses + PRIOR * pooled) / (uses.sum(1, keepdims=True) + PRIOR))
    return weights


BLOCK = "chunk string, bucket int, words binary, counts binary, ids binary, held binary, first binary, logs binary, places binary, uses binary"
BLOCK_ARROW = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), *((c, pa.binary()) for c in ("words", "counts", "ids", "held", "first", "logs", "places", "uses"))])
NO_ID = np.iinfo(np.int64).min


def _blocks(sent, buckets: int, parts: int):
    """For each piece of some 4 MB of text: its documents (bucket -1), and its distinct words by bucket."""
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, known = Lattice(*sent.value), Known(parts)
        for rows in tokens.gathered(batches, "text"):
            words = tokens.hashed_words(rows.column("text"), lower=True)
            n = np.diff(words.first)
            held = rows.column("held").to_numpy(zero_copy_only=False)
            part = rows.column("part").to_numpy()
            hashes, chosen, place = np.unique(words.hashes, return_index=True, return_inverse=True)
            at, have = known.places(hashes)
            logs = np.empty((len(hashes), parts), np.float32)
            logs[have] = known.values[at[have]]
            logs[~have] = lattice.log_probabilities(words, chosen[~have]).T
            known.add(hashes[~have], logs[~have])
            text = words.text_of
            counts = np.bincount(place * parts + part[text], ~held[text], len(hashes) * parts).astype(np.int64).reshape(-1, parts)
            keys, uses = np.unique(text * max(1, len(hashes)) + place, return_counts=True)
            chunk = uuid.uuid4().hex
            ids = rows.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy()
            out = [[chunk, -1, None, None, pack(ids), pack(held.astype(np.uint8)), pack(n), pack(logs.T.ravel()), pack(np.diff(keys, prepend=0)), pack(uses.astype(np.uint32))]]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                i, j = edges[b], edges[b + 1]
                out.append([chunk, b, pack(np.diff(hashes[i:j], prepend=np.uint64(0))), pack(counts[i:j].T.ravel()), None, None, None, None, None, None])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), BLOCK_ARROW)], schema=BLOCK_ARROW)
    return trimmed(block)


TOTAL = "chunk string, bucket int, counts binary, distinct array<long>, once array<long>, tokens array<long>"
TOTAL_ARROW = pa.schema([("chunk", pa.string()), ("bucket", pa.int32()), ("counts", pa.binary()), *((c, pa.list_(pa.int64())) for c in ("distinct", "once", "tokens"))])


def _totals(parts: int):
    def total(table: pa.Table) -> pa.Table:
        """One bucket's words: their totals by part go back to each piece of text; a row without one has the sums.

        ``distinct`` and ``once`` have an entry for each part and one for all together.
        """
        hashes = [np.cumsum(unpack(x, np.uint64)) for x in table.column("words").to_pylist()]
        counts = [unpack(x, np.int64).reshape(parts, -1) for x in table.column("counts").to_pylist()]
        words, place = np.unique(np.concatenate(hashes), return_inverse=True)
        sums = np.stack([np.bincount(place, np.concatenate([c[k] for c in counts]), len(words)) for k in range(parts)]).astype(np.int64)
        every = np.concatenate([sums, sums.sum(0, keepdims=True)])
        bucket = table.column("bucket")[0].as_py()
        rows, at = [[None, bucket, None, (every > 0).sum(1).tolist(), (every == 1).sum(1).tolist(), sums.sum(1).tolist()]], 0
        for chunk, own in zip(table.column("chunk").to_pylist(), hashes):
            rows.append([chunk, bucket, pack(sums[:, place[at:at + len(own)]].ravel()), None, None, None])
            at += len(own)
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), TOTAL_ARROW)], schema=TOTAL_ARROW)
    return total


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, lattice_score double"
SCORED_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                          ("base_score", pa.float64()), ("score", pa.float64()), ("lattice_score", pa.float64())])


def _scored(words: np.ndarray, once: np.ndarray, ends: np.ndarray, distinct: int):
    """A piece of text and its words' totals -> its documents' scores. Counts of training words, words seen once and texts, by part."""
    parts, all_ends = len(words), int(ends.sum())
    n_train = int(words.sum()) + all_ends
    v = distinct + (all_ends > 0)
    escape = np.clip((once + 1) / (words + 2), 1e-4, 1.0)
    end = (ends + 1) / (words + ends + 2)

    def merge(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
        head, rest = rows[0], rows[1:]
        total = np.concatenate([unpack(r["counts"], np.int64).reshape(parts, -1) for r in rest] or [np.empty((parts, 0), np.int64)], axis=1)
        n, logs = unpack(head["first"], np.int64), unpack(head["logs"], np.float32).astype(np.float64).reshape(parts, -1)
        keys, uses = np.cumsum(unpack(head["places"], np.int64)), unpack(head["uses"], np.uint32).astype(np.int64)
        text, place = np.divmod(keys, max(1, total.shape[1]))
        c = total.sum(0)[place]
        base = np.bincount(text, uses * np.log10(c + 0.1), len(n)) + np.log10(all_ends + 0.1)
        known = np.bincount(text, uses * (c > 0), len(n)).astype(np.int64) + (all_ends > 0)
        whole, pure = np.full(len(n), -np.inf), np.full(len(n), -np.inf)
        for k in range(parts):
            if ends[k] or not all_ends:
                with np.errstate(divide="ignore"):
                    own = np.logaddexp(np.log(total[k] / max(1, words[k])) + np.log1p(-escape[k]), logs[k] + np.log(escape[k])) + np.log1p(-end[k])
                share = np.log((ends[k] + 1) / (all_ends + parts))
                whole = np.logaddexp(whole, np.bincount(text, uses * own[place], len(n)) + np.log(end[k]) + share)
                pure = np.logaddexp(pure, np.bincount(text, uses * (logs[k] + np.log1p(-end[k]))[place], len(n)) + np.log(end[k]) + share)
        ids = unpack(head["ids"], np.int64)
        return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(unpack(head["held"], np.uint8) > 0), pa.array(n + 1), pa.array(known),
                         pa.array(np.full(len(n), n_train)), pa.array(base - (n + 1) * np.log10(n_train + 0.1 * (v + 1))), pa.array(whole / np.log(10)),
                         pa.array(pure / np.log(10))], schema=SCORED_ARROW)
    return merge


def scored(docs: DataFrame, path: str, folds: int = 10, rounds: int = 2, column: str = "lang", parts: int = 8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score of every row of ``docs``.

    ``lattice_score`` is the log10 probability by the pieces alone, without the arcs of whole words.
    """
    buckets = buckets_for(docs, "text", BUCKET_BYTES)
    value = F.col(column).cast("string") if column in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out(F.col("doc_id"), folds).alias("held"), value.alias("value"))
    common = rows.where("not held and value is not null").groupBy("value").count().orderBy(F.col("count").desc(), "value").limit(parts).collect()
    part = F.lit(len(common))
    for k, r in enumerate(common):
        part = F.when(F.col("value") == r["value"], k).otherwise(part)
    rows = rows.withColumn("part", part.cast("int")).drop("value")
    parts = len(common) + 1
    pieces, logs = vocabulary(path)
    logs = fitted(rows.where("not held"), pieces, logs, parts, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((pieces, logs))
    blocks = written(rows.mapInArrow(_blocks(sent, buckets, parts), BLOCK), "lm-blocks")
    totals = written(blocks.where("bucket >= 0").select("chunk", "bucket", "words", "counts").groupBy("bucket").applyInArrow(_totals(parts), TOTAL), "lm-totals")

    def sums(name: str, n: int) -> np.ndarray:
        return np.array(totals.where("chunk is null").agg(*[F.coalesce(F.sum(F.get(name, F.lit(k))), F.lit(0)) for k in range(n)]).first(), np.int64)

    ends = np.zeros(parts, np.int64)
    for k, n in rows.where("not held").groupBy("part").count().collect():
        ends[k] = n
    heads = blocks.where("bucket < 0").select("chunk", "bucket", F.lit(None).cast("binary").alias("counts"), "ids", "held", "first", "logs", "places", "uses")
    replies = totals.where("chunk is not null").select("chunk", "bucket", "counts")
    every = heads.unionByName(replies, allowMissingColumns=True)
    merge = _scored(sums("tokens", parts), sums("once", parts), ends, int(sums("distinct", parts + 1)[-1]))
    return every.groupBy("chunk").applyInArrow(merge, SCORED)
