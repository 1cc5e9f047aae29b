"""Quality classifier: a linear support vector machine on Naive Bayes features.

A text's n-gram indicators (byte pairs, hashed runs of four bytes, and runs of
words that equal the word one to four places before, by the power of two of
their length; all of the whole text) are scaled by the classes' log-count ratios and brought to unit
length; a linear hinge-loss model is fitted by dual coordinate descent. The
margins of rows kept from that fit calibrate the score.

The model is fitted on at most ``max_train`` labelled rows (a setting, the rows
of least id hash); scoring reads every text once and shuffles nothing. Labels,
lang, source and doc_id are no inputs of a score.

Defined cases: null or empty text has no n-grams and gets the model's bias;
without a labelled row of each class the score is the share of label 1 (0.5
without any); repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm import tokens
from faultline.llm.labelled import fit_logistic, held_out, logistic, sample_of, sampled_texts
from faultline.llm.storage import trimmed, written

PAIRS, RUNS = 1 << 16, 1 << 18
LAGS, LEVELS = 4, 16
FEATURES = PAIRS + RUNS + LAGS * LEVELS


def repeated_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of each run of words that equal the word ``lag`` places before; sorted by text."""
    words = tokens.hashed_words(column)
    text = words.text_of
    texts, found = [], []
    for lag in range(1, LAGS + 1):
        equal = np.zeros(len(text) + 2, np.int8)
        equal[1 + lag:-1] = (words.hashes[lag:] == words.hashes[:-lag]) & (text[lag:] == text[:-lag])
        edge = np.diff(equal)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        texts.append(text[begin])
        found.append(PAIRS + RUNS + (lag - 1) * LEVELS + np.minimum(np.log2(end - begin).astype(np.int64), LEVELS - 1))
    text, feature = np.concatenate(texts), np.concatenate(found)
    order = np.argsort(text, kind="stable")
    return text[order], feature[order]


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct features of each text."""
    data, offsets = tokens.text_bytes(column)
    wide = data.astype(np.uint32)
    pairs = wide[:-1] | wide[1:] << np.uint32(8) if len(data) > 1 else np.empty(0, np.uint32)
    runs = np.empty(0, np.int64)
    if len(data) > 3:
        runs = ((pairs[:-2] | pairs[2:] << np.uint32(16)) * np.uint32(2654435761) >> np.uint32(14)).astype(np.int64) + PAIRS
    pairs = pairs.astype(np.int64)
    text, repeated = repeated_words(column)
    edges = np.searchsorted(text, np.arange(len(offsets))).tolist()
    mark = np.zeros(FEATURES, np.int32)
    for t, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        own = np.concatenate([pairs[a:max(a, b - 1)], runs[a:max(a, b - 3)], repeated[edges[t]:edges[t + 1]]])
        place = np.arange(len(own), dtype=np.int32)
        mark[own] = place  # of equal features one keeps its place
        yield own[mark[own] == place]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tokens.slices(batch, "text", 1 << 20):
            rows = [np.sort(x).astype(np.int32).tobytes() for x in indicators(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "features"])


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, rounds: int = 12,
                            seed: int = 7) -> np.ndarray:
    """Hinge-loss weights (the last is the bias) of sparse rows; y is -1 or 1; the classes weigh alike."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) for v in values]) + 1.0
    most = cost * np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * values[i]
                w[-1] += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Model:
    """Feature ratios, the products of ratio and weight, and the calibration."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, scale: float, shift: float):
        self.square, self.product = (ratio * ratio).astype(np.float32), (ratio * weight).astype(np.float32)
        self.bias, self.scale, self.shift = bias, scale, shift

    def margin(self, features: np.ndarray) -> float:
        length = float(self.square[features].sum(dtype=np.float64)) ** 0.5
        return (float(self.product[features].sum(dtype=np.float64)) / length if length else 0.0) + self.bias

    def scores(self, column: pa.Array) -> np.ndarray:
        margins = np.array([self.margin(x) for x in indicators(column)])
        return logistic(self.scale * margins + self.shift)


def fit(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> Model:
    n1 = int(label.sum())
    if n1 in (0, len(label)):
        share = (n1 + 0.5) / (len(label) + 1)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    kept = np.arange(len(rows)) % 5 == 4  # for the calibration
    if min(label[~kept].sum(), (1 - label[~kept]).sum(), label[kept].sum(), (1 - label[kept]).sum()) < 5:
        kept[:] = False
    counts = np.zeros((2, FEATURES))
    for i in np.flatnonzero(~kept):
        counts[label[i]][rows[i]] += 1
    p = counts + smooth
    p /= np.array([[(label[~kept] == 0).sum()], [(label[~kept] == 1).sum()]]) + 2 * smooth
    ratio = np.log(p[1] / p[0])
    scaled = []
    for r in rows:
        v = ratio[r]
        length = float(v @ v) ** 0.5
        scaled.append(v / length if length else v)
    use = np.flatnonzero(~kept)
    w = dual_coordinate_descent([rows[i] for i in use], [scaled[i] for i in use], np.where(label[use] == 1, 1, -1), FEATURES)
    held = np.flatnonzero(kept) if kept.any() else use
    margins = np.array([w[rows[i]] @ scaled[i] + w[-1] for i in held])
    scale, shift = fit_logistic(margins[:, None], label[held].astype(float), ridge=1e-2)
    return Model(ratio, w[:-1], float(w[-1]), float(scale), float(shift))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, max_train: int = 8_000, max_bytes: int = 256 << 20) -> Model:
    """A model of at most ``max_train`` labelled texts whose features take at most ``max_bytes`` together (the first is always taken).

    Both bounds take the texts in the order of a hash of their ids.
    """
    sample = sample_of(labels, label, folds, max_train)
    texts = sampled_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sample)
    rows = written(texts.mapInArrow(trimmed(_features), "doc_id long, label int, features binary"), "quality-sample")

    def place(doc_id: int) -> int:  # by a hash of the id, so that any fifth is a fair one
        return (doc_id * 0x9E3779B97F4A7C15) % (1 << 64)

    sizes = sorted(((r[0], r[1]) for r in rows.select("doc_id", F.length("features")).collect()), key=lambda r: place(r[0]))  # at most max_train rows
    taken = 1 + int(np.searchsorted(np.cumsum([n for _, n in sizes])[1:], max_bytes, "right"))
    if taken < len(sizes):
        rows = rows.where(F.col("doc_id").isin([i for i, _ in sizes[:taken]]))
    rows = rows.toArrow()
    table = sorted(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), rows["features"].to_pylist()))
    table.sort(key=lambda r: place(r[0]))
    return fit([np.frombuffer(f, np.int32) for _, _, f in table], np.array([y for _, y, _ in table], np.int64))


def _scorer(sent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sent.value.scores(part.column("text")), pa.float64())], names=["doc_id", "score"])
    return trimmed(score)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_scorer(sent), "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, max_train: int = 8_000) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    out = score(docs, train(docs, labels, "quality", folds, max_train))
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
