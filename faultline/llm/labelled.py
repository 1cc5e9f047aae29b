"""Labelled training rows: folds, a bounded sample, and a logistic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def held_out(doc_id: Column, folds: int) -> Column:
    """Whether a row is kept from training; a null id is not held out (and never labelled)."""
    return F.coalesce(fold(doc_id, folds) == 0, F.lit(False))


def sample_of(labels: DataFrame, label: str, folds: int, max_train: int) -> DataFrame:
    """At most ``max_train`` training rows (doc_id, label), those of least hash; null labels are left out.

    A doc_id with several labels has the largest. The bound makes the result
    small enough to be sent to every task.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)


def sampled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, label, text) of the sample, one row for each id that occurs: of an id with several texts, that of least hash.

    The sample is bounded, so only its texts are shuffled, and repeated rows are
    reduced before: the result has as many rows as the sample at most.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least")).select("doc_id", "label", "least.text")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the bias) of a ridge logistic model, by Newton steps; classes count alike if one is absent."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.eye(a.shape[1]) * ridge
    penalty[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
