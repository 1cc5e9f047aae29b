"""Bitmaps of hashed keys: a sieve of fixed size in front of an exact join.

A bitmap has as many bits as asked for, at most ``MOST_BITS`` (32 MB), so it
may be sent to every task whatever the number of keys. It lets every listed
key pass; others that pass are removed by the join that must follow.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_BITS = 1 << 28
LEAST_BITS = 1 << 16


def bitmap_of(keys: DataFrame, key: str) -> np.ndarray:
    """Bits (as bytes) of the low bits of the long column ``key``; nulls have none."""
    n = keys.count()
    bits = LEAST_BITS
    while bits < min(16 * n, MOST_BITS):
        bits *= 2
    rows = (keys.where(F.col(key).isNotNull()).select(F.col(key).bitwiseAND(bits - 1).alias("bit"))
            .groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow())
    out = np.zeros(bits >> 6, np.int64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return out.view(np.uint8)


def may_hold(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (int64 or uint64) may be listed."""
    bit = keys.view(np.uint64) & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
