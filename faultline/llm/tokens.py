"""Words of whole Arrow text columns as numpy arrays of positions and hashes.

Everything works on the UTF-8 bytes of a batch at once. A word's hash is a
polynomial of its bytes modulo 2**64, taken from one running sum over the
batch, and then mixed; ``seed`` gives independent functions. Words longer than
``LONG_WORD`` bytes are hashed one by one, so memory does not depend on how
long a text or a word is beyond the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LONG_WORD = 1 << 16
SPAN = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes outside [^\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


MASK = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _base(seed: int) -> tuple[np.ndarray, int]:
    draws = np.random.default_rng(1000 + seed)
    return draws.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), int(draws.integers(1, 1 << 60)) * 8 + 5


@lru_cache(maxsize=4)
def _base_ints(seed: int) -> tuple[list[int], int]:
    values, odd = _base(seed)
    return values.tolist(), odd


@lru_cache(maxsize=16)
def _powers(odd: int, n: int, inverse: bool) -> np.ndarray:
    step = pow(odd, -1, 1 << 64) if inverse else odd
    out = np.empty(n, np.uint64)
    out[0] = 1
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(step, done, 1 << 64))
        done += more
    return out


def window_hashes(values: np.ndarray, size: int, odd: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """The hash of each run of ``size`` consecutive values (len - size + 1 of them)."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += values[j:j + n] * np.uint64(pow(odd, j + 1, 1 << 64))
    return mix64(out)


@dataclass
class Words:
    """Words of a column: byte ranges in ``data``; texts' word ranges in ``first`` (one more than texts)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None = None

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the texts' offsets; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]: at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def split_words(column: pa.Array, lower: bool = False, breaks: np.ndarray = SPACES) -> Words:
    raw, offsets = text_bytes(column)
    data = LOWER[raw] if lower else raw
    if not len(data):
        return Words(data, np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~breaks[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # texts lie side by side in the buffer: a word that spans a border is two
    cuts = np.unique(offsets[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]
    if len(cuts):
        starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def hash_words(words: Words, seed: int = 0) -> np.ndarray:
    values, odd = _base(seed)
    out = np.empty(len(words.starts), np.uint64)
    i, n = 0, len(words.starts)
    lengths = words.ends - words.starts
    huge = np.flatnonzero(lengths > LONG_WORD)
    stops = iter([*huge.tolist(), n])
    while i < n:
        stop = next(stops)
        while i < stop:
            begin = words.starts[i]
            j = min(stop, max(i + 1, int(np.searchsorted(words.ends, begin + SPAN, "right"))))
            end = words.ends[j - 1]
            size = int(end - begin)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(values[words.data[begin:end]] * _powers(odd, SPAN, False)[:size], out=sums[1:])
            a, b = words.starts[i:j] - begin, words.ends[i:j] - begin
            out[i:j] = (sums[b] - sums[a]) * _powers(odd, SPAN, True)[a]
            i = j
        if i < n:
            digest = hashlib.blake2b(words.data[words.starts[i]: words.ends[i]].tobytes(), digest_size=8, salt=bytes([seed]))
            out[i] = int.from_bytes(digest.digest(), "little")
            i += 1
    return mix64(out + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def hash_word(word: bytes, seed: int = 0) -> int:
    """``hash_words`` of one word."""
    if len(word) > LONG_WORD:
        return int(hash_words(Words(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]), np.array([0, 1])), seed)[0])
    values, odd = _base_ints(seed)
    x = len(word) * 0x9E3779B97F4A7C15
    power = 1
    for b in word:
        x += values[b] * power
        power = power * odd & MASK
    x &= MASK
    x = (x ^ x >> 33) * 0xFF51AFD7ED558CCD & MASK
    x = (x ^ x >> 33) * 0xC4CEB9FE1A85EC53 & MASK
    return x ^ x >> 33


def hashed_words(column: pa.Array, lower: bool = False, breaks: np.ndarray = SPACES, seed: int = 0) -> Words:
    words = split_words(column, lower, breaks)
    words.hashes = hash_words(words, seed)
    return words


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch with about ``most_bytes`` of text each (one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    at = 0
    total = np.concatenate([[0], np.cumsum(lengths)])
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + most_bytes, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def gathered(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows dealt anew into batches of at most ``most_bytes`` of text (one row at least)."""
    kept, size = [], 0
    for batch in batches:
        for part in slices(batch, column, most_bytes):
            own = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
            if kept and size + own > most_bytes:
                yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]
                kept, size = [], 0
            kept.append(part)
            size += own
    if sum(part.num_rows for part in kept):
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


def set_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each text, sorted: flat hashes and the texts' ranges.

    A text of fewer words, but not none, has its whole sequence as one shingle.
    """
    n = np.diff(words.first)
    runs = window_hashes(words.hashes, size)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.empty(first[-1], np.uint64)
    for t in range(len(n)):
        a, b = first[t], first[t + 1]
        if n[t] >= size:
            flat[a:b] = runs[words.first[t]: words.first[t] + b - a]
            flat[a:b].sort()
        elif n[t]:
            own = words.hashes[words.first[t]: words.first[t + 1]]
            flat[a:b] = window_hashes(own, len(own)) ^ np.uint64(len(own))
    keep = np.ones(len(flat), bool)
    keep[1:] = flat[1:] != flat[:-1]
    keep[first[:-1][counts > 0]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], kept[first]
