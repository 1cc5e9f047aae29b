"""Bitmaps of documents for many pairs at once, as compressed planes.

A container holds the postings of some pairs over some documents. Bit (pair,
document) lies in byte ``pair * width + document // 8`` of a plane; only bytes
with a bit are kept, as sorted positions and values, so an empty stretch costs
nothing whatever its length. Plane j has the documents whose multiplicity of
the pair has bit j: the planes' union is the pair's document bitmap, and the
planes' bits weighted by 2**j are its links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from faultline.llm.packing import pack, unpack

BIT_OF = np.array([128 >> k for k in range(8)], np.uint8)


@dataclass
class Plane:
    at: np.ndarray  # sorted positions of the bytes that are not empty
    value: np.ndarray  # those bytes

    @staticmethod
    def of(rows: np.ndarray, docs: np.ndarray, width: int) -> Plane:
        """The plane with the bits (row, doc), sorted by row and doc."""
        at, first = np.unique(rows * width + (docs >> 3), return_index=True)
        return Plane(at, np.bitwise_or.reduceat(BIT_OF[docs & 7], first) if len(at) else np.empty(0, np.uint8))

    @staticmethod
    def union(planes: list[Plane]) -> Plane:
        at = np.concatenate([p.at for p in planes])
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        return Plane(at[first], np.bitwise_or.reduceat(np.concatenate([p.value for p in planes])[order], first) if len(at) else np.empty(0, np.uint8))

    def popcounts(self, width: int, rows: int) -> np.ndarray:
        """Bits in each row."""
        return np.bincount(self.at // width, np.bitwise_count(self.value), rows).astype(np.int64)

    def bits(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, doc) of every bit."""
        byte, bit = np.nonzero(self.value[:, None] & BIT_OF)
        at = self.at[byte]
        return at // width, (at % width) * 8 + bit


def planes_of(rows: np.ndarray, docs: np.ndarray, times: np.ndarray, width: int) -> list[Plane]:
    """Planes of the multiplicities ``times`` of (row, doc), which are sorted and distinct."""
    top = int(times.max(initial=0)).bit_length()
    chosen = [np.flatnonzero(times >> j & 1) for j in range(top)]
    return [Plane.of(rows[c], docs[c], width) for c in chosen]


def packed_planes(planes: list[Plane]) -> tuple[list[bytes], list[bytes]]:
    return [pack(np.diff(p.at, prepend=0).astype(np.uint32)) for p in planes], [pack(p.value) for p in planes]


def unpacked_planes(at: list[bytes], value: list[bytes]) -> list[Plane]:
    return [Plane(np.cumsum(unpack(a, np.uint32), dtype=np.int64), unpack(v, np.uint8)) for a, v in zip(at, value)]


def exact_sums(places: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of whole numbers by place, exact beyond 53 bits."""
    low, high = values & 0xFFFFFF, values >> 24
    return np.bincount(places, low, size).astype(np.int64) + (np.bincount(places, high, size).astype(np.int64) << 24)
