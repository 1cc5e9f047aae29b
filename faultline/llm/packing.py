"""Arrays as small binary values: bytes of equal weight side by side, compressed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    if not len(values):
        return bytes(8)
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, kind) -> np.ndarray:
    n, wide = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = pa.decompress(blob[8:], decompressed_size=n * wide, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, n).T).view(kind).reshape(n)
