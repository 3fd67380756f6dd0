"""Arrays of whole numbers as bytes, for rows that hold many of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeezed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest takes, equal places of all together, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    places = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(places).to_bytes(8, "little") + bytes([width]) + pa.compress(places, "zstd", asbytes=True)


def restored(packed: bytes) -> np.ndarray:
    """The numbers (uint64) of :func:`squeezed`."""
    size, width = int.from_bytes(packed[:8], "little"), packed[8]
    places = pa.decompress(packed[9:], size, "zstd", asbytes=True)
    full = np.zeros((size // width, 8), np.uint8)
    full[:, :width] = np.frombuffer(places, np.uint8).reshape(width, -1).T
    return full.view("<u8").ravel().astype(np.uint64, copy=False)


def packed(sorted_values: np.ndarray) -> bytes:
    """The first of sorted hashes, and their differences."""
    if not len(sorted_values):
        return b""
    return int(sorted_values[0]).to_bytes(8, "little") + squeezed(np.diff(sorted_values))


def unpacked(packed: bytes) -> np.ndarray:
    if not packed:
        return np.zeros(0, np.uint64)
    return np.cumsum(np.append(np.uint64(int.from_bytes(packed[:8], "little")), restored(packed[8:])), dtype=np.uint64)
