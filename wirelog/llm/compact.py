"""Whole numbers as compressed bytes, for blocks that travel through a shuffle or a table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def squeeze(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that those which are mostly zero take no room."""
    planes = np.ascontiguousarray(numbers.astype("<i8", copy=False)).view("u1").reshape(-1, 8).T
    body = pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)
    return len(numbers).to_bytes(8, "little") + body


def unsqueeze(data: bytes) -> np.ndarray:
    count = int.from_bytes(data[:8], "little")
    if not count:
        return np.empty(0, np.int64)
    planes = np.frombuffer(pa.decompress(data[8:], 8 * count, codec="zstd", asbytes=True), "u1").reshape(8, count)
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys, by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unsqueeze_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(data).view(np.uint64), dtype=np.uint64)


def by_frequency(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes renumbered so that frequent ones are small, and the old code of each new one."""
    old = np.argsort(-np.bincount(codes, minlength=size), kind="stable")
    new = np.empty(size, np.int64)
    new[old] = np.arange(size)
    return new[codes], old
