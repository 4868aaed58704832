"""Hashes of words and word shingles, computed on whole Arrow batches with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_PLACES = np.multiply.accumulate(np.full(64, 0xFF51AFD7ED558CCD, dtype=np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the published SplitMix64 finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(texts: pa.Array, most_bytes: int = 1 << 21) -> Iterator[tuple[int, pa.Array]]:
    """Slices of at most ``most_bytes`` (or one text), each with the index of its first text."""
    sizes = np.diff(_offsets(texts))
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most_bytes:
            yield start, texts.slice(start, i - start)
            start, total = i, 0
        total += int(size)
    if len(texts) > start:
        yield start, texts.slice(start)


def _offsets(texts: pa.Array) -> np.ndarray:
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    every = np.frombuffer(texts.buffers()[1], dtype=width)
    return every[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one entry more).

    Texts are non-null strings. The bytes of a word are weighed by place and summed.
    """
    offsets = _offsets(texts)
    first, last = int(offsets[0]), int(offsets[-1])
    if last == first:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[first:last]
    edges = offsets - first
    inside = ~_IS_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = edges[(edges > 0) & (edges < len(data))]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    bounds = np.concatenate([[0], starts, [len(data)]])
    places = np.arange(len(data), dtype=np.int64) - np.repeat(bounds[:-1], np.diff(bounds))
    longest = int(places[inside].max()) + 1
    weights = _PLACES
    while len(weights) < longest:
        weights = np.concatenate([weights, weights * _STEP + np.uint64(len(weights))])
    values = np.where(inside, data.astype(np.uint64) + np.uint64(1), np.uint64(0))
    values *= weights[np.minimum(places, len(weights) - 1)]
    return mix(np.add.reduceat(values, starts)), np.searchsorted(starts, edges)


_LANES = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Distinct hashes, sorted, of ``width`` words in a row; all words when there are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    total = np.zeros(count, dtype=np.uint64)
    for j in range(width):
        total += words[j : j + count] * _LANES[j]
    return np.unique(mix(total + np.uint64(width)))
