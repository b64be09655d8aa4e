"""Vectorised word splitting and hashing of whole texts in Arrow batches.

A word is a run of bytes whose table entry is not zero; the entry is the byte's hash value after A-Z were
lower-cased.  Separators are ASCII, so splitting UTF-8 bytes equals splitting code points.  A word's hash is a
polynomial over its bytes modulo 2**64, finished by a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK_BYTES = 2 << 20  # of text held in numpy form at once (a longer single text forms a chunk of its own)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finisher."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def byte_table(separators: bytes) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    upper = np.arange(65, 91)
    table[upper] = table[upper + 32]
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: words ``[^\x20\x09-\x0D]+``
SPACE_WORDS = byte_table(bytes([0x20, *range(0x09, 0x0E)]))
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM_WORDS = byte_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)))

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)
            _inverse = np.concatenate([np.ones(1, np.uint64), np.full(size - 1, inverse)]).cumprod(dtype=np.uint64)
    return _powers, _inverse


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0]: at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with at most ``limit`` bytes, or one longer text."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and for each text the number of its first word (one more entry at the end).

    ``offsets`` are those of some neighbouring texts; ``data`` their whole buffer.
    """
    base, n = offsets[0], int(offsets[-1] - offsets[0])
    counts = np.zeros(len(offsets), np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), counts
    values = table[data[base: base + n]]
    inside = values != 0
    edge = np.zeros(n + 1, bool)
    edge[offsets - base] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    first = np.flatnonzero(starts)
    last = np.flatnonzero(ends)
    powers, inverse = _tables(n + 1)
    with np.errstate(over="ignore"):
        values *= powers[:n]
        total = np.cumsum(values, dtype=np.uint64)
        hashes = total[last]
        hashes[1:] -= total[first[1:] - 1]
        if len(first) and first[0]:
            hashes[0] -= total[first[0] - 1]
        hashes *= inverse[first]
    counts = np.searchsorted(first, offsets - base)
    return mix(hashes), counts


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` neighbouring hashes (one fewer for each further member)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(length), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * np.uint64(_BASE) + hashes[k: k + n]
    return mix(out)
