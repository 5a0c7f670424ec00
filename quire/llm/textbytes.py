"""Vectorised byte work shared by the text operators.

Documents arrive as Arrow string columns.  Everything here works on the flat
UTF-8 buffer of a group of documents plus their offsets, so a batch costs a few
numpy passes and never a Python step per character.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once: small enough for the temporaries to stay in cache.
CHUNK_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Two independent random codes of every byte value, for two independent digests of the same bytes.
BYTE_CODES = np.random.default_rng(20240607).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE = BYTE_CODES[0]
_POWERS: dict[int, np.ndarray] = {}


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8).copy() if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def groups(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `limit` bytes together; one longer document stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """base**i modulo 2**64 for i < n (or of its inverse), kept between calls."""
    base = _INVERSE if inverse else _BASE
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(step)
        _POWERS[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (the public splitmix64 constants)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_of(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i, so that any range has a position-free hash."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def prefix(data: np.ndarray) -> np.ndarray:
    return prefix_of(_BYTE_CODE[data])


def ranged(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of every range [start, end) from its prefix sums, before mixing."""
    return (sums[end] - sums[start]) * powers(len(sums), inverse=True)[start]


def table(letters: bytes) -> np.ndarray:
    """Membership table over byte values."""
    out = np.zeros(256, bool)
    out[list(letters)] = True
    return out


#: Bytes that separate words: space and \\x09-\\x0D.
SPACE = table(bytes([0x20, *range(0x09, 0x0E)]))
#: ASCII lower-casing alone; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(is_gap: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of non-gap bytes; runs end at document borders."""
    n = len(is_gap)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = ~is_gap
    first = inside.copy()
    first[1:] &= is_gap[:-1]
    border = offsets[(offsets > 0) & (offsets < n)]
    first[border] = inside[border]
    last = inside.copy()
    last[:-1] &= is_gap[1:]
    last[border - 1] = inside[border - 1]
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def per_document(index: np.ndarray, n: int) -> np.ndarray:
    """Offsets of the items of each of n documents, given the sorted document of every item."""
    return np.searchsorted(index, np.arange(n + 1))


def trim() -> None:
    """Give freed memory back to the system: Python workers live on after a task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if release is not None:
        release(0)
