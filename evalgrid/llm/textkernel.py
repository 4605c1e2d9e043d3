"""Vectorised work on the UTF-8 bytes of Arrow string columns: words, word hashes, shingle hashes.

Words are maximal runs of bytes other than space and \\t..\\r, which never cuts a UTF-8 character. A block of documents
of about BLOCK bytes is held at a time (a longer document is a block of its own), so memory follows the longest
document, not the partition.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def lean(kernel):
    """The kernel, after which its Python worker, which Spark keeps for other tasks, gives its unused memory back."""

    def run(*given):
        try:
            yield from kernel(*given)
        finally:
            give_back()

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser for 64-bit hashes (xor-shift and multiply); wraps around."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))
_PLACE = mix(np.arange(1001, 1065, dtype=_U) * _U(_BASE)) | _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, BLOCK + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of about `size` bytes of text, each with the text's bytes and offsets."""
    for batch in batches:
        data, at = utf8(batch.column(batch.schema.get_field_index(column)))
        first, n = 0, batch.num_rows
        while first < n:
            last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
            yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
            first = last


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each document (one more than documents)."""
    inside = ~SEPARATOR[data]
    before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[at] = False
    after[: len(data)] = inside
    cut = after.copy()
    cut[at] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~cut[1:]) + 1
    return starts, ends, np.searchsorted(starts, at)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal spans have equal hashes wherever they stand."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def shingles(hashes: np.ndarray, first: np.ndarray, k: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a document, in order, and the number of shingles before each document.
    whole: a document with 1 to k-1 words has the whole sequence as its one shingle; otherwise it has none."""
    n, counts = len(hashes), np.diff(first)
    runs = np.zeros(max(n - k + 1, 0), _U)
    for j in range(k):
        runs += hashes[j : j + len(runs)] * _PLACE[j]
    runs = mix(runs + _U(k))
    per = np.maximum(counts - k + 1, 0)
    starts = np.flatnonzero(np.arange(len(runs)) + k <= np.repeat(first[1:], counts)[: len(runs)]) if len(runs) else np.zeros(0, np.int64)
    out, short = runs[starts], np.flatnonzero((counts > 0) & (counts < k)) if whole else []
    if len(short):
        at = np.concatenate([[0], np.cumsum(per)])[short]
        per[short] = 1
        own = [mix(np.array([int((hashes[first[d] : first[d + 1]] * _PLACE[: counts[d]]).sum(dtype=_U)) + int(counts[d]) & (2**64 - 1)], _U))[0] for d in short]
        out = np.insert(out, at, np.array(own, _U))
    return out, np.concatenate([[0], np.cumsum(per)])
