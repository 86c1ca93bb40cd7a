"""Vectorised text kernels over Arrow string columns.

All functions work on flat arrays: one uint8 array with the UTF-8 bytes of
several documents and the documents' byte offsets in it.  A *word* is a maximal
run of bytes outside ``\\x20 \\x09-\\x0D``; UTF-8 lead and continuation bytes are
never white space, so words found on bytes are the words found on code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at once; one longer document is handled alone.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
#: Multipliers by place in a window.
_PLACE = _rng.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `most` bytes; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, place, body = column.buffers()
    offsets = np.frombuffer(place, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def per_document(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often the mask holds in each document."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and at last their number)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    full = offsets[1:] > offsets[:-1]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][full]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][full] - 1] = True
    starts = np.flatnonzero(before & ~space)
    return starts, np.flatnonzero(after & ~space) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of a well-known public hash family; in place."""
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each of the spans, which ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    powers = np.full(int(length.max()) + 1, _BASE[seed], np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    low, high = int(starts[0]), int(ends[-1])
    reach = np.diff(np.append(starts, high))
    place = np.arange(low, high) - np.repeat(starts, reach)
    inside = place < np.repeat(length, reach)
    value = _BYTE[seed][data[low:high]]
    value *= powers[np.minimum(place, len(powers) - 1)]
    value *= inside
    out = np.add.reduceat(value, starts - low)
    out[length == 0] = 0  # reduceat gives an empty segment the next value
    out += length.astype(np.uint64) * _BASE[1 - seed]
    return mix(out)


def gram_hashes(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k-word windows that start at each word but the last k-1; windows over document ends are included."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n] * _PLACE[seed][0]
    for j in range(1, k):
        out += hashes[j : n + j] * _PLACE[seed][j]
    return mix(out)


def gram_owner(first: np.ndarray, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For n windows of k words: the document that each starts in, and whether it also ends there."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
    return owner, np.arange(n) + k <= first[1:][owner]


def as_column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def string_rows(column: pa.Array) -> list[str]:
    """Python strings, nulls as empty ones."""
    return [x or "" for x in column.to_pylist()]
