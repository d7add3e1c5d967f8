"""Array helpers on Arrow string columns: chunks of text bytes, word spans, rolling hashes.

A chunk holds the texts of consecutive rows as one byte array with row offsets,
so that the operators work with a few numpy passes over many rows at once. Null
texts count as empty. Chunks stay near ``CHUNK_BYTES``; a longer single text is
a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_POWERS: dict[str, np.ndarray] = {}

# One 64-bit value for each byte, from a fixed seed.
BYTE_VALUES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def as_text(column: pa.Array) -> pa.Array:
    """The column as large strings, nulls as empty texts."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column made by ``as_text``, and the offsets of its rows (one more than rows)."""
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    if at[-1] == at[0]:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: int = 1, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Row slices of ``batch`` with about ``limit`` text bytes, each with its text column."""
    column = as_text(batch.column(text))
    _, at = text_bytes(column)
    row = 0
    while row < len(column):
        stop = max(int(np.searchsorted(at, at[row] + limit, "right")) - 1, row + 1)
        yield batch.slice(row, stop - row), column.slice(row, stop - row)
        row = stop


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    known = _POWERS.get(kind)
    if known is None or len(known) < n:
        steps = np.full(max(n, CHUNK_BYTES + CHUNK_BYTES // 8), base, np.uint64)
        steps[0] = 1
        known = _POWERS[kind] = np.cumprod(steps)
    return known[:n]


class SpanHash:
    """64-bit hashes of any byte spans, from one pass over the bytes.

    A span's hash depends on its bytes alone, not on its place. The hash is a polynomial
    modulo 2^64, for which long spans of equal hash can be built (Thue-Morse words of
    1,024 letters). Where a false match would be a wrong result, spans are shorter than
    that or their bytes decide (``numbered``).
    """

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * _powers("up", _BASE, len(data)), out=self.sums[1:])
        self.inverse = _powers("down", _BASE_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start])

    def fixed(self, length: int) -> np.ndarray:
        """Hashes of all spans of one length, in order of their start."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _SHIFT)
    h *= _MIX
    h ^= h >> _SHIFT
    return h


def byte_table(pattern) -> np.ndarray:
    """256 flags: ``pattern(byte)``."""
    return np.array([bool(pattern(b)) for b in range(256)])


def spans(data: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes flagged in ``inside`` that stay within a row: starts, stops, rows."""
    if not len(data):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    flag = inside[data]
    first = np.empty(len(data) + 1, bool)
    first[0], first[-1] = True, True
    np.not_equal(flag[1:], flag[:-1], out=first[1:-1])
    first[at] = True
    edges = np.flatnonzero(first)
    kept = flag[edges[:-1]]
    starts, stops = edges[:-1][kept], edges[1:][kept]
    return starts, stops, np.searchsorted(at, starts, "right") - 1


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)


def ascii_lower(data: np.ndarray) -> np.ndarray:
    return LOWER[data]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def list_array(counts: np.ndarray, values: pa.Array) -> pa.Array:
    """A list column from the number of values in each row and all values in order."""
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), values)


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for ``size[0]`` places, then the same for the next."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def gathered(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The byte spans as a string column; they may overlap."""
    whole = data.tobytes()
    ends = np.zeros(len(start) + 1, np.int64)
    np.cumsum(stop - start, out=ends[1:])
    joined = b"".join([whole[a:b] for a, b in zip(start.tolist(), stop.tolist())])
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(joined)])


def kept_spans(data: np.ndarray, inside: np.ndarray, size: np.ndarray) -> pa.Array:
    """All maximal runs of bytes flagged in ``inside``, of these sizes, as a string column."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data[inside[data]])])


def numbered(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, equal just for equal values, and the distinct values by number."""
    found = column.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary
