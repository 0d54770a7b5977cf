"""Vectorised text kernels over Arrow string buffers.

Words are maximal runs of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``. Those separators are single
bytes in UTF-8, so words can be found and hashed on the raw buffer without decoding it. Hashes are 64 bits:
a word's bytes are mixed in eight at a time, spans over ``LANES`` * 8 bytes go through xxHash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are worked on at once; the temporary arrays take about 30 times as much.
BLOCK_BYTES = 1 << 20

# A worker gives memory back to the system, rather than keeping the most it ever used.
pa.set_memory_pool(pa.system_memory_pool())

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
#: Spans of up to so many times eight bytes are hashed all at once, longer ones by themselves.
LANES = 8
#: Keeps the first 0 to 8 bytes of eight.
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)
_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective bit mixer on unsigned 64-bit integers."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def string_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    rows = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    rows = rows.astype(np.int64)
    size = int(rows[-1])
    raw = np.frombuffer(data, np.uint8, size) if data is not None and size else np.zeros(0, np.uint8)
    return raw[rows[0] : rows[-1]], rows - rows[0]


def slices(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column, each of about ``limit`` bytes or a single row."""
    _, rows = string_buffer(column)
    at, n = 0, len(rows) - 1
    while at < n:
        end = int(np.searchsorted(rows, rows[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def separators(raw: np.ndarray) -> np.ndarray:
    return ~_INSIDE[raw]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return np.where((raw >= 65) & (raw <= 90), raw | 0x20, raw)


def word_spans(raw: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; a row boundary ends a word."""
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = _INSIDE[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edges = rows[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    stops[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(np.searchsorted(starts, rows)))
    return starts, np.flatnonzero(stops) + 1, row


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, the same wherever it lies."""
    left = ends - starts
    out = mix(left.astype(_U) * _STEP)
    if not len(left):
        return out
    eight = np.ndarray((len(raw) + 1,), "<u8", np.concatenate((raw, np.zeros(8, np.uint8))), strides=(1,))
    at, todo = starts, None
    for _ in range(LANES):
        word = eight[at] & _KEEP[np.minimum(left, 8)]
        if todo is None:
            out = mix(out ^ word)
            todo = np.flatnonzero(left > 8)
        else:
            out[todo] = mix(out[todo] * _STEP ^ word)
            todo, more = todo[left > 8], left > 8
            left, at = left[more], at[more]
        if not len(todo):
            return out
        if len(left) != len(todo):
            left, at = left[todo], at[todo]
        left, at = left - 8, at + 8
    for i in todo.tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return out


def words(raw: np.ndarray, rows: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and hash of each word."""
    starts, ends, row = word_spans(raw, rows)
    return starts, ends, row, span_hashes(lower_ascii(raw) if lower else raw, starts, ends)


def windows(hashes: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of each run of ``width`` words that lies in one row."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(row[:n] == row[width - 1 :])
    out = np.zeros(len(first), _U)
    for i in range(width):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[first + i]
    return mix(out), row[first], first


def shingle_sets(column: pa.Array, width: int, lower: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """The row number and the sorted distinct shingle hashes of each row.

    A row with fewer than ``width`` words has all its words as its one shingle, a row without words none.
    """
    for first, end in slices(column):
        raw, rows = string_buffer(column.slice(first, end - first))
        _, _, row, hashes = words(raw, rows, lower)
        out, at, _ = windows(hashes, row, width)
        counts = np.bincount(row, minlength=end - first)
        short = np.flatnonzero((counts > 0) & (counts < width))
        if len(short):
            begin = np.concatenate(([0], np.cumsum(counts)))
            extra = np.zeros(len(short), _U)
            for i in range(width - 1):
                more = counts[short] > i
                pick = np.minimum(begin[short] + i, len(hashes) - 1)
                extra = np.where(more, extra * _U(0xA24BAED4963EE407) + hashes[pick], extra)
            out = np.concatenate((out, mix(extra + counts[short].astype(_U))))
            at = np.concatenate((at, short))
        if len(short):
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
        bounds = np.searchsorted(at, np.arange(end - first + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a > 1:
                out[a:b].sort()
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (at[1:] != at[:-1])
        out, at = out[new], at[new]
        bounds = np.searchsorted(at, np.arange(end - first + 1))
        for i in range(end - first):
            yield first + i, out[bounds[i] : bounds[i + 1]]
