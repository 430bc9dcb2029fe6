"""Vectorised hashing of the words or bytes of Arrow string columns, in numpy, for use inside tasks.

Texts are taken in blocks of a few MB, so a task's memory follows the block size and not the batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK = 2 << 20
_rng = np.random.Generator(np.random.PCG64(20240801))
#: A random 64-bit value for each byte; in FOLDED, A-Z have those of a-z.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Each byte, A-Z folded.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ASCII characters that are neither letters nor digits; what lies between them are terms.
NOT_TERM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
M1, M2, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def powers(n: int, q: U) -> np.ndarray:
    out = np.full(max(n, 1), q, U)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def inverse(q: U) -> U:
    return U(pow(int(q), -1, 2**64))


def rolling(values: np.ndarray, width: int, q: U = U(0xD6E8FEB86659FD93)) -> np.ndarray:
    """Hash of each run of width values; entry i starts at i."""
    n = len(values)
    if n < width:
        return np.empty(0, U)
    total = np.zeros(n + 1, U)
    np.cumsum(values * powers(n, q), out=total[1:])
    return mixed((total[width:] - total[:-width]) * powers(n - width + 1, inverse(q)))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8))[at[0] : at[-1]], at - at[0]


def text_blocks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with about most bytes; a longer text is a run of its own."""
    data, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _word_part(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = gap[data]
    first = ~space
    first[1:] &= space[:-1]
    at = offsets[offsets < len(data)]
    first[at] = ~space[at]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, U)
    lead = starts[0]
    place = np.arange(lead, len(data), dtype=np.int64) - np.repeat(starts, np.diff(starts, append=len(data)))
    x = table[data[lead:]]
    x += place.astype(U) * STEP
    x ^= x >> U(32)
    x *= M1
    x ^= x >> U(29)
    x[space[lead:]] = 0
    return starts, mixed(np.add.reduceat(x, starts - lead))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, gap: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each word, its first byte, and the n + 1 offsets of each text's words. lower folds A-Z only; gap marks the bytes between words."""
    table, found, lo = FOLDED if lower else BYTE, [], 0
    while lo < len(data):
        hi = min(len(data), lo + 2 * BLOCK)
        while hi < len(data) and not (gaps := np.flatnonzero(gap[data[lo:hi]])).size and hi - lo < 2**40:
            hi = min(len(data), hi + (hi - lo))
        if hi < len(data):
            hi = lo + int(gaps[-1]) + 1
        starts, hashes = _word_part(data[lo:hi], offsets[(offsets >= lo) & (offsets < hi)] - lo, table, gap)
        found.append((starts + lo, hashes))
        lo = hi
    starts = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    hashes = np.concatenate([x for _, x in found]) if found else np.empty(0, U)
    return hashes, starts, np.searchsorted(starts, offsets)


def word_sizes(data: np.ndarray, starts: np.ndarray, gap: np.ndarray = IS_SPACE) -> np.ndarray:
    """Bytes of each word."""
    return np.add.reduceat((~gap[data[starts[0] :]]).astype(np.int64), starts - starts[0]) if len(starts) else np.empty(0, np.int64)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == U else x.astype(np.int64))


def lists(parts: list[np.ndarray]) -> pa.Array:
    """An array<bigint> column from one numpy array for each row."""
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), as_long(flat))


def batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], names=list(columns))
