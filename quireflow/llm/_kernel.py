"""Vectorised text kernels shared by the operators: numpy over Arrow string buffers.

Every function works on one slice of rows whose texts lie end to end in one byte array, so a
batch costs a handful of numpy passes instead of Python work per word. Nothing here knows Spark.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice holds at most; a longer single text makes a slice of its own.
SLICE_BYTES = 1 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}
try:
    _trim = ctypes.CDLL(None).malloc_trim  # where the C library has it
except (AttributeError, OSError, TypeError):
    _trim = None


def trim() -> None:
    """Give freed memory back to the system: workers live on and share a limit with their executor."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run):
    """A batch function that trims when it is done."""

    def trimmed(batches):
        yield from run(batches)
        trim()

    return trimmed


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform_bits(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _PRIME + np.uint64(seed))


_BYTE_BITS = uniform_bits(256, 20_011)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash base (or of its inverse); kept between calls."""
    base = _INVERSE if inverse else _PRIME
    known = _powers.get(inverse)
    if known is None or len(known) < n:
        size = max(n, SLICE_BYTES + 64)
        with np.errstate(over="ignore"):
            known = np.full(size, base, dtype=np.uint64)
            known[0] = 1
            known = np.multiply.accumulate(known)
        if size <= 4 * SLICE_BYTES:
            _powers[inverse] = known
    return known[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash: entry i covers data[:i]."""
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_BITS[data] * powers(len(data)), out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end); equal bytes give equal hashes anywhere."""
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * powers(len(prefix), inverse=True)[starts])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string or binary column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bounds, bytes) of runs of rows that hold about `most` bytes."""
    at, data = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, at[lo : hi + 1] - at[lo], data[at[lo] : at[hi]]
        lo = hi


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A 256-entry truth table that holds for the given inclusive byte ranges."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def runs(bounds: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of set bytes, none across two rows."""
    n = len(mask)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    first = np.empty(n, dtype=bool)
    first[0] = mask[0]
    np.logical_and(mask[1:], ~mask[:-1], out=first[1:])
    last = np.empty(n, dtype=bool)
    last[-1] = mask[-1]
    np.logical_and(mask[:-1], ~mask[1:], out=last[:-1])
    inner = bounds[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    if len(inner):
        first[inner] = mask[inner]
        last[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def window_starts(rows: np.ndarray, width: int) -> np.ndarray:
    """Token numbers at which `width` consecutive tokens lie in one row."""
    if len(rows) < width:
        return np.zeros(0, np.int64)
    return np.flatnonzero(rows[width - 1 :] == rows[: len(rows) - width + 1])


def window_hashes(tokens: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` consecutive token hashes from each start."""
    out = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _PRIME + tokens[starts + k]
    return mix(out)


def counts_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)[:n] if len(rows) else np.zeros(n, np.int64)
