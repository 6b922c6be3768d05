"""Byte-level views of text columns: words, lines and fingerprints of many documents in a few numpy calls.

All functions work on *slices*: some documents whose UTF-8 bytes lie one after the other in one array. A slice
holds about ``SLICE_BYTES``, so the working memory of a task depends neither on the size of its partition nor on
the number of its rows (one longer document makes a slice of its own).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

# ASCII white space of the word pattern, 0x20 and 0x09 to 0x0D.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the entropy of 64-bit values over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _table(seed: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(256, dtype=np.uint64) * _ODD + np.uint64(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


_TABLES = {(s, low): _table(1 + s, low) for s in (0, 1) for low in (False, True)}
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, seed: int = 0) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    have = _POWERS.get(seed)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        have = np.full(size, _BASES[seed], dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 2 * SLICE_BYTES:  # of one very long document: not kept
            return have
        _POWERS[seed] = have
    return have


class Slice:
    """Documents whose bytes are ``data[offsets[i]:offsets[i + 1]]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.n = data, offsets, len(offsets) - 1

    def prefix(self, seed: int = 0, lower: bool = False) -> np.ndarray:
        """Running sum of byte values times powers, from which any stretch's fingerprint follows."""
        n = len(self.data)
        out = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLES[seed, lower][self.data] * powers(n, seed)[:n], out=out[1:])
        return out

    def fingerprints(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0, lower: bool = False, prefix=None) -> np.ndarray:
        """64-bit fingerprints of the byte stretches [start, end); equal bytes give equal values in any slice.

        The sums are aligned by the power of the distance to a fixed place, so a stretch's value does not depend on
        where it lies: sum of t[b_j] * base**(j - start) = (sum * base**-start).
        """
        p = self.prefix(seed, lower) if prefix is None else prefix
        value = (p[ends] - p[starts]) * inverse_powers(len(self.data), seed)[starts]
        return mix(value + (ends - starts).astype(np.uint64) * _ODD)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and where each document's words begin (n + 1 numbers)."""
        white = WHITE[self.data]
        before = np.empty(len(white) + 1, dtype=bool)
        before[0], before[1:] = True, white
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(white))]
        first = ~white & before[:-1]
        first[inner] = ~white[inner]
        after = np.empty(len(white), dtype=bool)
        after[:-1] = white[1:]
        if len(after):
            after[-1] = True
        after[inner - 1] = True
        starts, ends = np.flatnonzero(first), np.flatnonzero(~white & after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


_INVERSES: dict[int, np.ndarray] = {}


def inverse_powers(n: int, seed: int = 0) -> np.ndarray:
    have = _INVERSES.get(seed)
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        have = np.full(size, np.uint64(pow(int(_BASES[seed]), -1, 1 << 64)), dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size > 2 * SLICE_BYTES:
            return have
        _INVERSES[seed] = have
    return have


def give_back() -> None:
    """Free memory returns to the operating system: workers are kept between stages and would hold their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def slices(column: pa.Array, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int, Slice]]:
    """(first row, row after the last, slice) of a string column; NULL counts as empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1))
        yield i, j, Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    give_back()


def owners(starts_of: np.ndarray) -> np.ndarray:
    """For runs that begin at starts_of[:-1] and end at the next: the number of the run for each element."""
    return np.repeat(np.arange(len(starts_of) - 1), np.diff(starts_of))


def windows(values: np.ndarray, starts_of: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``width`` values inside one document, and the place of each run's first value."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        total = total * _ODD + values[k : n - width + 1 + k]
    end = np.repeat(starts_of[1:], np.diff(starts_of))[: n - width + 1]
    at = np.flatnonzero(np.arange(n - width + 1) + width <= end)
    return mix(total[at]), at


def batches(make, schema: pa.Schema):
    """Turn make(batch) -> iterator of {name: array} into a function for ``mapInArrow``."""

    def run(source):
        for batch in source:
            for columns in make(batch):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name].cast(f.type) for f in schema], schema=schema)

    return run


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)


def list_array(values: np.ndarray, starts_of: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts_of, type=pa.int32()), pa.array(values, type=kind))
