"""Vectorised word and shingle hashing over the UTF-8 buffers of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the rolling polynomial and its inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
#: Bytes of text hashed together; a longer document is hashed alone and whole.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of documents [a, b) of at most ``most`` bytes, or of one longer document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        tables = []
        for base in (_P, _P_INV):
            t = np.full(size, base, dtype=np.uint64)
            t[0] = 1
            np.multiply.accumulate(t, out=t)
            tables.append(t)
        if size > 4 * BLOCK_BYTES:  # of one very long document: not kept
            return tables[0], tables[1]
        _powers[:] = tables
    return _powers[0], _powers[1]


def word_bounds(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+``, or of the runs of bytes where ``solid`` holds."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    if solid is None:
        solid = ~_SPACE[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    power, inverse = _power_tables(len(data) + 1)
    rolled = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=rolled[1:])
    h = (rolled[ends] - rolled[starts]) * inverse[starts]
    return mix64(h + (ends - starts).astype(np.uint64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts data[start:end] as a string column; the slices must be valid UTF-8."""
    size = ends - starts
    offsets = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(size, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))).cast(pa.string())


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): an order that brings equal keys together, and where in it each distinct key begins."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, dtype=np.int64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Of each document the sorted distinct hashes of its ``width``-word shingles.

    A-Z count as a-z.  A document of fewer words has its whole sequence as one
    shingle; one without words has none.
    """
    for a, b in blocks(offsets):
        lo, hi = offsets[a], offsets[b]
        part = _LOWER[data[lo:hi]]
        offs = offsets[a : b + 1] - lo
        starts, ends, doc = word_bounds(part, offs)
        h = word_hashes(part, starts, ends)
        at = np.searchsorted(doc, np.arange(b - a + 1))
        if len(h) >= width:
            m = len(h) - width + 1
            s = np.full(m, width, dtype=np.uint64)
            for k in range(width):
                s = mix64(s * np.uint64(0xD6E8FEB86659FD93) + h[k : k + m])
        else:
            s = np.zeros(0, dtype=np.uint64)
        for i in range(b - a):
            words = at[i + 1] - at[i]
            if words >= width:
                yield np.unique(s[at[i] : at[i + 1] - width + 1])
            elif words:
                one = np.full(1, words, dtype=np.uint64)
                for x in h[at[i] : at[i + 1]]:
                    one = mix64(one * np.uint64(0xD6E8FEB86659FD93) + x)
                yield one
            else:
                yield s[:0]
