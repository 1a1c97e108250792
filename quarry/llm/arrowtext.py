"""Vectorised text helpers for Arrow batches: words, word hashes and k-word windows.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. UTF-8 text is worked on as
one flat byte array per slice of a batch, so the cost is a few numpy passes per byte and
memory is bounded by the slice (or by one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
SLICE_ROWS = 1000

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


class Texts:
    """One slice of a text column: ``buf`` (all bytes) and ``offs`` (n+1 byte offsets).
    A null text is an empty one."""

    def __init__(self, first: int, buf: np.ndarray, offs: np.ndarray):
        self.first, self.buf, self.offs = first, buf, offs
        self.n = len(offs) - 1

    def raw(self, i: int) -> bytes:
        return self.buf[self.offs[i]:self.offs[i + 1]].tobytes()

    def breaks(self) -> np.ndarray:
        """True at the first byte of each text."""
        b = np.zeros(len(self.buf) + 1, dtype=bool)
        b[self.offs[:-1]] = True
        return b[:-1]

    def words(self, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, start byte, end byte) of every word, in order. ``blank`` marks the bytes
        that part words."""
        if not len(self.buf):
            z = np.zeros(0, dtype=np.int64)
            return z, z, z
        space = blank[self.buf]
        edge = self.breaks()
        before = np.empty(len(space), dtype=bool)
        before[0] = True
        before[1:] = space[:-1]
        before |= edge
        after = np.empty(len(space), dtype=bool)
        after[-1] = True
        after[:-1] = space[1:] | edge[1:]
        starts = np.flatnonzero(~space & before)
        ends = np.flatnonzero(~space & after) + 1
        return np.searchsorted(self.offs, starts, side="right") - 1, starts, ends


def texts(column: pa.Array | pa.ChunkedArray, max_bytes: int = SLICE_BYTES,
          max_rows: int = SLICE_ROWS) -> Iterator[Texts]:
    """Slices of a string column of at most ``max_rows`` rows and about ``max_bytes``
    bytes (one longer text is a slice of its own)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + n + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1
        j = min(max(j, i + 1), i + max_rows, n)
        yield Texts(i, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
        i = j


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word (ranges are disjoint, in order and not empty)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    val = buf[np.repeat(starts, lens) + pos].astype(np.uint64) + np.uint64(1)
    val *= powers(_BASE, int(lens.max()))[pos]
    return mix(np.add.reduceat(val, first) + lens.astype(np.uint64))


def windows(doc: np.ndarray, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every k-word window inside one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    p = powers(_GRAM, k)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h += hashes[j:j + n] * p[j]
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return at, mix(h[at])
