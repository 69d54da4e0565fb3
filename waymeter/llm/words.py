"""Words of many texts at once, as numpy arrays over an Arrow column's own buffers.

A word is a run of bytes other than ASCII white space (0x20, 0x09-0x0D). Word and window hashes are polynomials over Z/2^64
with an odd base, read off prefix sums, so that the cost is a few vector operations per byte whatever the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The splitmix64 finaliser: one 64-bit value to another, one to one."""
    x = (x + U((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))).astype(U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U), 7)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]


class _Powers:
    """Powers of an odd base and of its inverse, as far as they have been asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // (1 << 18)) << 18
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)])) for b in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_IN_WORD, _IN_WINDOW = _Powers(0xD6E8FEB86659FD93), (_Powers(0xA0761D6478BD642F), _Powers(0xE7037ED1A0B428DB))


@dataclass
class Words:
    """Words of rows ``first`` to ``last`` (exclusive) of a column: byte spans in ``data``, hashes, and each row's share ``at[row - first] .. at[row - first + 1]``."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def rows(self) -> np.ndarray:
        """Each word's row, from 0 at ``first``."""
        return np.repeat(np.arange(self.last - self.first), self.counts())

    def windows(self, k: int, which: int = 0) -> np.ndarray:
        """A hash of the ``k`` words from each word on; only those that end in the same row mean anything (see :meth:`whole`)."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, U)
        up, down = _IN_WINDOW[which].to(n + 1)
        h = self.hashes if not which else mix(self.hashes, 101)
        sums = np.concatenate([np.zeros(1, U), np.cumsum(h * up[:n], dtype=U)])
        return mix((sums[k:] - sums[:-k]) * down[: n - k + 1], which)

    def whole(self, k: int) -> np.ndarray:
        """Whether the ``k`` words from each word on lie in one row; as long as :meth:`windows`."""
        n = len(self.hashes)
        return (np.arange(n) + k <= np.repeat(self.at[1:], self.counts()))[: max(0, n - k + 1)]


def words(column: pa.Array, lower: bool = False, chunk_bytes: int = 1 << 20) -> Iterator[Words]:
    """Splits a string column; null has no words. Rows are taken together up to ``chunk_bytes`` of text, a longer text by itself."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(off, off[first] + chunk_bytes, "right")) - 1)
        seg, begins = data[off[first] : off[last]], off[first : last + 1] - off[first]
        n, inside = len(seg), _WORD[seg]
        cut = np.zeros(n + 1, bool)
        cut[begins] = True
        starts = np.flatnonzero(inside & (cut[:n] | ~np.concatenate([[False], inside[:-1]]))) if n else np.zeros(0, np.int64)
        ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]]))) + 1 if n else np.zeros(0, np.int64)
        up, down = _IN_WORD.to(n + 1)
        sums = np.concatenate([np.zeros(1, U), np.cumsum((_BYTE_LOWER if lower else _BYTE)[seg] * up[:n], dtype=U)])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))
        yield Words(first, last, seg, starts, ends, np.searchsorted(starts, begins), hashes)
        first = last
