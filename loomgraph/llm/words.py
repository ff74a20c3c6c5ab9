"""Words, word hashes and rolling n-gram hashes of whole Arrow columns, computed with numpy on their UTF-8 bytes.

A hash is a polynomial in odd multipliers modulo 2**64 over random byte values, then mixed; two
independent ones make a 128-bit key where the keys of a whole corpus must not collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

from loomgraph.llm.worker import give_back, kept

U = np.uint64
SLICE_BYTES = 1 << 19
_M = (U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(None)
def _byte_values(lower: bool, which: int) -> np.ndarray:
    t = np.random.default_rng(1234 + which).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    if lower:
        t[65:91] = t[97:123]
    return t


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i for i < n, grown when a longer array is asked for."""
    made = kept("powers", dict)
    have = made.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        m = int(_M[which])
        both = []
        for x in (m, pow(m, -1, 1 << 64)):
            out = np.full(size, U(x))
            out[0] = U(1)
            both.append(np.cumprod(out, dtype=np.uint64))
        have = made[which] = tuple(both)
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(29))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(32))


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Position-independent hash of values[start:end] for each pair, from one running sum."""
    p, inv = powers(len(values) + 1, which)
    c = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:-1], out=c[1:])
    return mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64) * U(0x2545F4914F6CDD1D))


@dataclass
class Words:
    """Words of the documents of one slice. doc_first[i]:doc_first[i+1] are those of document i."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc_first: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.doc_first) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.doc_first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts())

    def hashes(self, lower: bool = False, which: int = 0) -> np.ndarray:
        return range_hash(_byte_values(lower, which)[self.buf], self.start, self.end, which)

    def grams(self, h: np.ndarray, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each k consecutive words that lie in one document."""
        n = len(h)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc_end = np.repeat(self.doc_first[1:], self.counts())
        first = np.flatnonzero(np.arange(n) + k <= doc_end)
        return first, range_hash(h, first, first + k, which)


def slices(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `size` bytes: first row, end row, bytes, offsets. Null: empty.

    A longer single text stays whole in a run of its own."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    if not len(col):
        return
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        to = max(row + 1, int(np.searchsorted(off, off[row] + size, "right")) - 1)
        yield row, to, data[off[row] : off[to]], off[row : to + 1] - off[row]
        row = to
    give_back()


def words_of(buf: np.ndarray, off: np.ndarray, separator: np.ndarray = _SPACE) -> Words:
    """Maximal runs of bytes that aren't separators and don't cross a document's end."""
    n = len(buf)
    inside = ~separator[buf]
    cut = off[(off > 0) & (off < n)]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[cut] = inside[cut]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:]
    stop[cut - 1] = inside[cut - 1]
    start = np.flatnonzero(begin)
    return Words(buf, start, np.flatnonzero(stop) + 1, np.searchsorted(start, off))


def column_words(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for row, to, buf, off in slices(col, size):
        yield row, to, words_of(buf, off)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
