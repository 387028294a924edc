"""Words and word windows of UTF-8 texts, hashed with numpy on Arrow buffers.

Helpers of the document operators. Words are maximal runs of word bytes; all
bytes of a non-ASCII character are word bytes in every class used here, so a
class of ASCII characters can be tested byte by byte. Buffers are worked off in
slices cut between words, so one very long text needs no more memory than
about 24 bytes for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes worked off at once.
SLICE = 1 << 19

#: Odd multipliers of the rolling hashes.
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xC2B2AE3D27D4EB4F
SECOND_BASE = 0x165667B19E3779F9


def _class(separators: list[tuple[int, int]]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for first, last in separators:
        table[first : last + 1] = False
    return table


#: Everything but blank and the controls from tab to carriage return.
SPACED = _class([(0x20, 0x20), (0x09, 0x0D)])
#: ASCII letters and digits and everything beyond ASCII.
ALNUM = _class([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


class Words(NamedTuple):
    """Words of a batch of texts: hash, byte span in data, and for text i the
    words first[i] to first[i + 1]."""

    data: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """base ** i and its inverse modulo 2 ** 64 for i below the largest size asked for."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (self._grow(x, size) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grow(x: int, n: int) -> np.ndarray:
        out = np.full(n, x, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_BYTES = _Powers(BYTE_BASE)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other and the n + 1 offsets; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _slices(data: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    a, n = 0, len(data)
    while a < n:
        b = min(n, a + SLICE)
        if b < n:
            gaps = np.flatnonzero(~table[data[a:b]])
            while not len(gaps) and b < n:  # one word longer than a slice
                more = np.flatnonzero(~table[data[b : b + SLICE]])
                gaps, b = more + (b - a), min(n, b + SLICE)
            b = a + int(gaps[-1]) + 1 if len(gaps) else n
        yield a, b
        a = b


def words(texts: pa.Array, table: np.ndarray, lower: bool) -> Words:
    """Words of every text; lower folds A-Z before hashing."""
    data, offsets = text_buffer(texts)
    hashes, begins, ends = [], [], []
    for a, b in _slices(data, table):
        part = data[a:b]
        inside = table[part]
        edges = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, b)] - a
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[edges] = inside[edges]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        stops[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
        begin, end = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        up, down = _BYTES.get(len(part) + 1)
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        folded = _LOWER[part] if lower else part
        np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        raw = (total[end] - total[begin]) * down[begin]
        hashes.append(mix(raw + (end - begin).astype(np.uint64) * np.uint64(SECOND_BASE)))
        begins.append(begin + a)
        ends.append(end + a)
    if not hashes:
        none = np.zeros(0, np.int64)
        return Words(data, none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64))
    begin = np.concatenate(begins)
    return Words(data, np.concatenate(hashes), begin, np.concatenate(ends), np.searchsorted(begin, offsets))


def windows(h: np.ndarray, k: int, base: int = WORD_BASE) -> np.ndarray:
    """Hash of every k consecutive values; those across texts are the caller's to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total = total * np.uint64(base) + h[i : i + n]
    return mix(total + np.uint64(k))


def window_counts(first: np.ndarray, k: int) -> np.ndarray:
    """Windows of k words in each text."""
    return np.maximum(np.diff(first) - k + 1, 0)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as counts say, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)


def sliding_min_positions(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the smallest of every w consecutive values, the rightmost of equals."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = values[:n].copy(), np.arange(n)
    for i in range(1, w):
        other = values[i : i + n]
        better = other <= best
        best[better] = other[better]
        at[better] = np.flatnonzero(better) + i
    return at


def signed(h: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark longs."""
    return pa.array(h.view(np.int64))
