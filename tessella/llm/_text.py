"""Vectorised handling of the texts of an Arrow batch, on their UTF-8 bytes.

Words are maximal runs of bytes other than space and 0x09-0x0D. All of these separators are ASCII, so
splitting bytes splits code points. Word and word-sequence hashes are 64-bit polynomial hashes over random
byte values; they never depend on the batch, so equal words hash equally on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
KEPT_POWERS = 1 << 21  # entries of the power tables that are kept between calls
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    tables = []
    for base in (_BASE, _INVERSE):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps, dtype=np.uint64))
    if n <= KEPT_POWERS:
        _powers[:] = tables
    return tables[0], tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Bit finaliser of 64-bit hashes (new array)."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n+1 offsets of each; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most `most` bytes, or a single longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


@dataclass
class Words:
    """Words of a run of documents: byte ranges, and first[d] to first[d+1] are the words of document d."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, fold: np.ndarray | None = None) -> np.ndarray:
        """64-bit hash of each word, after mapping its bytes by fold."""
        values = _BYTE_VALUES if fold is None else _BYTE_VALUES[fold]
        out, i = np.empty(len(self.start), np.uint64), 0
        while i < len(out):  # by runs of words of about SLICE_BYTES, so that a long text takes no more
            low = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, low + SLICE_BYTES, "right")))
            start, end = self.start[i:j] - low, self.end[i:j] - low
            n = int(end[-1])
            power, inverse = _power_tables(n + 1)
            sums = np.empty(n + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[self.data[low : low + n]] * power[:n], out=sums[1:])
            out[i:j] = mix((sums[end] - sums[start]) * inverse[start])
            i = j
        return out


def find_words(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> Words:
    solid = ~blank[data]
    n = len(data)
    starts = solid.copy()
    starts[1:] &= ~solid[:-1]
    bounds = offsets[:-1][offsets[:-1] < n]
    starts[bounds] = solid[bounds]
    stops = solid.copy()
    stops[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    stops[last] = solid[last]
    start = np.flatnonzero(starts)
    end = np.flatnonzero(stops) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by first word; runs may cross documents. Shorter by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[j : j + n]
    return mix(h)


def whole_runs(first: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over n run starts: True where the k words from there lie in one document."""
    mask = np.ones(n, bool)
    inner = np.diff(first) > 0
    ends = first[1:][inner]
    for j in range(1, k):
        at = ends - j
        at = at[(at >= 0) & (at < n)]
        mask[at] = False
    return mask
