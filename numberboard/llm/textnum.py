"""Words and shingles of a batch of texts as numpy arrays, without a loop over words.

A batch is an Arrow string column. White space is the six ASCII characters 0x20 and 0x09-0x0D; all
other bytes belong to words. Words are known by 64-bit fingerprints: a polynomial over random byte
values, mixed. Null texts count as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_REACH = 4096
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_STEP = np.cumprod(np.full(_REACH, 0x9E3779B97F4A7C15, dtype=np.uint64))
_LEAP = np.cumprod(np.full(_REACH, 0xD1342543DE82EF95, dtype=np.uint64))
_PLACE = _rng.integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_LENGTH = _rng.integers(1, 2**64, 16, dtype=np.uint64)
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``limit`` bytes of text each; a longer text stands alone."""
    _, offsets = raw(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each begins (one more for the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """``starts``/``ends``: byte range of each word; ``first``: first word of each text, one more for the end."""

    bytes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = raw(column)
        solid = ~WHITE[data]
        begins, stops = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        stops[:-1] &= ~solid[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[edges] = solid[edges]
        stops[edges - 1] = solid[edges - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return cls(data, offsets, starts, ends, np.searchsorted(starts, offsets))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A fingerprint of each word, of its lower-cased form (A-Z) if asked."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        size = self.ends - self.starts
        at = np.cumsum(size) - size
        kind = np.int32 if len(self.bytes) < 1 << 31 else np.int64
        place = np.arange(int(size.sum()), dtype=kind) - np.repeat(at.astype(kind), size)
        long = int(size.max()) > _REACH
        solid = self.bytes[~WHITE[self.bytes]]  # the bytes of all words
        value = (_LOWER if lower else _BYTE)[solid]
        value *= _STEP[place % _REACH if long else place]
        if long:  # nothing for the others: a word's fingerprint must not depend on its batch
            far = np.flatnonzero(place >= _REACH)
            value[far] *= _LEAP[(place[far] // _REACH) % _REACH]
        return mix(np.add.reduceat(value, at) + size.astype(np.uint64) * _LEAP[0])

    def text_of(self) -> np.ndarray:
        """Number of the text each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of all runs of ``n`` words, one for each start (runs over text ends included)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    total = np.full(len(words) - n + 1, _LENGTH[n], dtype=np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * _PLACE[k]
    return mix(total)


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct fingerprints of its runs of ``n`` words.

    A text with fewer words gives its whole sequence as one; a text without words gives none.
    """
    every = grams(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield grams(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
