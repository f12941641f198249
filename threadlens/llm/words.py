"""Vectorised word splitting and hashing of Arrow string columns (runs inside Spark tasks).

A word is a maximal run of characters other than space and U+0009..U+000D.  All six separators
are ASCII, so words can be cut on the UTF-8 bytes of a whole Arrow batch at once; no Python object
is made per word.  Batches are worked on in slices of a few MB so that memory stays bounded
whatever the number of rows or the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULT = np.uint64(0x9E3779B97F4A7C13)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64, inverse: np.uint64):
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            out = []
            for b in (self.base, self.inverse):
                a = np.full(n, b, dtype=np.uint64)
                a[0] = 1
                out.append(np.cumprod(a, dtype=np.uint64))
            self.up, self.down = out
        return self.up, self.down


_BYTE_POWERS = _Powers(_MULT, _INV)
_WORD_MULT = np.uint64(0xC2B2AE3D27D4EB4F)
_WORD_POWERS = _Powers(_WORD_MULT, np.uint64(pow(int(_WORD_MULT), -1, 1 << 64)))


@dataclass
class Words:
    """Words of a run of texts: byte spans in ``data`` and the first word of every text."""

    data: np.ndarray        # uint8, the bytes of all texts
    bounds: np.ndarray      # int64, n_texts + 1: byte bounds of the texts in data
    starts: np.ndarray      # int64 per word
    ends: np.ndarray        # int64 per word
    first: np.ndarray       # int64, n_texts + 1: word bounds of the texts

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` maps A-Z to a-z first."""
        return SpanHasher(self.data, lower)(self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()


class SpanHasher:
    """64-bit hashes of byte spans: polynomial prefix sums, shifted to a common origin."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        up, self.down = _BYTE_POWERS.get(len(data) + 1)
        self.acc = np.zeros(len(data) + 1, dtype=np.uint64)
        x = (_BYTE_LOWER if lower else _BYTE)[data]
        x *= up[:len(data)]
        np.cumsum(x, out=self.acc[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.acc[ends]
        h -= self.acc[starts]
        h *= self.down[starts]
        h += (ends - starts).astype(np.uint64)
        return mix64(h)


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run ``h[starts:ends]`` of word hashes (runs may overlap)."""
    if len(starts) == 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _WORD_POWERS.get(len(h) + 1)
    acc = h * up[:len(h)]
    np.cumsum(acc, out=acc)
    g = acc[ends - 1] - np.where(starts > 0, acc[starts - 1], np.uint64(0))
    g *= down[starts]
    g += (ends - starts).astype(np.uint64)
    return mix64(g)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column of at most ``limit`` bytes each (one row at least)."""
    n = len(column)
    if n == 0:
        return
    offsets = _offsets(column)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + len(column) + 1]
    return off.astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the byte bounds of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    off = _offsets(column) if len(column) else np.zeros(1, dtype=np.int64)
    buf = column.buffers()[2] if len(column) else None
    if buf is None:
        return np.zeros(0, dtype=np.uint8), off - off[0]
    return np.frombuffer(buf, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def split_words(column: pa.Array) -> Words:
    """Words of every row of a string column; null and empty rows have none."""
    data, bounds = text_bytes(column)
    inside = ~_SPACE[data]
    before = np.empty(len(data), dtype=bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        cuts = bounds[1:-1]
        cuts = cuts[cuts < len(data)]
        before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), dtype=bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = bounds[1:-1]
        after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(starts, bounds)
    return Words(data, bounds, starts, ends, first)


def ngrams(words: Words, h: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word runs of each text, and their bounds per text.

    ``short``: a text of 1 to k-1 words gives its whole sequence as one run; otherwise none.
    """
    n = words.counts
    per = np.maximum(n - k + 1, 0)
    if short:
        per = np.where((n > 0) & (n < k), 1, per)
    first = np.concatenate(([0], np.cumsum(per)))
    starts = np.repeat(words.first[:-1] - first[:-1], per) + np.arange(first[-1])
    ends = np.minimum(starts + k, np.repeat(words.first[1:], per))
    return run_hashes(h, starts, ends), first


def as_signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=np.uint64).view(np.int64)
