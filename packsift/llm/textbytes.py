"""Words and their hashes straight from the UTF-8 bytes of an Arrow text column.

Everything is numpy over the buffer of a batch, a bounded slice of whole documents at
a time, so memory does not follow the size of a batch. A document longer than the
slice bound is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# The characters that separate words, [\x20\x09-\x0D].
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

SLICE_BYTES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def splitmix(x: np.ndarray) -> np.ndarray:
    """A mixing of 64 bits, one to one."""
    x = x.astype(np.uint64, copy=True)
    x += _ODD
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is the empty text."""
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1].copy() if n else np.zeros(1, np.int64)
    lo, hi = int(offs[0]), int(offs[-1])
    raw = np.frombuffer(data, np.uint8)[lo:hi] if data is not None and hi > lo else np.zeros(0, np.uint8)
    offs -= lo
    if column.null_count:
        null = np.asarray(column.is_null())
        if (np.diff(offs)[null] > 0).any():  # a null slot may still span bytes
            column = column.fill_null("")
            return text_buffer(column)
    return raw, offs


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes, or of one document."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


@dataclass
class Words:
    """Words of a slice: byte ranges in ``data`` and the first word of each document."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # documents + 1

    @property
    def per_doc(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.per_doc)


class Splitter:
    """Finds words and hashes them; ``lower`` folds A-Z, ``extra`` adds separators."""

    def __init__(self, lower: bool = False, extra: tuple[int, ...] = (), seed: int = 1):
        self.is_word = np.ones(256, bool)
        self.is_word[list(SEPARATORS) + list(extra)] = False
        fold = np.arange(256)
        if lower:
            fold[65:91] += 32
        self.seed = seed
        self.table = splitmix(fold.astype(np.uint64) + np.uint64(seed << 32))
        self.base = np.uint64((0xD1342543DE82EF95 + 2 * seed) | 1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self._powers = np.ones(1, np.uint64)
        self._backs = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            with np.errstate(over="ignore"):
                steps = np.full(n, self.base, np.uint64)
                steps[0] = 1
                self._powers = np.multiply.accumulate(steps)
                steps = np.full(n, self.inverse, np.uint64)
                steps[0] = 1
                self._backs = np.multiply.accumulate(steps)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> Words:
        """``offsets`` start at 0 and end at ``len(data)``."""
        word = self.is_word[data]
        n = len(data)
        heads = offsets[:-1][np.diff(offsets) > 0]
        before = np.zeros(n, bool)
        before[1:] = word[:-1]
        before[heads] = False
        start = np.flatnonzero(word & ~before)
        after = np.zeros(n, bool)
        after[:-1] = word[1:]
        after[heads[1:] - 1 if len(heads) else heads] = False
        end = np.flatnonzero(word & ~after) + 1
        return Words(data, start, end, np.searchsorted(start, offsets))

    def hashes(self, words: Words) -> np.ndarray:
        """One 64-bit hash per word, equal exactly for equal bytes after folding (but
        for collisions)."""
        n = len(words.data)
        self._grow(n + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.table[words.data] * self._powers[:n], out=sums[1:])
            out = (sums[words.end] - sums[words.start]) * self._backs[words.start]
            return splitmix(out ^ (words.end - words.start).astype(np.uint64))


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of ``k`` consecutive words from each position; positions whose words
    would pass the end of the array get a value of no meaning."""
    n = len(hashes)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        base = np.uint64((0xA0761D6478BD642F + 2 * seed) | 1)
        for j in range(k):
            out *= base
            out[: n - j] += hashes[j:] if j else hashes
        return splitmix(out + np.uint64(k))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Whether ``k`` words from each position stay in one document."""
    per = np.diff(first)
    n = int(first[-1])
    left = np.repeat(first[1:], per) - np.arange(n)
    return left >= k


def whole(hashes: np.ndarray, seed: int = 0) -> int:
    """One hash of a whole short sequence, its length included."""
    value, base = len(hashes) + 1, (0xE7037ED1A0B428DB + 2 * seed) | 1
    for h in hashes.tolist():
        value = (value * base + h) & 0xFFFFFFFFFFFFFFFF
    return int(splitmix(np.array([value], np.uint64))[0])
