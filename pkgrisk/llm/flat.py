"""Whole texts as flat numpy arrays.

A column of texts in an Arrow batch is one byte buffer with offsets. The classes here find words or lines of many
texts at once in that buffer and hash them without a Python object per word. Work is done in blocks of about
``BLOCK`` bytes, each holding whole texts, so memory does not follow the size of an Arrow batch.

A word's hash is a polynomial over 2^64 of random byte values, taken from running sums and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pkgrisk.session import small_batches as small_batches  # the operators take it from here

BLOCK = 1 << 20
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: bytes of words: everything but white space; letters, digits and everything above ASCII
NOT_SPACE = ~byte_table(SPACES)
ALNUM = byte_table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i for i below n, kept between calls."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK + (1 << 18))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finishing step of a 64-bit hash, on a new array."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … (counts[0] of them), starts[1], …"""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)


class Texts:
    """A block of texts: bytes, and the offsets at which each text begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.raw = data
        self.offsets = offsets.astype(np.int64)
        self.data = LOWER[data]
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def runs(self, member: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the longest runs of bytes in ``member``, none across texts."""
        is_in = member[self.data if data is None else data]
        n = len(is_in)
        begins = is_in.copy()
        begins[1:] &= ~is_in[:-1]
        finish = is_in.copy()
        finish[:-1] &= ~is_in[1:]
        edge = self.offsets[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] = is_in[edge]
        finish[edge - 1] = is_in[edge - 1]
        return np.flatnonzero(begins), np.flatnonzero(finish) + 1

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of (lower-cased) bytes."""
        up, down = powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_VALUES[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[ends] - self._sums[starts]) * down[starts])

    def words(self, member: np.ndarray = NOT_SPACE) -> Words:
        return Words(self, *self.runs(member))


class Words:
    """Words of a block, in order; ``first[i]:first[i + 1]`` are those of text i."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.first = np.searchsorted(starts, texts.offsets)
        self.counts = np.diff(self.first)
        self.hash = texts.hashes(starts, ends)

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``width`` words and each text's number of them.

        A text with fewer words is one shingle of all its words; one without words has none.
        """
        n = len(self.hash)
        full = np.maximum(self.counts - width + 1, 0)
        short = (self.counts > 0) & (full == 0)
        each = full + short
        if n == 0:
            return np.zeros(0, np.uint64), each
        at = ranges(self.first[:-1], each)
        out = np.full(len(at), np.uint64(width), np.uint64)
        padded = np.concatenate([self.hash, np.zeros(width, np.uint64)])
        left = np.repeat(np.where(short, self.counts, width), each)
        for k in range(width):
            word = padded[at + k]
            if short.any():
                word = np.where(left > k, word, np.uint64(0))
            out = out * np.uint64(0xD6E8FEB86659FD93) + word
        return mix(out), each


def distinct(values: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of every group, sorted within it, and their numbers."""
    group = np.repeat(np.arange(len(each)), each)
    order = np.lexsort((values, group))
    values, group = values[order], group[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (group[1:] != group[:-1])
    return values[keep], np.bincount(group[keep], minlength=len(each))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, width, n + 1, column.offset * np.dtype(width).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, Texts]]:
    """Consecutive rows [low, high) of a text column and their texts, about ``size`` bytes at a time."""
    data, offsets = buffers(column)
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, high, Texts(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
        low = high
