"""Byte blocks of Arrow text columns: words, windows and polynomial hashes in numpy.

Spark hands each task Arrow batches; a batch is cut into blocks of a few million bytes, and every
step below works on a whole block at once. Texts are UTF-8 bytes, never prefixes of them; a null
text is an empty one. One text longer than a block makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
NOT_SPACE = ~ASCII_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTER_DIGIT = np.zeros(256, bool)
LETTER_DIGIT[0x30:0x3A] = LETTER_DIGIT[0x61:0x7B] = LETTER_DIGIT[0x80:] = True


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and the ``hi - lo + 1`` places between texts."""

    lo: int
    hi: int
    data: np.ndarray
    cuts: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


@dataclass
class Words:
    """Byte places of the words of a block; words ``bounds[i]`` to ``bounds[i + 1]`` are text i's."""

    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column, nulls as empty texts."""
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    cuts = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1] if places else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), cuts


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    data, cuts = buffers(batch.column(column))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield Block(lo, hi, data[cuts[lo] : cuts[hi]], cuts[lo : hi + 1] - cuts[lo])
        lo = hi


def runs(mask: np.ndarray, cuts: np.ndarray) -> Words:
    """Maximal runs of true bytes, broken at the places between texts."""
    n = len(mask)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    inner = cuts[1:-1]
    before[inner[inner < n]] = False
    after[inner[inner > 0] - 1] = False
    begin = np.flatnonzero(mask & ~before)
    end = np.flatnonzero(mask & ~after) + 1
    return Words(begin, end, np.searchsorted(begin, cuts))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), BLOCK_BYTES + 1)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers(int(BASE))


class Prefix:
    """Prefix polynomial hashes modulo 2^64: the hash of any byte range in constant time."""

    def __init__(self, data: np.ndarray):
        up, self.down = _POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def raw(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[begin]) * self.down[begin]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(begin, end))


def _join(values: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(first), np.uint64(k))
    for j in range(k):
        h = h * STEP + values[first + j]
    return mix(h)


def windows(values: np.ndarray, bounds: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of each text, the first word of each, and bounds by text.

    With ``short``, a text of fewer words, but not none, is one window.
    """
    counts = np.diff(bounds)
    firsts = np.arange(len(values))
    hashes = np.zeros(len(values), np.uint64)
    whole = firsts + k <= np.repeat(bounds[1:], counts)
    at = firsts[whole]
    if len(at):
        hashes[at] = _join(values, at, k)
    if short:
        for m in range(1, k):
            few = bounds[:-1][counts == m]
            if len(few):
                whole[few] = True
                hashes[few] = _join(values, few, m)
    at = firsts[whole]
    return hashes[at], at, np.searchsorted(at, bounds)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values between each two bounds."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def arrow_batches(spark, rows: int = 512) -> None:
    """Small Arrow batches: long texts make large ones otherwise."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
