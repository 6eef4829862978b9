"""Words of whole text columns as numpy arrays.

An Arrow string column is one run of bytes with offsets, so its words can be
found and hashed for many texts at once. A word's hash is a polynomial over
its bytes, mixed, in 64 bits; equal words have equal hashes in every process.
"""

import numpy as np
import pyarrow as pa

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BASE_INV = pow(_BASE, -1, 1 << 64)
SLICE = 1 << 20


def mix(x):
    """Finaliser of splitmix64, on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _byte_values():
    return mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def white_space_words():
    """Byte classes of words without space, tab, line feed, vertical tab, form feed, carriage return."""
    word = np.ones(256, bool)
    word[[32, 9, 10, 11, 12, 13]] = False
    return word


def letter_words():
    """Byte classes of words of digits, a-z and everything beyond ASCII. Use on lower-cased text."""
    word = np.zeros(256, bool)
    word[48:58] = word[97:123] = word[128:] = True
    return word


def lower_table():
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold


def text_slices(column, most=SLICE):
    """Row ranges of an Arrow string column, each with at most ``most`` bytes or a single row."""
    n = len(column)
    if n == 0:
        return
    _, offsets = raw(column)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def raw(column):
    """Bytes and offsets of an Arrow string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1, column.offset * 8)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


class Splitter:
    """Finds and hashes the words of rows of a text column."""

    def __init__(self, classes, lower):
        self.classes, self.fold = classes, lower_table() if lower else None
        self.values, self.powers, self.inverse = _byte_values(), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n):
        if len(self.powers) < n:
            steps = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
            steps[0][0] = steps[1][0] = 1
            self.powers, self.inverse = (np.multiply.accumulate(s) for s in steps)

    def split(self, data, offsets):
        """Of the rows between ``offsets``: starts and ends of words (bytes of ``data``), first word of each row, and hashes."""
        base, end = int(offsets[0]), int(offsets[-1])
        part = data[base:end]
        rows = offsets - base
        if self.fold is not None:
            part = self.fold[part]
        is_word = self.classes[part]
        n = len(part)
        if n == 0:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(offsets), np.int64), np.zeros(0, np.uint64)
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        before = np.empty(n, bool)
        before[0], before[1:] = False, is_word[:-1]
        starts = np.flatnonzero(is_word & (~before | edge[:-1]))
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, is_word[1:]
        ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
        self._grow(max(n, SLICE))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[part] * self.powers[:n], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self.inverse[starts]
        hashes = mix(hashes + (ends - starts).astype(np.uint64) * _GOLD)
        first = np.searchsorted(starts, rows)
        return starts + base, ends + base, first, hashes


def grams(hashes, k):
    """Hashes of k consecutive words; the i-th starts at word i. Empty when there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _M1 + hashes[j:j + n]
    return mix(out ^ np.uint64(k))


def gram_rows(first, k):
    """Whether a gram that starts at word i stays in its row, for every gram of ``grams``."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for end in first[1:-1]:
        ok[max(0, int(end) - k + 1):max(0, int(end))] = False
    return ok
