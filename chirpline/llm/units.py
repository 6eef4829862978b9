"""Pieces of text that a byte-level BPE tokenizer with the usual split pattern treats apart.

Nothing that the split pattern matches has white space after other characters,
and a match depends on nothing before it. So a text may be cut wherever white
space follows another character: ids of the units, one after the other, are
the ids of the text. A unit is a run of white space with the run of other
characters behind it.
"""

import re
import sys
from types import ModuleType

import numpy as np
import pyarrow as pa

from chirpline.llm.words import raw

# The characters of the White_Space property.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = frozenset(re.findall(f"[{SPACES}]", "".join(map(chr, range(0x3001)))))
UNIT = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
DEFAULT_FILE = "byte_bpe_50k.json"


def tokenizer_path(path=None):
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def kept_in_process(key, build):
    """What ``build()`` gives, kept for all later tasks of this worker process.

    Functions reach the workers by value, so a global of this module would be a new one in each task.
    """
    store = sys.modules.setdefault("_chirpline_kept", ModuleType("_chirpline_kept")).__dict__
    if key not in store:
        store[key] = build()
    return store[key]


class Memory:
    """A dictionary that forgets: at ``most`` new entries the older half goes."""

    def __init__(self, most):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys):
        new, old, out = self.new, self.old, []
        for k in set(keys):
            if k not in new:
                if k in old:
                    new[k] = old[k]
                else:
                    out.append(k)
        return out

    def put(self, key, value):
        self.new[key] = value

    def tidy(self):
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


class Recent:
    """Values of keys, the older half of which is forgotten beyond ``most`` new ones."""

    def __init__(self, most):
        self.most, self.new, self.old = most, {}, {}

    def values(self, keys, make):
        """The value of every key; ``make(keys)`` gives those of a list of unknown ones. Keys are distinct, or made twice."""
        found = list(map(self.new.get, keys))
        gaps = [i for i, v in enumerate(found) if v is None]
        if gaps:
            missing = [keys[i] for i in gaps]
            values = list(map(self.old.get, missing))
            made = iter(make([k for k, v in zip(missing, values) if v is None]))
            values = [next(made) if v is None else v for v in values]
            for i, v in zip(gaps, values):
                found[i] = v
            self.new.update(zip(missing, values))
            if len(self.new) > self.most:
                self.old, self.new = self.new, {}
        return found


class Shelf:
    """Records of byte strings, side by side in arrays; beyond ``most`` new ones the older half goes.

    A record is some ragged columns, each a pair of values and counts. A key is
    found by its hash and compared byte by byte.
    """

    def __init__(self, most):
        self.most, self.new, self.old = most, None, None

    def __len__(self):
        return sum(len(part[0]) for part in (self.new, self.old) if part)

    def records(self, names, keys, make):
        """Columns of all keys, given as distinct hashes and as values and counts; ``make(places)`` gives those of unknown ones."""
        news, olds = (self.places(part, names, keys) for part in (self.new, self.old))
        made = np.flatnonzero((news < 0) & (olds < 0))
        held = np.flatnonzero((news < 0) & (olds >= 0))
        parts = [[take_rows(*keys, made), *make(made)]]
        if len(held):
            parts.append([take_rows(*c, olds[held]) for c in self.old[2]])
        added = stacked(parts)
        if self.new:
            known = np.flatnonzero(news >= 0)
            found = stacked([[take_rows(*c, news[known]) for c in self.new[2]], added])
        else:
            known, found = made[:0], added
        back = np.empty(len(names), np.int64)
        back[np.concatenate([known, made, held])] = np.arange(len(names))
        self.add(names[np.concatenate([made, held])], added)
        return [take_rows(*c, back) for c in found[1:]]

    @staticmethod
    def places(part, names, keys):
        """The record of each key in a part, or -1."""
        if not part:
            return np.full(len(names), -1)
        known, place, columns, _ = part
        at = np.minimum(np.searchsorted(known, names), len(known) - 1)
        out = np.where(known[at] == names, place[at], -1)
        hit = np.flatnonzero(out >= 0)
        (one, n), (two, m) = take_rows(*keys, hit), take_rows(*columns[0], out[hit])
        if not (np.array_equal(n, m) and np.array_equal(one, two)):
            same = [a == b for a, b in zip(split_rows(one, n), split_rows(two, m))]
            out[hit[~np.array(same, bool)]] = -1
        return out

    def add(self, names, columns):
        if not len(names):
            return
        if self.new:
            names, columns = np.concatenate([self.new[3], names]), stacked([self.new[2], columns])
        place = np.argsort(names, kind="stable")
        part = names[place], place.astype(np.int32), columns, names
        self.old, self.new = (part, None) if len(names) > self.most else (self.old, part)


def split_rows(values, counts):
    """The bytes of each row of a ragged array."""
    data, ends = values.tobytes(), [0, *np.cumsum(counts.astype(np.int64) * values.itemsize).tolist()]
    return [data[x:y] for x, y in zip(ends, ends[1:])]


def stacked(parts):
    """Ragged columns of several parts, one below the other."""
    if len(parts) == 1:
        return parts[0]
    return [tuple(map(np.concatenate, zip(*columns))) for columns in zip(*parts)]


class Cutter:
    """Cuts texts, each with a space put in front if there is a ``lead``, into units, and names equal units by one number.

    A cut is before each byte of ``before`` that follows anything but these
    bytes or a character of ``joined``, and on both sides of each byte of
    ``alone``; so is one before each byte of ``after_word`` that follows an
    ASCII letter or digit. All of them are ASCII, but for ``joined``.
    """

    def __init__(self, before: str, joined: str = "", alone: str = "", lead: bool = True, after_word: str = ""):
        self.lead, self.ends, self.word = lead, np.zeros(256, bool), np.zeros(256, bool)
        self.ends[list(after_word.encode())] = self.word[[b for b in range(128) if chr(b).isalnum()]] = True
        self.before, self.alone, self.run = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
        self.before[list(before.encode())] = self.alone[list(alone.encode())] = True
        self.run[[ord(c) for c in before + joined if c < "\x80"]] = True
        self.joined = [np.frombuffer(c.encode(), np.uint8) for c in joined if c >= "\x80"]

    def units(self, texts):
        """Number of each unit, first unit of each row and the end, and the distinct units. Empty rows have none."""
        unit, first, distinct = self.unit_column(texts)
        return unit, first, distinct.to_numpy(zero_copy_only=False).tolist()

    def unit_column(self, texts):
        """``units`` with the distinct units as an Arrow column."""
        data, offsets = raw(texts)
        base, rows = int(offsets[0]), offsets - offsets[0]
        filled = np.diff(rows) > 0
        text = data[base:int(offsets[-1])]
        if self.lead:
            text = np.insert(text, rows[:-1][filled], 32)
            rows = rows + np.concatenate([[0], np.cumsum(filled)])
        if not len(text):
            return np.zeros(0, np.int64), rows, pa.array([], pa.large_string())
        cut = np.zeros(len(text), bool)
        at = np.flatnonzero(self.before[text[1:]] & ~self.run[text[:-1]]) + 1
        wide = np.flatnonzero(text[at - 1] >= 0x80)
        hold = np.zeros(len(at), bool)
        for c in self.joined:
            ends = at[wide] - 1
            same = ends >= len(c) - 1
            for j in range(len(c)):
                same &= text[ends - j] == c[-1 - j]
            hold[wide[same]] = True
        cut[at[~hold]] = True
        cut[1:] |= self.ends[text[1:]] & self.word[text[:-1]]
        lone = np.flatnonzero(self.alone[text])
        cut[lone] = True
        cut[lone[lone + 1 < len(text)] + 1] = True
        cut[rows[:-1][filled]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts, len(text)).astype(np.int64)
        column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(text)).dictionary_encode()
        return column.indices.to_numpy().astype(np.int64), np.searchsorted(starts, rows), column.dictionary


def take_rows(values, counts, rows):
    """The values of some rows of a ragged array, and how many each has."""
    starts = np.cumsum(counts) - counts
    sizes = counts[rows]
    ends = np.cumsum(sizes)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[rows] - (ends - sizes), sizes)], sizes


def row_sums(values, first):
    """Sums of the values between consecutive places of ``first``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])
