"""Exact token counts of every prefix of a text, by dynamic programming over byte-level BPE.

Of all tokens that end at a byte, exactly one can end the encoding of the
prefix up to it: the one that stays apart from the last token of the prefix
before it when both are encoded together. So one pass stores the last token
and the count of each prefix, and truncation or budget questions are look-ups:
nothing is encoded again.

The pass runs once for each distinct unit (see ``units``) and its counts are
remembered, as differences, so that a document's counts are a running sum.

Defined cases: null texts are empty and have 0 tokens; the special string of
the vocabulary is one token where it is complete and ordinary text before;
rows that repeat are counted each; other columns are not looked at.
"""

import json
from array import array
from operator import sub

import numpy as np
import regex
from pyspark.sql import DataFrame

from chirpline.llm.frames import arrow_map, doc_schema, table, texts_of
from chirpline.llm.units import SPACES, UNIT, Memory, kept_in_process, tokenizer_path
from chirpline.llm.words import raw

LIMIT = 1024
REMEMBERED = 300_000
# The split pattern of the vocabulary, and its matches of which a shorter prefix splits otherwise.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER, HEAD = 1 << 40, 4
LATE = ("'re", "'ve", "'ll")


def byte_letters():
    """The printable letter that stands for each byte in vocabulary files of this kind."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class PrefixCounter:
    """Token counts of all prefixes under one vocabulary."""

    def __init__(self, path=None, remembered=REMEMBERED):
        from tokenizers import Tokenizer

        with open(path := tokenizer_path(path), encoding="utf-8") as f:
            spec = json.load(f)
        of = {c: b for b, c in byte_letters().items()}
        as_bytes = lambda s: bytes(of[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {as_bytes(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes_of = {i: b for b, i in self.tokens.items()}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(pairs)}
        self.starts = dict.fromkeys((b[:k] for b in self.tokens for k in range(1, len(b))), -1) | self.tokens
        self.split, self.library = regex.compile(SPLIT), Tokenizer.from_file(path).pre_tokenizer
        self.apart, self.whole, self.steps, self.runs, self.heads, self.remembered = {}, {}, {}, {}, {}, Memory(remembered)

    def merged(self, data):
        """Tokens of a run of bytes by applying the merges in their order."""
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = self.ranks
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
            if not found:
                break
            _, i = min(found)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def merges_of(self, token):
        """The merges that make a token, in their order: rank, first piece and last piece after each."""
        steps = self.steps.get(token)
        if steps is None:
            data, steps = self.bytes_of[token], []
            parts, ranks = [data[i:i + 1] for i in range(len(data))], self.ranks
            while len(parts) > 1:
                rank, i = min((ranks.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
                if rank == NEVER:
                    break
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                steps.append((rank, parts[0], parts[-1]))
            steps.append((NEVER, parts[0], parts[-1]))
            self.steps[token] = steps
        return steps

    def stays_apart(self, a, b):
        """Whether two tokens side by side stay as they are: no merge across the border comes first.

        Each side merges as it does alone. Of equal ranks the leftmost merge goes first.
        """
        key = a << 20 | b
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            left, right, ranks, i, j = self.merges_of(a), self.merges_of(b), self.ranks, 0, 0
            x, y = self.bytes_of[a][-1:], self.bytes_of[b][:1]
            while True:
                across, one, two = ranks.get((x, y), NEVER), left[i][0], right[j][0]
                if across < one and across <= two:
                    known = False
                    break
                if one == two == NEVER:
                    known = True
                    break
                if one <= two:
                    x, i = left[i][2], i + 1
                else:
                    y, j = right[j][1], j + 1
            self.apart[key] = known
        return known

    def is_whole(self, token, data):
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(data) == [data]
        return known

    def tokens_of(self, head):
        """Sizes and tokens that start a few bytes; a size of 0 at the end if longer ones may."""
        found, starts = [], self.starts
        for k in range(1, len(head) + 1):
            t = starts.get(head[:k])
            if t is None:
                break
            if t >= 0:
                found.append((k, t))
        else:
            if len(head) == HEAD:
                found.append((0, -1))
        if len(self.heads) > self.remembered.most:
            self.heads.clear()
        self.heads[head] = found
        return found

    def longer(self, data, i):
        for j in range(i + HEAD + 1, len(data) + 1):
            t = self.starts.get(data[i:j])
            if t is None:
                return
            if t >= 0:
                yield j - i, t

    def run_counts(self, text):
        """Counts of the prefixes of a run that the split pattern leaves in one piece."""
        known = self.runs.get(text)
        if known is None:
            if len(self.runs) > self.remembered.most:
                self.runs.clear()
            known = self.runs[text] = [1, 2, len(self.merged(text.encode()))] if text in LATE else self._run_counts(text)
        return known

    def _run_counts(self, text):
        data = text.encode()
        n, apart, known = len(data), self.apart, self.heads
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            before = last[i] << 20
            head = data[i:i + HEAD]
            found = known.get(head)
            if found is None:
                found = self.tokens_of(head)
            if found and found[-1][0] == 0:
                found = [*found[:-1], *self.longer(data, i)]
            for size, t in found:
                if last[i + size] < 0:
                    if i:
                        fits = apart.get(before | t)
                        if fits is None:
                            fits = self.stays_apart(last[i], t)
                    else:
                        fits = self.is_whole(t, data[:size])
                    if fits:
                        last[i + size], count[i + size] = t, count[i] + 1
        if n == len(text):
            return count[1:]
        return [count[i] for i in range(1, n + 1) if i == n or data[i] & 0xC0 != 0x80]

    def pieces(self, text, start):
        if text.isascii() or max(text) < "\u0250":
            return [(m.start(), m.end()) for m in self.split.finditer(text, start)]
        return [(start + s, start + e) for _, (s, e) in self.library.pre_tokenize_str(text[start:])]

    def unit_counts(self, unit):
        """Counts of the prefixes of a unit, by characters."""
        body = unit[1:] if unit[0] == " " else unit
        if body.isalpha():
            return self.run_counts(unit)
        if body[:-1].isalpha() and body[-1] in ",.!?:;":
            counts = self.run_counts(unit[:-1])
            return [*counts, counts[-1] + 1]
        for special in self.special:
            if (at := unit.find(special)) >= 0:
                end = at + len(special)
                left = self.unit_counts(unit[:end - 1])
                full = (left[at - 1] if at else 0) + 1
                return [*left, full, *(full + x for x in (self.unit_counts(unit[end:]) if end < len(unit) else ()))]
        spaces = UNIT_SPACES.match(unit).end()
        counts = [1] if unit[:spaces] == " " else self.run_counts(unit[:spaces]) if spaces else []
        if spaces == len(unit):
            return counts
        counts = list(counts)
        base, start = counts[spaces - 2] if spaces > 1 else 0, max(spaces - 1, 0)
        if spaces and unit[spaces - 1] != " ":
            base, start = base + self.run_counts(unit[spaces - 1])[-1], spaces
        for s, e in self.pieces(unit, start):
            found = self.run_counts(unit[s:e])
            counts.extend(base + x for x in found[max(0, spaces - s):])
            base += found[-1]
        return counts

    def counts(self, text):
        """Token counts of the prefixes of 1, 2, ... characters of a text."""
        units = UNIT.findall(text)
        for u in self.remembered.missing(units):
            found = self.unit_counts(u)
            self.remembered.put(u, array("h", map(sub, found, [0, *found[:-1]])).tobytes())
        known = self.remembered.new
        out = np.cumsum(np.frombuffer(b"".join([known[u] for u in units]), np.int16), dtype=np.int64)
        self.remembered.tidy()
        return out


UNIT_SPACES = regex.compile(f"[{SPACES}]*")


def fitting(counts, budget):
    """Characters of the longest prefix with at most ``budget`` tokens."""
    inside = np.flatnonzero(counts <= budget)
    return int(inside[-1]) + 1 if len(inside) else 0


def prefix_counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and prefix_tokens: the token counts of the prefixes of 1, 2, ... characters."""
    schema = doc_schema(("prefix_tokens", "array<int>"), id_type=docs.schema[id_col].dataType)

    def make():
        counter = kept_in_process(("prefix counter", path), lambda: PrefixCounter(path))

        def step(batch):
            for i, text in enumerate(batch.column("text")):
                yield {"doc_id": batch.column("doc_id")[i:i + 1], "prefix_tokens": [counter.counts(text.as_py() or "").astype(np.int32)]}

        return step

    return arrow_map(texts_of(docs, id_col, text_col), make, schema)


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and fit_chars, the characters of the longest prefix within the limit."""
    schema = doc_schema(("n_bytes", "long"), ("n_tokens", "long"), ("fit_chars", "long"), id_type=docs.schema[id_col].dataType)

    def make():
        counter = kept_in_process(("prefix counter", path), lambda: PrefixCounter(path))

        def step(batch):
            texts = batch.column("text")
            total, fit = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                counts = counter.counts(text.as_py() or "")
                if len(counts):
                    total[i], fit[i] = counts[-1], fitting(counts, limit)
            yield {"doc_id": batch.column("doc_id"), "n_bytes": np.diff(raw(texts)[1]), "n_tokens": total, "fit_chars": fit}

        return step

    return arrow_map(texts_of(docs, id_col, text_col), make, schema)


def op6_token_counts(spark, sf_dir):
    found = token_counts(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_tokens", (found["n_tokens"] > LIMIT).alias("over_limit"), "fit_chars")
