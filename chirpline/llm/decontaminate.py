"""Removal of benchmark passages with a generalised suffix automaton of the items.

Words are runs of digits, letters a-z (after lower-casing A-Z) and characters
beyond ASCII. The items' words build the automaton; the words of each text
stream through it, and the length of the longest known suffix tells where a
window of ``window`` item words ends. An item of fewer words is one window.

The automaton is sent in shards of at most ``shard_words`` item words (plus one
item), so a worker's memory does not depend on the number of items. A run of
words that no item knows resets the automaton, so only runs of known words
that are long enough for a window are streamed.

Defined cases: null or empty texts have no words and no hits; items without
words match nothing; an item without id marks words but is not listed; rows
that repeat are judged each by itself; other columns are not looked at.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm.automaton import SuffixAutomaton
from chirpline.llm.frames import arrow_map, doc_schema, give_back, table, texts_of
from chirpline.llm.words import Splitter, letter_words, raw, text_slices

WINDOW = 10
SHARD_WORDS = 100_000


def item_shards(items: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_words: int = SHARD_WORDS):
    """Broadcast shards of (item ids, word hashes, number of words of each item)."""
    spark, splitter = items.sparkSession, Splitter(letter_words(), True)
    shards, ids, words, total = [], [], [], 0

    def close():
        nonlocal ids, words, total
        if words:
            sizes = np.array([len(w) for w in words])
            shards.append(spark.sparkContext.broadcast((ids, np.concatenate(words), sizes)))
        ids, words, total = [], [], 0

    chosen = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).distinct()
    for row in chosen.toLocalIterator():
        found = splitter.split(*raw(pa.array([row["text"]], pa.string())))[3]
        if len(found):
            if total and total + len(found) > shard_words:
                close()
            ids.append(row["id"])
            words.append(found)
            total += len(found)
    close()
    return shards


class ItemIndex:
    """The automaton of a shard, with the short items and the owners of its states."""

    def __init__(self, shard, window):
        self.ids, words, sizes = shard
        self.window = window
        self.vocabulary, symbols = np.unique(words, return_inverse=True)
        self.least = min(window, int(sizes.min()))
        self.automaton = a = SuffixAutomaton()
        pieces = [x.tolist() for x in np.split(symbols, np.cumsum(sizes)[:-1])]
        for x in pieces:
            a.add(x)
        self.owners, own = {}, {}
        for i, x in enumerate(pieces):
            state = 0
            for symbol in x:
                state = a.next[state][symbol]
                s = state
                while s and a.length[s] >= window and i not in (known := self.owners.setdefault(s, set())):
                    known.add(i)
                    s = a.link[s]
            if len(x) < window:
                own.setdefault(state, []).append((len(x), i))
        self.shorts = {}
        if own:
            for s in a.by_length():
                held = own.get(s, []) + (self.shorts.get(a.link[s], []) if s else [])
                if held:
                    self.shorts[s] = held

    def known(self, hashes):
        """Symbols of words, -1 for words that no item has."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def hits(self, hashes, first):
        """Covered words as (start, end) pairs, each with its item."""
        symbols = self.known(hashes)
        inside = symbols >= 0
        if not inside.any():
            return
        n = len(symbols)
        edge = np.zeros(n + 1, bool)
        edge[first] = True
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        long = ends - starts >= self.least
        a, window, shorts, owners = self.automaton, self.window, self.shorts, self.owners
        for s, e in zip(starts[long].tolist(), ends[long].tolist()):
            for k, (state, size) in enumerate(a.walk(symbols[s:e].tolist()), s + 1):
                if size >= window:
                    yield k - size, k, owners[a.at_depth(state, window)]
                if shorts:
                    for m, i in shorts.get(state, ()):
                        if m <= size:
                            yield k - m, k, (i,)


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
            shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each document: doc_id, text, n_words, item_ids (sorted) and spans of covered words with their places.

    A span is a struct of the first word, the word after the last, and the bytes of the text (UTF-8) it takes.
    """
    shards = item_shards(items, text_col="text", shard_words=shard_words)
    schema = doc_schema(("text", "string"), ("n_words", "long"), ("item_ids", "array<string>"),
                        ("spans", "array<struct<first:long,end:long,start_byte:long,end_byte:long>>"),
                        id_type=docs.schema[id_col].dataType)

    def make():
        splitter, built = Splitter(letter_words(), True), {}

        def index(k):
            if k not in built:
                built.clear()
                built[k] = ItemIndex(shards[k].value, window)
            return built[k]

        def step(batch):
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            data, offsets = raw(texts)
            cuts = [(lo, hi) for lo, hi in text_slices(texts)]
            marks, found = [None] * len(cuts), [{} for _ in cuts]
            for k in range(len(shards)):
                for c, (lo, hi) in enumerate(cuts):
                    _, _, first, hashes = splitter.split(data, offsets[lo:hi + 1])
                    if marks[c] is None:
                        marks[c] = np.zeros(len(hashes) + 1, np.int32)
                    shard = index(k)
                    for s, e, owners in shard.hits(hashes, first):
                        marks[c][s] += 1
                        marks[c][e] -= 1
                        row = int(np.searchsorted(first, s, "right")) - 1
                        found[c].setdefault(row, set()).update(shard.ids[i] for i in owners)
            for c, (lo, hi) in enumerate(cuts):
                starts, ends, first, hashes = splitter.split(data, offsets[lo:hi + 1])
                covered = np.cumsum(marks[c][:-1]) > 0 if marks[c] is not None else np.zeros(len(hashes), bool)
                spans, ids = [], []
                for row in range(hi - lo):
                    s, e = int(first[row]), int(first[row + 1])
                    ids.append(sorted(i for i in found[c].get(row, ()) if i is not None))
                    spans.append([])
                    if row in found[c]:
                        hit = np.flatnonzero(np.diff(np.concatenate([[0], covered[s:e].view(np.int8), [0]])))
                        begin = int(offsets[lo + row])
                        spans[-1] = [{"first": int(x), "end": int(y), "start_byte": int(starts[s + x]) - begin,
                                      "end_byte": int(ends[s + y - 1]) - begin} for x, y in zip(hit[::2], hit[1::2])]
                yield {"doc_id": doc_ids[lo:hi], "text": texts[lo:hi], "n_words": np.diff(first), "item_ids": ids, "spans": spans}

        return step

    return arrow_map(texts_of(docs, id_col, text_col), make, schema)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_span: int = WINDOW, max_coverage: float = 0.5,
                  text_col: str = "text") -> DataFrame:
    """The documents with long spans of item words cut out.

    Spans of ``max_span`` words or more, and all spans of short items, go out of the text. A document of which
    spans cover a larger share than ``max_coverage`` goes as a whole. All other columns stay.
    """
    shards = item_shards(items)

    def cut(batches):
        splitter, built = Splitter(letter_words(), True), {}
        give_back()  # what earlier steps of this process have left
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = batch.column(i)
            data, offsets = raw(texts)
            for lo, hi in text_slices(texts):
                keep, new = [], []
                starts, ends, first, hashes = splitter.split(data, offsets[lo:hi + 1])
                marks = np.zeros(len(hashes) + 1, np.int32)
                for k in range(len(shards)):
                    if k not in built:
                        built.clear()
                        built[k] = ItemIndex(shards[k].value, window)
                    for s, e, _ in built[k].hits(hashes, first):
                        marks[s] += 1
                        marks[e] -= 1
                covered = np.cumsum(marks[:-1]) > 0
                for row in range(hi - lo):
                    s, e = int(first[row]), int(first[row + 1])
                    inside = covered[s:e]
                    if not inside.any():
                        keep.append(True)
                        new.append(texts[lo + row].as_py())
                        continue
                    keep.append(bool(inside.mean() <= max_coverage))
                    hit = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
                    at, parts = int(offsets[lo + row]), []
                    for x, y in zip(hit[::2], hit[1::2]):
                        if y - x >= max_span or y - x < window:
                            parts.append(data[at:starts[s + x]].tobytes())
                            at = int(ends[s + y - 1])
                    parts.append(data[at:offsets[lo + row + 1]].tobytes())
                    new.append(b"".join(parts).decode())
                part = batch.slice(lo, hi - lo)
                yield part.set_column(i, part.schema.field(i), pa.array(new, texts.type)).filter(pa.array(keep, pa.bool_()))
            give_back()

    return docs.mapInArrow(cut, docs.schema)


def digest(ids):
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def op2_decontaminate(spark, sf_dir):
    found = matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
                        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
