"""Removal of passages that an earlier document holds, with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words (white space apart, unchanged) of one
document. A word goes if a window over it also starts in a document with a
smaller id.

Every window has an anchor, its run of ``ANCHOR`` words with the least hash, so
equal windows have equal anchors. Anchors that two different texts hold name
the passages that may repeat. These passages, each the windows of one anchor,
are dealt to shards by their anchor. A shard takes them in the order of their
documents: each streams through the automaton of the passages of all earlier
documents, whose matching statistics show the maximal spans that are known and
long enough, and then joins the automaton.

The automata are dealt out rather than broadcast: a shard needs only the
passages that can match it, so the work grows with the input, where streaming
all documents through all shards grows with its square. Passages of an anchor
with very many places in the texts enter no automaton, which would hold them
all: they are dealt as single windows by the hash of the window, and a window
is known if the smallest id that holds it is smaller. That takes no memory for
a group, whatever its size.

Equal texts are one text, of which the copies after the first go as a whole.

Defined cases: null texts and texts of fewer words than a window keep all
words; rows of one id are one document and do not remove each other's words;
rows without id come after all others; a table without documents gives no
rows; other columns are not looked at. Words, texts and the single windows of
frequent anchors are known by 64-bit hashes.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpline.llm.automaton import SuffixAutomaton
from chirpline.llm.cells import shared_cells
from chirpline.llm.frames import lists, table, written
from chirpline.llm.words import Splitter, gram_rows, grams, mix, raw, text_slices, white_space_words

WINDOW, ANCHOR = 13, 5
SHARD_ROWS = 4000
HOT_ROWS = 8000
BROADCAST_ROWS = 2_000_000
LAST_ID = 2 ** 63 - 1


class Anchored:
    """Words, anchors and names of the rows of a text column."""

    def __init__(self, window=WINDOW, anchor=ANCHOR):
        self.window, self.anchor, self.splitter = window, anchor, Splitter(white_space_words(), False)

    def split(self, data, offsets):
        """Word places, first word of each row, hashes; window starts, and the anchor's place and hash of each window."""
        starts, ends, first, hashes = self.splitter.split(data, offsets)
        none = np.zeros(0, np.int64)
        at, place, key = none, none, np.zeros(0, np.uint64)
        if len(hashes) >= self.window:
            small = grams(hashes, self.anchor)
            at = np.flatnonzero(gram_rows(first, self.window))
            among = np.lib.stride_tricks.sliding_window_view(small, self.window - self.anchor + 1)
            if len(at):
                place = at + among[at].argmin(axis=1)
                key = small[place]
        return starts, ends, first, hashes, at, place, key

    @staticmethod
    def names(first, hashes):
        """A 64-bit name of the word sequence of each row."""
        n = len(hashes)
        sizes = np.diff(first)
        inside = np.arange(n) - np.repeat(first[:-1], sizes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes + mix(inside.astype(np.uint64) + np.uint64(1))), out=sums[1:])
        return mix(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64)).view(np.int64)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id (as a number, null last), tid (hash of the text) and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))


def text_facts(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, tid, name, n_words and the digest of all words, for every row."""
    schema = T.StructType.fromDDL("doc_id long, tid long, name long, n_words long, sha string")

    def run(batches):
        own = Anchored(window)
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            for lo, hi in text_slices(batch.column("text")):
                _, _, first, hashes = own.splitter.split(data, offsets[lo:hi + 1])
                sha = [hashlib.sha256(b" ".join(data[offsets[r]:offsets[r + 1]].tobytes().split())).hexdigest() for r in range(lo, hi)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("tid")[lo:hi], pa.array(own.names(first, hashes)),
                                                  pa.array(np.diff(first).astype(np.int64)), pa.array(sha)], names=schema.names)

    return docs.mapInArrow(run, schema)


def anchor_rows(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """key, sid and n: the anchors of each different text of a task, with the number of their places there."""
    def run(batches):
        own, had = Anchored(window, anchor), set()
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            for lo, hi in text_slices(batch.column("text")):
                _, _, first, hashes, at, place, key = own.split(data, offsets[lo:hi + 1])
                if not len(at):
                    continue
                names = own.names(first, hashes)
                new = np.array([n not in had and not had.add(n) for n in names.tolist()])
                row = np.searchsorted(first, place, "right") - 1
                chosen = np.concatenate([[True], place[1:] != place[:-1]]) & new[row]
                key, row = key[chosen], row[chosen]
                order = np.lexsort((key, row))  # an anchor that a text repeats counts once
                key, row = key[order], row[order]
                once = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])) if len(key) else np.zeros(0, np.int64)
                n = np.diff(np.append(once, len(key))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64)), pa.array(names[row[once]]), pa.array(n)], names=["key", "sid", "n"])

    return docs.select("text").mapInArrow(run, T.StructType.fromDDL("key long, sid long, n int"))


PASSAGES = "key long, doc_id long, tid long, starts array<long>, words binary"


def passages(docs: DataFrame, window: int, anchor: int, known) -> DataFrame:
    """The windows of each anchor that may repeat, as one run of words: key, doc_id, tid, first words of its places, word hashes.

    ``known`` is a broadcast sorted array of anchors, or None if the rows bring their own in ``keys``. Of equal texts a task gives those with a smaller id than before.
    """
    schema = T.StructType.fromDDL(PASSAGES)

    def run(batches):
        own, had = Anchored(window, anchor), {}
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for lo, hi in text_slices(batch.column("text")):
                _, _, first, hashes, at, place, key = own.split(data, offsets[lo:hi + 1])
                if not len(at):
                    continue
                row = np.searchsorted(first, at, "right") - 1
                names, new = own.names(first, hashes).tolist(), np.zeros(hi - lo, bool)
                for r, name in enumerate(names):
                    if had.get(name, LAST_ID + 1) > ids[lo + r]:
                        had[name] = int(ids[lo + r])
                        new[r] = True
                signed = key.view(np.int64)
                if known is not None:
                    among = known.value
                    spot = np.minimum(np.searchsorted(among, signed), max(len(among) - 1, 0))
                    chosen = new[row] & (among[spot] == signed if len(among) else False)
                else:
                    chosen = new[row].copy()
                    lists = batch.column("keys")
                    for r in np.unique(row):
                        mine = row == r
                        chosen[mine] &= np.isin(signed[mine], np.array(lists[int(r) + lo].as_py() or [], np.int64))
                at, place, signed, row = at[chosen], place[chosen], signed[chosen], row[chosen]
                if not len(at):
                    continue
                lead = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)]))
                last = np.append(lead[1:], len(at)) - 1
                view, found = memoryview(hashes.tobytes()), {}
                starts = (at[lead] - first[row[lead]]).tolist()
                for a, b, k, r, start in zip(at[lead].tolist(), (at[last] + window).tolist(), signed[lead].tolist(), row[lead].tolist(), starts):
                    found.setdefault((r, k, bytes(view[8 * a:8 * b])), []).append(start)  # a passage that a text repeats is one row
                rows = pa.array([r + lo for r, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k for _, k, _ in found], pa.int64()), batch.column("doc_id").take(rows), batch.column("tid").take(rows),
                                                  pa.array(list(found.values()), pa.list_(pa.int64())), pa.array([w for _, _, w in found], pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def shard_hits(rows: DataFrame, window: int) -> DataFrame:
    """Spans (doc_id, tid, start, end) of words known from earlier documents. rows: shard and the columns of passages."""
    schema = T.StructType.fromDDL("doc_id long, tid long, start long, end long")

    def run(batches):
        shard, doc, automaton, waiting = None, None, None, []
        for batch in batches:
            out = [[], [], [], []]
            words = batch.column("words")
            for i, (s, d, tid, starts) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("shard", "doc_id", "tid", "starts")))):
                if s != shard:
                    shard, doc, automaton, waiting = s, d, SuffixAutomaton(), []
                elif d != doc:
                    for symbols in waiting:
                        automaton.add(symbols)
                    doc, waiting = d, []
                symbols = np.frombuffer(words[i].as_buffer(), np.int64).tolist()
                spans, full = [], False
                for k, (_, size) in enumerate(automaton.walk(symbols), 1):
                    if size >= window:
                        if spans and k - size <= spans[-1][1]:
                            spans[-1][1] = k
                        else:
                            spans.append([k - size, k])
                        full = size == len(symbols)
                for start in starts if spans else ():
                    for begin, end in spans:
                        for column, v in zip(out, (d, tid, start + begin, start + end)):
                            column.append(v)
                if not full:
                    waiting.append(symbols)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=schema.names)

    dealt = rows.repartition("shard").sortWithinPartitions("shard", "doc_id", "tid", "starts")
    return dealt.mapInArrow(run, schema)


def window_rows(rows: DataFrame, window: int) -> DataFrame:
    """Each window of passages by its hash: key, doc_id, tid and first words of its places. rows: passages."""
    schema = T.StructType.fromDDL("key long, doc_id long, tid long, starts array<long>")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            words, places = batch.column("words").to_pylist(), batch.column("starts")
            sizes, n_places = np.array([len(w) // 8 for w in words]), places.value_lengths().to_numpy()
            n = sizes - window + 1
            row = np.repeat(np.arange(len(words)), n)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            key = grams(np.frombuffer(b"".join(words), np.uint64), window)[np.repeat(np.cumsum(sizes) - sizes, n) + inside]
            at = pa.array(row)
            starts = places.take(at).flatten().to_numpy() + np.repeat(inside, n_places[row])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("doc_id").take(at), batch.column("tid").take(at),
                                              lists(starts, n_places[row], pa.int64())], names=schema.names)

    return rows.select("doc_id", "tid", "starts", "words").mapInArrow(run, schema)


def window_hits(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, tid and spans of the windows that an earlier document holds too. rows: passages with all windows of their anchors."""
    spots = written(window_rows(rows, window), "hot-windows")
    held = spots.groupBy("key").agg(F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last"), F.count("*").alias("_n"))
    held = written(held.filter("_first < _last"), "hot-window-firsts")
    often = held.filter(F.col("_n") > HOT_ROWS).select("key", "_first")
    often = F.broadcast(often) if often.count() <= BROADCAST_ROWS else often
    seldom = held.filter(F.col("_n") <= HOT_ROWS).select("key", "_first")
    found = spots.join(often, "key").unionByName(spots.join(often.select("key"), "key", "left_anti").join(seldom, "key"))
    starts = found.filter(F.col("doc_id") > F.col("_first")).groupBy("doc_id", "tid").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    span = lambda x: F.struct(x.alias("start"), (x + F.lit(window).cast("long")).alias("end"))
    return starts.select("doc_id", "tid", F.transform(F.array_distinct("starts"), span).alias("spans"))


def known_spans(docs: DataFrame, facts: DataFrame, window: int, anchor: int) -> DataFrame:
    """doc_id, tid and spans (sorted structs of start and end) that a smaller id holds too. docs: keyed; facts: text_facts, written."""
    cells = written(shared_cells(anchor_rows(docs, window, anchor), ["sid"], []), "anchors")
    counts = written(cells.groupBy("key").agg(F.sum("n").alias("count")), "anchor-counts")
    n_keys, n_rows = counts.agg(F.count("*"), F.sum("count")).first()
    hot = written(counts.filter(F.col("count") > HOT_ROWS).select("key"), "hot-anchors")
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot
    shards = max(1, -(-(n_rows or 0) // SHARD_ROWS))
    if n_keys <= BROADCAST_ROWS:
        keys = np.sort(np.array([r[0] for r in counts.select("key").toLocalIterator()], np.int64))
        found = passages(docs, window, anchor, docs.sparkSession.sparkContext.broadcast(keys))
    else:
        lists = cells.withColumnRenamed("sid", "name").join(facts.select("doc_id", "tid", "name").distinct(), "name")
        lists = lists.groupBy("doc_id", "tid").agg(F.collect_set("key").alias("keys"))
        found = passages(docs.join(lists, ["doc_id", "tid"]), window, anchor, None)
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    few = found.join(hot, "key", "left_anti") if n_hot else found
    hits = shard_hits(few.select(shard, "doc_id", "tid", "starts", "words"), window)
    spans = hits.groupBy("doc_id", "tid").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    if n_hot:
        spans = spans.unionByName(window_hits(found.join(hot, "key", "left_semi"), window))
        spans = spans.groupBy("doc_id", "tid").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    return spans.withColumn("spans", F.array_sort("spans"))


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256 (of the kept words with one space between) and spans of removed words."""
    rows = keyed(docs, id_col, text_col)
    facts = written(text_facts(rows, window), "texts")
    least = facts.groupBy("name").agg(F.min("doc_id").alias("_least"))
    spans = written(known_spans(rows, facts, window, anchor), "known-spans")
    judged = facts.join(least, "name").join(spans, ["doc_id", "tid"], "left")
    copy = (F.col("doc_id") > F.col("_least")) & (F.col("n_words") >= window)
    all_words = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    judged = written(judged.select("doc_id", "tid", "n_words", "sha", F.when(copy, all_words).otherwise(F.col("spans")).alias("spans"), copy.alias("copy")), "judged")
    cut = judged.filter("not copy and spans is not null").select("doc_id", "tid", "spans").distinct()
    size = cut.agg(F.sum(F.size("spans"))).first()[0] or 0
    texts = rows.join(F.broadcast(cut) if size <= BROADCAST_ROWS // 4 else cut, ["doc_id", "tid"])
    schema = T.StructType.fromDDL("doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>")

    def run(batches):
        for batch in batches:
            words_of, out = batch.column("text"), {n: [] for n in schema.names}
            for i, (doc, spans) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("spans").to_pylist())):
                words = words_of[i].as_py().encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    gone[s["start"]] += 1
                    gone[s["end"]] -= 1
                covered = np.cumsum(gone[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]]))).tolist()
                kept = b" ".join([words[k] for k in np.flatnonzero(~covered).tolist()])
                for n, v in zip(schema.names, (doc, len(words), int(covered.sum()), hashlib.sha256(kept).hexdigest(),
                                               [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])):
                    out[n].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                                                             ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))

    changed = texts.select("doc_id", "text", "spans").mapInArrow(run, schema)
    whole = judged.filter("copy or spans is null").select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(0).alias("n_removed"),
        F.when(F.col("copy"), F.sha2(F.lit(""), 256)).otherwise(F.col("sha")).alias("kept_sha256"),
        F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>")).alias("spans"))
    out = changed.unionByName(whole)
    return out.withColumn("doc_id", F.when(F.col("doc_id") < LAST_ID, F.col("doc_id")))


def op7_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
