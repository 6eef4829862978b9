"""Spelling variants by composition: the vocabulary's acceptor, a one-edit transducer, and the acceptor again.

A pair that the composition accepts runs along one path as long as both words
agree, makes one edit at the end of their common prefix, and then runs through
two states side by side that accept a common rest. Partitions of initial states
deal this out: of a pair whose shorter word has l letters, the edit lies in
[lo, hi), so both words have their first lo and last l - hi letters in common
and meet under the key of l, lo, hi and these letters. Each word goes to four
keys, two halves as the shorter word and two as the longer one. The words of a
key are read as the paths from one initial state over the letters between;
an acceptor of all keys of an Arrow batch is minimised and composed at once, by
arrays of states, from the front. Keys of more than ``MOST`` words are split
once more, into the halves of [lo, hi), until the rest is bounded by the
alphabet; so no group is unbounded, and no pair is tried that differs before
its edit.

Words are found by native functions alone: runs of letters, their case folded,
counted by Spark.

Defined cases: null and empty texts and words have no words; words of any
length; equal words count together; ties for the form go to the smallest word
in code-point order; no rows give no rows. Keys are 96 bits of hashes, states
of an acceptor are told apart by 64 bits.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpline.llm.frames import table, texts_of, written
from chirpline.llm.words import mix, raw

LEAST_LENGTH, LEAST_COUNT, FACTOR, MARRED = 7, 2, 10, 31
MOST = 50_000
CHAR = 21
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PAIRS = "word string, n long, other string, other_n long, l int, lo int, hi int"


def spread(first, rows):
    """Members of some rows of a table of arcs by state (``first``): the row's place and the arc."""
    sizes = first[rows + 1] - first[rows]
    at = np.repeat(np.arange(len(rows)), sizes)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[rows], sizes)


class Acceptor:
    """Minimal acceptor with an initial state for each group of words; words are numbered by where their path ends."""

    def __init__(self, codes, begin, sizes, group):
        """Words as runs of ``codes``; ``group`` counts up from 0."""
        many, groups = len(begin), int(group[-1]) + 1
        node, total, levels, active, depth = group.copy(), groups, [], np.arange(many), 0
        while True:
            active = active[sizes[active] > depth]
            if not len(active):
                break
            found, own = np.unique(node[active] << CHAR | codes[begin[active] + depth], return_inverse=True)
            levels.append((found >> CHAR, found & (1 << CHAR) - 1, total))
            node[active] = total + own
            total, depth = total + len(found), depth + 1
        ends = np.bincount(node, minlength=total)
        sign, count = mix(np.arange(1, 3, dtype=np.uint64))[(ends > 0).astype(int)], ends.copy()
        for parent, char, start in reversed(levels):
            child = np.arange(start, start + len(parent))
            heads = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
            arc = mix(sign[child] * np.uint64(0x9E3779B97F4A7C15) + mix(char.astype(np.uint64) + np.uint64(3)))
            sign[parent[heads]] += np.add.reduceat(arc, heads)
            count[parent[heads]] += np.add.reduceat(count[child], heads)
        _, sample, state = np.unique(sign, return_index=True, return_inverse=True)
        chosen = np.zeros(total, bool)
        chosen[sample] = True
        parent = np.concatenate([p for p, _, _ in levels] or [np.zeros(0, np.int64)])
        char = np.concatenate([c for _, c, _ in levels] or [np.zeros(0, np.int64)])
        child = np.arange(groups, total)
        keep = chosen[parent]
        key = state[parent[keep]] << CHAR | char[keep]
        order = np.argsort(key)
        self.key, self.to = key[order], state[child[keep]][order]
        self.char, own = self.key & (1 << CHAR) - 1, self.key >> CHAR
        self.first = np.searchsorted(own, np.arange(len(sample) + 1))
        self.final, self.count = ends[sample] > 0, count[sample]
        past = np.concatenate([[0], np.cumsum(self.count[self.to])])
        self.skip = past[:-1] - past[self.first[own]] + self.final[own]
        self.initial = state[:groups]
        self.base = np.cumsum(self.count[self.initial]) - self.count[self.initial]
        at, number, depth, active = self.initial[group], self.base[group], 0, np.arange(many)
        while True:
            active = active[sizes[active] > depth]
            if not len(active):
                break
            arc = np.searchsorted(self.key, at[active] << CHAR | codes[begin[active] + depth])
            number[active] += self.skip[arc]
            at[active], depth = self.to[arc], depth + 1
        self.word = np.empty(many, np.int64)
        self.word[number] = np.arange(many)

    def one_edit(self, room):
        """Pairs of words of one group that are one edit apart; an insertion may lie before ``room`` letters of its group."""
        q, off, room = self.initial, self.base, room.copy()
        none = np.zeros(0, np.int64)
        one, off_one, two, off_two, bar = none, none, none, none, none
        depth, out = 0, []
        while len(q) or len(one):
            if len(one):
                at, arc = spread(self.first, one)
                key = two[at] << CHAR | self.char[arc]
                other = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = (self.key[other] == key) & (self.char[arc] != bar[at])
                at, arc, other = at[hit], arc[hit], other[hit]
                one, off_one = self.to[arc], off_one[at] + self.skip[arc]
                two, off_two, bar = self.to[other], off_two[at] + self.skip[other], np.full(len(at), -1)
            if len(q):
                many = self.count[q] > 1
                q, off, room = q[many], off[many], room[many]
                at, arc = spread(self.first, q)
                to, start = self.to[arc], off[at] + self.skip[arc]
                # Insertions: one word goes on by a letter; the other does not have that letter next.
                ins = room[at] > depth
                # Replacements: two letters of one state.
                rest = self.first[q[at] + 1] - arc - 1
                left = np.repeat(np.arange(len(arc)), rest)
                right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(rest) - rest, rest)
                one = np.concatenate([one, to[ins], to[left]])
                off_one = np.concatenate([off_one, start[ins], start[left]])
                two = np.concatenate([two, q[at[ins]], to[right]])
                off_two = np.concatenate([off_two, off[at[ins]], start[right]])
                bar = np.concatenate([bar, self.char[arc[ins]], np.full(len(left), -1)])
                q, off, room, depth = to, start, room[at], depth + 1
            done = self.final[one] & self.final[two]
            out.append((off_one[done], off_two[done]))
        a, b = (np.concatenate(x) for x in zip(*out)) if out else (none, none)
        return self.word[a], self.word[b]


def char_codes(words):
    """Code points of an Arrow string column and the first of each row, with the end."""
    data, offsets = raw(words)
    part = data[int(offsets[0]):int(offsets[-1])]
    places = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    return np.frombuffer(part.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64), places[offsets - offsets[0]]


def pairs_of(rows: pa.Table):
    """Rows of PAIRS for whole groups of keyed words."""
    key, salt = rows.column("key").to_numpy(), rows.column("salt").to_numpy()
    starts = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
    group = np.cumsum(starts) - 1
    rows = rows.filter(pa.array(np.bincount(group)[group] > 1)).combine_chunks()
    if not rows.num_rows:
        return
    group = np.unique(group[np.bincount(group)[group] > 1], return_inverse=True)[1]
    codes, first = char_codes(rows.column("word"))
    l, lo, hi = (rows.column(c).to_numpy().astype(np.int64) for c in ("l", "lo", "hi"))
    begin = first[:-1] + lo
    sizes = first[1:] - np.maximum(l - hi, 0) - begin
    room = (hi - lo)[np.searchsorted(group, np.arange(int(group[-1]) + 1))]
    a, b = Acceptor(codes, begin, sizes, group).one_edit(room)
    # two words of l + 1 letters are a pair of another key
    own = np.minimum(first[a + 1] - first[a], first[b + 1] - first[b]) == l[a]
    a, b = a[own], b[own]
    if len(a):
        one, two = rows.take(pa.array(a)), rows.take(pa.array(b))
        yield pa.table({"word": one.column("word"), "n": one.column("n"), "other": two.column("word"), "other_n": two.column("n"),
                        **{c: pa.nulls(len(a), pa.int32()) for c in ("l", "lo", "hi")}})


def composed(most):
    """Batches of keyed words in the order of their keys: pairs of whole groups; words of groups beyond ``most`` as they are."""
    def left_over(rows):
        return pa.table({"word": rows.column("word"), "n": rows.column("n"), "other": pa.nulls(rows.num_rows, pa.string()),
                         "other_n": pa.nulls(rows.num_rows, pa.int64()), **{c: rows.column(c) for c in ("l", "lo", "hi")}})

    def run(batches):
        held, large = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            key, salt = rows.column("key").to_numpy(), rows.column("salt").to_numpy()
            if large is not None:
                same = int(np.argmin(np.append((key == large[0]) & (salt == large[1]), False)))
                if same:
                    yield from left_over(rows.slice(0, same)).to_batches()
                    rows, key, salt = rows.slice(same), key[same:], salt[same:]
                if not len(key):
                    held = None
                    continue
                large = None
            last = len(key) - int(np.argmin(np.append(((key == key[-1]) & (salt == salt[-1]))[::-1], False)))
            if last:
                for found in pairs_of(rows.slice(0, last)):
                    yield from found.to_batches()
            held = rows.slice(last)
            if held.num_rows > most and held.column("hi")[0].as_py() - held.column("lo")[0].as_py() > 1:
                yield from left_over(held).to_batches()
                large, held = (key[-1], salt[-1]), None
        if held is not None:
            for found in pairs_of(held):
                yield from found.to_batches()

    return run


def keyed(rows: DataFrame) -> DataFrame:
    """Words with the key of what they share with every partner whose edit lies in [lo, hi)."""
    tail = F.greatest(F.col("l") - F.col("hi"), F.lit(0))
    parts = ["l", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", F.length("word") - tail + 1, tail)]
    return rows.select("word", "n", "l", "lo", "hi", F.xxhash64(*parts).alias("key"), F.hash(*parts).alias("salt"))


def halves(rows: DataFrame, middle) -> DataFrame:
    both = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), "hi"))
    return rows.withColumn("_part", F.explode(both)).withColumns({"lo": F.col("_part.lo"), "hi": F.col("_part.hi")}).drop("_part").filter("hi > lo")


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, n, other, other_n for every two different words one inserted, deleted or replaced code point apart, once each. ``words``: word, n."""
    size = F.length("word")
    rows = words.filter(size > 0).select("word", "n", F.explode(F.array(size, size - 1)).alias("l")).filter("l > 0")
    rows = halves(rows.withColumns({"lo": F.lit(0), "hi": F.col("l") + 1}), F.floor(F.col("l") / 2).cast("int"))
    found = None
    while True:
        done = written(keyed(rows).repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(composed(most), PAIRS), "variants")
        pairs = done.filter("other IS NOT NULL").select("word", "n", "other", "other_n")
        found = pairs if found is None else found.unionByName(pairs)
        rest = done.filter("other IS NULL").select("word", "n", "l", "lo", "hi")
        if rest.isEmpty():
            return found
        rows = halves(rest, F.floor((F.col("lo") + F.col("hi")) / 2).cast("int"))


def variants(words: DataFrame, factor: int = FACTOR, most: int = MOST) -> DataFrame:
    """word, n, n_near, form, form_n and root. ``words``: word and n, each word once."""
    pairs = near_pairs(words, most)
    both = pairs.select("word", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= factor * F.col("n")
    out = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    # Forms have at least twice the count of their words, so chains end; each round doubles how far a word has followed its chain.
    chain = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = chain.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        step = written(chain.join(further, chain["root"] == further["_at"], "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        chain = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    return out.join(chain, "word", "left").withColumn("root", F.coalesce("root", "word"))


def runs(docs: DataFrame, least: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and run, the maximal runs of at least that many letters with A-Z in lower case, by native functions."""
    pattern = f"[A-Za-z\\u00C0-\\u00FF]{{{least},}}"
    found = texts_of(docs, id_col, text_col).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    return found.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))


def marred(found: DataFrame, every: int = MARRED) -> DataFrame:
    """``runs`` of which one in ``every``, chosen by a checksum of id and run, lacks one code point."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (h % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(h % every == 0, less).otherwise(F.col("run")).alias("word"))


def counted(words: DataFrame, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word and n of the words of at least that length and count, as a written table."""
    return written(words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count), "words")


def op11_variants(spark, sf_dir):
    return variants(counted(marred(runs(table(spark, sf_dir, "documents"), LEAST_LENGTH))))
