"""Documents whose sets of word shingles are alike, by a tree over group counts.

A document's set is its distinct runs of ``WIDTH`` words (white space apart,
A-Z lower-cased); a shorter text is one run of all its words. The tokens of
a set fall into groups by hash, and the group counts are a point. The sum of
the smaller coordinates of two points is at least the overlap of their sets.

The bound is used at two depths. In the finest groups, one for each token,
sets whose rarest tokens are all different cannot overlap enough: so sets meet
in cells, one for each of their rarest tokens. So many tokens are taken that
linked sets must share a tenth of their size of cells; a set with fewer live
cells has no link and leaves them all. Sets with the same lead (below) form
blocks, and blocks that meet in as many cells as their smallest sets would
share if they were linked are joined: the points of ``GROUPS``
coarse groups of one block are held in an R-tree of largest coordinates and
ranges of sizes, and a search goes only into boxes whose bound and sizes allow
a link. Only sets of pairs that survive go on to be verified on the sets themselves.

Equal sets are one point. Each set is first verified against one set of its
cells (its lead, that with which it shares most cells, of the first in each), so a large
group of near copies becomes one component with as many pairs as members;
later only pairs of different components are looked at.

Defined cases: null texts and texts without words have an empty set, no links
and their own component; equal ids are one document for components; ties of
any kind are broken by hashes; a table without documents gives no rows; other
columns are not looked at. Sets and tokens are known by 64-bit hashes.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpline.llm.cells import group_counts, rarest, shared_cells
from chirpline.llm.components import components
from chirpline.llm.frames import arrow_map, doc_schema, table, texts_of, written
from chirpline.llm.words import Splitter, gram_rows, grams, mix, raw, text_slices, white_space_words

WIDTH = 5
ABOVE, OF = 75, 100  # a link: OF * overlap >= ABOVE * union
GROUPS = 128
BROADCAST_ROWS = 500_000
LEAF = 16
BLOCK_SETS = 256
PRUNE_ROUNDS = 2
COUNTED_PAIRS = 100_000
SPARE = 10  # prefixes hold one token in so many more than one shared cell needs


def spare(n):
    """Cells that a set of this size shares with any linked set that is not smaller."""
    return max(1, -(-n // SPARE))


def set_id(tokens):
    """A 64-bit name of a set of token hashes, as a signed integer."""
    return int(mix(np.array([np.sum(mix(tokens ^ np.uint64(0x5DEECE66D))) + np.uint64(len(tokens))], np.uint64)).view(np.int64)[0])


class Shingles:
    """Token sets of the rows of a text column."""

    def __init__(self, width=WIDTH):
        self.width, self.splitter = width, Splitter(white_space_words(), True)

    def sets(self, data, offsets):
        _, _, first, hashes = self.splitter.split(data, offsets)
        all_grams = grams(hashes, self.width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= self.width:
                yield np.unique(all_grams[a:b - self.width + 1])
            else:
                yield grams(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)

    def tokens(self, data, offsets):
        found = list(self.sets(data, offsets))
        return np.concatenate(found) if found else np.zeros(0, np.uint64)


def need(a, b, above=ABOVE, of=OF):
    """Least overlap of linked sets of these sizes, as (factor of the overlap, right side): factor * overlap >= right side."""
    return of + above, above * (a + b)


def point(tokens):
    """Exact group counts, in 16 bits each where they fit and else in 32; ``read_point`` tells them by their size."""
    counts = np.bincount((tokens & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return counts.astype(np.uint16 if counts.max() <= 65535 else np.uint32)


def read_point(data):
    return np.frombuffer(data, np.uint16 if len(data) == 2 * GROUPS else np.uint32)


class CountTree:
    """An R-tree of group counts: boxes of the largest coordinates and the range of sizes, packed level by level."""

    def __init__(self, points, sizes):
        self.points, self.sizes = points, sizes
        order = np.argsort(sizes, kind="stable")
        slab = max(LEAF, int(np.ceil(np.sqrt(len(order) / LEAF))) * LEAF)
        parts = []
        for lo in range(0, len(order), slab):
            own = order[lo:lo + slab]
            widest = int(np.argmax(points[own].astype(np.float64).var(axis=0)))
            parts.append(own[np.argsort(points[own, widest], kind="stable")])
        self.order = np.concatenate(parts)
        groups = [self.order[i:i + LEAF] for i in range(0, len(order), LEAF)]
        self.levels = [(groups, *self.boxes([(points[g].max(axis=0), sizes[g].min(), sizes[g].max()) for g in groups]))]
        while len(self.levels[-1][0]) > LEAF:
            _, most, least, largest = self.levels[-1]
            groups = [np.arange(i, min(i + LEAF, len(most))) for i in range(0, len(most), LEAF)]
            self.levels.append((groups, *self.boxes([(most[g].max(axis=0), least[g].min(), largest[g].max()) for g in groups])))

    @staticmethod
    def boxes(rows):
        return np.stack([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])

    def search(self, q, size, above, of):
        """Points that may belong to sets linked with one of that size and those counts."""
        among = np.arange(len(self.levels[-1][0]))
        for depth, (groups, most, least, largest) in enumerate(reversed(self.levels)):
            small = np.maximum(least[among], -(-above * size // of))
            factor, right = need(size, small, above, of)
            open_ = (of * largest[among] >= above * size) & (above * least[among] <= of * size)
            open_ &= factor * np.minimum(most[among], q).sum(axis=1, dtype=np.int64) >= right
            among = among[open_]
            if not len(among):
                return among
            among = np.concatenate([groups[g] for g in among])
        return among[likely(q, size, self.points[among], self.sizes[among], above, of)]


def likely(q, size, points, sizes, above=ABOVE, of=OF):
    """Whether sizes and summed minima allow a link, row by row."""
    factor, right = need(size, sizes, above, of)
    ok = (of * np.minimum(size, sizes) >= above * np.maximum(size, sizes))
    return ok & (factor * np.minimum(q, points).sum(axis=-1, dtype=np.int64) >= right)


def read_points(column):
    rows = column.to_pylist()
    if all(len(r) == 2 * GROUPS for r in rows):
        return np.frombuffer(b"".join(rows), np.uint16).reshape(-1, GROUPS)
    return np.stack([read_point(r) for r in rows])


def verified(pairs: DataFrame, sets: DataFrame, above: int, of: int) -> DataFrame:
    """The pairs (a, b) of set ids that are linked, by their token sets (sid, tokens)."""
    both = (pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("_x")), "a")
            .join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("_y")), "b"))

    def run(batches):
        for batch in batches:
            xs, ys, keep = batch.column("_x"), batch.column("_y"), []
            for x, y in zip(xs, ys):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                factor, right = need(len(x), len(y), above, of)
                keep.append(factor * len(np.intersect1d(x, y, assume_unique=True)) >= right)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "_x", "_y").mapInArrow(run, T.StructType.fromDDL("a long, b long"))


def likely_pairs(pairs: DataFrame, points: DataFrame, above: int, of: int) -> DataFrame:
    """Pairs that sizes and group counts allow. points: sid, n, point."""
    both = (pairs.join(points.select(F.col("sid").alias("a"), F.col("n").alias("_n"), F.col("point").alias("_p")), "a")
            .join(points.select(F.col("sid").alias("b"), F.col("n").alias("_m"), F.col("point").alias("_q")), "b"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n, m = batch.column("_n").to_numpy(), batch.column("_m").to_numpy()
                factor, right = need(n, m, above, of)
                ok = of * np.minimum(n, m) >= above * np.maximum(n, m)
                ok &= factor * np.minimum(read_points(batch.column("_p")), read_points(batch.column("_q"))).sum(axis=1, dtype=np.int64) >= right
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "_n", "_m", "_p", "_q").mapInArrow(run, T.StructType.fromDDL("a long, b long"))


def meeting_blocks(rows: DataFrame) -> DataFrame:
    """Pairs of blocks (bx, by) that meet with sets of different components, and in how many cells. rows: key, block, least and most component."""
    schema = T.StructType.fromDDL("bx long, by long, cells long")

    def run(batches):
        held, counted = None, Counter()

        def pairs(part):
            keys, blocks, least, most = (part.column(n).to_numpy() for n in ("key", "block", "least", "most"))
            starts = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = blocks[s:e].tolist()
                if least[s:e].min() == most[s:e].max():
                    continue
                for i, x in enumerate(own):
                    if least[s + i] != most[s + i]:
                        yield x, x
                    for j in range(i + 1, len(own)):
                        if least[s + i] != most[s + j] or most[s + i] != least[s + j]:
                            yield x, own[j]

        def sums():
            if counted:
                found = [*zip(*counted), counted.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in found], names=schema.names)
                counted.clear()

        def add(part):
            for pair in pairs(part):
                counted[pair] += 1
                if len(counted) >= COUNTED_PAIRS:
                    yield from sums()

        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = (pa.concat_tables([held, part]) if held is not None else part).combine_chunks()
            keys = part.column("key").to_numpy()
            last = np.flatnonzero(keys != keys[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            held = part.slice(cut)
            if cut:
                yield from add(part.slice(0, cut).combine_chunks())
        if held is not None:
            yield from add(held.combine_chunks())
        yield from sums()

    dealt = rows.repartition("key").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(run, schema).groupBy("bx", "by").agg(F.sum("cells").alias("cells"))


def often_enough(meets: DataFrame, smallest: DataFrame, above: int, of: int) -> DataFrame:
    """The block pairs that meet in as many cells as their sets share if they are linked. smallest: block, n (least size of its sets)."""
    both = (meets.join(smallest.select(F.col("block").alias("bx"), F.col("n").alias("_n")), "bx")
            .join(smallest.select(F.col("block").alias("by"), F.col("n").alias("_m")), "by"))
    n = F.greatest(F.least("_n", "_m"), F.ceil(F.greatest("_n", "_m") * above / of))
    return both.filter(F.col("cells") >= F.greatest(F.lit(1), F.ceil(n / SPARE))).select("bx", "by")


class BlockPair:
    """The sets of two blocks, or of one with itself."""

    def __init__(self, bx, by):
        self.blocks, self.rows = (bx, by), {}

    def add(self, block, sid, comp, point, tokens=b""):
        self.rows.setdefault(block, {})[sid] = (comp, read_point(point), np.frombuffer(tokens, np.uint64))

    def likely(self, above, of):
        """Pairs of sets of different components that sizes and group counts allow to be linked."""
        bx, by = self.blocks
        first, second = self.rows.get(bx, {}), self.rows.get(by, {})
        if not first or not second:
            return
        ids, held = list(second), list(second.values())
        points = np.stack([h[1] for h in held])
        tree = CountTree(points, points.sum(axis=1, dtype=np.int64))
        for x, (comp, point, _) in first.items():
            for k in tree.search(point, int(point.sum(dtype=np.int64)), above, of).tolist():
                if comp != held[k][0] and (bx != by or ids[k] > x):
                    yield x, ids[k]

    def wanted(self, above, of):
        """Block and id of the sets that some likely pair needs."""
        bx, by = self.blocks
        return list(dict.fromkeys(r for x, y in self.likely(above, of) for r in ((bx, x), (by, y))))

    def links(self, above, of):
        """Links between sets of different components. What is connected by then is passed over."""
        parent = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        bx, by = self.blocks
        for x, y in self.likely(above, of):
            (one, _, tokens), (other, _, others) = self.rows[bx][x], self.rows[by][y]
            p, q = find(one), find(other)
            if p != q:
                factor, right = need(len(tokens), len(others), above, of)
                if factor * len(np.intersect1d(tokens, others, assume_unique=True)) >= right:
                    parent[p] = q
                    yield x, y


def by_block_pair(rows: DataFrame, result, fields: str) -> DataFrame:
    """``result(pair)``, a list of rows, of every pair of blocks. rows: bx, by, block, sid, comp, point and perhaps tokens."""
    schema = T.StructType.fromDDL(fields)

    def run(batches):
        now = None

        def send(pair):
            out = result(pair) if pair is not None else []
            if out:
                names = {"bx": [pair.blocks[0]] * len(out), "by": [pair.blocks[1]] * len(out)}
                own = [n for n in schema.names if n not in names]
                names |= {n: [r[k] for r in out] for k, n in enumerate(own)}
                yield pa.RecordBatch.from_arrays([pa.array(names[n], pa.int64()) for n in schema.names], names=schema.names)

        for batch in batches:
            data = [batch.column(n) for n in ("point", "tokens") if n in batch.schema.names]
            for i, (bx, by, block, sid, comp) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("bx", "by", "block", "sid", "comp")))):
                if now is None or now.blocks != (bx, by):
                    yield from send(now)
                    now = BlockPair(bx, by)
                now.add(block, sid, comp, *(d[i].as_py() for d in data))
        yield from send(now)

    return rows.repartition("bx", "by").sortWithinPartitions("bx", "by", "block", "sid").mapInArrow(run, schema)


def verified_blocks(meets: DataFrame, sets: DataFrame, above: int, of: int) -> DataFrame:
    """Links (a, b) that join the components of all linked pairs of these blocks. sets: sid, comp, block, point, tokens.

    Points alone go to every pair of blocks. Token sets follow only where a likely pair needs them.
    """
    points = sets.drop("tokens")
    first = meets.join(points.withColumn("bx", F.col("block")), "bx")
    second = meets.filter("bx <> by").join(points.withColumn("by", F.col("block")), "by")
    names = ["bx", "by", "block", "sid", "comp", "point"]
    likely = by_block_pair(first.select(*names).unionByName(second.select(*names)), lambda pair: pair.wanted(above, of), "bx long, by long, block long, sid long")
    likely = written(likely, "likely")
    used = written(likely.select("sid").distinct(), "sids")
    used = F.broadcast(used) if used.count() <= BROADCAST_ROWS else used
    held = sets.join(used, "sid", "left_semi").drop("block")
    return by_block_pair(likely.join(held, "sid").select(*names, "tokens"), lambda pair: list(pair.links(above, of)), "a long, b long")


def shingle_sets(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (size of the set) and sid (its name, null if it is empty) of every document."""
    schema = doc_schema(("n", "long"), ("sid", "long"), id_type=docs.schema[id_col].dataType)

    def make():
        own = Shingles(width)

        def step(batch):
            data, offsets = raw(batch.column("text"))
            for lo, hi in text_slices(batch.column("text")):
                found = list(own.sets(data, offsets[lo:hi + 1]))
                yield {"doc_id": batch.column("doc_id")[lo:hi], "n": [len(s) for s in found], "sid": [set_id(s) if len(s) else None for s in found]}

        return step

    return arrow_map(texts_of(docs, id_col, text_col), make, schema)


def set_rows(texts: DataFrame, width: int, fields: str, rows_of) -> DataFrame:
    """Rows of ``rows_of(sid, tokens)`` (a list of columns) for each different set; a task leaves out sets it has had."""
    schema = T.StructType.fromDDL(fields)

    def run(batches):
        own, had = Shingles(width), set()
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            for lo, hi in text_slices(batch.column("text")):
                parts = []
                for s in own.sets(data, offsets[lo:hi + 1]):
                    if len(s) and (sid := set_id(s)) not in had:
                        had.add(sid)
                        parts.append(rows_of(sid, s))
                if parts:
                    columns = [[c for p in parts for c in p[k]] if isinstance(parts[0][k], list) else np.concatenate([p[k] for p in parts])
                               for k in range(len(schema))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)

    return texts.select("text").mapInArrow(run, schema)


def similar_links(docs: DataFrame, width: int = WIDTH, above: int = ABOVE, of: int = OF, text_col: str = "text") -> DataFrame:
    """Links (a, b) of set ids that connect just what all links connect."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    counts = group_counts(texts, lambda: Shingles(width).tokens)
    sent = spark.sparkContext.broadcast(np.minimum(counts, 2 ** 32 - 1).astype(np.uint32))

    def prefix(sid, s):
        k = min(len(s), len(s) - -(-above * len(s) // of) + spare(len(s)))
        first = rarest(s, sent.value, k)
        return first.view(np.int64), np.full(k, sid), np.full(k, len(s))

    members = shared_cells(set_rows(texts, width, "key long, sid long, n long", prefix), ["sid"], [])
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * above / of) / SPARE))
    for turn in range(PRUNE_ROUNDS):
        alive = F.count("*").over(Window.partitionBy("sid")) >= least
        strong = written(members, "cells").withColumn("_ok", alive).filter("_ok").drop("_ok")
        members = shared_cells(strong, ["sid"], ["sid"] if turn == PRUNE_ROUNDS - 1 else [])
    members = written(members, "cells")
    named = written(members.select("sid").distinct(), "sids")
    wanted = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    sets = set_rows(texts, width, "sid long, n long, point binary, tokens binary",
                    lambda sid, s: ([sid], [len(s)], [point(s).tobytes()], [s.tobytes()]))
    sets = written(sets.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]), "sets")

    shared = members.filter("sid <> first_sid").groupBy("sid", F.col("first_sid").alias("b")).count()
    star = shared.groupBy("sid").agg(F.max_by("b", F.struct("count", "b")).alias("b")).select(F.col("sid").alias("a"), "b")
    star = written(star, "stars")
    first = written(verified(likely_pairs(star, sets.drop("tokens"), above, of), sets, above, of), "links")
    home = components(first).withColumnsRenamed({"node": "sid", "component": "comp"})
    named = sets.select("sid", "n").join(star.withColumnsRenamed({"a": "sid", "b": "_lead"}), "sid", "left").withColumn("_lead", F.coalesce("_lead", "sid"))
    sizes = named.groupBy("_lead").agg(F.ceil(F.count("*") / BLOCK_SETS).alias("_slots"))
    block = F.xxhash64("_lead", F.pmod(F.xxhash64("sid"), "_slots"))
    facts = named.join(sizes, "_lead").join(home, "sid", "left").select("sid", "n", F.coalesce("comp", "sid").alias("comp"), block.alias("block"))
    facts = written(facts, "homes")
    smallest = facts.groupBy("block").agg(F.min("n").alias("n"))
    facts = facts.drop("n")
    home = F.broadcast(facts) if facts.count() <= BROADCAST_ROWS else facts
    rest = members.select("key", "sid").join(home, "sid").groupBy("key", "block").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    meets = written(often_enough(meeting_blocks(rest), smallest, above, of), "meets")
    second = verified_blocks(meets, sets.join(facts, "sid"), above, of)
    return first.unionByName(written(second, "links"))


def near_duplicates(docs: DataFrame, width: int = WIDTH, above: int = ABOVE, of: int = OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles and component_id, the smallest id it reaches by links."""
    own = written(shingle_sets(docs, width, id_col, text_col), "shingles")
    least = own.filter("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("_least"))
    homes = components(similar_links(docs, width, above, of, text_col)).withColumnsRenamed({"node": "sid"})
    homes = least.join(homes, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    roots = homes.groupBy("component").agg(F.min("_least").alias("_root"))
    homes = written(homes.join(roots, "component").select("sid", "_root"), "roots")
    return own.join(homes, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("_root", "doc_id").alias("component_id"))


def op4_ngram_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
