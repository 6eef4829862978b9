"""Removal of lines that are alike an earlier line, by an exact set-similarity join.

A line's tokens are its distinct words (white space apart, A-Z lower-cased),
ordered by rarity: the count of the token's group over all lines (in steps of a
sixteenth of a doubling), then the hash. Two lines are alike if their token sets have a Jaccard similarity of
``ABOVE`` / ``OF`` at least. Such lines share one of their first tokens; where
they first do, the places of it bound the overlap (positional filter), and the
sizes do as well (length filter). A 64-bit parity map of the tokens bounds it
once more. Pairs that survive are verified on the token sets.

A line goes if an equal set stands earlier, or if its set is alike a set that
first stands earlier; earlier is by document id, then line. That is judged on
the input. A set is first verified against one candidate, that with which it
shares most cells; only sets that this does not settle are verified against
the others. In large cells a set first meets the earliest line alone. So a line
with thousands of variants costs as many pairs as variants.

A set so small that one token more or less takes it below the similarity is
alike no other set. It goes by the equal set alone and enters no cell.

Defined cases: lines of fewer distinct words than ``least_words`` stay (the
query and the pipeline leave it at ``ANY_WORDS``, so only lines without words
stay for that); null texts are empty and have no lines; rows of one id count as one document, of
which no row removes another's line at the same place; null ids come first;
other columns stay as they are. Tokens and sets are known by 64-bit hashes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpline.llm.cells import bucket, group_counts
from chirpline.llm.frames import table, written
from chirpline.llm.words import Splitter, mix, raw, text_slices, white_space_words

ABOVE, OF = 9, 10
LEAST_WORDS = 5
ANY_WORDS = 1
BROADCAST_ROWS = 500_000
WEIGHT_BITS = 9
SMALL_CELL = 64


def line_offsets(data, offsets):
    """Starts of the lines of some rows, with the end of the last, the row of each line and its number there."""
    base, end = int(offsets[0]), int(offsets[-1])
    breaks = np.flatnonzero(data[base:end] == 10) + base + 1
    edges = np.unique(np.concatenate([offsets, breaks]))
    row = np.searchsorted(offsets, edges[:-1], "right") - 1
    number = np.arange(len(row)) - np.searchsorted(row, row)
    return edges, row, number


class Lines:
    """Token sets of the lines of rows."""

    def __init__(self, least_words, counts=None):
        self.least, self.splitter = least_words, Splitter(white_space_words(), True)
        # a fixed order needs no more than steps of a sixteenth of a doubling
        self.weights = None if counts is None else np.minimum(np.log2(counts.astype(np.float64) + 1) * 16, 2 ** WEIGHT_BITS - 1).astype(np.uint64)

    def sets(self, data, offsets):
        """Tokens of all lines with enough words, line after line, the rarest first; sizes, rows and numbers of these lines."""
        edges, row, number = line_offsets(data, offsets)
        if len(edges) < 2:
            return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3
        _, _, first, hashes = self.splitter.split(data, edges)
        line = np.repeat(np.arange(len(row)), np.diff(first))
        # one key to sort by: the line, the weight of the token, the first bits of its hash
        bits = max(1, int(len(row)).bit_length())
        key = line.astype(np.uint64) << np.uint64(64 - bits)
        if self.weights is not None:
            key |= self.weights[bucket(hashes)] << np.uint64(64 - bits - WEIGHT_BITS)
            bits += WEIGHT_BITS
        order = np.argsort(key | hashes >> np.uint64(bits))
        hashes, line = hashes[order], line[order]
        fresh = np.ones(len(hashes), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (line[1:] != line[:-1])
        sizes = np.bincount(line[fresh], minlength=len(row))
        chosen = sizes >= self.least
        keep = fresh & chosen[line]
        return hashes[keep], sizes[chosen], row[chosen], number[chosen]


def digests(tokens, sizes):
    """Names and parity maps of token sets that stand one after the other."""
    starts = np.cumsum(sizes) - sizes
    if not len(sizes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = mix(tokens ^ np.uint64(0x2545F4914F6CDD1D))
    names = mix(np.add.reduceat(mixed, starts) + sizes.astype(np.uint64))
    parity = np.bitwise_xor.reduceat(np.uint64(1) << (mixed & np.uint64(63)), starts)
    return names.view(np.int64), parity.view(np.int64)


def line_rows(docs: DataFrame, least_words: int) -> DataFrame:
    """Every line with enough words: doc_id, tid (hash of the text), line and sid."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + T.StructType.fromDDL("tid long, line int, sid long").fields)

    def run(batches):
        lines = Lines(least_words)
        for batch in batches:
            texts = batch.column("text")
            data, offsets = raw(texts)
            for lo, hi in text_slices(texts):
                tokens, sizes, row, number = lines.sets(data, offsets[lo:hi + 1])
                at = pa.array(row + lo)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("tid").take(at),
                                                  pa.array(number, pa.int32()), pa.array(digests(tokens, sizes)[0], pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)


def prefix_rows(docs: DataFrame, sent, least_words: int, above: int, of: int) -> DataFrame:
    """For each different set of a task its first tokens: key, doc_id, line, sid, n, pos and the parity map."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", id_type)]
                          + T.StructType.fromDDL("line int, sid long, n int, pos int, bits long").fields)

    def run(batches):
        lines, had = Lines(least_words, sent.value), {}
        for batch in batches:
            texts, ids = batch.column("text"), batch.column("doc_id")
            data, offsets = raw(texts)
            for lo, hi in text_slices(texts):
                tokens, sizes, row, number = lines.sets(data, offsets[lo:hi + 1])
                if not len(sizes):
                    continue
                names, parity = digests(tokens, sizes)
                place = [(i is not None, i, n) for i, n in zip(ids.take(pa.array(row + lo)).to_pylist(), number.tolist())]
                new = np.zeros(len(sizes), bool)
                for k, (name, at) in enumerate(zip(names.tolist(), place)):
                    if name not in had or at < had[name]:  # a task may meet a later line of a set first
                        had[name] = at
                        new[k] = True
                k = sizes - -(-above * sizes // of) + 1
                start = np.cumsum(sizes) - sizes
                take = k[new]
                line = np.repeat(np.flatnonzero(new), take)
                pos = np.arange(len(line)) - np.repeat(np.cumsum(take) - take, take)
                at = pa.array(row[line] + lo)
                yield pa.RecordBatch.from_arrays([
                    pa.array(tokens[start[line] + pos].view(np.int64)), ids.take(at), pa.array(number[line], pa.int32()), pa.array(names[line]),
                    pa.array(sizes[line], pa.int32()), pa.array(pos, pa.int32()), pa.array(parity[line])], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def may_be_alike(a: str, b: str, above: int, of: int):
    """Length, positional and parity filters on columns with these prefixes, where the sets share a token."""
    n, m, p, q = F.col(f"{a}n"), F.col(f"{b}n"), F.col(f"{a}pos"), F.col(f"{b}pos")
    overlap = F.ceil((n + m) * above / (of + above))
    return ((F.least(n, m) * of >= F.greatest(n, m) * above) & (1 + F.least(n - p - 1, m - q - 1) >= overlap)
            & (F.bit_count(F.col(f"{a}bits").bitwiseXOR(F.col(f"{b}bits"))) <= n + m - 2 * overlap))


def verified(pairs: DataFrame, sets: DataFrame, above: int, of: int) -> DataFrame:
    """Pairs (sid, other) of which the token sets are alike."""
    both = (pairs.join(sets.select("sid", F.col("tokens").alias("_x")), "sid")
            .join(sets.select(F.col("sid").alias("other"), F.col("tokens").alias("_y")), "other"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append((of + above) * len(np.intersect1d(x, y, assume_unique=True)) >= above * (len(x) + len(y)))
            yield batch.select(["sid", "other"]).filter(pa.array(keep, pa.bool_()))

    return both.select("sid", "other", "_x", "_y").mapInArrow(run, T.StructType.fromDDL("sid long, other long"))


def token_sets(docs: DataFrame, least_words: int) -> DataFrame:
    def run(batches):
        lines, had = Lines(least_words), set()
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            for lo, hi in text_slices(batch.column("text")):
                tokens, sizes, _, _ = lines.sets(data, offsets[lo:hi + 1])
                names = digests(tokens, sizes)[0].tolist()
                ends = np.cumsum(sizes)
                new = [k for k, name in enumerate(names) if name not in had and not had.add(name)]
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in new], pa.int64()),
                                                  pa.array([tokens[ends[k] - sizes[k]:ends[k]].tobytes() for k in new], pa.binary())], names=["sid", "tokens"])

    return docs.select("text").mapInArrow(run, T.StructType.fromDDL("sid long, tokens binary"))


def met_lines(rows: DataFrame, above: int, of: int) -> DataFrame:
    """What the cells of ``prefix_rows`` hold: pairs (sid, other) that the filters admit, ``other`` standing earlier.

    Of cells up to ``SMALL_CELL`` sets all pairs. Larger ones stream through: there each set meets the first, and all
    sets come out with their key for a join of those that this does not settle.
    """
    id_type = rows.schema["doc_id"].dataType
    schema = T.StructType([*T.StructType.fromDDL("sid long, other long, key long").fields, T.StructField("doc_id", id_type),
                           *T.StructType.fromDDL("line int, n int, pos int, bits long").fields])

    def admitted(n, m, p, q, x, y):
        overlap = -(-((n + m) * above) // (of + above))
        ok = (np.minimum(n, m) * of >= np.maximum(n, m) * above) & (1 + np.minimum(n - p - 1, m - q - 1) >= overlap)
        ok[ok] = np.bitwise_count((x[ok] ^ y[ok]).view(np.uint64)) <= (n + m - 2 * overlap)[ok]
        return ok

    def run(batches):
        held, large = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            part = (pa.concat_tables([held, part]) if held is not None else part).combine_chunks()
            yield from step(part, large, False)
            held, large = state.pop()
        if held is not None:
            yield from step(held, large, True)

    state = []

    def step(part, large, end):
        keys, sids = part.column("key").to_numpy(), part.column("sid").to_numpy()
        n, pos, bits = (part.column(c).to_numpy().astype(np.int64) for c in ("n", "pos", "bits"))
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        run_of = np.repeat(np.arange(len(starts)), sizes)
        big = sizes > SMALL_CELL
        big[0] |= large
        close = len(starts) if end or big[-1] else len(starts) - 1  # a small cell at the end waits for the next batch
        order = np.lexsort((sids, run_of))
        again = np.zeros(len(keys), bool)
        again[order[1:]] = (sids[order[1:]] == sids[order[:-1]]) & (run_of[order[1:]] == run_of[order[:-1]])
        live = np.flatnonzero(~again & (run_of < close))
        out = {f: [] for f in ("sid", "other")}
        small = live[~big[run_of[live]]]
        width = int(sizes[~big].max()) if (~big).any() else 0
        for d in range(1, width):
            i, j = small[:-d], small[d:]
            same = run_of[i] == run_of[j]
            if not same.any():
                break
            i, j = i[same], j[same]
            ok = admitted(n[i], n[j], pos[i], pos[j], bits[i], bits[j])
            out["sid"].append(sids[j[ok]])
            out["other"].append(sids[i[ok]])
        if out["sid"]:
            pairs = np.unique(np.stack([np.concatenate(out["sid"]), np.concatenate(out["other"])]), axis=1)
            if pairs.shape[1]:
                nothing = [pa.nulls(pairs.shape[1], pa.int64()), pa.nulls(pairs.shape[1], part.schema.field("doc_id").type),
                           *(pa.nulls(pairs.shape[1], t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), *nothing], names=schema.names)
        wide = live[big[run_of[live]]]
        if len(wide):
            lead = starts[run_of[wide]]
            other = sids[lead].copy()
            ok = (other != sids[wide])
            ok[ok] = admitted(n[lead[ok]], n[wide[ok]], pos[lead[ok]], pos[wide[ok]], bits[lead[ok]], bits[wide[ok]])
            rows_ = part.take(pa.array(wide))
            yield pa.RecordBatch.from_arrays([pa.array(sids[wide]), pa.array(other, mask=~ok), pa.array(keys[wide])]
                                             + [rows_.column(c).combine_chunks() for c in ("doc_id", "line", "n", "pos", "bits")], names=schema.names)
        if not end:
            state.append((part.slice(int(starts[-1]), 1), True) if big[-1] else (part.slice(int(starts[-1])), False))

    return rows.repartition("key").sortWithinPartitions("key", "doc_id", "line").mapInArrow(run, schema)


def alike_earlier(docs: DataFrame, least_words: int, above: int, of: int) -> DataFrame:
    """sid of every set that is alike another set which first stands earlier. docs: doc_id and text."""
    least_words = max(least_words, -(-above // max(1, of - above)))  # n tokens of n + 1 are the best that different sets reach
    def make_tokens():
        lines = Lines(least_words)
        return lambda data, offsets: lines.sets(data, offsets)[0]

    counts = group_counts(docs, make_tokens)
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2 ** 32 - 1).astype(np.uint32))
    met = written(met_lines(prefix_rows(docs, sent, least_words, above, of), above, of), "line-cells")

    def settle(pairs):
        pairs = written(pairs, "line-pairs")
        ids = written(pairs.select(F.explode(F.array("sid", "other")).alias("sid")).distinct(), "line-ids")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        sets = written(token_sets(docs, least_words).join(ids, "sid", "left_semi").dropDuplicates(["sid"]), "line-sets")
        return written(verified(pairs, sets, above, of).select("sid").distinct(), "line-alike")

    pairs = written(met.filter("other is not null").groupBy("sid", "other").count(), "line-pairs")
    best = pairs.groupBy("sid").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
    done = settle(best)
    rest = pairs.select("sid", "other").join(done, "sid", "left_anti").join(best, ["sid", "other"], "left_anti")
    place = F.struct("doc_id", "line")
    wide = met.filter("key is not null").groupBy("key", "sid").agg(F.min(place).alias("at"), *(F.min(c).alias(c) for c in ("n", "pos", "bits")))
    other = wide.select("key", *(F.col(c).alias(f"o_{c}") for c in ("sid", "at", "n", "pos", "bits")))
    more = wide.join(done, "sid", "left_anti").join(other, "key").filter((F.col("o_at") < F.col("at")) & may_be_alike("", "o_", above, of))
    rest = rest.unionByName(more.select("sid", F.col("o_sid").alias("other"))).distinct()
    return done.unionByName(settle(rest)).distinct()


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS, above: int = ABOVE, of: int = OF) -> DataFrame:
    """doc_id, tid and gone, the sorted numbers of the lines to remove. docs: doc_id, tid and text."""
    lines = written(line_rows(docs, least_words), "lines")
    first = lines.groupBy("sid").agg(F.min(F.struct("doc_id", "line")).alias("_first"))
    alike = alike_earlier(docs.select("doc_id", "text"), least_words, above, of).withColumn("_alike", F.lit(True))
    judged = first.join(alike, "sid", "left")
    gone = lines.join(judged, "sid").filter(F.coalesce("_alike", F.lit(False)) | (F.struct("doc_id", "line") > F.col("_first")))
    return gone.groupBy("doc_id", "tid").agg(F.array_sort(F.collect_set("line")).alias("gone"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, above: int = ABOVE, of: int = OF, id_col: str = "doc_id",
                text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """The documents without the lines that go; ``removed_col`` names a column for the numbers of these lines."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = keyed.withColumn("tid", F.xxhash64("text"))
    gone = removed_lines(keyed, least_words, above, of).select(F.col("doc_id").alias("_id"), F.col("tid").alias("_tid"), F.col("gone").alias("_gone"))
    own = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    found = docs.withColumn("_own", own).join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_tid")), "left")
    found = found.withColumn("_lines", F.when(F.col("_gone").isNotNull(), F.split(text_col, "\n", -1)))
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get("_lines", i)), "\n")
    found = found.withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept))
    extra = [F.coalesce("_gone", F.array().cast("array<int>")).alias(removed_col)] if removed_col else []
    return found.select(*docs.columns, *extra)


def op3_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
    found = dedup_lines(docs.withColumn("n_lines", n_lines), ANY_WORDS, removed_col="gone")
    return found.select("doc_id", "n_lines", F.size("gone").cast("long").alias("n_removed"),
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
