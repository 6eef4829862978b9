"""Sets that share a rare token: counts of token groups, and cells of sets by prefix token.

Two sets that overlap enough share one of the first tokens of both, in any
fixed order of tokens. The order is by the count of the token's group over the
whole table; the groups are a fixed number of hash buckets, so the counts have
a fixed size whatever the data are.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chirpline.llm.frames import arrow_map
from chirpline.llm.words import raw, text_slices

BITS = 20
PARTS = 64


def bucket(hashes):
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def group_counts(texts: DataFrame, make_tokens) -> np.ndarray:
    """Number of sets that hold a token of each group, over all rows. ``make_tokens()(data, offsets)`` gives the tokens of all sets."""
    schema = T.StructType.fromDDL("part int, counts binary")
    width = (1 << BITS) // PARTS

    def count(batches):
        tokens, out = make_tokens(), np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            data, offsets = raw(batch.column("text"))
            for lo, hi in text_slices(batch.column("text")):
                out += np.bincount(bucket(tokens(data, offsets[lo:hi + 1])), minlength=1 << BITS).astype(np.uint32)
        for p in range(PARTS):
            yield pa.RecordBatch.from_pydict({"part": [p], "counts": [out[p * width:(p + 1) * width].tobytes()]}, pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    def add(batches):
        sums = {}
        for batch in batches:
            for p, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                sums[p] = sums.get(p, 0) + np.frombuffer(counts.as_buffer(), np.uint32 if len(counts.as_buffer()) == 4 * width else np.uint64).astype(np.uint64)
        for p, s in sums.items():
            yield pa.RecordBatch.from_pydict({"part": [p], "counts": [s.tobytes()]}, pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    rows = texts.select("text").mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect()
    total = np.zeros(1 << BITS, np.uint64)
    for r in rows:
        total[r["part"] * width:(r["part"] + 1) * width] = np.frombuffer(r["counts"], np.uint64)
    return total


def rarest(tokens, counts, k):
    """The first k tokens in the order of their groups' counts, then their hashes."""
    return tokens[np.lexsort((tokens, counts[bucket(tokens)]))[:k]]


def shared_cells(rows: DataFrame, order: list[str], first: list[str]) -> DataFrame:
    """The rows of keys that two different sets (sid) hold, with columns of the first row of their key as ``first_<name>``.

    Rows stream through in the order of the keys, so a cell of any size takes
    no memory. Of the rows of a key's first set only the first stays.
    """
    schema = T.StructType([*rows.schema.fields, *(T.StructField(f"first_{n}", rows.schema[n].dataType) for n in first)])

    def stream(batches):
        head, alive = None, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if head is not None:
                table = pa.concat_tables([head, table])
            table = table.combine_chunks()
            keys, sids = table.column("key").to_numpy(), table.column("sid").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            other = sids != sids[starts][run]
            repeat = np.zeros(len(keys), bool)
            repeat[1:] = other[1:] & (keys[1:] == keys[:-1]) & (sids[1:] == sids[:-1])
            other &= ~repeat
            live = np.zeros(len(starts), bool)
            live[run[other]] = True
            keep = other.copy()
            keep[starts] = live
            if head is not None and alive:
                keep[0] = False
            carried = alive and len(starts) == 1 and head is not None
            head, alive = table.slice(int(starts[-1]), 1), bool(live[-1]) or carried
            at = np.flatnonzero(keep)
            if len(at):
                out = table.take(pa.array(at))
                lead = pa.array(starts[run[at]])
                for n in first:
                    out = out.append_column(f"first_{n}", table.column(n).take(lead))
                yield from out.combine_chunks().to_batches()

    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(stream, schema)
