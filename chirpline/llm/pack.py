"""Packing of documents into sequences of a fixed number of tokens by a grouping genetic algorithm.

A document is its ids and the closing id. A longer one is cut into pieces of
the full length, of which the first may be shorter; full pieces are sequences
of their own. All other pieces are packed: they are dealt at random to blocks
of about ``block_items``, and several islands breed packings of each block.
Crossover puts whole well-filled bins of one parent into the other, removes
the bins there that hold some of the same pieces, and best-fits what these
bins held besides. After each epoch every island hands its elite to the next
island of its block. The best packing of each block counts, and what its poorly
filled bins hold is dealt to new blocks once more.

A piece travels with its own columns, so nothing is joined and rows that
repeat stay apart. Blocks have a bounded size whatever the keys are.

Defined cases: null texts are empty and hold only the closing id; empty tables
give no rows; ties are broken by the order of the written pieces; other
columns are not looked at.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpline.llm.bytepairs import ByteModel
from chirpline.llm.frames import arrow_map, doc_schema, give_back, table, texts_of, written
from chirpline.llm.merging import judged_pairs
from chirpline.llm.units import SPACE_CHARS, Cutter, Recent, kept_in_process, row_sums, take_rows
from chirpline.llm.words import text_slices

SEQUENCE = 2048
CLOSING_ID = 0
BLOCK_ITEMS = 4096
ISLANDS = 3
EPOCHS = 2
REMEMBERED = 120_000
SLICE = 1 << 21


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers, encoded once for each distinct unit.

    Units are remembered for a task; only the small table of judged pairs of tokens stays with the process.
    """

    def __init__(self, model: ByteModel, remembered=REMEMBERED):
        self.model, self.remembered = model, Recent(remembered)
        self.model.encoder.forget(kept_in_process(("judged pairs", model.path), judged_pairs))
        # letters and digits never go on into these marks
        marks = "".join(c for c in ",.;:!?)" if not any(c in s for s in self.model.special))
        self.cutter = Cutter("".join(c for c in SPACE_CHARS if c < "\x80"), "".join(SPACE_CHARS), lead=False, after_word=marks)

    def learn(self, units):
        ids, counts = self.model.encode_units(units)
        data, ends = ids.astype("<u4").tobytes(), [0, *np.cumsum(4 * counts).tolist()]
        return [data[x:y] for x, y in zip(ends, ends[1:])]

    def ids(self, texts):
        """Ids of an Arrow column of texts, and how many each row has."""
        unit, first, distinct = self.cutter.units(texts)
        found = self.remembered.values(distinct, self.learn)
        ids, sizes = take_rows(np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64), unit)
        return ids, row_sums(sizes, first)


def token_pieces(docs: DataFrame, length: int = SEQUENCE, path: str | None = None, closing_id: int = CLOSING_ID,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32 and, on demand, the ids themselves."""
    fields = [("piece", "int"), ("start", "long"), ("length", "long"), ("ids_crc32", "long")] + [("ids", "binary")] * with_ids
    schema = doc_schema(*fields, id_type=docs.schema[id_col].dataType)

    model = ByteModel(path, specials=True)

    def make():
        encoder = Encoder(model)

        def step(batch):
            for lo, hi in text_slices(batch.column("text"), SLICE):
                found, counts = encoder.ids(batch.column("text")[lo:hi])
                data = memoryview(np.insert(found, np.cumsum(counts), closing_id).astype("<u4").tobytes())
                out, rows, base = {n: [] for n, _ in fields}, [], 0
                for row, total in enumerate((counts + 1).tolist()):
                    count = -(-total // length)
                    end = total - (count - 1) * length
                    start = 0
                    for piece in range(count):
                        part = data[base + 4 * start:base + 4 * end]
                        for n, v in (("piece", piece), ("start", start), ("length", end - start), ("ids_crc32", zlib.crc32(part))):
                            out[n].append(v)
                        if with_ids:
                            out["ids"].append(bytes(part))
                        rows.append(row)
                        start, end = end, end + length
                    base += 4 * total
                yield {"doc_id": batch.column("doc_id")[lo:hi].take(pa.array(rows, pa.int64())), **out}
                del found, counts, data, out, rows
                give_back()

        return step

    return arrow_map(texts_of(docs, id_col, text_col), make, schema)


def best_fit(sizes, order, bins, fills, capacity):
    """Put the items into open bins, each where the least room stays, or into new ones. Changes ``bins`` and ``fills``."""
    rooms, mask = {}, 0
    for b, f in enumerate(fills):
        if f < capacity:
            rooms.setdefault(capacity - f, []).append(b)
            mask |= 1 << (capacity - f)
    for i in order:
        size = sizes[i]
        at = mask >> size
        if at:
            room = size + (at & -at).bit_length() - 1
            held = rooms[room]
            b = held.pop()
            if not held:
                mask &= ~(1 << room)
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i] = b
        fills[b] += size
        if left := room - size:
            if mask >> left & 1:
                rooms[left].append(b)
            else:
                rooms[left] = [b]
                mask |= 1 << left


def compact(bins):
    return np.unique(bins, return_inverse=True)[1]


def fitness(sizes, bins, capacity):
    """Mean of the squared shares of the bins in use."""
    return float(np.mean((np.bincount(bins, sizes) / capacity) ** 2))


def random_packing(sizes, rng, capacity, noise):
    order = np.argsort(-sizes * (1 + noise * rng.standard_normal(len(sizes))), kind="stable")
    bins, fills = np.zeros(len(sizes), np.int64), []
    best_fit(sizes.tolist(), order.tolist(), bins, fills, capacity)
    return bins


def crossover(sizes, giver, taker, rng, capacity):
    """Whole well-filled bins of ``giver`` in ``taker``; pieces of the bins they displace are best-fitted."""
    fills = np.bincount(giver, sizes)
    share = rng.uniform(0.05, 0.3)
    chosen = rng.random(len(fills)) < share * (fills / capacity) ** 8
    injected = chosen[giver]
    hit = np.zeros(int(taker.max()) + 1, bool)
    hit[taker[injected]] = True
    worst = np.bincount(taker, sizes, len(hit))
    hit |= worst <= np.partition(worst, min(1, len(worst) - 1))[min(1, len(worst) - 1)]
    displaced = hit[taker] & ~injected
    child = np.where(injected, giver + len(hit), taker)
    stays = ~displaced
    child[stays] = compact(child[stays])
    fills = np.bincount(child[stays], sizes[stays]).astype(np.int64).tolist() if stays.any() else []
    loose = np.flatnonzero(displaced)
    loose = loose[np.argsort(-sizes[loose] * (1 + 0.05 * rng.random(len(loose))), kind="stable")]
    best_fit(sizes.tolist(), loose.tolist(), child, fills, capacity)
    return child


def evolve(sizes, elites, rng, capacity, population=6, generations=10):
    """The best packing bred from the given ones and random ones."""
    least = -(-int(sizes.sum()) // capacity)
    pool = [compact(np.asarray(e)) for e in elites]
    while len(pool) < population:
        pool.append(random_packing(sizes, rng, capacity, 0.0 if not pool else 0.1 * rng.random()))
    scored = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(pool)), key=lambda x: (-x[0], x[1]))
    made = len(scored)
    for _ in range(generations):
        if scored[0][2].max() + 1 <= least:
            break
        a, b = rng.choice(min(4, len(scored)), 2, replace=False) if len(scored) > 1 else (0, 0)
        for giver, taker in ((a, b), (b, a)):
            child = crossover(sizes, scored[giver][2], scored[taker][2], rng, capacity)
            scored.append((fitness(sizes, child, capacity), made, child))
            made += 1
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:population]
    return scored[0][2]


def breed(items: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, seed: int) -> DataFrame:
    """The items with block and bin, after the islands' epochs."""
    plain = items.columns
    dealt = items.withColumns({"_block": (F.rand(seed) * blocks).cast("long"), "_item": F.monotonically_increasing_id()})
    out = T.StructType([*dealt.schema.fields, T.StructField("_home", T.LongType()), T.StructField("_bin", T.LongType())])

    def island(last):
        def run(key, rows):
            rows = rows.sort_values(["_home", "_item"], kind="stable")
            homes = rows["_home"].unique()
            first = rows[rows["_home"] == homes[0]]
            sizes = first["length"].to_numpy()
            elites = [rows["_bin"][rows["_home"] == h].to_numpy() for h in homes] if rows["_bin"].notna().all() else []
            rng = np.random.default_rng([seed, int(key[0]), int(key[1]), len(elites)])
            best = evolve(sizes, elites, rng, capacity)
            return first.assign(_bin=best, _home=0 if last else int(key[1]))[out.names]

        return run

    current = dealt.withColumns({"_home": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))),
                                 "_bin": F.lit(None).cast("long")}).withColumn("_to", F.col("_home"))
    for epoch in range(epochs + 1):
        last = epoch == epochs
        if epoch:
            current = current.withColumn("_to", F.lit(0).cast("long") if last else
                                         F.explode(F.array("_home", (F.col("_home") + 1) % islands)))
        current = current.groupBy("_block", "_to").applyInPandas(island(last), out)
    return current.select(*plain, "_block", "_bin")


def pack(pieces: DataFrame, capacity: int = SEQUENCE, block_items: int = BLOCK_ITEMS, islands: int = ISLANDS, epochs: int = EPOCHS,
         well_filled: float = 0.98, seed: int = 7) -> DataFrame:
    """The pieces (any frame with a length column) with sequence_id and offset.

    Pass a written table: it is read several times.
    """
    full = pieces.filter(F.col("length") >= capacity)
    out = full.withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest, rounds = pieces.filter(F.col("length") < capacity), 2
    own = pieces.columns
    for turn in range(rounds):
        blocks = max(1, -(-rest.count() // block_items))
        bred = written(breed(rest, blocks, capacity, islands, epochs, seed + turn), "packed")
        in_bin = lambda name: f"sum({name}) OVER (PARTITION BY _block, _bin"
        placed = bred.withColumns({
            "_fill": F.expr(in_bin("length") + ")"),
            "offset": F.expr(in_bin("length") + f" ORDER BY length DESC, {', '.join(f'`{c}`' for c in own if c != 'length')} ROWS UNBOUNDED PRECEDING)") - F.col("length"),
        })
        done = placed if turn == rounds - 1 else placed.filter(F.col("_fill") >= well_filled * capacity)
        out = out.unionByName(done.select(*own, ((F.lit(turn + 1).cast("long") * (1 << 60)) + F.col("_block") * (1 << 24) + F.col("_bin")).alias("sequence_id"), "offset"))
        rest = placed.filter(F.col("_fill") < well_filled * capacity).select(*own)
    return out


def op1_pack(spark, sf_dir):
    return pack(written(token_pieces(table(spark, sf_dir, "documents")), "pieces"))
