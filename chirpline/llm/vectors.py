"""Vectors that nearly coincide, by tiles of neighbours that meet without a shuffle.

Two unit vectors with a cosine of ``COSINE`` at least are no further apart than
a squared distance of 2 - 2 * COSINE. Vectors are dealt and sorted by the signs
of their first dimensions after a random rotation and packed into tiles, which
are written once. Every pair of tiles meets in a task that reads both, so no
vector is copied for others to visit and the disk holds each a few times,
whatever their number. A tile has a box around its vectors; vectors beyond the
distance from the other tile's box are left out. Of the rest, the first
``GRID`` + 1 blocks of ``BLOCK`` rotated dimensions and the length of what
remains bound the cosine; only where they allow a link are whole vectors
compared, in double precision where single precision does not decide.

Pairs are counted, never written. A task gives its sums for each vector and one
vector that it reaches, and joins these where they turn out to be linked. Equal
vectors are one vector. Work grows with the square of the number of different
vectors, but for tiles that lie apart.

Defined cases: vectors that are null, empty, zero or have null or non-finite
components link with nothing; vectors of different lengths do not link; rows of
one id and vector are one; rows without id are returned without links; other
columns are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chirpline.llm.components import components
from chirpline.llm.frames import table, written

COSINE = 0.95
BLOCK, GRID, TILE = 8, 2, 4096
#: Bytes of a tile's vectors, tiles that a task keeps prepared, and rows of one that meet another at once.
TILE_BYTES, TILES_HELD, STRIP = 1 << 20, 24, 256
#: Signs in a code.
SIGNS = 20
#: More than any error of single precision.
ROUGH = 1e-4


def rotation(dims, seed=11):
    """A random orthogonal matrix, the same in every process."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dims]).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def matrix(column, dims):
    """Rows of an Arrow list column as doubles, and as unit vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    return values, values / np.sqrt((values * values).sum(axis=1))[:, None]


PACKED = "no long, dims int, sid binary, copies binary, vector binary"


def coded(vectors: DataFrame) -> DataFrame:
    """The vectors with the signs of their first rotated dimensions as a number."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("code", T.IntegerType())])

    def run(batches):
        for batch in batches:
            sizes, code = batch.column("dims").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dims in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dims)
                turned = matrix(batch.column("vector").take(pa.array(rows)), dims)[1] @ rotation(dims)[:, :SIGNS]
                code[rows] = (turned > 0) @ (1 << np.arange(turned.shape[1])[::-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], names=schema.names)

    return vectors.mapInArrow(run, schema)


def packed(vectors: DataFrame, tile_rows: int) -> DataFrame:
    """Tiles of vectors of one length that lie side by side, each a row of arrays. vectors: sid, vector, copies, dims."""
    schema = T.StructType.fromDDL(PACKED)
    order = ["dims", "code", "sid"]
    dealt = coded(vectors).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        number, dims, waiting, count = TaskContext.get().partitionId() << 32, None, [], 0

        def tile(rows):
            nonlocal number
            table = pa.Table.from_batches(rows).combine_chunks()
            flat = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            values = [np.ascontiguousarray(x).tobytes() for x in (table.column("sid").to_numpy(), table.column("copies").to_numpy(), flat)]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([dims], pa.int32()),
                                               *(pa.array([v], pa.binary()) for v in values)], names=schema.names)

        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            cuts = [0, *(np.flatnonzero(sizes[1:] != sizes[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo and waiting and sizes[lo] != dims:
                    yield tile(waiting)
                    waiting, count = [], 0
                while lo < hi:
                    dims = int(sizes[lo])
                    most = min(tile_rows, max(64, TILE_BYTES // (4 * dims)))
                    own = batch.slice(lo, min(hi - lo, most - count)).select(["sid", "copies", "vector"])
                    waiting.append(own)
                    lo, count = lo + own.num_rows, count + own.num_rows
                    if count == most:
                        yield tile(waiting)
                        waiting, count = [], 0
        if waiting:
            yield tile(waiting)

    return dealt.mapInArrow(run, schema)


class Tile:
    """Vectors of a tile as arrays, with what their links gave so far."""

    def __init__(self, dims, sid, copies, vector, head):
        self.ids, self.copies = np.frombuffer(sid, np.int64), np.frombuffer(copies, np.int64)
        self.values = np.frombuffer(vector, np.float32).reshape(-1, dims)
        doubles = self.values.astype(np.float64)
        self.norms = np.sqrt((doubles * doubles).sum(axis=1))[:, None]
        turned = (doubles / self.norms) @ rotation(dims)
        rest = np.sqrt(np.maximum(0, 1 - (turned[:, :head] ** 2).sum(axis=1)))
        self.turned = turned.astype(np.float32)
        self.bound = np.concatenate([turned[:, :head], rest[:, None]], axis=1).astype(np.float32)
        self.low, self.high = self.turned.min(axis=0), self.turned.max(axis=0)

    def unit(self, rows):
        return self.values[rows].astype(np.float64) / self.norms[rows]

    def reaching(self, other, limit):
        """The rows that are not too far from the box around another tile."""
        gap = np.maximum(self.turned - other.high, other.low - self.turned)
        np.maximum(gap, 0, out=gap)
        return np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= limit + ROUGH)


def linked(one, other, cosine):
    """Rows of two tiles whose vectors link, some rows of the first at a time: both ends of each link. In a tile with itself both directions."""
    limit = 2 - 2 * cosine
    rows, cols = one.reaching(other, limit), other.reaching(one, limit)
    if not (len(rows) and len(cols)):
        return
    bound = np.ascontiguousarray(other.bound[cols].T)
    for lo in range(0, len(rows), STRIP):
        mine = rows[lo:lo + STRIP]
        likely = one.bound[mine] @ bound >= cosine - ROUGH
        if not likely.any():
            continue
        x, y = mine[likely.any(axis=1)], cols[likely.any(axis=0)]
        dots = one.turned[x] @ other.turned[y].T
        u, v = np.nonzero(dots >= cosine - ROUGH)
        # only where single precision does not decide, doubles do
        sure = dots[u, v] >= cosine + ROUGH
        u, v, open_ = x[u], y[v], np.flatnonzero(~sure)
        for at in range(0, len(open_), 1 << 15):
            some = open_[at:at + (1 << 15)]
            sure[some] = np.einsum("ij,ij->i", one.unit(u[some]), other.unit(v[some])) >= cosine
        if one is other:
            sure &= u != v
        if sure.any():
            yield u[sure], v[sure]


class Links:
    """Counts of links of the vectors of some tiles and for each a vector that it reaches."""

    def __init__(self):
        self.counts, self.roots, self.ids = {}, {}, {}

    def add(self, a, one, b, other, cosine):
        """The links between two tiles; yields pairs of vectors that are joined by them."""
        for u, v in linked(one, other, cosine):
            for name, tile in ((a, one), (b, other)):
                if name not in self.counts:
                    self.counts[name], self.roots[name], self.ids[name] = np.zeros(len(tile.ids), np.int64), tile.ids.copy(), tile.ids.copy()
            np.add.at(self.counts[a], u, other.copies[v])
            if a != b:
                np.add.at(self.counts[b], v, one.copies[u])
            left, right = self.roots[a], self.roots[b]
            before = left[u], right[v]
            while True:
                least = np.minimum(left[u], right[v])
                if np.array_equal(left[u], least) and np.array_equal(right[v], least):
                    break
                np.minimum.at(left, u, least)
                np.minimum.at(right, v, least)
            for old, new in zip(before, (left[u], right[v])):
                moved = old != new
                if moved.any():
                    yield np.unique(np.stack([old[moved], new[moved]], axis=1), axis=0)

    def rows(self):
        for name, counts in self.counts.items():
            met = np.flatnonzero(counts)
            yield self.ids[name][met], self.roots[name][met], counts[met]


def vector_links(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, grid: int = GRID, tile_rows: int = TILE) -> DataFrame:
    """Rows (sid, root, links) of all pairs of tiles. vectors: sid, vector, copies and dims, one row for each different vector.

    Of a vector each task gives one that it reaches and the copies it links with; rows without links only join two vectors.
    """
    schema = T.StructType.fromDDL("sid long, root long, links long")
    tiles = written(packed(vectors, tile_rows), "vector-tiles")
    others = tiles.select(*[F.col(c).alias(f"{c}_2") for c in tiles.columns])
    a, b = F.col("no"), F.col("no_2")
    # every pair once, half of them with the later tile first, so that all tasks have their share
    once = ((a < b) == (F.pmod(a + b, F.lit(2)) == 0)) | ((a - b) == 0)
    pairs = tiles.hint("shuffle_replicate_nl").join(others, ((F.col("dims") - F.col("dims_2")) == 0) & once)

    def run(batches):
        known, found = {}, Links()

        def tile(batch, i, end):
            name, dims, *values = (batch.column(c + end)[i] for c in ("no", "dims", "sid", "copies", "vector"))
            name, dims = name.as_py(), dims.as_py()
            if name in known:
                known[name] = known.pop(name)
            else:
                known[name] = Tile(dims, *(v.as_buffer().to_pybytes() for v in values), min(dims, block * (grid + 1)))
                if len(known) > TILES_HELD:
                    del known[next(iter(known))]
            return name, known[name]

        def send(sid, root, links):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (sid, root, links)], names=schema.names)

        for batch in batches:
            for i in range(batch.num_rows):
                for joined in found.add(*tile(batch, i, ""), *tile(batch, i, "_2"), cosine):
                    yield send(joined[:, 0], joined[:, 1], np.zeros(len(joined), np.int64))
        for rows in found.rows():
            yield send(*rows)

    return pairs.mapInArrow(run, schema)


def usable(vector: str):
    """Whether a vector can link: finite components, none null, and not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, block: int = BLOCK, grid: int = GRID, id_col: str = "vec_id",
                 vector_col: str = "embedding") -> DataFrame:
    """One row for each row: vec_id, n_links, component_id and kept."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("vector"))
    rows = rows.withColumn("ok", F.coalesce(usable("vector") & F.col("vec_id").isNotNull(), F.lit(False)))
    # equal vectors have equal names of 128 bits; only one row of each vector is dealt with its vector
    plain = F.transform("vector", lambda x: x + F.lit(0.0).cast("float"))
    good = rows.filter("ok").select("vec_id", plain.alias("vector")).withColumns({
        "name": F.xxhash64("vector"), "name_2": F.xxhash64(F.lit(1), "vector")})
    named, name = good.select("vec_id", "name", "name_2"), ["name", "name_2"]
    same = written(named.distinct().groupBy(*name).agg(F.min("vec_id").alias("sid"), F.count("*").alias("copies")), "vectors")
    firsts = good.join(same.withColumn("vec_id", F.col("sid")), ["vec_id", *name]).dropDuplicates(["vec_id", *name])
    firsts = firsts.select("sid", "vector", "copies", F.size("vector").alias("dims"))
    found = written(vector_links(firsts, cosine, block, grid), "vector-links")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    homes = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "sid")
    facts = same.join(links, "sid", "left").join(homes, "sid", "left")
    facts = facts.select(*name, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "sid").alias("component_id"))
    out = named.join(facts, name).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_vectors(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
