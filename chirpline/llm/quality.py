"""Text quality from the bytes of a whole document, by a small convolutional network in numpy.

A filter looks at ``WIDTH`` bytes, every second byte. Chunks of two blocks of
``BLOCK`` bytes overlap by half and cover the document from its first byte to
its last; each filter's largest response in a chunk is the chunk's feature.
The document's largest, mean and smallest chunk features make one probability.

The network is trained here, on the driver, by gradient descent over at most
``sample_rows`` labelled documents of at most ``sample_bytes`` bytes, chosen by
the hash of their id among those outside the held-out fold. Scoring reads
nothing but the text.

Defined cases: null texts are empty, and an empty text is one block of padding
with a score like any other; labels that are null are not learnt from, and a
document with several labels counts with the smallest; without any label the
score is 0.5; rows that repeat are scored each; other columns are not looked at.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirpline.llm.frames import arrow_map, doc_schema, table, texts_of
from chirpline.llm.words import raw, text_slices

WIDTH, STEP, BLOCK, FILTERS = 8, 2, 128, 16
SAMPLE_ROWS, SAMPLE_BYTES, EPOCHS = 3000, 32_768, 12
THRESHOLD = 0.3
#: Blocks of which the responses are held at once.
SPAN = 2048
FOLDS = 5


def padded(data, offsets):
    """The rows one after the other, each padded to whole blocks, and the first block of each."""
    sizes = np.diff(offsets)
    blocks = np.maximum(1, -(-(sizes + WIDTH) // BLOCK))
    first = np.concatenate([[0], np.cumsum(blocks)])
    out = np.zeros(int(first[-1]) * BLOCK + WIDTH, np.uint8)
    for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        at = int(first[row]) * BLOCK
        out[at:at + b - a] = data[a:b]
    return out, first


class ByteConvNet:
    """Filters by position and byte, and the weights of the pooled features."""

    def __init__(self, seed=3):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.weights = rng.normal(0, 0.1, (3, FILTERS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def responses(self, x):
        """Responses of the filters at every second byte."""
        n = (len(x) - WIDTH) // STEP
        out = self.filters[0].take(x[0:n * STEP:STEP], axis=0)
        for j in range(1, WIDTH):
            out += self.filters[j].take(x[j:j + n * STEP:STEP], axis=0)
        return out

    def chunks(self, x, first, places=False):
        """Largest response of each filter in each chunk, and on demand where. A chunk starts at each block of its row but the last.

        Responses are taken for some blocks at a time. In a row's last block, positions that reach beyond it lie in padding;
        they respond like the last position within it, not to the row behind.
        """
        many, whole = int(first[-1]), (BLOCK - WIDTH) // STEP
        block, at = np.empty((many, FILTERS), np.float32), np.empty((many, FILTERS), np.int64)
        last = np.zeros(many, bool)
        last[first[1:] - 1] = True
        for lo in range(0, many, SPAN):
            hi = min(many, lo + SPAN)
            found = self.responses(x[lo * BLOCK:hi * BLOCK + WIDTH]).reshape(-1, BLOCK // STEP, FILTERS)
            ends = np.flatnonzero(last[lo:hi])
            found[ends, whole + 1:] = found[ends, whole:whole + 1]
            block[lo:hi] = found.max(axis=1)
            if places:
                at[lo:hi] = found.argmax(axis=1) + np.arange(lo, hi)[:, None] * (BLOCK // STEP)
        following = np.concatenate([block[1:], block[-1:]])
        following[last] = block[last]
        best = np.maximum(block, following)
        if not places:
            return best
        after = np.concatenate([at[1:], at[-1:]])
        return best, np.where(following > block, after, at)

    def pooled(self, best, first):
        """Largest, mean and smallest chunk features of each row, after the ramp."""
        ramp = np.maximum(best, 0)
        sizes = np.diff(first)[:, None]
        return np.stack([np.maximum.reduceat(ramp, first[:-1]), np.add.reduceat(ramp, first[:-1]) / sizes,
                         np.minimum.reduceat(ramp, first[:-1])], axis=1)

    def probabilities(self, data, offsets):
        x, first = padded(data, offsets)
        logit = (self.pooled(self.chunks(x, first), first) * self.weights).sum(axis=(1, 2)) + self.bias[0]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, x, first, labels):
        best, at = self.chunks(x, first, places=True)
        pooled = self.pooled(best, first)
        logit = (pooled * self.weights).sum(axis=(1, 2)) + self.bias[0]
        d = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
        row = np.repeat(np.arange(len(labels)), np.diff(first))
        ramp = np.maximum(best, 0)
        share = np.zeros_like(ramp)
        for k in (0, 2):
            equal = ramp == pooled[row, k]
            share += self.weights[k] * equal / np.add.reduceat(equal.astype(np.float32), first[:-1])[row]
        share += self.weights[1] / np.diff(first)[row][:, None]
        share *= d[row][:, None] * (best > 0)
        to_filters = np.empty_like(self.filters)
        for j in range(WIDTH):
            cell = x[at * STEP + j].astype(np.int64) * FILTERS + np.arange(FILTERS)
            to_filters[j] = np.bincount(cell.ravel(), share.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        return to_filters, (pooled * d[:, None, None]).sum(axis=0), np.array([d.sum()], np.float32)

    def fit(self, texts, labels, epochs=EPOCHS, batch=48, rate=0.01, seed=5):
        """Gradient descent with running moments over byte strings and their 0/1 labels."""
        rng, labels = np.random.default_rng(seed), np.asarray(labels, np.float32)
        self.bias[0] = np.log((labels.mean() + 0.01) / (1.01 - labels.mean()))
        weights = [self.filters, self.weights, self.bias]
        first_moment, second_moment = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                own = order[lo:lo + batch]
                joined = b"".join(texts[i] for i in own)
                x, first = padded(np.frombuffer(joined, np.uint8), np.cumsum([0, *(len(texts[i]) for i in own)]))
                step += 1
                now = rate * (1 - 0.9 * epoch / epochs)
                for w, g, m, v in zip(weights, self.gradients(x, first, labels[own]), first_moment, second_moment):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-6)
        return self


def fold(id_col="doc_id"):
    """The fold of a document; fold 0 is held out."""
    return F.crc32(F.col(id_col).cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
          sample_bytes: int = SAMPLE_BYTES) -> ByteConvNet | None:
    """A network fitted to a bounded sample of the labelled documents outside the held-out fold; None without any."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & (fold() != 0))
    chosen = (known.groupBy("doc_id").agg(F.min(label_col).cast("int").alias("label"))
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(sample_rows))
    label = {r["doc_id"]: r["label"] for r in chosen.collect()}
    if not label:
        return None
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = texts.filter(F.col("doc_id").isin(list(label)) & (F.octet_length("text") <= sample_bytes)).dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: str(r["doc_id"]))
    if not rows:
        return None
    return ByteConvNet().fit([r["text"].encode() for r in rows], [label[r["doc_id"]] for r in rows])


def quality_scores(docs: DataFrame, net: ByteConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score, the probability that a document is of good quality."""
    schema = doc_schema(("score", "double"), id_type=docs.schema[id_col].dataType)
    sent = docs.sparkSession.sparkContext.broadcast(None if net is None else (net.filters, net.weights, net.bias))

    def make():
        own = None if sent.value is None else ByteConvNet()
        if own is not None:
            own.filters, own.weights, own.bias = sent.value

        def step(batch):
            texts = batch.column("text")
            data, offsets = raw(texts)
            for lo, hi in text_slices(texts, 1 << 18):
                score = np.full(hi - lo, 0.5) if own is None else own.probabilities(data, offsets[lo:hi + 1])
                yield {"doc_id": batch.column("doc_id")[lo:hi], "score": score}

        return step

    return arrow_map(texts_of(docs, id_col, text_col), make, schema)


def keep_good(docs: DataFrame, net: ByteConvNet | None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents with a score of at least the threshold, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(None if net is None else (net.filters, net.weights, net.bias))

    def run(batches):
        own = None if sent.value is None else ByteConvNet()
        if own is not None:
            own.filters, own.weights, own.bias = sent.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            data, offsets = raw(texts)
            for lo, hi in text_slices(texts, 1 << 18):
                part = batch.slice(lo, hi - lo)
                yield part if own is None else part.filter(pa.array(own.probabilities(data, offsets[lo:hi + 1]) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
