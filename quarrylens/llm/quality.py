"""Operator 5: document quality by a byte-level convolutional network in numpy.

UTF-8 bytes are embedded; learned filters slide over overlapping chunks that cover the
whole document; each filter is max-pooled within a chunk; the mean and the maximum over
the chunks go through one logistic unit.  The model is fitted on the driver on at most
``SAMPLE_ROWS`` labelled documents in the order of a hash of doc_id, none left out for its
length: of a text with more than ``LEARN_CHUNKS`` chunks that many are learned from, one
drawn from each of as many equal parts of it, cut where the text lies.  So the driver holds
SAMPLE_ROWS x LEARN_CHUNKS x CHUNK bytes at most (250 MB; some 14 MB on texts of usual
length), and steps end when ``LEARN_BYTES`` have gone through the network.  Scoring reads
every byte of every document.  Filters of eight bytes are applied every ``STRIDE`` bytes.
Memory for responses is that of a few chunks at a time, in learning and in scoring.

Defined cases: a null text scores as an empty one (padding only); a null doc_id counts
as empty text in the fold rule; labels that are null are not used, of repeated labels of
a document the larger is, and of rows that share a doc_id one is learned from; with no label of one class every score is the smoothed share
of label 1; repeated rows come again; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.store import save

CHUNK = 1024
HOP = 768
WIDTH = 8
STRIDE = 4
EMBED = 8
FILTERS = 32
GROUP = 64  # chunks whose responses are held at once
BACK_GROUP = 16  # the same in learning
SAMPLE_ROWS = 4000
LEARN_CHUNKS = 64
LEARN_BYTES = 256 << 20
STEPS = 900
BATCH = 32
THRESHOLD = 0.3
FOLDS = 5
HASH_SEED = 11


def chunk_bounds(size: int) -> list[tuple[int, int]]:
    """Byte ranges of overlapping chunks that cover ``size`` bytes; one empty range for no bytes."""
    starts = range(0, max(size - (CHUNK - HOP), 1), HOP)
    return [(s, min(s + CHUNK, size)) for s in starts]


class Network:
    """embed [256, EMBED], filters [WIDTH * EMBED, FILTERS], bias [FILTERS], out [2 * FILTERS], offset."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = rng.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.offset = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.offset]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """[positions, WIDTH * EMBED]: embedded bytes under the filters, every STRIDE bytes."""
        embedded = self.embed[data]
        positions = (len(data) - WIDTH) // STRIDE + 1
        step = embedded.strides[0] * STRIDE
        return np.ascontiguousarray(np.lib.stride_tricks.as_strided(embedded, (positions, WIDTH * EMBED), (step, embedded.itemsize)))

    def responses(self, chunks: np.ndarray, positions: int) -> np.ndarray:
        """[chunk, position, FILTERS] of chunks in rows of bytes, as far as ``positions``."""
        embedded = self.embed[chunks[:, : (positions - 1) * STRIDE + WIDTH]]
        shape = (len(chunks), positions, WIDTH * EMBED)
        windows = np.lib.stride_tricks.as_strided(embedded, shape, (embedded.strides[0], embedded.strides[1] * STRIDE, embedded.itemsize))
        return (windows.reshape(-1, WIDTH * EMBED) @ self.filters).reshape(len(chunks), positions, FILTERS)

    def pooled(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Chunk vectors of whole texts laid end to end, and each text's number of chunks."""
        buffer, low, high, counts, at = [], [], [], [], 0
        for text in texts:
            padded = text + bytes(WIDTH + -len(text) % STRIDE)
            bounds = chunk_bounds(len(text))
            for a, b in bounds:
                low.append((at + a) // STRIDE)
                high.append((at + max(b - 1, a)) // STRIDE + 1)
            counts.append(len(bounds))
            buffer.append(padded)
            at += len(padded)
        data = np.frombuffer(b"".join(buffer) + bytes(WIDTH), np.uint8)
        low, high = np.array(low), np.minimum(high, (len(data) - WIDTH) // STRIDE)
        best = np.empty((len(low), FILTERS), np.float32)
        for g in range(0, len(low), GROUP):
            begin, end = low[g : g + GROUP], high[g : g + GROUP]
            s, e = int(begin[0]), int(end.max()) + 1
            response = self.windows(data[s * STRIDE : (e - 1) * STRIDE + WIDTH]) @ self.filters
            best[g : g + GROUP] = np.maximum.reduceat(response, np.column_stack([begin, end]).ravel() - s, axis=0)[::2]
        return np.maximum(best + self.bias, 0), np.array(counts)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        start = size = 0
        for k, text in enumerate(texts):  # about 1 MB of text at once, and at least one document
            size += len(text)
            if size >= 1 << 20 or k == len(texts) - 1:
                vectors, counts = self.pooled(texts[start : k + 1])
                first = np.cumsum(counts) - counts
                mean = np.add.reduceat(vectors, first, axis=0) / counts[:, None]
                most = np.maximum.reduceat(vectors, first, axis=0)
                out[start : k + 1] = sigmoid(np.concatenate([mean, most], axis=1) @ self.out + self.offset[0])
                start, size = k + 1, 0
        return out


class Constant:
    def __init__(self, score: float):
        self.score = score

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.score)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -40, 40)))


def gradients(net: Network, chunks: list[list[bytes]], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss, in the order of ``parameters``. Only a filter's best window in a chunk has one, so the backward pass is short."""
    owner = np.concatenate([np.full(len(own), k) for k, own in enumerate(chunks)])
    flat = [c for own in chunks for c in own]
    data = np.zeros((len(owner), CHUNK + WIDTH), np.uint8)
    best = np.empty((len(owner), FILTERS), np.int64)
    most_of = np.empty((len(owner), FILTERS), np.float32)
    for row, chunk in enumerate(flat):
        data[row, : len(chunk)] = np.frombuffer(chunk, np.uint8)
    used = np.maximum(1, -(-np.fromiter(map(len, flat), np.int64, len(flat)) // STRIDE))
    for g in range(0, len(flat), BACK_GROUP):
        own = slice(g, g + BACK_GROUP)
        response = net.responses(data[own], int(used[own].max()))
        response[np.arange(response.shape[1])[None, :] >= used[own, None]] = -np.inf
        best[own] = response.argmax(axis=1)
        most_of[own] = np.take_along_axis(response, best[own][:, None], axis=1)[:, 0]
    hidden = np.maximum(most_of + net.bias, 0)
    counts = np.bincount(owner, minlength=len(chunks))
    first = np.cumsum(counts) - counts
    mean = np.add.reduceat(hidden, first, axis=0) / counts[:, None]
    most = np.maximum.reduceat(hidden, first, axis=0)
    both = np.concatenate([mean, most], axis=1)
    error = (sigmoid(both @ net.out + net.offset[0]) - labels).astype(np.float32) / len(labels)
    back = error[:, None] * net.out[None, :]
    top = hidden == most[owner]
    ties = np.add.reduceat(top.astype(np.float32), first, axis=0)
    down = back[owner, :FILTERS] / counts[owner, None] + np.where(top, back[owner, FILTERS:] / ties[owner], 0)
    down *= hidden > 0
    at = best * STRIDE
    under = data[np.arange(len(owner))[:, None, None], at[:, :, None] + np.arange(WIDTH)]  # [chunk, filter, WIDTH]
    windows = net.embed[under].reshape(len(owner), FILTERS, WIDTH * EMBED)
    g_filters = np.einsum("cf,cfw->wf", down, windows)
    g_windows = (down[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    g_embed = np.stack([np.bincount(under.ravel(), weights=g_windows[:, d], minlength=256) for d in range(EMBED)], axis=1)
    return [g_embed, g_filters, down.sum(axis=0), both.T @ error, error.sum(keepdims=True)]


def fit(chunks: list[list[bytes]], labels: np.ndarray, steps: int = STEPS, seed: int = 0, learn_bytes: int = LEARN_BYTES) -> Network | Constant:
    """Adam on log loss; ``chunks`` are those of each text. As many steps as ``learn_bytes`` allow on average, and at least one pass over all texts."""
    positive = int(labels.sum())
    if positive in (0, len(labels)):
        return Constant((positive + 1) / (len(labels) + 2))
    net, rng = Network(seed), np.random.default_rng(seed)
    net.offset[0] = np.log(positive / (len(labels) - positive))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    order = np.empty(0, np.int64)
    a_pass = sum(len(c) for own in chunks for c in own)
    steps = max(min(steps, int(learn_bytes * len(labels) / (max(a_pass, 1) * BATCH))), -(-len(labels) // BATCH))
    for step in range(1, steps + 1):
        if len(order) < BATCH:
            order = np.concatenate([order, rng.permutation(len(labels))])
        picked, order = order[:BATCH], order[BATCH:]
        found = gradients(net, [chunks[i] for i in picked], labels[picked])
        rate = 0.01 * (1 - (step - 1) / steps) + 0.0005
        for p, g, (m, v) in zip(net.parameters(), found, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fold(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod FOLDS; rows of fold 0 are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def learned_chunks(text: bytes, seed: int, most: int) -> list[bytes]:
    """All chunks of a text; of more than ``most`` one drawn from each of ``most`` equal parts."""
    bounds = chunk_bounds(len(text))
    if len(bounds) > most:
        edges = np.arange(most + 1) * len(bounds) // most
        picked = edges[:-1] + (np.random.default_rng(seed).random(most) * np.diff(edges)).astype(np.int64)
        bounds = [bounds[k] for k in picked.tolist()]
    return [text[slice(*b)] for b in bounds]


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS, learn_chunks: int = LEARN_CHUNKS) -> Network | Constant:
    picked = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(fold(F.col("doc_id")) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64(F.lit(HASH_SEED), "doc_id"), "doc_id").limit(sample_rows)
    )

    def run(batches):
        for batch in batches:
            ids, quality = batch.column(0), batch.column(1)
            chunks = [learned_chunks(text.as_py(), (doc_id.as_py() ^ HASH_SEED) & (1 << 63) - 1, learn_chunks) for doc_id, text in zip(ids, batch.column(2))]
            yield pa.RecordBatch.from_arrays([ids, quality, pa.array(chunks, pa.list_(pa.binary()))], ["doc_id", "quality", "chunks"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    rows = narrow.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one row of a doc_id, however often it comes
    found = save(rows.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, chunks array<binary>"), "quality-sample").toArrow().sort_by("doc_id")
    return fit(found["chunks"].to_pylist(), found["quality"].to_numpy().astype(np.float64), steps)


def score(docs: DataFrame, model: Network | Constant, at_least: float | None = None) -> DataFrame:
    """docs with ``qc_score`` added, or replaced; only rows scored ``at_least``, if given."""
    docs = docs.drop("qc_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", qc_score double"

    def run(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]
            scores = shared.value.scores(texts) if texts else np.empty(0)
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "qc_score"])
            yield out if at_least is None else out.filter(pa.array(scores >= at_least))

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = train(docs, labels)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), F.col("qc_score").alias("score"), (F.col("qc_score") >= THRESHOLD).cast("int").alias("predicted"))
