"""A quality classifier on random-indexing word vectors.

Words and runs of punctuation fall on a fixed number of rows; each has a sparse ternary index vector, and a word's
vector is the sum of the index vectors of its neighbours over all documents. A document pools three means:
of its words' vectors, of their squares, and of the products of neighbours (equal to the squares where a word repeats).
A two-layer network in numpy scores it; its logit is divided by a temperature fitted
on rows that the network did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SpanHash, class_runs, drop, mix, pieces, settled, stored, sum_vectors, table, vector_rows

#: Rows for words, dimensions, nonzero entries of an index vector, neighbours on either side.
ROWS, DIM, NONZERO, NEAR = 1 << 13, 32, 2, 2
POOLED, SLICES = 3 * DIM, 8
#: Labelled rows that the network is fitted on, about (drawn by a hash of doc_id): the bound of the sample.
TRAIN_ROWS = 20_000
HIDDEN, EPOCHS, SEED, ACCEPT = 32, 60, 7, 0.3

_KIND = np.full(256, 2, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_index = mix(np.arange(1, ROWS * NONZERO + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(ROWS, NONZERO)
_AT, _SIGN = (_index % np.uint64(DIM)).astype(np.int64), np.where(_index >> np.uint64(63), 1.0, -1.0)


def held_out(id="doc_id"):
    """Rows without an id are held out too."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 5 == 0, F.lit(True))


def _tokens(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row of the vectors for each token, and each token's document."""
    start, end = class_runs(_KIND[raw], at)
    return (SpanHash(raw)(start, end) % np.uint64(ROWS)).astype(np.int64), np.searchsorted(at, start, "right") - 1


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all rows, from the neighbours over all documents; sums of whole numbers, so that reruns agree."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * DIM)
        for batch in batches:
            for _, raw, at in pieces(batch, "text"):
                word, doc = _tokens(raw, at)
                for k in range(1, NEAR + 1):
                    same = doc[k:] == doc[:-k]
                    a, b = word[:-k][same], word[k:][same]
                    for x, y in ((a, b), (b, a)):
                        for z in range(NONZERO):
                            total += np.bincount(x * DIM + _AT[y, z], _SIGN[y, z], ROWS * DIM)
        yield vector_rows(total, SLICES)

    sums = sum_vectors(docs.select("text").mapInArrow(count, "slice int, part int, counts binary"), SLICES, ROWS * DIM).reshape(ROWS, DIM).astype(float)
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    sums -= sums.mean(axis=0)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pool(raw: np.ndarray, at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Means of the vectors of each document's words, of their squares and of the products of neighbours; zeros for a
    document without any."""
    word, doc = _tokens(raw, at)
    n = len(at) - 1
    edge = np.searchsorted(doc, np.arange(n + 1))
    out = np.zeros((n, POOLED), np.float32)
    some = np.flatnonzero(edge[1:] > edge[:-1])
    if len(some):
        v = vectors[word]
        count = (edge[some + 1] - edge[some])[:, None]
        out[some, :DIM] = np.add.reduceat(v, edge[some]) / count
        out[some, DIM : 2 * DIM] = np.add.reduceat(v * v, edge[some]) / count
        pairs = np.zeros_like(v)
        pairs[:-1] = v[:-1] * v[1:] * (doc[:-1] == doc[1:])[:, None]
        out[some, 2 * DIM :] = np.add.reduceat(pairs, edge[some]) / np.maximum(count - 1, 1)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss; every fifth row fits the temperature only. Without rows every score is 0.5."""
    rng = np.random.default_rng(SEED)
    d = x.shape[1]
    net = Network(np.zeros(d), np.ones(d), rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    if len(x) < 5:
        return net
    rest = np.arange(len(x)) % 5 == 4
    fx, fy = x[~rest].astype(float), y[~rest].astype(float)
    net.mean, net.scale = fx.mean(0), fx.std(0) + 1e-4
    net.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN)
    names, step = ("w1", "b1", "w2", "b2"), 0
    m, v = ({k: np.zeros_like(np.asarray(getattr(net, k), float)) for k in names} for _ in range(2))
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(fx)), max(1, len(fx) // 128)):
            z = (fx[rows] - net.mean) / net.scale
            h = np.maximum(z @ net.w1 + net.b1, 0)
            g = (1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -50, 50))) - fy[rows]) / len(rows)
            gh = np.outer(g, net.w2) * (h > 0)
            grad = {"w1": z.T @ gh + 1e-4 * net.w1, "b1": gh.sum(0), "w2": h.T @ g + 1e-4 * net.w2, "b2": np.asarray(g.sum())}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                setattr(net, k, getattr(net, k) - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
    logit, ry = net.logit(x[rest].astype(float)), y[rest].astype(float)
    grid = np.exp(np.linspace(np.log(0.25), np.log(16), 80))
    loss = [np.mean(np.logaddexp(0, logit / t) - ry * logit / t) for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def features(docs: DataFrame, vectors) -> DataFrame:
    """(doc_id, pooled) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in pieces(batch, "text"):
                x = pool(raw, at, vectors.value)
                yield pa.RecordBatch.from_pydict({"doc_id": rows.column(0), "pooled": pa.array([r.tobytes() for r in x], pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, pooled binary")


def drawn(labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, y): about TRAIN_ROWS labelled documents that aren't held out, drawn by a hash of the id, and so few that they
    may be broadcast. A document that is labelled twice has the lower label."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30))
    return known.where(draw < F.lit(int((1 << 30) * min(1.0, TRAIN_ROWS / max(1, n)))))


def train(pooled: DataFrame, known: DataFrame) -> Network:
    """A network from the rows of pooled that known (drawn()) has; these come to the driver."""
    rows = sorted((r[0], bytes(r[1]), r[2]) for r in pooled.join(F.broadcast(known), "doc_id").select("doc_id", "pooled", "y").collect())
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float32).reshape(-1, POOLED)
    return fit(x, np.array([r[2] for r in rows], float))


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) of each row of docs (doc_id, text): the calibrated probability of label 1.

    Null and empty texts pool zeros and are scored like any other; rows that repeat are scored alike; labels of unknown
    or repeated documents are harmless; without labels all scores are 0.5. Other columns are not read.
    """
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    pooled = stored(spark, features(docs, vectors))
    net = spark.sparkContext.broadcast(train(pooled, drawn(labels)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, POOLED)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(net.value.score(x.astype(float)))})

    return pooled.select("doc_id", "pooled").mapInArrow(run, "doc_id long, score double")


def keep(spark: SparkSession, docs: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """The rows of docs that score least or more, with all their columns; no row leaves its partition."""
    vectors = spark.sparkContext.broadcast(word_vectors(docs))
    known = stored(spark, drawn(labels))
    some = known.select(F.col("doc_id").alias("l_doc_id"))
    pooled = features(docs.join(F.broadcast(some), docs["doc_id"] == some["l_doc_id"], "left_semi"), vectors)
    net = spark.sparkContext.broadcast(train(pooled, known))
    drop(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, at in pieces(batch, "text"):
                yield rows.filter(pa.array(net.value.score(pool(raw, at, vectors.value).astype(float)) >= least))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settled(spark, lambda: score(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
