"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, a calibrated temperature.

Every term has a sparse random index vector, derived from its hash. One pass over the corpus adds to each term's row the
index vectors of its left and right neighbours; the table has a fixed number of rows (terms share rows by hash), so a
task sends a few MB whatever it read. A document is the mean of its terms' vectors, its length and how it repeats itself.
Labels are learned from a bounded sample; everything else covers all rows and whole texts.
"""
from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from highwater.llm.common import Scratch, mix, small_batches, texts
from highwater.llm.labelled import doc_terms, held_out, label_sample

ROWS, DIMS, MARKS = 1 << 14, 32, 4
SAMPLE = 20_000
HIDDEN, EPOCHS, BATCH = 24, 60, 256
U = np.uint64


def _row(h: np.ndarray) -> np.ndarray:
    return (h & U(ROWS - 1)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For each row, the places and signs of its index vector's marks."""
    bits = mix(np.arange(ROWS * MARKS, dtype=U), 77).reshape(ROWS, MARKS)
    return (bits & U(DIMS - 1)).astype(np.int64), np.where(bits >> U(63), 1, -1).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The table of summed neighbour vectors, centred, rows of length 1."""
    def run(batches):
        places, signs = index_vectors()
        table = np.zeros(ROWS * DIMS)
        for b in batches:
            for _, h, at in doc_terms(b["text"], fold_case=False):
                w = _row(h)
                if len(w) < 2:
                    continue
                inner = np.ones(len(w) - 1, bool)
                cuts = at[1:-1]
                inner[cuts[(cuts > 0) & (cuts < len(w))] - 1] = False
                left, right = w[:-1][inner], w[1:][inner]
                for j in range(MARKS):
                    table += np.bincount(left * DIMS + places[right, j], signs[right, j], ROWS * DIMS)
                    table += np.bincount(right * DIMS + (places[left, j] + DIMS // 2) % DIMS, signs[left, j], ROWS * DIMS)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(table.astype(np.int64).tobytes(), 1)], pa.binary())], ["t"])

    def add(batches):
        total = np.zeros(ROWS * DIMS, np.int64)
        for b in batches:
            for x in b["t"]:
                total += np.frombuffer(zlib.decompress(x.as_buffer()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], ["t"])

    total = np.zeros(ROWS * DIMS)
    for r in docs.select("text").mapInArrow(run, "t binary").coalesce(24).mapInArrow(add, "t binary").toLocalIterator():
        total += np.frombuffer(zlib.decompress(r["t"]), np.int64)
    table = total.reshape(ROWS, DIMS)
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1)
    return (table - table.mean(0)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, x): mean word vector, its length, log of the number of terms, share of distinct terms, share of the commonest term."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        for b in batches:
            x = np.zeros((len(b), DIMS + 4), np.float32)
            for first, h, at in doc_terms(b["text"], fold_case=False):
                w = _row(h)
                for i in range(len(at) - 1):
                    own = w[at[i]:at[i + 1]]
                    if len(own):
                        kinds, n = np.unique(own, return_counts=True)
                        mean = n.astype(np.float32) @ shared.value[kinds] / len(own)
                        x[first + i] = [*mean, np.sqrt(mean @ mean), np.log1p(len(own)), len(kinds) / len(own), n.max() / len(own)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], flat], ["doc_id", "x"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


class Network:
    """Two layers with Adam; a temperature fitted on the fifth of the sample that the weights did not see."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.share = float(y.mean()) if len(y) else 0.5
        self.one = len(np.unique(y)) < 2
        if self.one:
            return
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        order = rng.permutation(len(x))
        test, fit = order[:len(x) // 5], order[len(x) // 5:]
        z = (x - self.mean) / self.spread
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for epoch in range(EPOCHS):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // BATCH)):
                a = np.tanh(z[part] @ self.p[0] + self.p[1])
                d = (1 / (1 + np.exp(-(a @ self.p[2] + self.p[3][0]))) - y[part]) / len(part)
                back = np.outer(d, self.p[2]) * (1 - a * a)
                grads = [z[part].T @ back + 1e-4 * self.p[0], back.sum(0), a.T @ d + 1e-4 * self.p[2], np.array([d.sum()])]
                t += 1
                rate = 0.01 * (1 - epoch / EPOCHS) + 1e-4
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        out, target = self.raw(x[test]), y[test]
        heat = np.geomspace(0.5, 8, 60)
        loss = [np.logaddexp(0, np.where(target == 1, -out, out) / k).mean() if len(out) else 0 for k in heat]
        self.temperature = float(heat[int(np.argmin(loss))]) if len(out) else 1.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.spread @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share) if self.one else 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -500, 500)))


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2, cut: float = 0.7, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; labels: (doc_id, quality).

    Only text is scored; a null or empty text has zero vectors and gets whatever the network gives them. Repeated rows get
    equal scores, rows without doc_id are scored and not held out. Labels without a document, null or contradictory labels
    are not learned from. Without labels of both kinds every score is the share of label 1 (0.5 without labels). Extra
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    s = scratch or Scratch(spark)
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    features = s.table(pooled(rows, word_vectors(rows)), "features")
    known = features.join(F.broadcast(label_sample(labels, "quality", folds, fold, sample)), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").limit(sample).toPandas()
    x = np.array(known["x"].tolist(), np.float64).reshape(len(known), DIMS + 4)
    net = spark.sparkContext.broadcast(Network(x, known["label"].to_numpy(np.float64)))

    def run(batches):
        for b in batches:
            x = b["x"].flatten().to_numpy().astype(np.float64).reshape(len(b), DIMS + 4)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(net.value.score(x))], ["doc_id", "score"])

    return features.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without those predicted to be of low quality; rows without doc_id stay."""
    bad = quality_scores(docs, labels).where("predicted = 0 and doc_id is not null").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
