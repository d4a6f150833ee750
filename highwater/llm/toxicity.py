"""Toxicity scores by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the distinct cells of a text's terms: a pair such as an insult
and a group's name may weigh more, or less, than its parts. Every case-folded term of the training sample is hashed into
one of 2^18 cells with a weight and factors; none is screened out by what it tells alone, as a pair may tell more than
both its words. Cells that the sample does not fill weigh nothing. Documents are scored in one pass.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from highwater.llm.common import Scratch, small_batches, texts
from highwater.llm.labelled import doc_terms, held_out, label_sample

SAMPLE = 20_000
CELL_BITS, FACTORS = 18, 8
STEPS, RATE, BATCH = 100, 0.1, 1 << 18  # BATCH: filled cells handled at once
LASSO_W, LASSO_V, RIDGE = 3.0, 4.0, 0.1  # of the summed loss, so a larger sample is held back less


class Machine:
    """Weights of all cells, fitted on the whole sample by Adam steps with a lasso on weights and factors: a cell leaves zero if its
    rows together, given all other cells, err by more than the lasso, so single rows are not learned by heart. What left
    zero is then fitted again without the lasso, which holds large weights back too."""

    def __init__(self, rows: list[np.ndarray], y: np.ndarray, seed: int = 3):
        self.w0 = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
        self.w, self.v = np.zeros(1 << CELL_BITS, np.float32), np.zeros((1 << CELL_BITS, FACTORS), np.float32)
        ends, cells = np.cumsum([0] + [len(r) for r in rows]), np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
        if not ends[-1] or not 0 < y.sum() < len(y):
            return
        spread = 0.3 / np.sqrt(ends[-1] / len(y))  # so the pairs of a row start small together
        filled = np.unique(cells)
        self.v[filled] = np.random.default_rng(seed).normal(0, spread, (len(filled), FACTORS))
        self._fit(cells, ends, y, True)
        left = (self.w != 0) | self.v.any(1)
        keep = left[cells]
        if keep.any():
            self._fit(cells[keep], np.r_[0, np.cumsum(keep)][ends], y, False)

    def _fit(self, cells: np.ndarray, ends: np.ndarray, y: np.ndarray, lasso: bool) -> None:
        filled, item = np.unique(cells, return_inverse=True)
        item, n = item.astype(np.int32), len(filled)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(BATCH, ends[-1], BATCH)), len(y)])
        runs = [self._run(item[ends[a]:ends[b]], ends[a:b + 1] - ends[a], y[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        p = np.r_[np.float32(self.w0), self.w[filled], self.v[filled].ravel()]
        free = p != 0 if not lasso else np.ones(len(p), bool)
        pull = np.r_[np.float32(0), np.full(n, LASSO_W, np.float32), np.full(n * FACTORS, LASSO_V, np.float32)] * lasso
        m, s = np.zeros_like(p), np.zeros_like(p)
        for t in range(1, STEPS + 1):
            g = self._slopes(p, n, runs)
            g[1:] += np.float32(RIDGE) * p[1:]
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            step = RATE * min(1.0, 2 * (1 - t / (STEPS + 1))) / (np.sqrt(s / (1 - 0.99 ** t)) + 1e-6)
            p = p - step * (m / (1 - 0.9 ** t))
            p = (np.sign(p) * np.maximum(np.abs(p) - step * pull, 0) * free).astype(np.float32)
        self.w0, self.w[filled], self.v[filled] = float(p[0]), p[1:n + 1], p[n + 1:].reshape(n, FACTORS)

    @staticmethod
    def _run(item: np.ndarray, ends: np.ndarray, y: np.ndarray):
        """Rows in order, and their entries by cell: both sums are then over neighbours."""
        doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(ends))
        by = np.argsort(item, kind="stable")
        own, first = np.unique(item[by], return_index=True)
        return item, ends, y, doc[by], own, first

    @staticmethod
    def _slopes(p: np.ndarray, n: int, runs: list) -> np.ndarray:
        w, v, g = p[1:n + 1], p[n + 1:].reshape(n, FACTORS), np.zeros_like(p)
        gw, gv = g[1:n + 1], g[n + 1:].reshape(n, FACTORS)
        for item, ends, y, doc, own, first in runs:
            total, z = _sums(float(p[0]), w, v, item, ends)
            d = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y).astype(np.float32)
            g[0] += d.sum()
            alone = np.add.reduceat(d[doc], first)
            gw[own] += alone
            gv[own] += np.add.reduceat((d[:, None] * total)[doc], first) - alone[:, None] * v[own]
        return g

    def scores(self, cells: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of rows whose cells lie between neighbouring ends."""
        z = _sums(self.w0, self.w, self.v, cells, ends)[1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sums(w0: float, w: np.ndarray, v: np.ndarray, item: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the sum of its factors, and the machine's value."""
    total, alone = np.zeros((len(ends) - 1, v.shape[1]), v.dtype), np.zeros(len(ends) - 1)
    some = np.flatnonzero(np.diff(ends))
    if len(some):
        total[some] = np.add.reduceat(v[item], ends[some])
        alone[some] = np.add.reduceat((w - 0.5 * (v ** 2).sum(1))[item].astype(np.float64), ends[some])
    return total, w0 + alone + 0.5 * (total.astype(np.float64) ** 2).sum(1)


def _cells(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distinct cells of each row's terms, where each row's cells start and end)."""
    for first, h, at in doc_terms(text, fold_case=True):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        both = np.unique(row << CELL_BITS | (h >> np.uint64(64 - CELL_BITS)).astype(np.int64))
        yield first, both & (1 << CELL_BITS) - 1, np.searchsorted(both, np.arange(len(at)) << CELL_BITS)


def _sample_cells(batches):
    for b in batches:
        out = [None] * len(b)
        for first, cells, ends in _cells(b["text"]):
            for i in range(len(ends) - 1):
                out[first + i] = cells[ends[i]:ends[i + 1]].astype("<i4").tobytes()
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["label"], pa.array(out, pa.binary())], ["doc_id", "label", "cells"])


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1, cut: float = 0.7, sample: int = SAMPLE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of ``docs``; labels: (doc_id, toxic).

    Only text is scored, whole; a text without known terms, so also a null or empty one, gets the machine's intercept.
    Repeated rows get equal scores and teach once (of different texts under one doc_id the one whose cells sort first);
    rows without doc_id are scored and not held out. Labels without a document, null or
    contradictory labels are not learned from; with labels of one kind only, scores are the intercept (0.5 without labels).
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    s = scratch or Scratch(spark)
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    ids = label_sample(labels, "toxic", folds, fold, sample)
    known = rows.join(F.broadcast(ids), "doc_id").mapInArrow(_sample_cells, "doc_id long, label int, cells binary")
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("cells").alias("cells"))  # one row an id, so at most ``sample``
    fitted = s.table(known, "sample").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    machine = Machine([np.frombuffer(x, "<i4") for x in fitted["cells"]], fitted["label"].to_numpy(np.float64))
    shared = spark.sparkContext.broadcast(machine)

    def run(batches):
        for b in batches:
            score = np.zeros(len(b))
            for first, cells, ends in _cells(b["text"]):
                score[first:first + len(ends) - 1] = shared.value.scores(cells, ends)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score)], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
