"""What the two document classifiers share: folds, a bounded sample of labelled rows, words of a text."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from highwater.llm.common import BYTE, FOLDED, slices, span_hash

LETTER, DIGIT, SIGN = 1, 2, 3
CLASS = np.full(256, SIGN, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = CLASS[128:] = LETTER


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold that no label is learned from. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def label_sample(labels: DataFrame, column: str, folds: int, fold: int, limit: int) -> DataFrame:
    """(doc_id, label): at most ``limit`` labelled ids outside the held-out fold, by hash order. Ids whose rows disagree and
    null labels are left out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    rows = rows.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("high"))
    return rows.where("label = high").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def doc_terms(col: pa.Array, fold_case: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of the terms, where each row's terms start and end). A term is a run of letters (any byte above
    ASCII counts as one), of digits or of other visible characters."""
    for first, off, data in slices(col):
        kind = np.r_[CLASS[data], np.uint8(0)]
        change = np.ones(len(kind), bool)
        change[1:] = kind[1:] != kind[:-1]
        change[off] = True
        edge = np.flatnonzero(change)
        start, end = edge[:-1], edge[1:]
        seen = kind[start] > 0
        start, end = start[seen], end[seen]
        h = span_hash(data, start, end, FOLDED if fold_case else BYTE) if len(start) else np.zeros(0, np.uint64)
        yield first, h, np.searchsorted(start, off)
