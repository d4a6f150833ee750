"""What several operators share: scratch tables, byte-level words and shingles, fixed-size hashing.

Words are read from the UTF-8 bytes that Arrow hands over; nothing is decoded. A word's hash is a polynomial over its
bytes, taken from one running sum, so a batch costs a few numpy passes whatever its words look like.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from highwater.session import cut_lineage

SLICE = 1 << 21  # bytes of text handled at once, unless one text is longer
U = np.uint64


class Scratch:
    """Tables of one run, written to the folder that the cluster names in ``spark.checkpoint.dir``."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            cut_lineage(spark.range(1))  # sets a folder for local sessions, raises on a cluster
            base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        self.spark, self.path = spark, f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.read(name, df.schema)

    def read(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2,000 rows, so long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def texts(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns and ``text`` as a string that is never null."""
    return docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """SplitMix64's finaliser; another seed gives another permutation of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x + U((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


BASE = 0x9E3779B97F4A7C55 | 1
BYTE = mix(np.arange(256, dtype=U), 11)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.r_[U(1), np.full(max(n, SLICE), U(v))]) for v in (BASE, _inverse(BASE))]
    return _powers[0], _powers[1]


def slices(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, byte offsets of the rows, bytes) for runs of rows of about SLICE bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type):
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    else:
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(off, off[row] + SLICE, "right")) - 1)
        yield row, off[row:end + 1] - off[row], data[off[row]:off[end]]
        row = end


def word_spans(data: np.ndarray, off: np.ndarray, gap: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a row's end also ends a word."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~gap[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.r_[False, inside[:-1]] & ~cut
    start = np.flatnonzero(inside & ~before)
    stop = np.zeros(len(data) + 1, bool)
    stop[1:] = inside[:-1] & (~inside[1:] | cut[1:])
    return start, np.flatnonzero(stop)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
    """A 64-bit hash of each span's bytes."""
    up, down = _power_tables(len(data))
    with np.errstate(over="ignore"):
        run = np.r_[U(0), np.cumsum(table[data] * up[:len(data)])]
        return mix((run[end] - run[start]) * down[start])


def doc_shingles(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct hashes of its k-word shingles). A shorter text is one shingle; one without words has none."""
    for first, off, data in slices(col):
        start, end = word_spans(data, off)
        w = span_hash(data, start, end)
        at = np.searchsorted(start, off)
        with np.errstate(over="ignore"):
            run = w.copy()
            for j in range(1, k):
                run[:len(w) - j] = run[:len(w) - j] * U(0xD6E8FEB86659FD93) + w[j:]
        run = mix(run, k)
        for i in range(len(off) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield first + i, np.unique(run[a:b - k + 1])
            elif b > a:
                yield first + i, short_shingle(w[a:b])
            else:
                yield first + i, run[:0]


def short_shingle(w: np.ndarray) -> np.ndarray:
    h = U(len(w))
    with np.errstate(over="ignore"):
        for x in w:
            h = mix(np.array([h * U(0xD6E8FEB86659FD93) + x]), 97)[0]
    return np.array([h])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
