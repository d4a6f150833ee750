"""Token-id files: ids of all documents one after another, document boundaries in Elias-Fano form.

A file is a run of blocks in ascending doc_id order. A block holds whole documents: two Elias-Fano sequences (where
documents end, and their ids) and the token ids, 2 bytes each if the vocabulary allows, else 4. Elias-Fano keeps n sorted
numbers below u in about n * (2 + log2(u / n)) bits; a sample of every 256th set bit makes ``select`` a short scan, so no
64-bit offset table exists anywhere. Blocks travel in Parquet rows, so any store that Spark writes to can hold them and
the writer's commit protects against lost executors.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from highwater.llm.common import small_batches, texts
from highwater.llm.encoders import encoder

SAMPLE = 256
BLOCK_TOKENS = 1 << 20
ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)
FILE_SCHEMA = "shard int, start_in_shard long, n_tokens long, n_docs long, no_id long, header binary, ids binary"


class EliasFano:
    """A sorted sequence of integers of at least 0."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        low_bits = max(0, int(int(v[-1]) // max(n, 1)).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
        at = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        marks[at] = 1
        return cls(n, low_bits, np.packbits(bits.ravel(), bitorder="little"), np.packbits(marks, bitorder="little"), at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, pos: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data, pos)
        pos += 25
        s = -(-n // SAMPLE)
        low, high = np.frombuffer(data, np.uint8, a, pos), np.frombuffer(data, np.uint8, b, pos + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", s, pos + a + b)), pos + a + b + 4 * s

    def _low(self, i: int) -> int:
        first, shift = divmod(i * self.low_bits, 8)
        chunk = int.from_bytes(self.low[first:first + (shift + self.low_bits + 7) // 8].tobytes(), "little")
        return chunk >> shift & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number: from the nearest sample over whole bytes to the byte that holds the i-th set bit."""
        bit = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte, value = bit >> 3, int(self.high[bit >> 3]) >> (bit & 7) << (bit & 7)
        while left >= ONES[value]:
            left -= int(ONES[value])
            byte += 1
            value = int(self.high[byte])
        for _ in range(left):
            value &= value - 1
        place = 8 * byte + (value & -value).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        """All numbers at once."""
        if not self.n:
            return np.zeros(0, np.int64)
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits).astype(np.int64)
        return (at << self.low_bits) + (low << np.arange(self.low_bits)).sum(1)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, wide: bool | None = None) -> None:
    """Encode every whole text (null: empty), append ``end_id`` to each and write blocks in ascending doc_id order.

    Rows without doc_id come first; repeated ids stay in one run (equal ids may lie in several shards); an empty text is
    just its end id. Extra columns are ignored. An empty table writes no block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    rows.select("doc_id", "text").mapInArrow(_blocks(tokenizer_path, end_id, wide), FILE_SCHEMA).write.parquet(path)


def _blocks(tokenizer_path: str, end_id: int, wide: bool | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        four = wide if wide is not None else max(enc.tokenizer.get_vocab_size(True) - 1, end_id) > 0xFFFF
        end = struct.pack("<I", end_id)
        shard, start = TaskContext.get().partitionId(), 0
        ids, parts, size = [], [], 0

        def block():
            ends = np.cumsum([len(p) // 4 for p in parts])
            known = np.array([i for i in ids if i is not None], np.int64)
            base = int(known[0]) if len(known) else 0
            head = struct.pack("<4sBq", b"EFT1", 4 if four else 2, base) + EliasFano.build(np.r_[0, ends]).to_bytes() + EliasFano.build(known - base).to_bytes()
            data = np.frombuffer(b"".join(parts), "<u4")
            data = data if four else data.astype("<u2")
            values = [shard, start, int(ends[-1]), len(ids), len(ids) - len(known), head, data.tobytes()]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split(" ")[0] for c in FILE_SCHEMA.split(", ")])

        for b in batches:
            for i, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                p = enc.encode(text.as_py()) + end
                ids.append(i)
                parts.append(p)
                size += len(p) // 4
                if size >= BLOCK_TOKENS:
                    yield block()
                    start, size = start + size, 0
                    ids, parts = [], []
        if ids:
            yield block()
    return run


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone.

    ``start`` counts the ids of all documents before it: the totals of earlier shards (one number per shard reaches the
    driver), the block's place in its shard and the boundary inside the block.
    """
    blocks = spark.read.parquet(path)
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect())
    base, at = {}, 0
    for r in totals:
        base[r["shard"]], at = at, at + r["n"]

    def run(batches):
        for b in batches:
            for shard, start, no_id, head, ids in zip(*(b[c] for c in ("shard", "start_in_shard", "no_id", "header", "ids")), strict=True):
                doc, where, length, crc = decode_block(head.as_py(), ids.as_buffer(), no_id.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(where + (base[shard.as_py()] + start.as_py())),
                                                  pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def decode_block(head: bytes, ids, no_id: int) -> tuple[list, np.ndarray, np.ndarray, list[int]]:
    magic, width, base = struct.unpack_from("<4sBq", head)
    if magic != b"EFT1":
        raise ValueError("not a token-id block")
    bounds, pos = EliasFano.from_bytes(head, 13)
    names, _ = EliasFano.from_bytes(head, pos)
    edge = bounds.values()
    data = np.frombuffer(ids, "<u4" if width == 4 else "<u2").astype("<u4")
    crc = [zlib.crc32(data[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return [None] * no_id + (names.values() + base).tolist(), edge[:-1], np.diff(edge), crc
