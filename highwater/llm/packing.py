"""Best-fit packing of token sequences, in rounds over a tree of partitions.

Each task encodes its documents, cuts longer ones and packs the pieces by best fit, longest first. Bins that are nearly
full are final; the others go up the tree as items of their own, where the bins of several partitions are packed again,
until one part is left. After a best-fit pass at most one bin of a group is half empty, and two bins that are over half
full never share a sequence; so a group's emptiest bins are the ones that find a place above. All open bins go up: the
``CARRY`` emptiest of a group in its first lane, the next in the lane behind it and so on. Lanes of one number are packed
together, so no group grows beyond ``FAN * CARRY`` bins and none is left out.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from highwater.llm.common import Scratch, small_batches, texts
from highwater.llm.encoders import encoder

ROOM = 1 << 16  # pieces that a task packs at once
CARRY = 4096
FAN = 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long, lane long"


def best_fit(lengths, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Longest first into the bin that it fills best. Returns each item's bin and offset, and each bin's fill."""
    where, at, fills = [0] * len(lengths), [0] * len(lengths), []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: a bin with room r is open
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        where[i], at[i] = b, fills[b]
        fills[b] += n
        left = room - n
        if left:
            open_bins[left].append(b)
            rooms |= 1 << left
    return where, at, fills


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every document and its place.

    A document is its ids and ``end_id``; only longer ones are cut, every ``capacity`` ids. A null text is empty and so
    one piece of one id. Rows without doc_id and repeated rows are packed like others; extra columns are ignored; an empty
    table packs nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    s = scratch or Scratch(spark)
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    pieces = s.table(rows.mapInArrow(_local(tokenizer_path, end_id, capacity), PIECES), "pieces")
    near = capacity - max(1, capacity // 256)
    level = pieces.where(F.col("at") == 0).where(F.col("fill") <= near).select("bin", "fill", F.shiftright("bin", 32).alias("part"), "lane")
    moves, n, parts = [], 0, level.agg(F.max("part")).first()[0] or 0
    while level is not None and (parts > 0 or not n):
        level = level.withColumn("part", F.floor(F.col("part") / FAN).cast("long"))
        parts //= FAN
        moved = s.table(level.groupBy("part", "lane").applyInPandas(_merge(capacity, near), "bin long, into long, shift long, part long, lane long, fill long, goes_up boolean"), f"level{n}")
        moves.append(moved.where("bin != into").select("bin", "into", "shift"))
        level = moved.where("goes_up").where("bin = into").select("bin", "fill", "part", "lane")
        n += 1
    if not moves:
        return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), F.col("at").alias("offset"))

    def after(low: DataFrame, high: DataFrame) -> DataFrame:
        """Moves of two rounds as one: a bin moved below is carried along by the bin it lies in."""
        up = high.select(F.col("bin").alias("into"), F.col("into").alias("top"), F.col("shift").alias("more"))
        carried = low.join(up, "into", "left").select("bin", F.coalesce("top", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        return carried.unionByName(high)

    return pieces.join(reduce(after, moves), "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"))


def _local(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), int(end_id).to_bytes(4, "little")
        base, rows = TaskContext.get().partitionId() << 32, []
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                ids = memoryview(enc.encode(text.as_py()) + end)
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a:a + 4 * capacity]
                    rows.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= ROOM:
                out, base = packed(rows, base, capacity)
                rows = []
                yield out
        if rows:
            yield packed(rows, base, capacity)[0]
    return run


def packed(rows: list[tuple], base: int, capacity: int) -> tuple[pa.RecordBatch, int]:
    where, at, fills = best_fit([r[3] for r in rows], capacity)
    lane = [0] * len(fills)
    for k, b in enumerate(sorted(range(len(fills)), key=fills.__getitem__)):
        lane[b] = k // CARRY
    cols = [*zip(*rows, strict=True), [base + b for b in where], at, [fills[b] for b in where], [lane[b] for b in where]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.int64()) for i, c in enumerate(cols)], [c.split(" ")[0] for c in PIECES.split(", ")]), base + len(fills)


def _merge(capacity: int, near: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["fill", "bin"], ascending=[False, True])  # the same whatever order rows arrive in
        where, shift, fills = best_fit(group["fill"].tolist(), capacity)
        bins = group["bin"].to_numpy()
        first = np.zeros(len(fills), np.int64)
        for i in range(len(bins) - 1, -1, -1):
            if shift[i] == 0:
                first[where[i]] = bins[i]
        fill = np.array([fills[b] for b in where])
        own = pd.Series(np.array(shift) == 0)
        order = pd.Series(np.where(own, fill, capacity + 1)).rank(method="first").to_numpy().astype(np.int64) - 1
        lane = group["lane"].to_numpy() * FAN + order // CARRY
        return pd.DataFrame({"bin": bins, "into": first[where], "shift": shift, "part": group["part"].to_numpy(), "lane": lane, "fill": fill,
                             "goes_up": (own & (fill <= near)).to_numpy()})
    return run
