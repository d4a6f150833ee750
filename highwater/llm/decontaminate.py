"""Benchmark items inside documents: MinHash containment with sketches sized by item length, then exact containment.

An item is short, a document may be long, so their Jaccard similarity says nothing. Sampling the short side does: an item
with q shingles of which at least t percent lie in a document misses at most q - ceil(tq/100) there. Items are parted by
size (classes of doubling length); the sketch of a class is its largest number of misses plus ``EXTRA`` + 1 smallest hashes, and
a document becomes a candidate when it holds all but the item's allowed misses of them. That loses nothing; the exact
count of shared shingles decides. Documents are read once per block of items and never shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from highwater.llm.common import doc_shingles, mix, small_batches, texts

EXTRA = 3
BLOCK_SHINGLES = 1 << 21  # shingles of items that one pass broadcasts, 16 MB
MASK = 20
U = np.uint64


def misses(q: int, percent: int) -> int:
    """How many of q shingles may be absent."""
    return q - (q * percent + 99) // 100


class ItemBlock:
    """Sketches and sets of some items, as plain arrays."""

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int):
        self.ids, self.sets, self.percent = ids, sets, percent
        keys, owner, self.need = [], [], []
        for i, u in enumerate(sets):
            largest = (1 << len(u).bit_length()) - 1  # of the item's size class
            size = min(len(u), misses(largest, percent) + 1 + EXTRA)
            self.need.append(size - misses(len(u), percent))
            keys.append(u[np.argsort(mix(u, 5))[:size]])
            owner.append(np.full(size, i))
        key, owner = np.concatenate(keys), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.need = key[order], owner[order], np.array(self.need)
        self.mask = np.zeros(1 << MASK, bool)
        self.mask[key >> U(64 - MASK)] = True

    def inside(self, u: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, shared shingles) of the items that the set holds to the wanted share."""
        u = u if not len(u) else u[self.mask[u >> U(64 - MASK)]]
        if not len(u):
            return
        lo, hi = np.searchsorted(self.key, u, "left"), np.searchsorted(self.key, u, "right")
        got = [self.owner[a:b] for a, b in zip(lo, hi, strict=True) if a < b]
        if got:
            n = np.bincount(np.concatenate(got), minlength=len(self.ids))
            yield from np.flatnonzero((n >= self.need) & (n > 0))


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): items of which at least ``percent`` percent lie in a document.

    n_shingles is the item's. Words, case and short texts as in the near-copy join: null and empty texts hold nothing and
    are in nothing; a text of fewer than k words is one shingle. Repeated item rows count once; an item_id with two texts
    is two items; a repeated document is reported for each of its rows. Rows without an id keep null there. Extra columns
    are ignored. No items or no documents: an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    sets = texts(items, F.col("item_id").cast("long").alias("item_id")).distinct().mapInArrow(_item_sets(k), "item_id long, n long, tokens binary").distinct()
    sets = sets.withColumn("h", F.xxhash64("item_id", "tokens")).persist()
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // block_shingles)
    schema = "doc_id long, item_id long, n_shingles long, n_shared long"
    found = spark.createDataFrame([], schema)
    for i in range(blocks):
        part = sets.where(F.pmod("h", F.lit(blocks)) == i).select("item_id", "tokens").collect()
        if part:
            block = spark.sparkContext.broadcast(ItemBlock([r["item_id"] for r in part], [np.frombuffer(r["tokens"], U) for r in part], percent))
            hits = rows.mapInArrow(_search(block, k, percent), schema)
            found = hits if not i else found.unionByName(hits)
    sets.unpersist()
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def _item_sets(k: int):
    def run(batches):
        for b in batches:
            sets = [u for _, u in doc_shingles(b["text"], k)]
            yield pa.RecordBatch.from_arrays([b["item_id"], pa.array([len(u) for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())],
                                             ["item_id", "n", "tokens"]).filter(pa.array([len(u) > 0 for u in sets], pa.bool_()))
    return run


def _search(block, k: int, percent: int):
    def run(batches):
        items = block.value
        for b in batches:
            out = [], [], [], []
            for i, u in doc_shingles(b["text"], k):
                for x in items.inside(u):
                    n, shared = len(items.sets[x]), np.intersect1d(items.sets[x], u, assume_unique=True).size
                    if 100 * shared >= percent * n:
                        for col, v in zip(out, (b["doc_id"][i].as_py(), items.ids[x], n, shared), strict=True):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "item_id", "n_shingles", "n_shared"])
    return run


def without_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without those that hold an item; rows without doc_id stay."""
    hit = contained_items(docs, items, k, percent).where("doc_id is not null").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")
