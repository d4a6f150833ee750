"""Approximate nearest neighbours by multi-index hashing over learned binary codes.

Codes: three rotations of the centred vectors, learned on a bounded sample by iterative quantisation (alternate between signs
and the rotation that fits them best), give 3 x dimension bits. A radius is learned with them: the Hamming distance within which
``TARGET`` of the sample's true neighbours lie. A code within the radius of a query agrees, in at least one of m substrings, up to
radius // m bits (pigeonhole). Each block of rows keeps one table per substring (value -> rows); a query probes the
values that occur in the table within that many bits, the rows found are tested on the whole code, and what lies within the
radius is ranked by exact inner products of the original vectors.

Queries come in blocks of fixed size that are sent to all tasks; every index row is a candidate of every query. Equal
vectors are one point that keeps its smallest ids, as many as an answer can use, so a vector that many rows share costs one row.
A query that has not found enough within the radius asks again with a larger one, at last with all codes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from highwater.llm.common import Scratch, small_batches

SAMPLE = 8192  # rows that rotations and radius are learned on
QUERY_BLOCK = 4096  # distinct query vectors that one pass sends to the tasks
INDEX_BLOCK = 8192  # rows that share substring tables
ROTATIONS, ROUNDS, TARGET, SUB = 3, 12, 0.95, 16
BITS16 = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


class Codes:
    """Centre, rotations and radius."""

    def __init__(self, x: np.ndarray, k: int, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.dim = x.shape[1]
        unit = self._unit(x)
        self.mean = unit.mean(0)
        z = unit - self.mean
        rotations = []
        for _ in range(ROTATIONS):
            r = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
            for _ in range(ROUNDS):
                u, _, v = np.linalg.svd(np.where(z @ r > 0, 1.0, -1.0).T @ z)
                r = (u @ v).T
            rotations.append(r)
        self.rotation = np.hstack(rotations)
        self.n_bits = -(-self.rotation.shape[1] // SUB) * SUB
        self.radius = self._radius(x, k) if len(x) > 1 else self.n_bits

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of 16-bit substrings."""
        bits = (self._unit(x) - self.mean) @ self.rotation > 0
        if bits.shape[1] < self.n_bits:
            bits = np.hstack([bits, np.zeros((len(x), self.n_bits - bits.shape[1]), bool)])
        return np.packbits(bits, axis=1).view(np.uint16)

    def _radius(self, x: np.ndarray, k: int) -> int:
        asked = x[:512]
        near = np.argsort(-(asked @ x.T), axis=1)[:, 1:k + 1]
        codes = self.of(x)
        far = [BITS16[codes[i] ^ codes[n]].sum(1) for i, n in enumerate(near)]
        return int(np.quantile(np.concatenate(far), TARGET))


class Tables:
    """The substring tables of one block of rows."""

    def __init__(self, codes: np.ndarray):
        wide = np.uint64 if codes.shape[1] % 4 == 0 else np.uint16  # whole codes are tested four substrings at a time
        self.codes, self.words, self.sub = codes, np.ascontiguousarray(codes.view(wide).T), []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, first = np.unique(codes[order, j], return_index=True)
            self.sub.append((order, values, np.r_[first, len(order)]))

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes lie within the radius: probe each table, then test whole codes."""
        reach = radius // len(self.sub)
        near = np.zeros(len(self.codes), bool)
        for q, (order, values, first) in zip(query, self.sub, strict=True):
            hit = np.bitwise_count(values ^ q) <= reach
            if hit.all():
                near[:] = True
                break
            if len(values) == len(order):
                near[order[hit]] = True
            else:
                near[order[np.repeat(hit, np.diff(first))]] = True
        rows = np.flatnonzero(near)
        words, q = self.words, query.view(self.words.dtype)
        if len(rows) == len(near):
            rows, far = np.arange(len(near)), sum(np.bitwise_count(words[j] ^ q[j]).astype(np.uint16) for j in range(len(q)))
        else:
            far = sum(np.bitwise_count(words[j][rows] ^ q[j]).astype(np.uint16) for j in range(len(q)))
        return rows[far <= radius]


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(embeddings: DataFrame, k: int = 20, every: int = 20, sample: int = SAMPLE, query_block: int = QUERY_BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose vec_id divides by ``every`` the k largest inner products found among
    all other rows, ties to the smaller vec_id; all candidates if there are fewer than k.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers take no part, nor do rows without vec_id; of
    repeated ids with one vector one row counts. Vectors of another length than the commonest take no part. Extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    s = scratch or Scratch(spark)
    v = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null").where(_usable(F.col("v")))
    dim = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    key = {"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}
    rows = s.table(rows.where(F.size("v") == dim["d"]).withColumns(key).distinct(), "rows")
    # equal vectors as one point with its k + 1 smallest ids, in two steps so that no task holds all copies
    w = Window.partitionBy("h1", "h2", "salt").orderBy("vec_id")
    part = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    points = part.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.slice(F.array_sort(F.collect_list("vec_id")), 1, k + 1).alias("ids"))
    total = rows.select("vec_id").distinct().count()
    points = s.table(points.repartition(max(6, total // INDEX_BLOCK)), "points")

    fit = points.orderBy("h1", "h2").limit(sample).select("v").toPandas()
    codes = spark.sparkContext.broadcast(Codes(np.array(fit["v"].tolist(), np.float64), k))
    own = rows.where(F.col("vec_id") % every == 0)
    asked = s.table(own.select("h1", "h2", "v").dropDuplicates(["h1", "h2"]), "asked")
    blocks = -(-asked.count() // query_block)
    answers = None
    for i in range(blocks):
        q = asked.where(F.pmod(F.xxhash64("h1", "h2"), F.lit(blocks)) == i).toPandas()
        todo, reach, step = np.arange(len(q)), codes.value.radius, 0
        vectors = np.array(q["v"].tolist(), np.float64).reshape(len(q), dim["d"])
        names = spark.createDataFrame(q[["h1", "h2"]].assign(qi=np.arange(len(q))), "h1 long, h2 long, qi int") if len(q) else None
        while len(todo):
            block = spark.sparkContext.broadcast((todo, vectors[todo]))
            found = s.table(_best(points.mapInArrow(_search(codes, block, reach, k), "qi int, score double, ids array<long>"), k), f"found_{i}_{step}")
            n = dict(found.groupBy("qi").count().collect())
            enough = np.array([n.get(int(j), 0) >= min(k + 1, total) or reach >= codes.value.n_bits for j in todo])
            done = spark.createDataFrame([(int(j),) for j in todo[enough]], "qi int")
            part = found.join(done, "qi", "left_semi").join(names, "qi").drop("qi")
            answers = part if answers is None else answers.unionByName(part)
            todo, reach, step = todo[~enough], min(codes.value.n_bits, reach + max(8, reach // 2)), step + 1
    if answers is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = own.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(answers, ["h1", "h2"]).where("query_id != vec_id")
    return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).select(
        "query_id", F.row_number().over(place).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _search(codes, block, reach: int, k: int):
    def run(batches):
        ids, vectors = [], []

        def answer():
            x = np.concatenate(vectors)
            first = np.array([i[0] for i in ids])
            tables = Tables(codes.value.of(x))
            which, score, got = [], [], []
            for qi, q, code in zip(block.value[0], block.value[1], codes.value.of(block.value[1]), strict=True):
                near = tables.within(code, reach)
                z = x[near] @ q
                for j in np.lexsort((first[near], -z))[:k + 1]:
                    which.append(qi)
                    score.append(z[j])
                    got.append(ids[near[j]])
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(score, pa.float64()), pa.array(got, pa.list_(pa.int64()))], ["qi", "score", "ids"])

        for b in batches:
            ids += b["ids"].to_pylist()
            vectors.append(b["v"].flatten().to_numpy().reshape(len(b), -1))
            if len(ids) >= INDEX_BLOCK:
                yield answer()
                ids, vectors = [], []
        if ids:
            yield answer()
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k + 1 best rows of each query over all blocks."""
    w = Window.partitionBy("qi").orderBy(F.desc("score"), "vec_id")
    rows = found.select("qi", "score", F.explode("ids").alias("vec_id"))
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
