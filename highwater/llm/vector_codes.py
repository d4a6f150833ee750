"""Product codes of vectors by exact integer k-means over metric trees.

A vector is cut into equal parts and every part has a codebook. Rows are taken in blocks; in each block and part the points
are put in a metric tree once, and the trees are kept as a table. A tree is built middle-out: about sqrt(n) anchors are
chosen farthest first, each taking over the points that are nearer to it (points within half the distance of two anchors
cannot change), anchors are then paired bottom-up into the ball that stays smallest, and an anchor with many points is built
the same way inside. Every ball caches its count and its integer sum.

An assignment walks all trees of a block level by level. A ball inherits the candidate entries of its parent; an entry is
struck off when every point of the ball is strictly nearer to the ball's best entry, which a bound on the linear function
|p-i|^2 - |p-j|^2 over the ball shows. With one candidate left the whole ball is owned: its cached sum and count go to the
entry and its points are not looked at. Points of leaves that stay open are compared with their leaf's candidates in exact
integers, ties to the lower index. Bounds carry a margin above rounding, so they only save work.

Per block a round sends one sum and one count per part and entry; these are added with Spark and the driver holds only the
codebooks.

Defined results. Rows whose vector is null or holds null or non-finite components are dropped. Vectors of each length form
a table of their own (own codebooks); a length that is no multiple of the number of parts is filled up with zeros, which
changes no distance. Equal ids: the start takes them in order of their vectors; a null id sorts after all others. With fewer
rows than entries the codebook has as many entries as rows. Components beyond +-2^23 after scaling (less for thousands of
dimensions) count as that bound, as squares would not fit the long result. Without rows there is no result row. Other
columns are not read.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from highwater.llm.common import Scratch

BLOCK = 2048  # rows that share trees
LEAF = 64     # points that are not split further
SALTS = 16


def _kept(vectors: DataFrame, vec: str) -> DataFrame:
    """vec_id, label, v, n: rows whose vector is all finite."""
    odd = F.exists(F.col(vec), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vec).isNotNull()).where(~odd).select(
        F.col("vec_id").cast("long").alias("vec_id"), "label", F.col(vec).cast("array<double>").alias("v"), F.size(vec).alias("n"))


def _integers(col: pa.Array, n: int, parts: int, scale: int) -> np.ndarray:
    """(rows, parts, width) of floor(scale * x)."""
    width = max(-(-n // parts), 1)
    limit = min(1 << 23, int((2.0 ** 55 / width) ** 0.5) // 2)
    out = np.zeros((len(col), parts * width), np.int64)
    if n:
        flat = np.asarray(col.flatten()).astype(np.float64).reshape(len(col), n)
        with np.errstate(over="ignore"):
            out[:, :n] = np.clip(np.floor(flat * scale), -limit, limit).astype(np.int64)
    return out.reshape(len(col), parts, width)


class Tree:
    """Balls over one set of points. A node covers ``order[lo:hi]``; a leaf has no children (-1)."""

    def __init__(self, points: np.ndarray):
        self.points, self.nodes, self.order = points, [], []  # a node: lo, hi, left, right, sum, centre, radius
        self.float = points.astype(np.float64)
        self.root = self.build(np.arange(len(points)))

    def leaf(self, idx: np.ndarray) -> int:
        lo, total = len(self.order), self.points[idx].sum(0)
        centre = total / len(idx)
        self.order.extend(idx.tolist())
        self.nodes.append((lo, len(self.order), -1, -1, total, centre, float(np.sqrt(((self.float[idx] - centre) ** 2).sum(1).max()))))
        return len(self.nodes) - 1

    def build(self, idx: np.ndarray) -> int:
        if len(idx) <= LEAF:
            return self.leaf(idx)
        owner = anchors(self.float[idx])
        if owner.max() == 0:
            return self.leaf(idx)
        by = np.argsort(owner, kind="stable")
        groups = np.split(idx[by], np.flatnonzero(np.diff(owner[by])) + 1)
        shape = [self.points[g].sum(0) for g in groups]
        counts = np.array([len(g) for g in groups])
        centre = np.array(shape) / counts[:, None]
        radius = np.array([np.sqrt(((self.float[g] - c) ** 2).sum(1).max()) for g, c in zip(groups, centre)])
        return self.join(pairing(centre, radius, counts), groups)

    def join(self, plan, groups: list[np.ndarray]) -> int:
        """Post-order over the pairing, so the points of a ball lie together."""
        todo, made = [(plan, False)], []
        while todo:
            at, ready = todo.pop()
            if isinstance(at, int):
                made.append(self.build(groups[at]))
            elif not ready:
                todo += [(at, True), (at[1], False), (at[0], False)]
            else:
                right, left = made.pop(), made.pop()
                (lo, _, _, _, s1, c1, r1), (_, hi, _, _, s2, c2, r2) = self.nodes[left], self.nodes[right]
                total = s1 + s2
                centre = total / (hi - lo)
                r = max(float(np.sqrt(((centre - c) ** 2).sum())) + r for c, r in ((c1, r1), (c2, r2)))
                self.nodes.append((lo, hi, left, right, total, centre, r))
                made.append(len(self.nodes) - 1)
        return made[0]


def anchors(x: np.ndarray) -> np.ndarray:
    """The anchor that owns each point: about sqrt(n) of them, each new one the point farthest from its anchor."""
    n = len(x)
    k = int(np.ceil(np.sqrt(n)))
    pivot = np.zeros((k, x.shape[1]))
    pivot[0] = x[((x - x.mean(0)) ** 2).sum(1).argmax()]
    dist, owner = np.sqrt(((x - pivot[0]) ** 2).sum(1)), np.zeros(n, np.int64)
    for a in range(1, k):
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        pivot[a] = x[far]
        half = np.sqrt(((pivot[:a] - pivot[a]) ** 2).sum(1)) / 2
        open_ = np.flatnonzero(dist > half[owner])
        d = np.sqrt(((x[open_] - pivot[a]) ** 2).sum(1))
        won = d < dist[open_]
        dist[open_[won]], owner[open_[won]] = d[won], a
    return owner


def pairing(centre: np.ndarray, radius: np.ndarray, counts: np.ndarray):
    """Nested pairs of anchor numbers: the two balls whose union stays smallest are joined until one is left."""
    k = len(radius)
    centre, radius, counts, node = centre.copy(), radius.copy(), counts.astype(np.float64), list(range(k))

    def union(i: int) -> np.ndarray:
        mid = (centre * counts[:, None] + centre[i] * counts[i]) / (counts + counts[i])[:, None]
        return np.maximum(np.sqrt(((mid - centre) ** 2).sum(1)) + radius, np.sqrt(((mid - centre[i]) ** 2).sum(1)) + radius[i])

    size = np.stack([union(i) for i in range(k)])
    np.fill_diagonal(size, np.inf)
    for _ in range(k - 1):
        a, b = divmod(int(size.argmin()), k)
        centre[a], radius[a] = (centre[a] * counts[a] + centre[b] * counts[b]) / (counts[a] + counts[b]), size[a, b]
        counts[a] += counts[b]
        node[a] = (node[a], node[b])
        gone = ~np.isfinite(size[a])
        fresh = union(a)
        fresh[gone] = np.inf
        fresh[[a, b]] = np.inf
        size[a], size[:, a] = fresh, fresh
        size[b], size[:, b] = np.inf, np.inf
        last = a
    return node[last]


FIELDS = ["lo", "hi", "left", "right", "sum", "centre", "radius"]


def _block_trees(x: np.ndarray) -> dict[str, np.ndarray]:
    """The trees of all parts in one set of arrays; node numbers and point places count on from part to part."""
    n, parts, _ = x.shape
    trees = [Tree(np.ascontiguousarray(x[:, p])) for p in range(parts)]
    first = np.cumsum([0, *(len(t.nodes) for t in trees)])
    cols = {f: np.array([node[i] for t in trees for node in t.nodes]) for i, f in enumerate(FIELDS)}
    part = np.repeat(np.arange(parts), np.diff(first))
    inner = cols["left"] >= 0
    for f in ("left", "right"):
        cols[f] = np.where(inner, cols[f] + first[part], -1)
    for f in ("lo", "hi"):
        cols[f] = cols[f] + part * n
    return cols | {"part": part, "root": first[:-1] + [t.root for t in trees], "order": np.concatenate([np.array(t.order) for t in trees]).astype(np.int64)}


ARRAYS = [*FIELDS, "part", "root", "order"]
FLOATS = ("centre", "radius")


def grow_trees(rows: DataFrame, n: int, parts: int, scale: int) -> DataFrame:
    """One row per block: ids, labels' places, integers and the arrays of its trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = _integers(part.column(2), n, parts, scale)
                trees = _block_trees(x)
                yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([part.column(1).to_pylist()], pa.list_(part.column(1).type)),
                                       pa.array([x.astype(np.int32).tobytes()])] + [pa.array([trees[f].astype(np.float64 if f in FLOATS else np.int64).tobytes()]) for f in ARRAYS],
                                      ["ids", "labels", "x", *ARRAYS])

    kind = dict(rows.dtypes)["label"]
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"ids array<long>, labels array<{kind}>, x binary, " + ", ".join(f"`{f}` binary" for f in ARRAYS))


def walk(trees: dict[str, np.ndarray], x: np.ndarray, books: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Assign every part of a block to an entry of its codebook, by tree.

    Yields ("ball": nodes, entries) for owned balls and ("point": places, entries, squared distances) for single points.
    """
    parts, entries, width = books.shape
    n = len(x)
    b = books.astype(np.float64)
    apart = np.sqrt(((b[:, :, None] - b[:, None]) ** 2).sum(-1))
    points = x.transpose(1, 0, 2).reshape(parts * n, width)
    flat = books.reshape(parts * entries, width)
    nodes, mask = trees["root"], np.ones((parts, entries), bool)
    while len(nodes):
        part, r = trees["part"][nodes], trees["radius"][nodes]
        d = ((trees["centre"][nodes][:, None] - b[part]) ** 2).sum(-1)
        open_ = np.where(mask, d, np.inf)
        best = open_.argmin(1)
        least = np.take_along_axis(d, best[:, None], 1)
        reach = 2 * r[:, None] * apart[part, best]
        mask &= (least - d + reach * (1 + 1e-9)) >= -1e-9 * (1 + d + least)
        owned = mask.sum(1) == 1
        if owned.any():
            yield "ball", nodes[owned], best[owned]
        nodes, mask = nodes[~owned], mask[~owned]
        leaf = trees["left"][nodes] < 0
        if leaf.any():
            yield "point", *_single(trees, points, flat, nodes[leaf], mask[leaf], n, entries)
        nodes, mask = nodes[~leaf], mask[~leaf]
        nodes, mask = np.r_[trees["left"][nodes], trees["right"][nodes]], np.r_[mask, mask]


def _single(trees, points, flat, nodes, mask, n: int, entries: int) -> tuple[np.ndarray, ...]:
    """Exact nearest candidates of the points of open leaves; of a leaf of equal points one is compared for all."""
    size = trees["hi"][nodes] - trees["lo"][nodes]
    leaf = np.repeat(np.arange(len(nodes)), size)
    slot = np.arange(len(leaf)) - np.repeat(np.cumsum(size) - size, size) + trees["lo"][nodes][leaf]
    place = trees["order"][slot] + trees["part"][nodes][leaf] * n
    node, cand = np.nonzero(mask)
    each = np.bincount(node, minlength=len(nodes))
    start = np.cumsum(each) - each
    many = each[leaf]
    who = np.repeat(np.arange(len(leaf)), many)
    pick = cand[np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many) + start[leaf][who]]
    d = ((points[place[who]] - flat[trees["part"][nodes][leaf][who] * entries + pick]) ** 2).sum(1)
    key = np.minimum.reduceat(d * entries + pick, np.cumsum(many) - many)
    return place, key % entries, key // entries


def _read(batch: pa.RecordBatch, row: int, parts: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    at = {f: i for i, f in enumerate(batch.schema.names)}
    n = len(batch.column(at["ids"])[row])
    x = np.frombuffer(batch.column(at["x"])[row].as_buffer(), np.int32).reshape(n, parts, -1).astype(np.int64)
    trees = {f: np.frombuffer(batch.column(at[f])[row].as_buffer(), np.float64 if f in FLOATS else np.int64) for f in ARRAYS}
    for f in ("sum", "centre"):
        trees[f] = trees[f].reshape(len(trees["lo"]), -1)
    return x, trees


def refine(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: assign, then replace each used entry by the floor of its parts' mean."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                x, t = _read(batch, row, parts)
                points = x.transpose(1, 0, 2).reshape(parts * len(x), width)
                for kind, where, entry, *_ in walk(t, x, books):
                    ball = kind == "ball"
                    e = (t["part"][where] if ball else where // len(x)) * entries + entry
                    np.add.at(total, e, t["sum"][where] if ball else points[where])
                    np.add.at(count, e, t["hi"][where] - t["lo"][where] if ball else 1)
        used = np.flatnonzero(count)
        yield pa.record_batch([pa.array(used), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["entry", "n", "s"])

    sums = blocks.select("ids", "x", *ARRAYS).mapInArrow(run, "entry long, n long, s array<long>").groupBy("entry").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(width)]).alias("s"))
    new = books.reshape(parts * entries, width).copy()
    for r in sums.collect():
        new[r["entry"]] = [s // r["n"] for s in r["s"]]
    return new.reshape(books.shape)


def encode(blocks: DataFrame, books: np.ndarray, label_type: str) -> DataFrame:
    """vec_id, label, code, error of every row."""
    parts, entries, _ = books.shape
    hexes = np.array([f"{i:02x}" for i in range(entries)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, t = _read(batch, row, parts)
                n = len(x)
                code = np.zeros(parts * n, np.int64)
                for kind, where, entry, *_ in walk(t, x, books):
                    if kind == "ball":
                        size = t["hi"][where] - t["lo"][where]
                        slot = np.arange(size.sum()) + np.repeat(t["lo"][where] - np.cumsum(size) + size, size)
                        where, entry = t["order"][slot] + np.repeat(t["part"][where] * n, size), np.repeat(entry, size)
                    code[where] = entry
                code = code.reshape(parts, n)
                near = books[np.arange(parts)[:, None], code].transpose(1, 0, 2)
                yield pa.record_batch([batch.column(0)[row].values, batch.column(1)[row].values, pa.array(["".join(c) for c in hexes[code.T]], pa.string()),
                                       pa.array(((x - near) ** 2).sum((1, 2)))], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label_type}, code string, error long")


def first_entries(rows: DataFrame, n: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the rows with the smallest ids."""
    top = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    x = _integers(pa.array([r["v"] for r in top], pa.list_(pa.float64())), n, parts, scale)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_label_sums(coded: DataFrame) -> DataFrame:
    """Adds label_error. A label with very many rows meets its sum under several salts."""
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("_l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    salted: Column = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    return coded.withColumn("_salt", salted).join(sums, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_salt") == F.col("_s"))).drop("_l", "_s", "_salt")


def vector_codes(vectors: DataFrame, vec: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label of every kept row."""
    kept = _kept(vectors, vec)
    label_type, coded = dict(kept.dtypes)["label"], None
    for r in kept.groupBy("n").count().orderBy("n").collect():
        rows = kept.where(F.col("n") == r["n"])
        books = first_entries(rows, r["n"], parts, entries, scale)
        blocks = Scratch(vectors.sparkSession).table(grow_trees(rows, r["n"], parts, scale), "trees")
        for _ in range(rounds):
            books = refine(blocks, books)
        some = encode(blocks, books, label_type).withColumn("codebooks_sha256", F.lit(digest(books)))
        coded = some if coded is None else coded.unionByName(some)
    if coded is None:
        coded = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    coded = Scratch(vectors.sparkSession).table(coded, "codes")
    return with_label_sums(coded).select("vec_id", "code", "error", "label_error", "codebooks_sha256", "label")
