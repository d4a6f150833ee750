"""Vector codes against plain integer k-means over all points and entries."""
import hashlib

import numpy as np
import pytest
from pyspark.sql import Row

from highwater.llm import vector_codes as m


def plain(rows, parts=16, entries=64, rounds=2):
    """rows of one length: (vec_id, vector, label)."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-len(rows[0][1]) // parts)
    x = np.zeros((len(rows), parts * width), np.int64)
    x[:, :len(rows[0][1])] = np.floor(np.array([r[1] for r in rows], np.float32).astype(float) * 256)
    x = x.reshape(len(rows), parts, width)
    start = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))[:entries]
    book = x[start].transpose(1, 0, 2).copy()
    for step in range(rounds + 1):
        d = ((x[:, :, None] - book[None]) ** 2).sum(-1)
        code = d.argmin(-1)
        if step < rounds:
            for p in range(parts):
                for e in range(book.shape[1]):
                    mine = x[code[:, p] == e, p]
                    if len(mine):
                        book[p, e] = mine.sum(0) // len(mine)
    error = d.min(-1).sum(1)
    by_label = {}
    for r, e in zip(rows, error.tolist()):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return [(r[0], "".join(f"{c:02x}" for c in k), int(e), by_label[r[2]], sha) for r, k, e in zip(rows, code.tolist(), error)]


def frame(spark, rows):
    return spark.createDataFrame([Row(vec_id=i, embedding=None if v is None else [None if x is None else float(x) for x in v], label=l, code="old", v=i) for i, v, l in rows],
                                 "vec_id long, embedding array<float>, label int, code string, v long")


def check(spark, rows):
    got = m.vector_codes(frame(spark, rows)).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)


def vectors(n, dims, seed, kind):
    rng = np.random.default_rng(seed)
    if kind == "noise":
        return rng.normal(0, 0.2, (n, dims)).astype(np.float32)
    if kind == "clusters":
        return (rng.normal(0, 2, (9, dims))[rng.integers(0, 9, n)] + rng.normal(0, 0.05, (n, dims))).astype(np.float32)
    return rng.integers(-1, 2, (n, dims)).astype(np.float32) / 256  # few values: ties everywhere


@pytest.mark.parametrize("kind", ["noise", "clusters", "ties"])
def test_equals_plain_k_means(spark, kind):
    v = vectors(1500, 64, 5, kind)
    rows = [(int(i), x.tolist(), int(i) % 3 if i % 7 else None) for i, x in enumerate(v)]
    rows += [(5000 + i, v[3].tolist(), 1) for i in range(700)]  # one vector in a third of all rows
    check(spark, rows)


def test_odd_rows(spark):
    v = vectors(40, 20, 6, "noise")  # fewer rows than entries, a length that 16 does not divide
    rows = [(int(i), x.tolist(), 1) for i, x in enumerate(v)]
    rows += [(90, None, 1), (91, [float("nan")] + v[0].tolist()[1:], 1), (92, [float("inf")] + v[0].tolist()[1:], 2), (93, [None] + v[0].tolist()[1:], 2),
             (5, v[9].tolist(), 1), (5, v[9].tolist(), 1), (None, v[8].tolist(), None), (-4, (v[7] * 90).tolist(), None)]
    check(spark, rows)


def test_lengths_are_tables_of_their_own_and_empty_tables(spark):
    a = [(i, x.tolist(), 0) for i, x in enumerate(vectors(90, 16, 1, "noise"))]
    b = [(100 + i, x.tolist(), 0) for i, x in enumerate(vectors(80, 32, 2, "clusters"))]
    got = {r["vec_id"]: r for r in m.vector_codes(frame(spark, a + b)).collect()}
    for want in (plain(a), plain(b)):
        assert [(got[i]["code"], got[i]["error"], got[i]["codebooks_sha256"]) for i, *_ in want] == [(c, e, s) for _, c, e, _, s in want]
    assert got[0]["label_error"] == sum(r["error"] for r in got.values())
    assert m.vector_codes(frame(spark, a)).where("vec_id < 0").count() == 0
    assert m.vector_codes(frame(spark, a).limit(0)).count() == 0
    assert m.vector_codes(frame(spark, [(1, None, 1)])).count() == 0


def test_balls_hold_their_points_and_are_owned_in_clustered_data():
    x = m._integers(__import__("pyarrow").array(vectors(2000, 64, 3, "clusters").astype(float).tolist()), 64, 16, 256)
    t = m._block_trees(x)
    for p in range(16):
        pts = x[:, p].astype(float)
        for node in np.flatnonzero(t["part"] == p):
            mine = t["order"][t["lo"][node]:t["hi"][node]]
            assert (x[mine, p].sum(0) == t["sum"][node]).all()
            assert np.sqrt(((pts[mine] - t["centre"][node]) ** 2).sum(1)).max() <= t["radius"][node] * (1 + 1e-9) + 1e-9
    books = np.ascontiguousarray(x[:64].transpose(1, 0, 2))
    seen, owned = np.zeros(16 * 2000, int), 0
    for kind, where, *_ in m.walk(t, x, books):
        if kind == "ball":
            for node in where:
                seen[t["order"][t["lo"][node]:t["hi"][node]] + t["part"][node] * 2000] += 1
            owned += int((t["hi"][where] - t["lo"][where]).sum())
        else:
            seen[where] += 1
    assert (seen == 1).all() and owned > 0
