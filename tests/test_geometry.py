"""Geometry against independent arithmetic."""
import math
import re
import random

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from highwater.functions import geometry as G
from highwater.operators import spatial as P


def seg_dist(p, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    l2 = dx * dx + dy * dy
    t = 0 if l2 == 0 else min(1, max(0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / l2))
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def snyder(lon, lat):
    """UTM 17N by the older series in e^2, independent of the one in use."""
    a, e2, k0 = 6378137.0, 0.00669437999014, 0.9996
    ep2 = e2 / (1 - e2)
    phi, lam = math.radians(lat), math.radians(lon + 81)
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    t, c, aa = math.tan(phi) ** 2, ep2 * math.cos(phi) ** 2, lam * math.cos(phi)
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * math.sin(2 * phi)
             + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * math.sin(4 * phi) - (35 * e2**3 / 3072) * math.sin(6 * phi))
    x = k0 * n * (aa + (1 - t + c) * aa**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * aa**5 / 120) + 500000
    y = k0 * (m + n * math.tan(phi) * (aa**2 / 2 + (5 - t + 9 * c + 4 * c * c) * aa**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * aa**6 / 720))
    return x, y


def test_transverse_mercator(spark):
    pts = [(-80.39, 25.72), (-80.18, 25.80), (-80.29, 25.76), (-81.0, 25.0), (-82.5, 28.0)]
    df = spark.createDataFrame(pts, "lon double, lat double")
    g = G.utm17n()
    rows = df.select("lon", "lat", g.forward("lon", "lat").alias("p")).select("*", g.inverse("p.x", "p.y").alias("q")).collect()
    for r in rows:
        x, y = snyder(r["lon"], r["lat"])
        assert abs(r["p"]["x"] - x) < 0.01 and abs(r["p"]["y"] - y) < 0.01
        assert abs(r["q"]["x"] - r["lon"]) < 1e-9 and abs(r["q"]["y"] - r["lat"]) < 1e-9


def test_state_plane_feet(spark):
    g = G.florida_east_feet()
    df = spark.createDataFrame([(-81.0, 24.0 + 20 / 60), (-80.29, 25.76)], "lon double, lat double")
    rows = df.select("lon", "lat", g.forward("lon", "lat").alias("p")).select("*", g.inverse("p.x", "p.y").alias("q")).collect()
    assert abs(rows[0]["p"]["x"] - 656166.667) < 0.01 and abs(rows[0]["p"]["y"]) < 1e-6
    assert all(abs(r["q"]["x"] - r["lon"]) < 1e-9 and abs(r["q"]["y"] - r["lat"]) < 1e-9 for r in rows)


def test_locate_from_state_plane(spark):
    from highwater.operators.checks import locate
    g = G.florida_east_feet()
    xy = spark.range(1).select(g.forward(F.lit(-80.29), F.lit(25.76)).alias("p")).first()["p"]
    df = spark.createDataFrame([(1, 25.75, -80.3, None, None), (2, 0.0, 0.0, xy["x"], xy["y"]), (3, None, -80.3, 0.0, 0.0)],
                               "id int, lat double, lon double, px double, py double")
    rows = {r["id"]: r for r in locate(df, to_lonlat=g.inverse).collect()}
    assert set(rows) == {1, 2} and rows[2]["from_xy"] and not rows[1]["from_xy"] and abs(rows[2]["lon"] + 80.29) < 1e-9


def random_lines(rnd, n):
    return [(f"e{i}", [(rnd.uniform(0, 600), rnd.uniform(0, 600)) for _ in range(rnd.randint(2, 5))]) for i in range(n)]


def lines_df(spark, lines):
    return spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in g], False) for i, g in lines], f"edge_id string, geom {G.LINE}, is_bridge boolean")


def test_nearest_lines_equals_brute_force(spark):
    rnd = random.Random(1)
    lines = random_lines(rnd, 25)
    pts = [(i, rnd.uniform(-50, 650), rnd.uniform(-50, 650)) for i in range(120)]
    got = {}
    for r in P.nearest_lines(spark.createDataFrame(pts, "point_id int, x double, y double"), lines_df(spark, lines), max_m=40.0).collect():
        got.setdefault(r["point_id"], set()).add(r["edge_id"])
    want = {}
    for i, x, y in pts:
        d = {e: round(min(seg_dist((x, y), a, b) for a, b in zip(g, g[1:])), 6) for e, g in lines}
        m = min(d.values())
        if m <= 40:
            want[i] = {e for e, v in d.items() if v == m}
    assert got == want and len(want) > 50


def test_nearest_node_far_away(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "node_id int, x double, y double")
    pts = spark.createDataFrame([(1, 30.0, 0.0), (2, 9000.0, 4000.0), (3, -70.0, 0.0)], "point_id int, x double, y double")
    got = {r["point_id"]: (r["node_id"], r["in_area"]) for r in P.nearest_node(pts, nodes, 50.0).collect()}
    assert got == {1: (1, True), 2: (2, False), 3: (1, False)}


def test_nearest_node_lonlat(spark):
    nodes = spark.createDataFrame([(1, -80.30, 25.76), (2, -80.29, 25.76)], "node_id int, x double, y double")
    pts = spark.createDataFrame([(1, -80.2993, 25.7601), (2, -80.25, 25.70)], "point_id int, x double, y double")
    got = {r["point_id"]: r for r in P.nearest_node(pts, nodes, 300.0, lat0=25.76).collect()}
    assert got[1]["node_id"] == 1 and got[1]["in_area"] and got[2]["node_id"] == 2 and not got[2]["in_area"]
    assert abs(got[1]["dist"] - math.hypot(0.0007 * 111320 * math.cos(math.radians(25.7601)), 0.0001 * 110540)) < 1e-3


def test_overlap_edges_against_sampling(spark):
    rnd = random.Random(3)
    edges = random_lines(rnd, 25)
    closures = [(f"c{i}", [(rnd.uniform(0, 600), rnd.uniform(0, 600)) for _ in range(rnd.randint(2, 4))]) for i in range(8)]
    square = [(100.0, 100.0), (400.0, 100.0), (400.0, 420.0), (100.0, 420.0), (100.0, 100.0)]
    xy = lambda g: [{"x": x, "y": y} for x, y in g]
    areas = spark.createDataFrame([(i, xy(g), None, None) for i, g in closures] + [("poly", None, [xy(square)], None)],
                                  f"closure_id string, geom {G.LINE}, rings array<{G.LINE}>, direction string")
    got = {(r["closure_id"], r["edge_id"]): r["share"] for r in P.overlap_edges(areas, lines_df(spark, edges), 60.0, 0.0001).collect()}

    def covered(c, p):
        if c == "poly":
            inside = 100 <= p[0] <= 400 and 100 <= p[1] <= 420
            return inside or min(seg_dist(p, a, b) for a, b in zip(square, square[1:])) <= 60
        g = dict(closures)[c]
        return min(seg_dist(p, a, b) for a, b in zip(g, g[1:])) <= 60

    for c in [i for i, _ in closures] + ["poly"]:
        for e, g in edges:
            total = sum(math.dist(a, b) for a, b in zip(g, g[1:]))
            inside = 0.0
            for a, b in zip(g, g[1:]):
                k = 1500
                hits = sum(covered(c, (a[0] + (b[0] - a[0]) * (i + .5) / k, a[1] + (b[1] - a[1]) * (i + .5) / k)) for i in range(k))
                inside += math.dist(a, b) * hits / k
            assert abs(got.get((c, e), 0.0) - inside / total) < 0.003, (c, e)


def test_overlap_respects_direction(spark):
    e = spark.createDataFrame([("east", [{"x": 0.0, "y": 0.0}, {"x": 100.0, "y": 0.0}]), ("west", [{"x": 100.0, "y": 0.0}, {"x": 0.0, "y": 0.0}])], f"edge_id string, geom {G.LINE}")
    a = spark.createDataFrame([("c", [{"x": 0.0, "y": 5.0}, {"x": 60.0, "y": 5.0}], None, "Eastbound")], f"closure_id string, geom {G.LINE}, rings array<{G.LINE}>, direction string")
    assert [r["edge_id"] for r in P.overlap_edges(a, e).collect()] == ["east"]


def test_fallback_for_interior_lots(spark):
    lots = spark.sql("select 'L1' as lot_id, 0D as x0 union all select 'L2', 1000D union all select 'L3', 5000D").withColumn(
        "rings", G.box_ring(F.col("x0"), F.lit(0.0), F.col("x0") + 50, F.lit(50.0)))
    e = spark.createDataFrame([("a", [{"x": -10.0, "y": 60.0}, {"x": 60.0, "y": 60.0}]), ("b", [{"x": 1000.0, "y": 150.0}, {"x": 1100.0, "y": 150.0}]), ("in", [{"x": 10.0, "y": 20.0}, {"x": 40.0, "y": 20.0}])],
                              f"edge_id string, geom {G.LINE}")
    got = {(r["lot_id"], r["edge_id"]): (r["dist"], r["access_method"]) for r in P.nearest_or_fallback(lots, e).collect()}
    assert got == {("L1", "a"): (10.0, "adjacent"), ("L1", "in"): (0.0, "adjacent"), ("L2", "b"): (100.0, "nearest")}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=0, max_size=25))
def test_cell_components(spark, cells):
    from highwater.operators.graph import cell_components
    todo, want = set(cells), []
    while todo:
        group, stack = set(), [todo.pop()]
        while stack:
            x, y = stack.pop()
            group.add((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in todo:
                    todo.remove(n)
                    stack.append(n)
        want.append(frozenset(group))
    got = {}
    for r in cell_components(spark.createDataFrame(list(set(cells)), "cx int, cy int")).collect():
        got.setdefault(r["component"], set()).add((r["cx"], r["cy"]))
    assert {frozenset(g) for g in got.values()} == set(want)


def ring_area_points(rng, ring):
    xs, ys = [x for x, _ in ring], [y for _, y in ring]
    pts = [(float(rng.uniform(min(xs) - 5, max(xs) + 5)), float(rng.uniform(min(ys) - 5, max(ys) + 5))) for _ in range(150)]
    pts += [(float(x), float(y)) for x, y in ring[::max(1, len(ring) // 20)]]  # vertices
    return pts + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(ring[::max(1, len(ring) // 20)], ring[1::max(1, len(ring) // 20)])]


def plain_inside(p, rings):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax) == 0 and min(ax, bx) <= p[0] <= max(ax, bx) and min(ay, by) <= p[1] <= max(ay, by):
                return True
            if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_polygon_cover_equals_ray_cast(spark):
    """Stars, boxes, holes, slivers, cell-aligned borders, a big ring of many vertices and a tiny one."""
    rng = np.random.default_rng(8)
    star = lambda x, y, r, n: [(x + r * (1 if i % 2 else 0.4) * math.cos(2 * math.pi * i / n), y + r * (1 if i % 2 else 0.4) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    close = lambda r: r + r[:1]
    polys = {"star": [close(star(30, 40, 50, 40))], "fine": [close(star(0, 0, 900, 3000))], "box": [close([(0, 0), (400, 0), (400, 400), (0, 400)])],
             "hole": [close([(-200, -200), (200, -200), (200, 200), (-200, 200)]), close([(-100, -100), (100, -100), (100, 100), (-100, 100)])],
             "sliver": [close([(0, 0), (800, 1), (800, 1.5)])], "tiny": [close([(5, 5), (5.01, 5), (5, 5.01)])], "corner": [close([(100, 100), (200, 300), (300, 100), (200, 200)])]}
    pts = sorted({p for rings in polys.values() for r in rings for p in ring_area_points(rng, r)})
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(pts)], "point_id int, x double, y double")
    pf = spark.createDataFrame([(k, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for k, rings in polys.items()], "poly string, rings array<array<struct<x:double,y:double>>>")
    got = {(r["point_id"], r["poly"]) for r in P.point_polygon_pairs(df, pf, ["point_id"], ["poly"]).collect()}
    assert got == {(i, k) for i, p in enumerate(pts) for k, rings in polys.items() if plain_inside(p, rings)}
    cover = P.polygon_cover(pf, ["poly"], 100.0).where("poly = 'fine'")
    assert cover.agg(F.max(F.size("segs"))).first()[0] <= 300 and cover.where("segs is null").count() > 50
    plan = P.point_polygon_pairs(df, pf, ["point_id"], ["poly"])._jdf.queryExecution().optimizedPlan().toString()
    assert "rings" not in plan  # whole rings do not reach the join


def test_a_third_of_all_points_in_one_cell(spark):
    """Points crowded on two streets and piled up on one spot: few more pairs are tested than found."""
    rng = np.random.default_rng(5)
    pts = [(i, 50 + float(x), 50 + float(y)) for i, (x, y) in enumerate(rng.uniform(0, 100, (3000, 2)))]
    pts += [(10000 + i, 60.0, 60.0) for i in range(2000)] + [(20000 + i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-4000, 4000, (4000, 2)))]
    lines = [(f"e{i}", [(x, y), (x + dx, y + dy)]) for i, (x, y, dx, dy) in enumerate(np.c_[rng.uniform(0, 200, (300, 2)), rng.uniform(-15, 15, (300, 2))].tolist())]
    df = spark.createDataFrame(pts, "point_id int, x double, y double")
    lf = lines_df(spark, lines)
    p, s = P._point_line_cells(df, lf, "edge_id", 30.0)
    tested = p.join(s, ["level", "cx", "cy"]).count()
    got = P.pairs_within(df, lf, "point_id", "edge_id", 30.0)
    found = got.select("point_id", "edge_id").join(df, "point_id").select("x", "y", "edge_id").distinct().count()
    assert found < tested <= 4 * found, (tested, found)
    some = [q for q in pts if q[0] % 37 == 0]
    mine = {(r["point_id"], r["edge_id"]): r["dist"] for r in got.where("point_id % 37 = 0").collect()}

    def dist(q, line):
        (ax, ay), (bx, by) = line
        t = max(0.0, min(1.0, ((q[1] - ax) * (bx - ax) + (q[2] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return math.hypot(q[1] - ax - t * (bx - ax), q[2] - ay - t * (by - ay))
    want = {(q[0], e): dist(q, line) for q in some for e, line in lines if dist(q, line) <= 30}
    assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 1e-5 for k in want)


def test_k_nearest_near_and_far(spark):
    """Crowded, repeated and lonely targets; points inside, far outside and on top of targets; ties to the smaller id."""
    from highwater.operators.nearest import k_nearest
    rng = np.random.default_rng(2)
    targets = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.uniform(0, 1000, (300, 2)), rng.normal(500, 1, (400, 2)), np.tile([[250.0, 250.0]], (200, 1)), [[9000.0, -50.0]]])]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.r_[rng.uniform(-100, 1100, (60, 2)), [[250.0, 250.0], [1e6, 1e6], [-3e5, 500.0], [8999.0, 0.0]]])]
    pf, tf = spark.createDataFrame(points, "point_id int, x double, y double"), spark.createDataFrame(targets, "target_id int, tx double, ty double")
    d = F.sqrt(F.pow(F.col("tx") - F.col("x"), 2) + F.pow(F.col("ty") - F.col("y"), 2))
    for k in (1, 5):
        got = {}
        for r in k_nearest(pf, tf, k, d).orderBy("rank").collect():
            got.setdefault(r["point_id"], []).append((r["dist"], r["target_id"]))
        for i, x, y in points:
            want = sorted((round(math.hypot(tx - x, ty - y), 6), t) for t, tx, ty in targets)[:k]
            assert [t for _, t in got[i]] == [t for _, t in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got[i], want)), i
    assert k_nearest(pf, tf.limit(0), 3, d).count() == 0
    few = k_nearest(pf, tf.where("target_id < 3"), 5, d).groupBy("point_id").count()
    assert few.where("count = 3").count() == len(points)


def test_a_far_point_looks_at_few_cells(spark, monkeypatch):
    from highwater.operators import nearest as N
    rng = np.random.default_rng(3)
    tf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1000, (5000, 2)))], "target_id int, tx double, ty double")
    pf = spark.createDataFrame([(1, 70000.0, 30000.0)], "point_id int, x double, y double")
    seen = []
    keep = N.stored
    monkeypatch.setattr(N, "stored", lambda df: seen.append((out := keep(df)).count()) or out)
    assert N.k_nearest(pf, tf, 1, F.lit(1.0)).count() == 1
    assert seen and max(seen) <= 12, seen


def test_nearest_in_a_long_strip(spark, monkeypatch):
    """Targets along a strip get cells as small as their number asks for; points of one cell go down the levels as one row."""
    from highwater.operators import nearest as N
    rng = np.random.default_rng(4)
    tf = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 1, (3000, 2)) * [40, 400000])], "target_id int, tx double, ty double")
    keyed, levels, _ = N.pyramid(tf)
    assert levels[0].agg(F.max("n")).first()[0] <= 8 * N.CROWD
    points = [(i, 20.0, 200000.0 + i * 0.001) for i in range(2000)]
    pf = spark.createDataFrame(points, "point_id int, x double, y double")
    seen, keep = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df: seen.append((out := keep(df)).count()) or out)
    monkeypatch.setattr(N, "CHUNK", 5)
    d = lambda x, y, tx, ty: F.sqrt(F.pow(tx - x, 2) + F.pow(ty - y, 2))
    by_row = F.sqrt(F.pow(F.col("tx") - F.col("x"), 2) + F.pow(F.col("ty") - F.col("y"), 2))
    for k in (1, 4):
        a, b = ({tuple(r) for r in N.k_nearest(pf, tf, k, m).select("point_id", "target_id", "dist", "rank").collect()} for m in (d, by_row))
        assert a == b and len(a) == k * len(points)
    assert seen and max(seen) <= 48, seen


def test_pairs_are_reduced_where_they_are_made(spark):
    """Pairs of positions and lines are not dealt out again: only what is left per place, line or point is."""
    pts = spark.createDataFrame([(i, float(i % 50), float(i % 7), None if i % 3 else "Northbound") for i in range(300)], "point_id int, x double, y double, direction string")
    lf = lines_df(spark, [(f"e{i}", [(5.0 * i, 0.0), (5.0 * i, 9.0)]) for i in range(10)])
    if "is_bridge" not in lf.columns:
        lf = lf.withColumn("is_bridge", F.lit(False))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = P.count_within(pts, lf, 3.0)
        near = P._near(*P._point_line_cells(pts, lf, "edge_id", 3.0), "edge_id", 3.0)
        for df in (n, near, P._nearest_of_place(near)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\([^)]*px#[^)]*edge_id#", plan), plan
        got = {r["edge_id"]: r["n"] for r in n.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    want = {f"e{i}": sum(abs(p % 50 - 5 * i) <= 3 for p in range(300)) for i in range(10)}
    assert got == want


def test_a_crowded_fine_cell_is_sliced(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 50)
    pts = spark.createDataFrame([(i, 1.0 + i * 0.01, 1.0) for i in range(400)], "point_id int, x double, y double")
    lf = lines_df(spark, [("a", [(0.0, 0.0), (9.0, 0.0)]), ("b", [(0.0, 3.0), (9.0, 3.0)])])
    p, s = P._point_line_cells(pts, lf, "edge_id", 30.0)
    assert p.groupBy(*P.CELL).count().agg(F.max("count")).first()[0] < 200
    got = P.pairs_within(pts, lf, "point_id", "edge_id", 30.0)
    assert got.count() == 800 and got.distinct().count() == 800


def test_samples_and_hausdorff_do_their_work_once(spark):
    """Segments and lengths of a line are worked out once a row, not once a sample or vertex; samples are where a plain walk puts them."""
    lines = [[(0.0, 0.0), (30.0, 40.0), (30.0, 100.0), (30.0, 100.0), (77.0, 3.0)], [(5.0, 5.0), (5.0, 5.0)], [(1.0, 2.0)], [(0.0, 0.0), (7.0, 0.0)], [(1.0, 1.0), (None, 4.0), (9.0, 9.0)], None]
    kind = "array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, g, lines[0]) for i, g in enumerate(lines)], f"i int, g {kind}, h {kind}")
    s = df.select("i", G.sample_line("g").alias("p"))
    h = df.select("i", G.hausdorff("g", "h").alias("d"))
    text = [x._jdf.queryExecution().optimizedPlan().toString() for x in (s, h)]
    assert text[0].count("zip_with") == 1, text[0]
    assert "zip_with" not in text[1][text[1].index("array_min("):], text[1]
    got = {r["i"]: r["p"] for r in s.collect()}

    def walk(g):
        legs = [math.dist(a, b) for a, b in zip(g, g[1:])]
        total = sum(legs)
        n = max(5, math.ceil(total / 10) + 1)
        for i in range(n):
            left = total * i / (n - 1)
            for a, b, m in zip(g, g[1:], legs):
                if left <= m or b is g[-1]:
                    t = min(left / m, 1.0) if m else 0.0
                    yield (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
                    break
                left -= m
            else:
                yield g[0]
    for i, g in enumerate(lines[:4]):
        want = list(walk(g))
        assert len(got[i]) == len(want) and all(math.dist(a, b) < 1e-9 for a, b in zip(got[i], want)), i
    assert [tuple(p) for p in got[4]] == [(9.0, 9.0)] * 5
    assert got[5] is None or [p and tuple(p) for p in got[5]] in ([None] * 5, [(None, None)] * 5)


def test_vertices_stay_with_their_edge(spark):
    """Containment deals edges out once: vertices, their count and the polygons that hold them stay together."""
    box = spark.createDataFrame([("z", 0.0, 0.0, 10.0, 10.0), ("w", 5.0, 0.0, 30.0, 10.0)], "zone string, a double, b double, c double, d double")
    zones = box.select("zone", G.box_ring("a", "b", "c", "d").alias("rings"))
    lf = lines_df(spark, [("in", [(1.0, 1.0), (10.0, 4.0)]), ("both", [(6.0, 1.0), (9.0, 4.0), (6.0, 1.0)]), ("out", [(1.0, 1.0), (40.0, 4.0)]),
                          ("rows", [(1.0, 1.0), (2.0, 1.0)]), ("rows", [(50.0, 1.0), (2.0, 1.0)])])
    got = P.in_polygon(lf, zones, "zone")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert {tuple(r) for r in got.collect()} == {("z", "in"), ("z", "both"), ("w", "both")}
