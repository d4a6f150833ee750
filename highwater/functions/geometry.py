"""Planar geometry as column expressions.

A line is ``array<struct<x,y>>``; a polygon is an array of such rings; a point is ``struct<x,y>``.
Everything stays on the JVM: array functions and arithmetic, no Python rows.
"""
from math import atan, atanh, radians, sin, sinh, sqrt, tan

from pyspark.sql import Column, functions as F

from highwater.settings import (CLOSURE_TOLERANCE_DEG, BEARINGS, M_PER_DEG_LAT, M_PER_DEG_LON, MIN_SAMPLES,
                                SAMPLE_STEP_M, US_FOOT)

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y) -> Column:
    return F.struct(col(x).cast("double").alias("x"), col(y).cast("double").alias("y"))


def line(*xy) -> Column:
    """line(x0, y0, x1, y1, ...) from columns."""
    return F.array(*[point(xy[i], xy[i + 1]) for i in range(0, len(xy), 2)])


def box_ring(x0, y0, x1, y1) -> Column:
    x0, y0, x1, y1 = map(col, (x0, y0, x1, y1))
    return F.array(line(x0, y0, x1, y0, x1, y1, x0, y1, x0, y0))


def segments(geom) -> Column:
    """array<struct<a,b>> of consecutive vertices; empty for fewer than two vertices."""
    g = col(geom)
    n = F.greatest(F.size(g) - 1, F.lit(0))
    return F.zip_with(F.slice(g, F.lit(1), n), F.slice(g, F.lit(2), n),
                      lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def seg_length(s) -> Column:
    return F.sqrt(F.pow(s["b"]["x"] - s["a"]["x"], 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))


def line_length(geom) -> Column:
    return F.aggregate(segments(geom), F.lit(0.0), lambda acc, s: acc + seg_length(s))


def point_at(geom, fraction) -> Column:
    """Point at a share of the length, measured along the line."""
    return _walk(col(geom), col(fraction) * line_length(geom))


def _walk(g, distance) -> Column:
    start = F.struct(distance.alias("left"), g[0]["x"].alias("x"), g[0]["y"].alias("y"), F.lit(False).alias("found"))

    def step(acc, s):
        length = seg_length(s)
        here = ~acc["found"] & (acc["left"] <= length)
        t = F.when(length > 0, acc["left"] / length).otherwise(F.lit(0.0))
        x = s["a"]["x"] + (s["b"]["x"] - s["a"]["x"]) * t
        y = s["a"]["y"] + (s["b"]["y"] - s["a"]["y"]) * t
        return F.struct(
            F.when(acc["found"] | here, acc["left"]).otherwise(acc["left"] - length).alias("left"),
            F.when(acc["found"], acc["x"]).when(here, x).otherwise(s["b"]["x"]).alias("x"),
            F.when(acc["found"], acc["y"]).when(here, y).otherwise(s["b"]["y"]).alias("y"),
            (acc["found"] | here).alias("found"))

    return F.aggregate(segments(g), start, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def sample_count(geom, step_m=SAMPLE_STEP_M, min_n=MIN_SAMPLES) -> Column:
    return F.greatest(F.lit(min_n), F.ceil(line_length(geom) / step_m).cast("int") + 1)


def _let(value, f) -> Column:
    """f(value) with the value worked out once a row; in a lambda an outer expression is worked out again for each element."""
    return F.transform(F.array(value), f)[0]


def sample_line(geom, step_m=SAMPLE_STEP_M, min_n=MIN_SAMPLES) -> Column:
    """Evenly spaced points, both ends included. Each segment places its own samples; a line without a length stays at its end."""
    def leg(acc, s):
        length = seg_length(s)
        one = F.struct(*[s[p][c].alias(f"{p}{c}") for p in "ab" for c in "xy"], acc["to"].alias("from"), length.alias("length"), (acc["to"] + length).alias("to"))
        return F.struct((acc["to"] + length).alias("to"), F.concat(acc["legs"], F.array(one)).alias("legs"))

    fields = ["ax", "ay", "bx", "by", "from", "length", "to"]
    start = F.struct(F.lit(0.0).alias("to"), F.array().cast(f"array<struct<{','.join(f'`{c}`:double' for c in fields)}>>").alias("legs"))

    def samples(v):
        n, total, legs = v["n"], v["total"], v["legs"]

        def of_leg(s, j):
            d = lambda i: total * i / (n - 1)
            index = lambda at, by: F.when(total > 0, F.floor(at * (n - 1) / F.when(total > 0, total)).cast("int") + by)
            first, last = j == 0, j == F.size(legs) - 1
            lo = F.when(first, 0).otherwise(F.coalesce(F.greatest(index(s["from"], -1), F.lit(0)), F.lit(0)))
            hi = F.when(last, n - 1).otherwise(F.coalesce(F.least(index(s["to"], 2), n - 1), n - 1))
            mine = F.filter(F.sequence(lo, hi, F.lit(1)), lambda i: (first | (d(i) > s["from"])) & (last | (d(i) <= s["to"])))

            def place(i):
                left = d(i) - s["from"]
                t = F.when(s["length"] > 0, left / F.when(s["length"] > 0, s["length"])).otherwise(F.lit(0.0))
                within = left <= s["length"]
                return F.struct(*[F.when(within, s[f"a{c}"] + (s[f"b{c}"] - s[f"a{c}"]) * t).otherwise(s[f"b{c}"]).alias(c) for c in "xy"])

            return F.transform(mine, place)

        end = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(v["end"]["x"].alias("x"), v["end"]["y"].alias("y")))
        return F.when(total.isNull() | (F.size(legs) == 0), end).otherwise(F.flatten(F.transform(legs, of_leg)))

    return _let(col(geom), lambda g: _let(F.aggregate(segments(g), start, leg), lambda w: _let(
        F.struct(w["to"].alias("total"), w["legs"].alias("legs"), F.element_at(g, -1).alias("end"),
                 F.greatest(F.lit(min_n), F.ceil(w["to"] / step_m).cast("int") + 1).alias("n")), samples)))


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    """Plain arithmetic, so it stays inside generated code when rows are (point, segment) pairs."""
    dx, dy = bx - ax, by - ay
    l2 = dx * dx + dy * dy
    t = F.when(l2 > 0, F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / l2, F.lit(0.0)), F.lit(1.0))) \
         .otherwise(F.lit(0.0))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))


def dist_to_line(pt, geom) -> Column:
    p = col(pt)
    return F.array_min(F.transform(segments(geom), lambda s: point_segment_distance(
        p["x"], p["y"], s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"])))


def on_boundary(pt, rings) -> Column:
    p = col(pt)

    def touches(s):
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        cross = (bx - ax) * (p["y"] - ay) - (by - ay) * (p["x"] - ax)
        return ((cross == 0) & p["x"].between(F.least(ax, bx), F.greatest(ax, bx))
                & p["y"].between(F.least(ay, by), F.greatest(ay, by)))

    return F.exists(col(rings), lambda r: F.exists(segments(r), touches))


def in_rings(pt, rings) -> Column:
    """Ray cast with holes: inside when a ray to the right crosses the rings an odd number of times."""
    p = col(pt)

    def crosses(s):
        ax, ay, bx, by = s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]
        straddles = (ay > p["y"]) != (by > p["y"])
        return straddles & (p["x"] < (bx - ax) * (p["y"] - ay) / F.when(by != ay, by - ay) + ax)

    count = F.aggregate(col(rings), F.lit(0),
                        lambda acc, r: acc + F.size(F.filter(segments(r), lambda s: F.coalesce(crosses(s), F.lit(False)))))
    return count % 2 == 1


def inside_point(rings) -> Column:
    """A point of the polygon: the middle of its widest stretch at half height, between vertices and so off every corner."""
    rings = col(rings)
    ys = F.transform(F.flatten(rings), lambda p: p["y"])
    half = (F.array_min(ys) + F.array_max(ys)) / 2
    y = (F.array_max(F.filter(ys, lambda v: v <= half)) + F.array_min(F.filter(ys, lambda v: v > half))) / 2

    def cuts(r):
        hit = F.filter(segments(r), lambda s: (s["a"]["y"] > y) != (s["b"]["y"] > y))
        return F.transform(hit, lambda s: (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"])

    xs = F.array_sort(F.flatten(F.transform(rings, cuts)))
    gaps = F.zip_with(xs, F.slice(xs, F.lit(2), F.size(xs)), lambda a, b: F.struct((b - a).alias("w"), ((a + b) / 2).alias("x")))
    widest = F.array_max(F.filter(gaps, lambda g, i: (i % 2 == 0) & g["w"].isNotNull()))
    return F.struct(widest["x"].alias("x"), y.alias("y"))


def covers(rings, pt) -> Column:
    """Inside or on the border."""
    return in_rings(pt, rings) | on_boundary(pt, rings)


def bearing(geom) -> Column:
    g = col(geom)
    first, last = g[0], F.element_at(g, -1)
    return F.pmod(F.degrees(F.atan2(last["x"] - first["x"], last["y"] - first["y"])), F.lit(360.0))


def heads_toward(bearing_deg, direction, tolerance=CLOSURE_TOLERANCE_DEG) -> Column:
    """True when the bearing is near the named direction; an unnamed or unknown direction passes."""
    d = F.lower(F.coalesce(col(direction), F.lit("")))
    target = F.lit(None).cast("double")
    for name, degrees in BEARINGS.items():
        target = F.when(d == name, F.lit(degrees)).otherwise(target)
    diff = F.abs(F.pmod(col(bearing_deg) - target + 180, F.lit(360.0)) - 180)
    return target.isNull() | (diff <= tolerance)


def hausdorff(a, b, a_segments=None, b_segments=None) -> Column:
    """Largest vertex-to-line distance, both ways. Pass ready-made segment arrays when one line meets many."""
    a, b = col(a), col(b)
    sa, sb = col(a_segments) if a_segments is not None else segments(a), col(b_segments) if b_segments is not None else segments(b)

    def leg(s):
        dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
        return F.struct(s["a"]["x"].alias("ax"), s["a"]["y"].alias("ay"), dx.alias("dx"), dy.alias("dy"), (dx * dx + dy * dy).alias("l2"))

    def squared(p, s):
        px, py, l2 = p["x"] - s["ax"], p["y"] - s["ay"], s["l2"]
        t = F.when(l2 > 0, F.least(F.greatest((px * s["dx"] + py * s["dy"]) / l2, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
        return F.pow(px - t * s["dx"], 2) + F.pow(py - t * s["dy"], 2)

    one_way = lambda pts, segs: F.array_max(F.transform(pts, lambda p: F.array_min(F.transform(segs, lambda s: squared(p, s)))))
    legs = F.struct(F.transform(sa, leg).alias("a"), F.transform(sb, leg).alias("b"))
    return _let(legs, lambda v: F.sqrt(F.greatest(one_way(a, v["b"]), one_way(b, v["a"]))))


def envelope(geom) -> Column:
    g = col(geom)
    xs, ys = F.transform(g, lambda p: p["x"]), F.transform(g, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"),
                    F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def segment_hits_box(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """Does a segment meet an axis-parallel box? Clip the parameter range on each axis in turn."""
    def axis(a, d, lo, hi):
        t1, t2 = (lo - a) / F.when(d != 0, d), (hi - a) / F.when(d != 0, d)
        still = F.when((a >= lo) & (a <= hi), F.lit(0.0)).otherwise(F.lit(2.0))
        enter = F.when(d != 0, F.least(t1, t2)).otherwise(still)
        leave = F.when(d != 0, F.greatest(t1, t2)).otherwise(F.lit(1.0))
        return enter, leave

    ex, lx = axis(ax, bx - ax, x0, x1)
    ey, ly = axis(ay, by - ay, y0, y1)
    return F.greatest(ex, ey, F.lit(0.0)) <= F.least(lx, ly, F.lit(1.0))


def line_hits_box(geom, x0, y0, x1, y1) -> Column:
    return F.exists(segments(geom), lambda s: segment_hits_box(
        s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"], col(x0), col(y0), col(x1), col(y1)))


def drop_repeated_vertices(geom) -> Column:
    """Consecutive duplicates removed; null when fewer than two vertices are left."""
    g = col(geom)
    kept = F.filter(g, lambda p, i: (i == 0) | (p != g[F.greatest(i - 1, F.lit(0))]))
    return F.when(F.size(kept) >= 2, kept)


def thin_path(geom, n) -> Column:
    """At most n evenly spread vertices, both ends kept."""
    g = col(geom)
    step = (F.size(g) - 1).cast("double") / (n - 1)
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                         lambda i: F.element_at(g, (F.bround(i * step).cast("int") + 1)))
    return F.when(F.size(g) <= n, g).otherwise(picked)


def round_path(geom, digits=6) -> Column:
    return F.transform(col(geom), lambda p: F.struct(F.bround(p["x"], digits).alias("x"),
                                                     F.bround(p["y"], digits).alias("y")))


def join_paths(geoms, digits=6) -> Column:
    """One rounded path from an ordered array of lines; a vertex shared by neighbours appears once."""
    rounded = F.transform(col(geoms), lambda g: round_path(g, digits))
    return F.aggregate(rounded, F.array().cast(LINE), lambda acc, g: F.concat(
        acc, F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) == g[0]),
                    F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0)))).otherwise(g)))


def flat_distance_m(lon1, lat1, lon2, lat2) -> Column:
    """Metres between two nearby lon/lat points on a flat earth."""
    lon1, lat1, lon2, lat2 = map(col, (lon1, lat1, lon2, lat2))
    dx = (lon2 - lon1) * M_PER_DEG_LON * F.cos(F.radians(lat1))
    dy = (lat2 - lat1) * M_PER_DEG_LAT
    return F.sqrt(dx * dx + dy * dy)


def decode_polyline(s) -> Column:
    """Encoded polyline text -> array of points (x = lon, y = lat), as one fold over its characters.

    Each number is a run of 5-bit groups, low group first, the last one below 32; odd results are negative.
    Numbers alternate latitude and longitude and are differences from the previous point.
    """
    codes = F.transform(F.split(col(s), ""), lambda ch: F.ascii(ch) - 63)
    start = F.struct(F.lit(0).cast("bigint").alias("value"), F.lit(0).alias("shift"),
                     F.array().cast("array<bigint>").alias("out"))

    def step(acc, code):
        value = acc["value"] + F.call_function("shiftleft", code.bitwiseAND(F.lit(31)).cast("bigint"), acc["shift"])
        signed = F.when(value % 2 == 1, -F.floor((value + 1) / 2)).otherwise(F.floor(value / 2)).cast("bigint")
        done = code < 32
        return F.struct(F.when(done, F.lit(0).cast("bigint")).otherwise(value).alias("value"),
                        F.when(done, F.lit(0)).otherwise(acc["shift"] + 5).alias("shift"),
                        F.when(done, F.concat(acc["out"], F.array(signed))).otherwise(acc["out"]).alias("out"))

    deltas = F.aggregate(F.filter(codes, lambda c: c >= 0), start, step, lambda acc: acc["out"])
    n = F.floor(F.size(deltas) / 2).cast("int")

    def total(upto, offset):
        part = F.filter(deltas, lambda v, i: (i % 2 == offset) & (i <= 2 * upto + offset))
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda a, v: a + v) / F.lit(1e5)

    pts = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
                      lambda i: F.struct(total(i, 1).alias("x"), total(i, 0).alias("y")))
    return F.when(n > 0, pts)


class TransverseMercator:
    """Conformal lon/lat <-> grid coordinates by the Krueger series (order n^4), parameters as literals."""

    def __init__(self, lon0, lat0=0.0, k0=0.9996, false_e=500000.0, false_n=0.0, unit=1.0,
                 a=6378137.0, inv_f=298.257223563):
        f = 1.0 / inv_f
        n = f / (2 - f)
        self.n, self.lon0, self.k0, self.unit = n, lon0, k0, unit
        self.false_e, self.false_n = false_e, false_n
        self.e = sqrt(f * (2 - f))
        self.big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
        self.alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
                      13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
                      61 * n**3 / 240 - 103 * n**4 / 140,
                      49561 * n**4 / 161280]
        self.beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
                     n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
                     17 * n**3 / 480 - 37 * n**4 / 840,
                     4397 * n**4 / 161280]
        self.delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45,
                      7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
                      56 * n**3 / 15 - 136 * n**4 / 35,
                      4279 * n**4 / 630]
        self.north0 = self._meridian(radians(lat0))

    def _meridian(self, lat):
        """Grid northing (unscaled) of a latitude on the central meridian, for the false origin."""

        t = tan(lat)
        conformal = atan(t * sqrt(1 + _sig(self.e, t) ** 2) - _sig(self.e, t) * sqrt(1 + t * t)) if lat else 0.0

        return self.big_a * (conformal + sum(c * sin(2 * (j + 1) * conformal) for j, c in enumerate(self.alpha)))

    def forward(self, lon, lat) -> Column:
        """lon/lat in degrees -> struct<x,y> in grid units."""
        phi, lam = F.radians(col(lat)), F.radians(col(lon) - self.lon0)
        sin_phi = F.sin(phi)
        t = F.sinh(F.atanh(sin_phi) - self.e * F.atanh(self.e * sin_phi))
        xi = F.atan2(t, F.cos(lam))
        eta = F.asinh(F.sin(lam) / F.sqrt(t * t + F.pow(F.cos(lam), 2)))
        east, north = eta, xi
        for j, c in enumerate(self.alpha, 1):
            east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return F.struct(((self.false_e + self.k0 * self.big_a * east) / self.unit).alias("x"),
                        ((self.false_n + self.k0 * (self.big_a * north - self.north0)) / self.unit).alias("y"))

    def inverse(self, x, y) -> Column:
        """Grid units -> struct<x: lon, y: lat> in degrees."""
        xi = ((col(y) * self.unit - self.false_n) / self.k0 + self.north0) / self.big_a
        eta = (col(x) * self.unit - self.false_e) / (self.k0 * self.big_a)
        xi1, eta1 = xi, eta
        for j, c in enumerate(self.beta, 1):
            xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        chi = F.asin(F.sin(xi1) / F.cosh(eta1))
        lat = chi
        for j, c in enumerate(self.delta, 1):
            lat = lat + c * F.sin(2 * j * chi)
        return F.struct((F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + self.lon0).alias("x"),
                        F.degrees(lat).alias("y"))


def _sig(e, t):

    return sinh(e * atanh(e * t / sqrt(1 + t * t)))


def utm17n() -> TransverseMercator:
    return TransverseMercator(lon0=-81.0)


def florida_east_feet() -> TransverseMercator:
    """State plane, Florida East, US survey feet."""
    return TransverseMercator(lon0=-81.0, lat0=24.0 + 20.0 / 60.0, k0=1 - 1 / 17000.0, false_e=200000.0,
                              unit=US_FOOT, inv_f=298.257222101)
