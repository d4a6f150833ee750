"""Registered queries: geometry, distance and containment joins, rasters, lots."""
from pyspark.sql import functions as F

from highwater.functions import geometry as G
from highwater.operators import checks as C, graph as N, spatial as P, serving as V, layers as L
from highwater.plans.registry import psd, query, r6
from highwater.session import stored

H = "(ceil((select n from fx_n) / 40e0))"  # height of a raster cell; its width is 40


def _cell_h(T) -> float:
    return float(-(-T.fx_n.first()["n"] // 40))


POINT_EDGE = f"""pe as (select point_id, s.edge_id, min(round({psd('p.x', 'p.y', 's.ax', 's.ay', 's.ex', 's.ey')}, 6)) as dist
  from fx_point p join fx_edge_seg s on not s.is_bridge and p.x between least(s.ax, s.ex) - 50 and greatest(s.ax, s.ex) + 50
    and p.y between least(s.ay, s.ey) - 50 and greatest(s.ay, s.ey) + 50 group by point_id, s.edge_id)"""


@query("j4_nearest_lines", f"""with {POINT_EDGE} select point_id, edge_id, dist from (select *, min(dist) over (partition by point_id) as m from pe where dist <= 30) t where dist = m""")
def _(T):
    return P.nearest_lines(T.fx_point, T.lines().where(~F.col("is_bridge")), max_m=30.0)


@query("j6_count_within", f"""with {POINT_EDGE} select e.edge_id, coalesce(n, 0) as n from fx_edge e left join (select edge_id, count(*) as n from pe where dist <= 50 group by edge_id) c on c.edge_id = e.edge_id""")
def _(T):
    return P.count_within(T.fx_point, T.lines(), 50.0)


@query("j25_near_point", f"""with {POINT_EDGE} select p.point_id, count(*) as n, round(min(dist), 6) as nearest from fx_point p join pe on pe.point_id = p.point_id where dist <= 40 group by p.point_id""")
def _(T):
    pairs = P.near_point(T.fx_point, T.lines().where(~F.col("is_bridge")), 40.0)
    return r6(pairs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("nearest")))


DIRECTION = "case lower(coalesce({d}, '')) when 'northbound' then 0 when 'eastbound' then 90 when 'southbound' then 180 when 'westbound' then 270 end"
BEARING = "(degrees(atan2(x1 - x0, y1 - y0)) + 360) % 360"


@query("j8_snap_events", f"""with c as (select concat('p', cast(event_id as string)) as closure_id, x, y, case cast(event_id % 5 as int) when 0 then 'Northbound' when 1 then 'Eastbound' when 2 then 'Southbound' when 3 then 'Westbound' end as direction from fx_report),
  pe as (select closure_id, direction, s.edge_id, min(round({psd('p.x', 'p.y', 's.ax', 's.ay', 's.ex', 's.ey')}, 6)) as dist from c p join fx_edge_seg s
    on p.x between least(s.ax, s.ex) - 30 and greatest(s.ax, s.ex) + 30 and p.y between least(s.ay, s.ey) - 30 and greatest(s.ay, s.ey) + 30 group by closure_id, direction, s.edge_id),
  ok as (select pe.*, {DIRECTION.format(d='direction')} as t, {BEARING} as b from pe join fx_edge e on e.edge_id = pe.edge_id where dist <= 30),
  f as (select *, min(dist) over (partition by closure_id) as m from ok where t is null or abs((b - t + 180 + 360) % 360 - 180) <= 60)
  select closure_id, edge_id, dist from f where dist <= m + 1""")
def _(T):
    k = F.col("event_id") % 5
    d = F.when(k == 0, "Northbound").when(k == 1, "Eastbound").when(k == 2, "Southbound").when(k == 3, "Westbound")
    pts = T.fx_report.select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("closure_id"), "x", "y", d.alias("direction"))
    return P.snap_events(pts, T.lines())


def _line(a):
    return [f"{a}.x0", f"{a}.y0", f"{a}.xm", f"{a}.ym", f"{a}.x1", f"{a}.y1"]


def _to(px, py, b):
    x0, y0, xm, ym, x1, y1 = _line(b)
    return f"least({psd(px, py, x0, y0, xm, ym)}, {psd(px, py, xm, ym, x1, y1)})"


def _hausdorff(a, b):
    return "greatest(" + ", ".join(_to(f"{p}.x{i}", f"{p}.y{i}", q) for p, q in ((a, b), (b, a)) for i in ("0", "m", "1")) + ")"


@query("j9_pair_twins", f"""with c as (select a.edge_id, b.edge_id as cand, round({_hausdorff('a', 'b')}, 6) as d from fx_edge a join fx_edge b on a.u = b.v and a.v = b.u and a.edge_id <> b.edge_id),
  best as (select edge_id, cand, d from (select *, row_number() over (partition by edge_id order by d, cand) as r from c where d <= 1) t where r = 1),
  m as (select a.edge_id, a.cand as twin_id, a.d as twin_m from best a join best b on a.cand = b.edge_id and b.cand = a.edge_id)
  select e.edge_id, m.twin_id, m.twin_m, least(e.edge_id, coalesce(m.twin_id, e.edge_id)) as street_id from fx_edge e left join m on m.edge_id = e.edge_id""")
def _(T):
    # derived once: where orders share a key, edges between two nodes may be numbered otherwise another time
    edges = stored(T.lines(kept=False).select("edge_id", "u", "v", "geom"))
    return P.pair_twins(edges).select("edge_id", "twin_id", "twin_m", "street_id")


ZONE_HIT = "{x} >= zx0 and {x} <= zx1 and {y} >= zy0 and {y} <= zy1"


@query("j3_point_in_zone", f"""with h as (select point_id, zone_id, row_number() over (partition by point_id order by priority desc, zone_id) as r from fx_point p join fx_zone z on {ZONE_HIT.format(x='p.x', y='p.y')})
  select p.point_id, h.zone_id from fx_point p left join h on h.point_id = p.point_id and r = 1""")
def _(T):
    z = T.zones().withColumn("zone_id", F.col("zone_id"))
    return P.point_in_zone(T.fx_point, z, "point_id", [-F.col("priority"), F.col("zone_id")], ["zone_id", "priority"], base=400.0).select("point_id", "zone_id")


@query("j3_fema_midpoints", """with m as (select edge_id, case when l1 >= l2 then x0 + (xm - x0) * (length / 2) / l1 else xm + (x1 - xm) * (length / 2 - l1) / l2 end as x,
    case when l1 >= l2 then y0 + (ym - y0) * (length / 2) / l1 else ym + (y1 - ym) * (length / 2 - l1) / l2 end as y
    from (select *, sqrt(power(xm - x0, 2) + power(ym - y0, 2)) as l1, sqrt(power(x1 - xm, 2) + power(y1 - ym, 2)) as l2 from fx_edge) t),
  h as (select edge_id, zone_id, row_number() over (partition by edge_id order by priority desc, zone_id) as r from (select edge_id, round(x, 6) as x, round(y, 6) as y from m) m
    join fx_zone z on m.x >= zx0 and m.x <= zx1 and m.y >= zy0 and m.y <= zy1) select e.edge_id, zone_id from fx_edge e left join h on h.edge_id = e.edge_id and r = 1""")
def _(T):
    mids = P.midpoints(T.lines()).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})
    return P.point_in_zone(mids, T.zones(), "edge_id", [-F.col("priority"), F.col("zone_id")], ["zone_id", "priority"], base=400.0).select("edge_id", "zone_id")


@query("j25_in_polygon", """select zone_id, edge_id from fx_zone join fx_edge on least(x0, xm, x1) >= zx0 and greatest(x0, xm, x1) <= zx1 and least(y0, ym, y1) >= zy0 and greatest(y0, ym, y1) <= zy1""")
def _(T):
    return P.in_polygon(T.lines(), T.zones(), "zone_id", base=400.0)


@query("a25_polygon_stats", """select zone_id, count(*) as edges, round(min(s.risk_score), 6) as risk_min, round(avg(s.risk_score), 6) as risk_avg, round(max(s.risk_score), 6) as risk_max,
  count(distinct s.street_id) as streets from fx_zone join fx_edge e on least(x0, xm, x1) >= zx0 and greatest(x0, xm, x1) <= zx1 and least(y0, ym, y1) >= zy0 and greatest(y0, ym, y1) <= zy1
  join fx_static s on s.edge_id = e.edge_id group by zone_id""")
def _(T):
    e = T.lines(kept=False).select("edge_id", "street_id", "geom", (((F.col("ok") * 37) % 1001) / 1000.0).alias("risk_score"))
    return r6(P.polygon_stats(e, T.zones(), "zone_id", base=400.0))


LOT_SEG = """ls as (select lot_id, x0 as cx, y0 as cy, x1 as dx, y0 as dy from fx_lot union all select lot_id, x1, y0, x1, y1 from fx_lot
  union all select lot_id, x1, y1, x0, y1 from fx_lot union all select lot_id, x0, y1, x0, y0 from fx_lot)"""
SEGSEG = (f"least({psd('ax', 'ay', 'cx', 'cy', 'dx', 'dy')}, {psd('ex', 'ey', 'cx', 'cy', 'dx', 'dy')}, {psd('cx', 'cy', 'ax', 'ay', 'ex', 'ey')}, {psd('dx', 'dy', 'ax', 'ay', 'ex', 'ey')})")
PROPER = ("(((ex-ax)*(cy-ay)-(ey-ay)*(cx-ax) > 0) <> ((ex-ax)*(dy-ay)-(ey-ay)*(dx-ax) > 0) and ((dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) > 0) <> ((dx-cx)*(ey-cy)-(dy-cy)*(ex-cx) > 0)"
          " and (ex-ax)*(cy-ay)-(ey-ay)*(cx-ax) <> 0 and (ex-ax)*(dy-ay)-(ey-ay)*(dx-ax) <> 0 and (dx-cx)*(ay-cy)-(dy-cy)*(ax-cx) <> 0 and (dx-cx)*(ey-cy)-(dy-cy)*(ex-cx) <> 0)")
LOT_EDGE = f"""{LOT_SEG}, le as (select lot_id, edge_id, min(round(case when {PROPER} then 0 else {SEGSEG} end, 6)) as dist from ls join fx_edge_seg s on not is_bridge
  and least(ax, ex) <= greatest(cx, dx) + 25 and greatest(ax, ex) >= least(cx, dx) - 25 and least(ay, ey) <= greatest(cy, dy) + 25 and greatest(ay, ey) >= least(cy, dy) - 25 group by lot_id, edge_id)"""


@query("j5_nearest_or_fallback", f"with {LOT_EDGE} select lot_id, edge_id, dist, 'adjacent' as access_method from le where dist <= 25")
def _(T):
    return P.nearest_or_fallback(T.lots(), T.lines().where(~F.col("is_bridge")))


@query("a7_access_roads", f"""with {LOT_EDGE}, k as (select le.lot_id, e.name, s.risk_score from le join fx_edge e on e.edge_id = le.edge_id join fx_static s on s.edge_id = le.edge_id where dist <= 25),
  n as (select lot_id, name, count(*) as c from k where name is not null group by lot_id, name),
  t as (select lot_id, string_agg(name, '; ' order by r) as access_roads from (select *, row_number() over (partition by lot_id order by c desc, name) as r from n) q where r <= 3 group by lot_id)
  select k.lot_id, count(*) as access_edges, round(min(risk_score), 6) as access_risk_min, round(max(risk_score), 6) as access_risk_max, any_value(t.access_roads) as access_roads
  from k left join t on t.lot_id = k.lot_id group by k.lot_id""")
def _(T):
    links = P.nearest_or_fallback(T.lots(), T.lines(kept=False).where(~F.col("is_bridge"))).join(T.fx_static.select("edge_id", "name", "risk_score"), "edge_id")
    return r6(P.access_roads(links))


@query("j14_nearest_node", """with d as (select p.point_id, node_id, round(sqrt(power(p.x - n.x, 2) + power(p.y - n.y, 2)), 6) as dist from fx_point p join fx_node n on abs(p.x - n.x) <= 200 and abs(p.y - n.y) <= 200)
  select point_id, node_id, dist, dist <= 60 as in_area from (select *, row_number() over (partition by point_id order by dist, node_id) as r from d) t where r = 1""")
def _(T):
    return P.nearest_node(T.fx_point, T.fx_node, 60.0).select("point_id", "node_id", "dist", "in_area")


@query("j20_sample_cells", f"""select p.point_id, c.z from fx_point p left join fx_cell c on c.cx = floor(p.x / 40) and c.cy = floor(p.y / {H})""")
def _(T):
    h = T.fx_n.select(F.ceil(F.col("n") / 40.0).cast("double").alias("h"))
    pts = T.fx_point.select("*", h.agg(F.max("h")).scalar().alias("h"))
    return P.sample_cells(pts, T.fx_cell, 0.0, 0.0, 40.0, F.col("h")).select("point_id", "z")


@query("j21_zonal_cells", f"""select lot_id, cx, cy from fx_lot join fx_cell on (cx + 0.5e0) * 40 between x0 and x1 and (cy + 0.5e0) * {H} between y0 and y1""")
def _(T):
    return P.zonal_cells(T.lots(), T.fx_cell, "lot_id", 0.0, 0.0, 40.0, _cell_h(T)).select("lot_id", "cx", "cy")


@query("j21_zonal_touched", f"""select lot_id, cx, cy from fx_lot join fx_cell on cx * 40 <= x1 and cx * 40 + 40 >= x0 and cy * {H} <= y1 and cy * {H} + {H} >= y0""")
def _(T):
    return P.zonal_cells(T.lots(), T.fx_cell, "lot_id", 0.0, 0.0, 40.0, _cell_h(T), all_touched=True).select("lot_id", "cx", "cy")


@query("a6_zonal_stats", f"""select lot_id, count(z) as cells, round(quantile_cont(z, 0.1), 9) as elev_p10, round(quantile_cont(z, 0.5), 9) as elev_median, round(avg(case when depth >= 0.1e0 then 1e0 else 0e0 end), 9) as pond_frac,
  round(quantile_cont(depth, 0.9), 9) as pond_depth_p90, round(max(depth), 9) as pond_depth_max, round(avg(z), 9) as elev_mean
  from fx_lot join fx_cell on (cx + 0.5e0) * 40 between x0 and x1 and (cy + 0.5e0) * {H} between y0 and y1 group by lot_id""")
def _(T):
    out = P.zonal_stats(P.zonal_cells(T.lots(), T.fx_cell, "lot_id", 0.0, 0.0, 40.0, _cell_h(T)), "lot_id")
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


WET = """wet as (select cx, cy, depth, cy * 1000000000 + cx as id from fx_cell where depth >= 0.15e0),
  adj as (select a.id as a, b.id as b from wet a join wet b on (a.cy = b.cy and abs(a.cx - b.cx) = 1) or (a.cx = b.cx and abs(a.cy - b.cy) = 1)),
  reach(a, b) as (select id, id from wet union select reach.a, adj.b from reach join adj on adj.a = reach.b),
  comp as (select w.cx, w.cy, w.depth, c.component from wet w join (select a, min(b) as component from reach group by a) c on c.a = w.id)"""


def _wet(T):
    return N.cell_components(T.fx_cell.where("depth >= 0.15").select("cx", "cy", "depth"))


@query("g2_cell_components", f"with recursive {WET} select cx, cy, component from comp")
def _(T):
    return _wet(T).select("cx", "cy", "component")


@query("a24_hotspot_stats", f"""with recursive {WET} select component, count(*) * 40 * {H} as area_m2, round(max(depth), 6) as depth_max_m, round(avg(depth), 6) as depth_mean_m from comp
  group by component having count(*) * 40 * {H} >= 2000""")
def _(T):
    return r6(P.hotspot_stats(_wet(T), 40.0 * _cell_h(T), 2000.0))


@query("t6_number_rows", f"""with recursive {WET}, h as (select component, count(*) * 40 * {H} as area_m2, round(max(depth), 6) as depth_max_m from comp group by component)
  select component, concat('hs_', lpad(cast(row_number() over (order by depth_max_m desc, area_m2 desc, component) as varchar), 3, '0')) as hotspot_id from h""")
def _(T):
    from highwater.operators.ranges import number_rows
    h = r6(P.hotspot_stats(_wet(T), 40.0 * _cell_h(T), 0.0), "depth_max_m")
    n = number_rows(h, [F.desc("depth_max_m"), F.desc("area_m2"), F.asc("component")])
    s = F.col("row_number").cast("string")
    return n.select("component", F.concat(F.lit("hs_"), F.when(F.length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)).alias("hotspot_id"))


@query("j22_touching_lots", f"""with recursive {WET} select component, string_agg(distinct name, '; ' order by name) as names from comp join fx_lot
  on cx * 40 <= x1 and cx * 40 + 40 >= x0 and cy * {H} <= y1 and cy * {H} + {H} >= y0 group by component""")
def _(T):
    return P.touching_names(_wet(T), T.lots(), None, 0.0, 0.0, 40.0, _cell_h(T))


CLIP = ("greatest(0, case when {d} = 0 then (case when {a} between {lo} and {hi} then 0 else 2 end) else least(({lo} - {a}) / nullif({d}, 0), ({hi} - {a}) / nullif({d}, 0)) end",
        "least(1, case when {d} = 0 then 1 else greatest(({lo} - {a}) / nullif({d}, 0), ({hi} - {a}) / nullif({d}, 0)) end")


def clip_hits(x0, y0, x1, y1, ax="ax", ay="ay", bx="ex", by="ey"):
    ex = CLIP[0].format(d=f"({bx}-{ax})", a=ax, lo=x0, hi=x1) + ")"
    ey = CLIP[0].format(d=f"({by}-{ay})", a=ay, lo=y0, hi=y1) + ")"
    lx = CLIP[1].format(d=f"({bx}-{ax})", a=ax, lo=x0, hi=x1) + ")"
    ly = CLIP[1].format(d=f"({by}-{ay})", a=ay, lo=y0, hi=y1) + ")"
    return f"greatest({ex}, {ey}) <= least({lx}, {ly})"


@query("j22_touching_roads", f"""with recursive {WET}, s as (select e.name, ax / 40 as ax, ay / {H} as ay, ex / 40 as ex, ey / {H} as ey from fx_edge_seg g join fx_edge e on e.edge_id = g.edge_id where e.name is not null),
  t as (select distinct component, name from comp join s on cx <= greatest(ax, ex) + 1e-9 and cx + 1 >= least(ax, ex) - 1e-9 and cy <= greatest(ay, ey) + 1e-9 and cy + 1 >= least(ay, ey) - 1e-9 and {clip_hits('(cx - 1e-9)', '(cy - 1e-9)', '(cx + 1 + 1e-9)', '(cy + 1 + 1e-9)')})
  select component, string_agg(name, '; ' order by name) as names from (select *, row_number() over (partition by component order by name) as r from t) q where r <= 4 group by component""")
def _(T):
    return P.touching_names(_wet(T), None, T.lines(), 0.0, 0.0, 40.0, _cell_h(T), limit=4)


@query("j23_drop_covered", f"""with recursive {WET}, i as (select distinct component, cx, cy from comp join fx_lot on (cx + 0.5e0) * 40 between x0 and x1 and (cy + 0.5e0) * {H} between y0 and y1),
  s as (select c.component, coalesce(n, 0) / count(*) as share from comp c left join (select component, count(*) as n from i group by component) k on k.component = c.component group by c.component, n)
  select c.component, c.cx, c.cy from comp c join s on s.component = c.component where share <= 0.5""")
def _(T):
    return P.drop_covered(_wet(T), T.lots(), "lot_id", 0.0, 0.0, 40.0, _cell_h(T)).select("component", "cx", "cy")


# ------------------------------------------------------------------ expressions over lines
@query("x1_flat_distance", """select point_id, round(sqrt(power((-79.99e0 - -80e0) * 111320 * cos(radians(25 + y / 10000)), 2) + power(((25 + y / 10000) + x / 1000000 - (25 + y / 10000)) * 110540, 2)), 6) as m from fx_point""")
def _(T):
    lat = 25 + F.col("y") / 10000
    return T.fx_point.select("point_id", F.round(G.flat_distance_m(F.lit(-80.0), lat, F.lit(-79.99), lat + F.col("x") / 1000000), 6).alias("m"))


PTS = """l as (select *, sqrt(power(xm - x0, 2) + power(ym - y0, 2)) as l1, sqrt(power(x1 - xm, 2) + power(y1 - ym, 2)) as l2 from fx_edge)"""
AT = "case when {d} <= l1 then x0 + (xm - x0) * {d} / l1 else xm + (x1 - xm) * ({d} - l1) / l2 end"


@query("x3_sample_line", f"""with {PTS}, n as (select *, greatest(5, cast(ceil((l1 + l2) / 10) as int) + 1) as n from l),
  s as (select edge_id, n, i, (l1 + l2) * i / (n - 1) as d, l1, l2, x0, y0, xm, ym, x1, y1 from n, unnest(range(0, n)) as t(i))
  select edge_id, count(*) as n, round(avg({AT.format(d='d')}), 6) as x, round(avg({AT.format(d='d').replace('x', 'y')}), 6) as y from s group by edge_id""")
def _(T):
    s = P.sample_points(T.lines())
    return r6(s.groupBy("edge_id").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y")))


@query("x4_point_at", f"""with {PTS}, d as (select *, (l1 + l2) * 0.3e0 as d from l) select edge_id, round({AT.format(d='d')}, 6) as x, round({AT.format(d='d').replace('x', 'y')}, 6) as y from d""")
def _(T):
    return r6(T.lines().select("edge_id", G.point_at("geom", F.lit(0.3)).alias("p")).select("edge_id", "p.x", "p.y"))


@query("x5_dist_to_line", f"select edge_id, round({_to('x0 + 30', 'y0 - 20', 'e')}, 6) as d from fx_edge e")
def _(T):
    return r6(T.lines().select("edge_id", G.dist_to_line(G.point(F.col("x0") + 30, F.col("y0") - 20), "geom").alias("d")))


# a border point counts by which side of it the polygon lies; ``covered`` takes the whole border in
@query("x6_in_rings", """with k as (select lot_id, s_suppkey % 60 as x, s_suppkey % 40 as y from fx_lot),
  b as (select *, not (x >= 20 and x < 40 and y >= 10 and y < 30) as inside, x = 0 or y = 0 or (x in (20, 40) and y between 10 and 30) or (y in (10, 30) and x between 20 and 40) as on_border from k)
  select lot_id, inside, on_border, inside or on_border as covered from b""")
def _(T):
    k = F.col("s_suppkey")
    hole = G.box_ring(F.col("x0") + 20, F.col("y0") + 10, F.col("x0") + 40, F.col("y0") + 30)
    lots = T.lots().withColumn("rings", F.concat("rings", hole)).withColumn("p", G.point(F.col("x0") + k % 60, F.col("y0") + k % 40))
    return lots.select("lot_id", G.in_rings("p", "rings").alias("inside"), G.on_boundary("p", "rings").alias("on_border"), G.covers("rings", "p").alias("covered"))


@query("f29_campus_lots", """select zone_id as campus_id, concat('way/', cast(s_suppkey as string)) as osm_id, case when s_suppkey % 4 = 0 then 'garage' else 'surface' end as type
  from fx_lot join fx_zone on zone_id % 3 = 0 and x > zx0 and x < zx1 and y > zy0 and y < zy1""")
def _(T):
    k = F.col("s_suppkey")
    f = T.lots().select(F.concat(F.lit("way/"), k.cast("string")).alias("osm_id"), "name", F.when(k % 4 == 0, "multi-storey").alias("parking"), "rings")
    campuses = T.zones().where("zone_id % 3 = 0").select(F.col("zone_id").alias("campus_id"), "rings")
    return P.campus_lots(f, campuses).select("campus_id", "osm_id", "type")


@query("x7_line_length", "select edge_id, round(length, 6) as length from fx_edge")
def _(T):
    return r6(T.lines().select("edge_id", G.line_length("geom").alias("length")))


@query("x8_bearing", f"select edge_id, round({BEARING}, 6) as b from fx_edge")
def _(T):
    return r6(T.lines().select("edge_id", G.bearing("geom").alias("b")))


@query("x9_heads_toward", f"""select e.edge_id, d.t is null or abs((({BEARING}) - d.t + 180 + 360) % 360 - 180) <= 60 as ok from fx_edge e join
  (select edge_id, {DIRECTION.format(d='direction')} as t from fx_closure) d on d.edge_id = e.edge_id""")
def _(T):
    c = T.fx_closure.select("edge_id", "direction")
    return T.lines().join(c, "edge_id").select("edge_id", G.heads_toward(G.bearing("geom"), "direction").alias("ok"))


@query("x10_hausdorff", f"select a.edge_id as a, b.edge_id as b, round({_hausdorff('a', 'b')}, 6) as d from fx_edge a join fx_edge b on a.u = b.u and a.v = b.v and a.key < b.key")
def _(T):
    e = T.lines().select("u", "v", "key", "edge_id", "geom")
    a = e.select("u", "v", F.col("key").alias("ka"), F.col("edge_id").alias("a"), F.col("geom").alias("ga"))
    b = e.select("u", "v", F.col("key").alias("kb"), F.col("edge_id").alias("b"), F.col("geom").alias("gb"))
    return r6(a.join(b, ["u", "v"]).where("ka < kb").select("a", "b", G.hausdorff("ga", "gb").alias("d")))


@query("f22_drop_repeated_vertices", "select edge_id, case when ok % 2 = 0 then 3 end as n from fx_edge")
def _(T):
    p0, pm, p1 = (G.point(f"x{i}", f"y{i}") for i in ("0", "m", "1"))
    g = F.when(F.col("ok") % 2 == 0, F.array(p0, p0, pm, p1, p1)).otherwise(F.array(p0, p0, p0))
    return T.fx_edge.select("edge_id", F.size(G.drop_repeated_vertices(g)).cast("int").alias("k")).select("edge_id", F.when(F.col("k") > 0, F.col("k")).alias("n"))


@query("t5_thin_path", """select u as route_id, count(*) as n, least(count(*), 6) as kept, round(sum(case when c <= 6 or i in (0, round_even((c - 1) / 5e0, 0), round_even(2 * ((c - 1) / 5e0), 0), round_even(3 * ((c - 1) / 5e0), 0), round_even(4 * ((c - 1) / 5e0), 0), round_even(5 * ((c - 1) / 5e0), 0)) then x0 + y0 * 3 else 0 end), 6) as s
  from (select u, x1 as x0, y1 as y0, row_number() over (partition by u order by ok, edge_id) - 1 as i, count(*) over (partition by u) as c from fx_edge) t group by u""")
def _(T):
    g = T.fx_route_edge.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("seq", F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("g"))
    g = g.withColumn("t", G.thin_path(F.transform("g", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), 6))
    return r6(g.select("route_id", F.size("g").cast("bigint").alias("n"), F.size("t").cast("bigint").alias("kept"), F.aggregate("t", F.lit(0.0), lambda a, p: a + p["x"] + p["y"] * 3).alias("s")))


@query("x36_join_paths", """with e as (select u, ok, edge_id, x0, y0, xm, ym, x1, y1 from fx_edge where ok in (select ok from fx_edge group by ok having count(*) = 2))
  select a.edge_id, 5 as n, round(a.x0 + a.xm + a.x1 + b.xm + b.x1, 6) as sx from e a join e b on a.edge_id < b.edge_id and exists (select 1 from fx_edge f join fx_edge g on f.ok = g.ok where f.edge_id = a.edge_id and g.edge_id = b.edge_id)""")
def _(T):
    e = T.lines().select("ok", "edge_id", "geom")
    b = e.select("ok", F.col("edge_id").alias("other"), F.col("geom").alias("g2"))
    j = e.join(b, "ok").where(F.col("edge_id") < F.col("other")).withColumn("path", G.join_paths(F.array("geom", "g2")))
    return r6(j.select("edge_id", F.size("path").alias("n"), F.aggregate("path", F.lit(0.0), lambda a, p: a + p["x"]).alias("sx")))


@query("f16_map_box", f"""with e as (select s.edge_id, s.street_id, s.risk_score, case when s.risk_score >= 0.6 then 2 when s.risk_score >= 0.35 then 1 else 0 end as rk from fx_static s where s.edge_id = s.street_id),
  h as (select distinct zone_id, g.edge_id from fx_zone join fx_edge_seg g on least(ax, ex) <= zx1 and greatest(ax, ex) >= zx0 and least(ay, ey) <= zy1 and greatest(ay, ey) >= zy0 where {clip_hits('zx0', 'zy0', 'zx1', 'zy1')}),
  r as (select h.zone_id as box_id, e.*, row_number() over (partition by h.zone_id order by rk desc, risk_score desc, e.edge_id) as position, count(*) over (partition by h.zone_id) as c from h join e on e.edge_id = h.edge_id where rk >= 1),
  cl as (select distinct street_id from fx_closure c join fx_edge g on g.edge_id = c.edge_id where coalesce(full_closure, false) and start <= timestamp '1998-06-01' and ("end" is null or "end" >= timestamp '1998-06-01'))
  select box_id, position, edge_id, risk_score as score, case rk when 2 then 'high' else 'medium' end as label, cl.street_id is not null as closed, c > 200 as truncated from r left join cl on cl.street_id = r.street_id where position <= 200""")
def _(T):
    streets = C.street_rows(T.lines())
    from highwater.functions.scoring import cutoff_label
    risk = T.fx_static.select("edge_id", "street_id", F.col("risk_score").alias("score"), cutoff_label("risk_score").alias("label"))
    boxes = T.fx_zone.select(F.col("zone_id").alias("box_id"), F.col("zx0").alias("x0"), F.col("zy0").alias("y0"), F.col("zx1").alias("x1"), F.col("zy1").alias("y1"), F.lit("medium").alias("min_label"))
    closed = C.active_at(T.fx_closure, "1998-06-01 00:00:00").where("full_closure").join(T.fx_edge.select("edge_id", "street_id"), "edge_id").select("street_id")
    return V.map_box(streets, risk, boxes, closed, limit=200).select("box_id", "position", "edge_id", "score", "label", "closed", "truncated")


@query("f15_street_rows", "select edge_id from fx_edge where edge_id = street_id")
def _(T):
    return C.street_rows(T.fx_edge).select("edge_id")


@query("drain_layer", f"""with {POINT_EDGE} select e.edge_id, coalesce(n, 0)::int as drain_count, round(coalesce(n, 0) / length * 100, 6) as drains_per_100m from fx_edge e left join (select edge_id, count(*) as n from pe where dist <= 50 group by edge_id) c on c.edge_id = e.edge_id""")
def _(T):
    return r6(L.drain_layer(P.count_within(T.fx_point, T.lines(), 50.0), T.fx_edge))
