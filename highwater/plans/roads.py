"""Registered queries: layers, risk score, filters, audits."""
from pyspark.sql import functions as F

from highwater.functions import scoring as S, text as X
from highwater.operators import checks as C, layers as L, metrics as M, serving as V
from highwater.plans.registry import query, r6, text, ts
from highwater.sources.readers import clean_cells

RISK_SQL = """
with fema as (select edge_id, case when coalesce(sfha, false) then 3 when zone = 'X' and subtype like '0.2%' then 2
    when zone = 'X' and subtype like 'AREA%' then 1 else 0 end as lvl from fx_fema),
elev as (select e.edge_id, max(z) as zmax, quantile_cont(z, 0.1) as p10, quantile_cont(depth, 0.9) as sink
    from fx_edge e left join fx_sample s on s.edge_id = e.edge_id group by e.edge_id),
days as (select e.edge_id, count(distinct case when l.category = 'flood' then l.date end) as flood_days
    from fx_edge e left join fx_link l on l.edge_id = e.edge_id group by e.edge_id),
pct as (select e.edge_id, case when d.flood_days > 0 then
      (rank() over (partition by e.jurisdiction, d.flood_days > 0 order by d.flood_days)
       + (count(*) over (partition by e.jurisdiction, d.flood_days) - 1) / 2e0)
      / count(*) over (partition by e.jurisdiction, d.flood_days > 0) else 0 end as p
    from fx_edge e join days d on d.edge_id = e.edge_id),
parts as (select e.edge_id, e.street_id, e.name, e.length, e.is_bridge, f.lvl / 3e0 as a,
      case when coalesce(v.zmax < 0 and not e.is_bridge, false) then null when v.p10 is null then null
        else 1 - least(greatest((v.p10 - 0.5e0) / 4.5e0, 0), 1) end as b, pct.p as c,
      case when v.sink is null then null else least(greatest(v.sink, 0), 1) end as g,
      coalesce(v.zmax < 0 and not e.is_bridge, false) as wet
    from fx_edge e join fema f on f.edge_id = e.edge_id join elev v on v.edge_id = e.edge_id join pct on pct.edge_id = e.edge_id),
raw as (select *, (0.35e0 * a + coalesce(0.25e0 * b, 0) + 0.2e0 * c + coalesce(0.1e0 * g, 0))
      / (0.35e0 + case when b is null then 0 else 0.25e0 end + 0.2e0 + case when g is null then 0 else 0.1e0 end) as s from parts),
risk as (select edge_id, street_id, name, length, case when is_bridge then least(s, 0.1e0) else s end as risk_score,
      case when is_bridge then 'bridge_capped' when wet then 'elev_water_only' end as score_note from raw)
"""


def layers(T):
    edges, samples = T.fx_edge, T.fx_sample
    return {"fema": L.fema_layer(T.fx_fema).drop("zone_subtype"),
            "elevation": L.elevation_features(samples, edges).select("edge_id", "elev_mean", "elev_min", "elev_p10", "elev_water_only"),
            "lowpoints": L.ponding_features(samples),
            "reports": L.report_days(T.fx_link, edges)}


def scored(T):
    return L.build_segments(T.fx_edge, layers(T))


@query("segment_risk", RISK_SQL + "select edge_id, round(risk_score, 6) as risk_score, score_note from risk")
def _(T):
    return r6(scored(T).select("edge_id", "risk_score", "score_note"))


@query("a8_street_summary", RISK_SQL + """select street_id, first(name order by edge_id) filter (where name is not null) as name,
  round(max(risk_score), 6) as risk_score, count(*) as edges, round(max(length), 6) as length_m,
  max(risk_score) = (select max(risk_score) from risk) as at_top from risk group by street_id""")
def _(T):
    return r6(L.street_summary(scored(T)))


@query("t1_top_streets", RISK_SQL + """select street_id, round(max(risk_score), 6) as risk_score, round(max(length), 6) as length_m
  from risk group by street_id order by round(max(risk_score), 6) desc, round(max(length), 6) desc, street_id limit 20""")
def _(T):
    s = r6(L.street_summary(scored(T)).select("street_id", "risk_score", "length_m"))
    return L.top_n(s, [F.desc("risk_score"), F.desc("length_m"), F.col("street_id")], 20)


@query("s1_read_layer", """select l_orderkey as ok, sum(cast(l_quantity as bigint))::bigint as qty from lineitem
  where l_quantity > 30 group by l_orderkey""")
def _(T):
    from highwater.sources.readers import read_layer
    df = read_layer(T.spark, f"{T.path}/lineitem.parquet", ["l_orderkey", "l_quantity"])
    return df.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("ok")).agg(F.sum(F.col("l_quantity").cast("bigint")).alias("qty"))


@query("s11_read_cells", "select cx, cy, case when cx % 10 = 3 or cy % 10 = 4 then null else z end as z from fx_cell")
def _(T):
    z = F.when(F.col("cx") % 10 == 3, -9999.0).when(F.col("cy") % 10 == 4, float("nan")).otherwise(F.col("z"))
    return clean_cells(T.fx_cell.select("cx", "cy", z.alias("z")), -9999.0)


@query("j1_join_layers", """select 'fema' as layer, count(*) as rows, 0::bigint as duplicate_keys, 0::bigint as unmatched from fx_fema
  union all select 'sink', count(*), 0, sum(case when e.edge_id is null then 1 else 0 end)::bigint
    from (select distinct l_orderkey as ok from lineitem) l left join (select min(edge_id) as edge_id, ok from fx_edge group by ok) e on e.ok = l.ok""")
def _(T):
    ids = T.fx_edge.groupBy("ok").agg(F.min("edge_id").alias("edge_id"))
    sink = T.lineitem.select(F.col("l_orderkey").alias("ok")).distinct().join(ids, "ok", "left").select(
        F.coalesce("edge_id", F.concat(F.lit("lost_"), F.col("ok").cast("string"))).alias("edge_id"), F.lit(1).alias("has_lines"))
    return L.join_layers(T.fx_edge, {"fema": T.fx_fema, "sink": sink})[1]


@query("j2_join_checked", "select s.edge_id, f.zone from fx_edge s left join fx_fema f on f.edge_id = s.edge_id")
def _(T):
    return C.join_checked(T.fx_edge.select("edge_id"), T.fx_fema.select("edge_id", "zone"), "edge_id", cardinality="one_to_one")


@query("f3_zone_risk_level", """select edge_id, case when coalesce(sfha, false) then 3 when zone = 'X' and subtype like '0.2%' then 2
  when zone = 'X' and subtype like 'AREA%' then 1 else 0 end as lvl from fx_fema""")
def _(T):
    return T.fx_fema.select("edge_id", S.zone_risk_level("zone", "subtype", "sfha").alias("lvl"))


@query("a1_report_days", """select e.edge_id, count(distinct case when category = 'flood' then l.date end)::int as flood_report_days,
  count(distinct case when category = 'drain' then l.date end)::int as drain_issue_days
  from fx_edge e left join fx_link l on l.edge_id = e.edge_id group by e.edge_id""")
def _(T):
    return L.report_days(T.fx_link, T.fx_edge)


@query("a2_street_table", """with m as (select street_id, edge_id, jurisdiction, is_bridge, elev_water_only, is_tunnel::int as is_tunnel,
    case when elev_water_only then null else elev_p10 end as elev_p10, case when fema_risk_level in (1,2,3) then fema_risk_level end as fema_risk_level,
    case when sink_p90 >= 0 then sink_p90 end as sink_p90, case when length >= 0 then length end as length, case when drain_count >= 0 then drain_count end as drain_count
    from fx_static)
  select street_id, round(avg(fema_risk_level), 6) as fema_risk_level, round(avg(elev_p10), 6) as elev_p10, round(avg(sink_p90), 6) as sink_p90,
    round(avg(length), 6) as length, round(avg(drain_count), 6) as drain_count, round(avg(is_tunnel), 6) as is_tunnel,
    bool_or(is_bridge) as is_bridge, bool_or(elev_water_only) as elev_water_only, min_by(jurisdiction, edge_id) as jurisdiction from m group by street_id""")
def _(T):
    return r6(L.street_table(T.fx_static))


@query("a3_elevation_features", """select e.edge_id, round(avg(z), 6) as elev_mean, round(min(z), 6) as elev_min,
  round(case when coalesce(max(z) < 0 and not any_value(e.is_bridge), false) then null else quantile_cont(z, 0.1) end, 6) as elev_p10,
  coalesce(max(z) < 0 and not any_value(e.is_bridge), false) as elev_water_only, count(s.edge_id) as n_samples,
  count(s.edge_id) - count(s.z) as n_null from fx_edge e left join fx_sample s on s.edge_id = e.edge_id group by e.edge_id""")
def _(T):
    return r6(L.elevation_features(T.fx_sample, T.fx_edge))


@query("a4_ponding_features", "select edge_id, round(max(depth), 6) as sink_depth, round(quantile_cont(depth, 0.9), 6) as sink_p90 from fx_sample group by edge_id")
def _(T):
    return r6(L.ponding_features(T.fx_sample))


@query("a5_freeboard_features", """select edge_id, round(avg(criteria), 6) as flood_criteria_m, round(quantile_cont(z - criteria, 0.1), 6) as freeboard_p10_m,
  round(avg(case when z is null then null when z - criteria < 0 then 1e0 else 0e0 end), 6) as below_criteria_frac from fx_sample group by edge_id""")
def _(T):
    return r6(L.freeboard_features(T.fx_sample))


@query("w2_pct_within", """with d as (select e.edge_id, e.jurisdiction, count(distinct case when category = 'flood' then l.date end) as n
    from fx_edge e left join fx_link l on l.edge_id = e.edge_id group by e.edge_id, e.jurisdiction)
  select edge_id, round(case when n > 0 then (rank() over (partition by jurisdiction, n > 0 order by n)
    + (count(*) over (partition by jurisdiction, n) - 1) / 2e0) / count(*) over (partition by jurisdiction, n > 0) else 0 end, 6) as pct from d""")
def _(T):
    d = L.report_days(T.fx_link, T.fx_edge).join(T.fx_edge.select("edge_id", "jurisdiction"), "edge_id")
    return r6(L.pct_within(d, "flood_report_days", "jurisdiction", "pct").select("edge_id", "pct"))


@query("x11_scale01", """select edge_id, round(case when length is null then null else least(greatest((length - 50e0) / 100e0, 0), 1) end, 6) as fixed,
  round(1 - least(greatest((length - 50e0) / 100e0, 0), 1), 6) as inverted, round(least(greatest((length - 150e0) / -100e0, 0), 1), 6) as descending,
  round((length - (select min(length) from fx_edge)) / (select max(length) - min(length) from fx_edge), 6) as by_data, 0e0 as empty_range from fx_edge""")
def _(T):
    e = L.scale_by_data(T.fx_edge, "length", "by_data")
    return r6(e.select("edge_id", S.scale01("length", 50.0, 150.0).alias("fixed"), S.scale01("length", 50.0, 150.0, True).alias("inverted"),
                       S.scale01("length", 150.0, 50.0).alias("descending"), "by_data", S.scale01("length", 5.0, 5.0).alias("empty_range")))


@query("x12_weighted_mean", """select edge_id, round((coalesce(elev_p10 * 0.25e0, 0) + coalesce(sink_p90 * 0.1e0, 0) + coalesce(nullif(drain_count, 3) * 0.65e0, 0))
  / nullif(case when elev_p10 is null then 0 else 0.25e0 end + case when sink_p90 is null then 0 else 0.1e0 end
  + case when nullif(drain_count, 3) is null then 0 else 0.65e0 end, 0), 6) as m from fx_static""")
def _(T):
    s = T.fx_static.withColumn("drain_count", F.nullif("drain_count", F.lit(3.0)))
    return r6(s.select("edge_id", S.weighted_mean({"elev_p10": 0.25, "sink_p90": 0.1, "drain_count": 0.65}).alias("m")))


@query("x13_physical_baseline", """with p as (select street_id, fema_risk_level / 3e0 as a,
    case when elev_p10 is null then null else 1 - least(greatest((elev_p10 - 0.5e0) / 4.5e0, 0), 1) end as b,
    case when sink_p90 is null then null else least(greatest(sink_p90, 0), 1) end as c from fx_street),
  k as (select *, case when a is null then 0 else 0.35e0 end + case when b is null then 0 else 0.25e0 end + case when c is null then 0 else 0.1e0 end as w from p)
  select street_id, round(coalesce((coalesce(a * 0.35e0, 0) + coalesce(b * 0.25e0, 0) + coalesce(c * 0.1e0, 0)) / nullif(w, 0), 0.5e0), 6) as physical,
    round(w / 0.7e0, 6) as coverage from k""")
def _(T):
    return r6(S.physical_baseline(T.fx_street).select("street_id", "physical", "coverage"))


@query("x14_bridge_cap", """select edge_id, case when is_bridge then least(risk_score, 0.1e0) else risk_score end as risk_score,
  case when is_bridge then 'bridge_capped' when elev_water_only then 'elev_water_only' end as score_note from fx_static""")
def _(T):
    return S.apply_bridge_cap(T.fx_static).select("edge_id", "risk_score", "score_note")


@query("x15_per_100m", "select edge_id, round(drain_count / nullif(length, 0) * 100, 6) as drains_per_100m from fx_static")
def _(T):
    return r6(T.fx_static.select("edge_id", S.per_100m("drain_count", "length").alias("drains_per_100m")))


# ------------------------------------------------------------------ filters
@query("f1_is_tagged", "select p_partkey, p_size % 3 <> 0 or p_size % 4 = 1 as tagged from part")
def _(T):
    tags = F.array(F.when(F.col("p_size") % 3 == 0, "no").otherwise(F.col("p_type")),
                   F.when(F.col("p_size") % 4 == 1, "viaduct").when(F.col("p_size") % 2 == 0, "no"))
    return T.part.select("p_partkey", X.is_tagged(tags).alias("tagged"))


@query("f2_join_tags", """select p_partkey, case when p_size % 7 = 0 then null when p_size % 2 = 0 then concat(p_brand, ';', p_type) else p_brand end as joined from part""")
def _(T):
    tags = F.when(F.col("p_size") % 7 == 0, None).when(F.col("p_size") % 2 == 0, F.array("p_brand", "p_type")).otherwise(F.array("p_brand"))
    return T.part.select("p_partkey", X.join_tags(tags).alias("joined"))


@query("f4_locate", """with r as (select point_id, case when point_id % 5 = 0 then null when point_id % 7 = 0 then 0 else x end as lon, y as lat, x + 1 as px, y + 2 as py from fx_point),
  l as (select point_id, lon is null or lat is null or lon = 0 or lat = 0 as from_xy, lon, lat, px, py from r),
  c as (select point_id, from_xy, case when from_xy then px else lon end as lon, case when from_xy then py else lat end as lat from l)
  select * from c where lon between 500 and 3000 and lat between 500 and 2500""")
def _(T):
    i = F.col("point_id")
    r = T.fx_point.select(i, F.when(i % 5 == 0, None).when(i % 7 == 0, 0.0).otherwise(F.col("x")).alias("lon"), F.col("y").alias("lat"),
                          (F.col("x") + 1).alias("px"), (F.col("y") + 2).alias("py"))
    return C.locate(r, (500, 500, 3000, 2500)).select("point_id", "from_xy", "lon", "lat")


@query("f5_categorise", """select event_id, case event_type when 'error' then 'flood' else 'drain' end as category from events
  where event_type in ('error', 'signup', 'purchase')""")
def _(T):
    return C.categorise(T.events, "event_type", ["error"], ["signup", "purchase"]).select("event_id", "category")


@query("f6_since", """select event_id, cast(cast(timezone('America/New_York', timezone('UTC', ts)) as date) as varchar) as date from events
  where cast(timezone('America/New_York', timezone('UTC', ts)) as date) >= date '2024-01-10'""")
def _(T):
    return text(C.since(T.events, "2024-01-10").select("event_id", "date"), "date")


@query("f7_active_at", """select edge_id, coalesce(full_closure, false) as full_closure from fx_closure
  where start <= timestamp '1998-06-01' and ("end" is null or "end" >= timestamp '1998-06-01')""")
def _(T):
    return C.active_at(T.fx_closure, "1998-06-01 00:00:00").select("edge_id", "full_closure")


@query("f8_clean_floats", "select event_id, case when event_type in ('view', 'click', 'error') then null else value end as value from events")
def _(T):
    k = F.col("event_type")
    v = F.when(k == "view", float("nan")).when(k == "click", float("inf")).when(k == "error", float("-inf")).otherwise(F.col("value"))
    return L.clean_floats(T.events.select("event_id", v.alias("value")))


@query("f9_mask_implausible", """select edge_id, case when elev_water_only then null else elev_p10 end as elev_p10,
  case when fema_risk_level in (1,2,3) then fema_risk_level end as fema_risk_level, case when sink_p90 >= 0 then sink_p90 end as sink_p90,
  case when drain_count >= 0 then drain_count end as drain_count, round(case when length >= 0 then length end, 6) as length from fx_static""")
def _(T):
    return r6(L.mask_implausible(T.fx_static).select("edge_id", "elev_p10", "fema_risk_level", "sink_p90", "drain_count", "length"), "length")


PROJECTS = """p as (select o_orderkey as project_id, case o_orderpriority when '1-URGENT' then 'FDOT' else o_orderpriority end as agency,
  case o_orderstatus when 'P' then 'Closed' else o_orderstatus end as status, o_orderdate as s, o_orderdate + to_days(cast(o_custkey % 1000 as integer)) as e,
  o_orderkey % 9 = 0 as nogeom, date_diff('day', o_orderdate, o_orderdate + to_days(cast(o_custkey % 1000 as integer))) as days from orders)"""


def _projects(T):
    o = T.orders
    return o.select(F.col("o_orderkey").alias("project_id"), F.when(F.col("o_orderpriority") == "1-URGENT", "FDOT").otherwise(F.col("o_orderpriority")).alias("agency"),
                    F.when(F.col("o_orderstatus") == "P", "Closed").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("start"),
                    F.expr("o_orderdate + make_dt_interval(cast(o_custkey % 1000 as int))").alias("end"),
                    F.when(F.col("o_orderkey") % 9 != 0, F.lit("geom")).alias("geom"))


@query("f10_keep_projects", f"""with {PROJECTS} select project_id from p where agency <> 'FDOT' and status <> 'Closed' and e >= timestamp '1998-01-01'
  and days <= 730 and not nogeom""")
def _(T):
    return C.keep_projects(_projects(T), "1998-01-01 00:00:00")[0].select("project_id")


@query("f10_project_drops", f"""with {PROJECTS} select count(*) as total, count(*) filter (where agency <> 'FDOT' and status <> 'Closed' and e >= timestamp '1998-01-01'
  and days <= 730 and not nogeom) as kept, count(*) filter (where agency = 'FDOT') as agency, count(*) filter (where status = 'Closed') as complete,
  count(*) filter (where e < timestamp '1998-01-01') as ended, count(*) filter (where days > 730) as too_long from p""")
def _(T):
    return C.keep_projects(_projects(T), "1998-01-01 00:00:00")[1]


@query("f17_suggestable", """select lot_id from fx_lot where name not like '%Unnamed%' and name not like '%Loading Area%' and name not like '%Staff%'
  and name not like '%Compound%' and coalesce(access, '') <> 'private'""")
def _(T):
    return C.suggestable(T.fx_lot).select("lot_id")


@query("f18_in_person", """select event_id from fx_event where location is not null and location <> ''
  and not regexp_matches(lower(location), '\\b(online|zoom|teams|remote|virtual)\\b')""")
def _(T):
    return C.in_person(T.fx_event).select("event_id")


@query("f19_timed", """select event_id from fx_event where not is_all_day and upper(status) <> 'CANCELLED'
  and start_ts >= timestamp '1997-01-01' and start_ts < timestamp '1998-01-01'""")
def _(T):
    return C.timed(T.fx_event, "1997-01-01 00:00:00", "1998-01-01 00:00:00").select("event_id")


@query("f20_flood_alerts", """with a as (select event_id - event_id % 3 as id, case event_type when 'error' then 'Flood Warning' when 'signup' then 'Coastal FLOOD Statement'
    else 'Rip Current' end as event, case when user_id % 4 = 0 then null else ts + to_hours(user_id % 48) end as ends, ts + to_hours(2) as expires, user_id from events)
  select distinct id from a where lower(event) like '%flood%' and coalesce(ends, case when user_id % 8 = 0 then null else expires end) >= timestamp '2024-01-15'
  or (lower(event) like '%flood%' and ends is null and user_id % 8 = 0)""")
def _(T):
    u = F.col("user_id")
    a = T.events.select((F.col("event_id") - F.col("event_id") % 3).alias("id"),
                        F.when(F.col("event_type") == "error", "Flood Warning").when(F.col("event_type") == "signup", "Coastal FLOOD Statement").otherwise("Rip Current").alias("event"),
                        F.when(u % 4 != 0, F.expr("ts + make_dt_interval(0, cast(user_id % 48 as int))")).alias("ends"),
                        F.when(u % 8 != 0, F.expr("ts + interval 2 hours")).alias("expires"))
    return C.flood_alerts(a, "2024-01-15 00:00:00").select("id")


@query("f21_dedupe_points", "select type, gx as x, gy as y, min(point_id) as point_id from (select type, point_id, floor(x / 50) as gx, floor(y / 50) as gy from fx_point) t group by type, gx, gy")
def _(T):
    p = T.fx_point.select("point_id", "type", F.floor(F.col("x") / 50).cast("double").alias("x"), F.floor(F.col("y") / 50).cast("double").alias("y"))
    return C.dedupe_points(p)


@query("f23_validate_trips", """select o_orderkey as id, (case when has_lot and has_point then 1 else 0 end) + (case when has_lot and not has_point and not known then 1 else 0 end)
  + (case when not has_lot and not full_point then 1 else 0 end) + (case when o_orderkey % 4 = 0 and o_orderkey % 6 = 0 then 1 else 0 end)
  + (case when o_orderkey % 4 = 0 and o_orderkey % 8 = 4 then 1 else 0 end) as n_errors
  from (select o_orderkey, o_orderkey % 3 = 0 as has_lot, o_orderkey % 5 = 0 or o_orderkey % 2 = 0 as has_point, o_orderkey % 5 = 0 and o_orderkey % 2 = 0 as full_point,
    o_custkey % 200 < (select count(*) from supplier) as known from orders) t""")
def _(T):
    k = F.col("o_orderkey")
    req = T.orders.select(k.alias("id"), F.when(k % 3 == 0, F.concat(F.lit("L"), (F.col("o_custkey") % 200).cast("string"))).alias("parking_id"),
                          F.when(k % 5 == 0, 25.7).alias("to_lat"), F.when(k % 2 == 0, -80.3).alias("to_lon"), F.lit(25.75).alias("from_lat"), F.lit(-80.2).alias("from_lon"),
                          F.when(k % 4 == 0, F.when(k % 8 == 4, "2026-09-26T13:00:00").otherwise("2026-09-26T13:00:00Z")).alias("depart_at"),
                          F.when(k % 6 == 0, "2026-09-26T13:00:00-04:00").alias("arrive_by"))
    return C.validate_trips(req, T.fx_lot).select("id", F.size("errors").cast("bigint").alias("n_errors"))


PATCH_SQL = """with p as (select user_id, c % 2 = 0 as s_buf, c % 3 = 0 as s_home, c % 5 = 0 as s_lot, c % 7 = 0 as s_name,
    case when c % 4 = 0 then null else c % 150 end as nbuf, case when c % 9 = 0 then null else 7e0 end as nhome,
    case when c % 10 = 0 then null else concat('L', cast(c % 120 as string)) end as nlot, case when c % 14 = 0 then '  ' else ' Kim ' end as nname, c
    from (select concat('u', cast(c_custkey as string)) as user_id, c_custkey as c from customer) t),
  e as (select *, coalesce((s_home and nhome is null) or (s_buf and nbuf is null) or (s_buf and nbuf not between 0 and 120)
    or (s_lot and nlot is not null and nlot not in (select lot_id from fx_lot)), false) as bad from p)"""


def _patches(T):
    c = F.col("c_custkey")
    sent = F.filter(F.array(F.when(c % 2 == 0, "buffer"), F.when(c % 3 == 0, "home"), F.when(c % 5 == 0, "preferred_lot"), F.when(c % 7 == 0, "name")), lambda x: x.isNotNull())
    return T.customer.select(F.concat(F.lit("u"), c.cast("string")).alias("user_id"), sent.alias("sent"), F.when(c % 4 != 0, (c % 150).cast("int")).alias("buffer"),
                             F.when(c % 9 != 0, 7.0).alias("home"), F.when(c % 10 != 0, F.concat(F.lit("L"), (c % 120).cast("string"))).alias("preferred_lot"),
                             F.when(c % 14 == 0, "  ").otherwise(" Kim ").alias("name"))


@query("f24_patch_profiles", PATCH_SQL + """ select u.user_id, case when not bad and s_home then nhome else u.home_x end as home, case when not bad and s_buf then nbuf else u.buffer end as buffer,
  case when not bad and s_lot then nlot else u.preferred_lot end as preferred_lot,
  case when not bad and s_name then nullif(trim(nname), '') else u.name end as name from fx_user u join e on e.user_id = u.user_id""")
def _(T):
    users = T.fx_user.select("user_id", F.col("home_x").alias("home"), "buffer", "preferred_lot", "name")
    return C.patch_profiles(users, _patches(T), T.fx_lot)[0].withColumn("buffer", F.col("buffer").cast("bigint"))


@query("f24_rejected_patches", PATCH_SQL + " select user_id from e where bad")
def _(T):
    users = T.fx_user.select("user_id", F.col("home_x").alias("home"), "buffer", "preferred_lot", "name")
    return C.patch_profiles(users, _patches(T), T.fx_lot)[1].select("user_id")


@query("f25_with_defaults", """select user_id, coalesce(preferred_lot, (select min(lot_id) from fx_lot)) as preferred_lot, coalesce(nullif(buffer, 0), 10) as buffer, 'en' as lang from fx_user""")
def _(T):
    d = T.fx_lot.agg(F.min("lot_id").alias("preferred_lot")).select("preferred_lot", F.lit(10).alias("buffer"), F.lit("en").alias("lang"))
    u = T.fx_user.select("user_id", "preferred_lot", F.nullif("buffer", F.lit(0)).alias("buffer"))
    return C.with_defaults(u, d).withColumn("buffer", F.col("buffer").cast("int"))


@query("f26_fill_zero", "select e.edge_id, coalesce(n, 0) as flood_report_days from fx_edge e left join (select edge_id, count(*) as n from fx_link group by edge_id) l on l.edge_id = e.edge_id")
def _(T):
    n = T.fx_link.groupBy("edge_id").agg(F.count(F.lit(1)).alias("flood_report_days"))
    return L.fill_zero(T.fx_edge.select("edge_id").join(n, "edge_id", "left"))


@query("f27_pick_scenario", "select o_orderkey, case when o_orderstatus = 'P' then 'storm' else (select max(scenario) from fx_run) end as scenario from orders")
def _(T):
    req = T.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "storm").alias("scenario"))
    return C.pick_scenario(req, T.fx_run.select("scenario"))


@query("f29_type_lots", """select osm_id, case when parking = 'multi-storey' then 'garage' else coalesce(parking, 'surface') end as type,
  coalesce(name, concat('Unnamed ', case when parking = 'multi-storey' then 'garage' else coalesce(parking, 'surface') end, ' lot (', osm_id, ')')) as name
  from (select concat('way/', cast(s_suppkey as string)) as osm_id, case when s_suppkey % 4 = 0 then 'multi-storey' when s_suppkey % 4 = 1 then 'surface' when s_suppkey % 4 = 2 then 'street_side' end as parking,
    case when s_suppkey % 3 = 0 then null else s_name end as name from supplier) t""")
def _(T):
    k = F.col("s_suppkey")
    f = T.supplier.select(F.concat(F.lit("way/"), k.cast("string")).alias("osm_id"), F.when(k % 3 != 0, F.col("s_name")).alias("name"),
                          F.when(k % 4 == 0, "multi-storey").when(k % 4 == 1, "surface").when(k % 4 == 2, "street_side").alias("parking"))
    return C.type_lots(f).select("osm_id", "type", "name")


# ------------------------------------------------------------------ audits
@query("v1_check_keys", """select 'empty' as "check", 0::bigint as violations union all select 'missing_columns', 1 union all select 'null_key', count(*) from fx_edge where name is null
  union all select 'repeated_key', count(*) from (select name from fx_edge where name is not null group by name having count(*) > 1) t""")
def _(T):
    return C.check_keys(T.fx_edge, "name", ["edge_id", "length", "surface"])


@query("v2_check_domains", """select 'unknown_jurisdiction' as "check", count(*) filter (where jurisdiction <> 'city') as violations from fx_static
  union all select 'missing_flags', 0 union all select 'twins_disagree', count(*) from (select street_id from fx_static group by street_id having count(distinct jurisdiction) > 1) t""")
def _(T):
    return C.check_domains(T.fx_static, ["city"])


@query("v3_check_weather", """with b as (select date, rain_mm, extract(day from date) as d from fx_weather_raw), w as (select * from b union all select * from b where d % 5 = 0)
  select 'empty' as "check", 0::bigint as violations union all select 'unit', count(*) from w where d % 7 = 0 union all select 'zone', count(*) from w where d % 11 = 0
  union all select 'bad_rain', count(*) from w where rain_mm < 60 union all select 'repeated_date', count(*) - count(distinct date) from w
  union all select 'gaps', count(*) from (select date, lead(date) over (order by date) as n from (select distinct date from w where d % 3 > 0) t) x where n > date + 1""")
def _(T):
    day = F.dayofmonth("date")
    w = T.fx_weather_raw.select("date", F.when(F.col("rain_mm") >= 60, F.col("rain_mm")).otherwise(-1.0).alias("rain_mm"), F.when(day % 7 == 0, "in").otherwise("mm").alias("unit"),
                                F.when(day % 11 == 0, "UTC").otherwise("America/New_York").alias("zone"))
    w = w.unionByName(w.where(day % 5 == 0))
    gaps = C.check_weather(w.where(day % 3 > 0)).where(F.col("check") == "gaps")
    return C.check_weather(w).where(F.col("check") != "gaps").unionByName(gaps)


@query("v4_check_horizon", """with w as (select date, rain_mm, lead(date) over (order by date) as n from fx_weather where extract(day from date) <> 13)
  select 'length' as "check", (case when count(*) between 1 and 7 then 0 else 1 end)::bigint as violations from w union all select 'retrievals', case when count(distinct extract(month from date)) > 1 then 1 else 0 end from w
  union all select 'missing_rain', count(*) from w where rain_mm < 60 union all select 'not_consecutive', count(*) from w where n <> date + 1""")
def _(T):
    """A whole history in place of a week: too long, with gaps on every 13th, rain left out where it is low, one retrieval a month."""
    days = T.fx_weather.where(F.dayofmonth("date") != 13).select(
        F.datediff("date", F.lit("2000-01-01").cast("date")).alias("seq"), "date", F.when(F.col("rain_mm") >= 60, F.col("rain_mm")).alias("rain_mm"),
        "rain_lag1_mm", "rain_prior3_mm", F.month("date").cast("string").alias("updated_at"))
    return C.check_horizon(days)


@query("v5_compare_keys", """select count(*) filter (where b is null) as only_a, count(*) filter (where a is null) as only_b, count(*) filter (where a is not null and b is not null) as both
  from (select distinct ok as a from fx_edge) x full outer join (select distinct l_orderkey as b from lineitem) y on a = b""")
def _(T):
    return C.compare_keys(T.fx_edge.select("ok"), T.lineitem.select(F.col("l_orderkey").alias("ok")), "ok")


@query("v6_load_report", """with o as (select distinct edge_id from fx_edge where status <> 'O'), n as (select distinct edge_id from fx_edge where status <> 'F'), b as (select edge_id from fx_edge where is_bridge),
  j as (select o.edge_id as o, n.edge_id as n, b.edge_id as b from o full join n on o.edge_id = n.edge_id full join b on b.edge_id = coalesce(o.edge_id, n.edge_id))
  select count(o) as previous, count(*) filter (where o is not null and n is not null) as common, count(*) filter (where o is not null and n is null) as only_previous,
    count(*) filter (where n is not null and o is null) as only_new, count(*) filter (where b is not null and o is not null) as bridges_present, count(b) as bridges from j""")
def _(T):
    e = T.fx_edge
    return C.load_report(e.where("status <> 'O'"), e.where("status <> 'F'"), e.where("is_bridge"))


@query("v7_check_pairs", """select 'size' as "check", count(*) filter (where n not in (1, 2)) as violations from (select street_id, count(*) as n from fx_edge group by street_id) t
  union all select 'not_reversed', count(*) filter (where n = 2 and not rev) from (select a.street_id, count(*) as n, bool_and(exists (select 1 from fx_edge b where b.street_id = a.street_id and b.u = a.v and b.v = a.u)) as rev from fx_edge a group by a.street_id) t
  union all select 'not_a_member', count(*) filter (where not m) from (select street_id, bool_or(edge_id = street_id) as m from fx_edge group by street_id) t""")
def _(T):
    return C.check_pairs(T.fx_edge)


@query("v9_audit_scores", """select 'out_of_range' as "check", count(*) filter (where risk_score not between 0 and 1) as violations from fx_static
  union all select 'twins_differ', count(*) from (select street_id from fx_static group by street_id having min(risk_score) <> max(risk_score)) t
  union all select 'row_difference', abs((select count(*) from fx_static) - (select count(*) from fx_link))""")
def _(T):
    return C.audit_scores(T.fx_static, T.fx_link)


@query("v10_scenario_response", """with j as (select edge_id, risk_score * 0.4e0 as dry, case when ok % 10 = 0 then risk_score * 0.3e0 else power(risk_score, 0.6e0) end as wet from fx_static where not is_bridge)
  select count(*) filter (where wet > dry) as up, count(*) filter (where wet < dry) as down, round(quantile_cont(dry, 0.5), 6) as dry_median, round(quantile_cont(wet, 0.5), 6) as wet_median from j""")
def _(T):
    src = F.when(F.col("is_bridge"), "bridge_policy_fallback").otherwise("model_reference_percentile").alias("score_source")
    s = T.fx_static
    dry = s.select("edge_id", (F.col("risk_score") * 0.4).alias("risk_score"), src)
    wet = s.select("edge_id", F.when(F.col("ok") % 10 == 0, F.col("risk_score") * 0.3).otherwise(F.pow("risk_score", F.lit(0.6))).alias("risk_score"), src)
    return r6(C.scenario_response(dry, wet))


@query("a11_value_counts", "select zone, subtype, sfha, count(*) as n from fx_fema group by all")
def _(T):
    return C.value_counts(T.fx_fema, ["zone", "subtype", "sfha"])


@query("a11_null_counts", """select 'edge_id' as "column", 0::bigint as nulls union all select 'zone', count(*) - count(zone) from fx_fema
  union all select 'subtype', count(*) - count(subtype) from fx_fema union all select 'sfha', count(*) - count(sfha) from fx_fema""")
def _(T):
    return C.null_counts(T.fx_fema)


@query("a28_zone_mismatches", "select count(*) filter (where (zone like 'A%' or zone like 'V%') <> sfha) as mismatches, count(*) as zoned from (select edge_id, case when edge_id like '1%' then 'VE' else zone end as zone, sfha from fx_fema) t where zone is not null")
def _(T):
    z = F.when(F.col("edge_id").startswith("1"), "VE").otherwise(F.col("zone"))
    return C.zone_mismatches(T.fx_fema.select(z.alias("fema_zone"), F.col("sfha").alias("in_sfha")))


@query("a29_travel_times", """select edge_id, round(length / (coalesce(speed_kph, avg(speed_kph) over (partition by highway)) / 3.6e0), 6) as seconds from fx_edge""")
def _(T):
    return r6(L.travel_times(T.fx_edge).select("edge_id", "seconds"))


@query("a10_report_counts", """with s as (select distinct ticket_id from fx_link)
  select source, category, type, count(*) as in_box, count(s.ticket_id) as snapped, count(distinct case when s.ticket_id is not null then date end) as distinct_dates
  from fx_report r left join s on s.ticket_id = r.ticket_id group by source, category, type""")
def _(T):
    return V.report_counts(T.fx_report, T.fx_link)


@query("j24_source_crosscheck", """with o as (select l.source, l.ticket_id, min_by(e.jurisdiction, l.edge_id) as j from fx_link l join fx_edge e on e.edge_id = l.edge_id group by l.source, l.ticket_id)
  select source, count(*) filter (where j = 'city') as city, count(*) filter (where j = 'county') as county from o group by source""")
def _(T):
    return V.source_crosscheck(T.fx_link, T.fx_edge)


@query("j10_keep_keys", "select edge_id from fx_edge where exists (select 1 from lineitem where l_orderkey = ok)")
def _(T):
    return C.keep_keys(T.fx_edge, T.lineitem.select(F.col("l_orderkey").alias("ok")), "ok").select("edge_id")


@query("j10_drop_keys", "select edge_id from fx_edge where not exists (select 1 from lineitem where l_orderkey = ok)")
def _(T):
    return C.drop_keys(T.fx_edge, T.lineitem.select(F.col("l_orderkey").alias("ok")), "ok").select("edge_id")


@query("u1_stack", "select event_id as id, ts_ as at, null as depth from (select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_ from events) e union all select l_orderkey, null, l_discount from lineitem")
def _(T):
    e = text(T.events.select(F.col("event_id").alias("id"), F.col("ts").alias("at")), "at")
    return C.stack(e, T.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("depth")))


@query("u2_distinct_keys", "select distinct street_id, cast(date as varchar) as date from fx_report")
def _(T):
    return text(C.distinct_keys(T.fx_report, ["street_id", "date"]), "date")


@query("u3_key_diff", "select a.ok, case when b.ok is null then 'only_a' else 'both' end as side from (select distinct ok from fx_edge) a left join (select distinct l_orderkey as ok from lineitem) b on a.ok = b.ok")
def _(T):
    return C.key_diff(T.fx_edge, T.lineitem.select(F.col("l_orderkey").alias("ok")), ["ok"])


@query("w4_first_by", "select u, v, ok, edge_id from (select *, row_number() over (partition by u, v order by length desc, edge_id) as r from fx_edge) t where r = 1")
def _(T):
    return C.first_by(T.fx_edge.select("u", "v", "ok", "edge_id", "length"), ["u", "v"], [-F.col("length"), F.col("edge_id")]).select("u", "v", "ok", "edge_id")


@query("w3_near_minimum", "select u, v, edge_id from (select *, min(length) over (partition by u, v) as m from fx_edge) t where length <= m + 1.5")
def _(T):
    return C.near_minimum(T.fx_edge.select("u", "v", "edge_id", "length"), ["u", "v"], "length", 1.5).select("u", "v", "edge_id")


@query("w12_day_gaps", """with t as (select distinct cast(o_orderdate as date) as d from orders)
  select cast(d as varchar) as date from t where d + 1 not in (select d from t) and d < (select max(d) from t)""")
def _(T):
    return text(C.day_gaps(T.orders.select(F.to_date("o_orderdate").alias("date"))), "date")


@query("x18_stable_ids", """select o_orderkey, concat(o_orderkey, '_', o_custkey, '_0') as edge_id, concat('r_', substr(sha1(o_orderstatus || o_orderkey), 1, 8)) as rid,
  concat(strftime(o_orderdate, '%Y-%m-%dT%H:%MZ'), '-storm') as run_id from orders""")
def _(T):
    return T.orders.select("o_orderkey", X.edge_id("o_orderkey", "o_custkey", F.lit(0)).alias("edge_id"),
                           X.stable_id("r_", F.concat("o_orderstatus", F.col("o_orderkey").cast("string")), 8).alias("rid"), X.run_id("o_orderdate", F.lit("storm")).alias("run_id"))


@query("x19_held_out", "select distinct user_id, ('0x' || substr(sha256('42:' || user_id), 1, 8))::ubigint % 5 = 0 as heldout from events")
def _(T):
    return T.events.select("user_id", X.held_out("user_id").alias("heldout")).distinct()


@query("x20_split_name", """select event_id, case when ('0x' || substr(sha256('42:' || user_id), 1, 8))::ubigint % 5 = 0 then case when cast(ts as date) > date '2024-01-23' then 'unseen_streets_test' else 'unused' end
  when cast(ts as date) <= date '2024-01-18' then 'train' when cast(ts as date) <= date '2024-01-23' then 'validation' else 'future_test' end as split from events""")
def _(T):
    return T.events.select("event_id", X.split_name(F.to_date("ts"), X.held_out("user_id"), "2024-01-18", "2024-01-23").alias("split"))


@query("x21_local_time", f"""select event_id, cast(cast(timezone('America/New_York', timezone('UTC', ts)) as date) as varchar) as local_date,
  {ts("timezone('UTC', timezone('America/New_York', cast(cast(ts as date) as timestamp)))")} as day_start,
  {ts("to_timestamp(event_id * 1000).at_time_zone('UTC')") if False else "strftime(make_timestamp(event_id * 1000000000), '%Y-%m-%d %H:%M:%S')"} as from_s from events""")
def _(T):
    return text(T.events.select("event_id", X.local_date("ts").alias("local_date"), X.local_day(F.to_date("ts"))[0].alias("day_start"),
                                F.coalesce(X.from_epoch_s(F.col("event_id") * 1000), F.timestamp_seconds(F.lit(0))).alias("from_s")), "local_date", "day_start", "from_s")


@query("x22_clock", """select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as iso, ltrim(strftime(timezone('America/New_York', timezone('UTC', ts)), '%I:%M %p'), '0') as clock from events""")
def _(T):
    return T.events.select("event_id", X.iso_utc("ts").alias("iso"), X.clock("ts").alias("clock"))


@query("x34_distance_text", """select edge_id, case when round_even(length * 10, 0) >= 1000 then printf('%.1f km', round_even(length * 10, 0) / 1000) else concat(cast(round_even(length * 10, 0) as bigint), ' m') end as t,
  case when j > 0 then concat('+', case when j % 2 = 0 then cast(j as varchar) else cast(j + 0.5 as varchar) end, ' min') else 'no extra time' end as extra from fx_edge""")
def _(T):
    minutes = F.when(F.col("j") % 2 == 0, F.col("j").cast("double")).otherwise(F.col("j") + 0.5)
    return T.fx_edge.select("edge_id", X.distance_text(F.col("length") * 10).alias("t"), X.extra_text(F.when(F.col("j") > 0, minutes).otherwise(F.lit(0.0))).alias("extra"))


@query("a12_distribution", """with x as (select length as v from fx_edge)
  select 'length' as "column", 'mean' as stat, round(avg(v), 6) as value from x union all select 'length', 'sd', round(stddev_samp(v), 6) from x
  union all select 'length', 'min', round(min(v), 6) from x union all select 'length', 'max', round(max(v), 6) from x
  union all select 'length', 'share_0', 0 union all select 'length', 'share_1', 0
  union all select 'length', 'share_above_100', round(avg(case when v > 100 then 1e0 else 0e0 end), 6) from x
  union all select 'length', 'p5', round(quantile_cont(v, 0.05), 6) from x union all select 'length', 'p50', round(quantile_cont(v, 0.5), 6) from x
  union all select 'length', 'p95', round(quantile_cont(v, 0.95), 6) from x""")
def _(T):
    return r6(M.distribution(T.fx_edge, ["length"], [0.05, 0.5, 0.95], [100.0]))


@query("a13_correlation", "select round(corr(risk_score, sink_p90), 6) as correlation, count(*) as n from fx_static where sink_p90 is not null")
def _(T):
    return r6(M.correlation(T.fx_static, "risk_score", "sink_p90"))


@query("a13_group_median", "select jurisdiction, round(quantile_cont(length, 0.5), 6) as median, count(length) as n from fx_static group by jurisdiction")
def _(T):
    return r6(M.group_median(T.fx_static, "length", ["jurisdiction"]))


@query("a23_long_outliers", """with c as (select quantile_cont(length, 0.75) + 0.5 * (quantile_cont(length, 0.75) - quantile_cont(length, 0.25)) as cutoff from fx_edge where is_bridge)
  select edge_id, mixed_tags, length > cutoff as long_outlier from fx_edge cross join c where is_bridge and (mixed_tags or length > cutoff)""")
def _(T):
    return M.long_outliers(T.fx_edge, 0.5).select("edge_id", "mixed_tags", "long_outlier")


@query("a30_inlet_medians", """with d as (select jurisdiction, abs(length) as length, drain_count, drain_count / abs(length) * 100 as r from fx_static)
  select jurisdiction as "group", 'drains_per_100m' as measure, round(quantile_cont(r, 0.5), 6) as median, count(*) as n from d where length >= 110 group by jurisdiction
  union all select jurisdiction, 'drain_count', round(quantile_cont(drain_count, 0.5), 6), count(*) from d where length >= 110 group by jurisdiction
  union all select case when length < 110 then 'short' else 'long' end, 'drains_per_100m', round(quantile_cont(r, 0.5), 6), count(*) from d group by 1""")
def _(T):
    d = T.fx_static.withColumn("length", F.abs("length")).withColumn("drains_per_100m", S.per_100m("drain_count", "length"))
    return r6(M.inlet_medians(d, 110.0))
