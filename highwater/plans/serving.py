"""Registered queries: runs, labels, closures, conditions, parking, routes, trips, people."""
import uuid

from pyspark.sql import functions as F

from highwater.functions import scoring as S, text as X
from highwater.operators import checks as C, layers as L, serving as V, trips as R
from highwater.plans.registry import query, r6, text, ts
from highwater.session import shared_folder
from highwater.sources.writers import replace_keyed

RANK = "case {c} when 'critical' then 2 when 'warning' then 1 else 0 end"


@query("s19_scenario_scores", """select street_id, round(power(min_by(risk_score, edge_id), 0.6), 6) as storm, round(min_by(risk_score, edge_id) * 0.4e0, 6) as dry from fx_static group by street_id""")
def _(T):
    storm = V.scenario_scores(T.fx_static, "storm").select("street_id", F.col("risk_score").alias("storm"))
    return r6(storm.join(V.scenario_scores(T.fx_static, "live").select("street_id", F.col("risk_score").alias("dry")), "street_id"))


@query("f11_cutoff_label", "select edge_id, case when risk_score >= 0.6e0 then 'high' when risk_score >= 0.35e0 then 'medium' else 'low' end as label from fx_static")
def _(T):
    return T.fx_static.select("edge_id", S.cutoff_label("risk_score").alias("label"))


@query("f12_rain_level", """select event_id, case when value < 300 then (case when value / 10 < 1 then 'none' when value / 10 < 10 then 'light' when value / 10 < 25 then 'moderate' else 'heavy' end)
  when event_type = 'view' then null else (case when value / 20 < 1 then 'none' when value / 20 < 7.5 then 'light' when value / 20 < 20 then 'moderate' else 'heavy' end) end as level from events""")
def _(T):
    v = F.col("value")
    return T.events.select("event_id", S.rain_level(F.when(v < 300, v / 10), F.when(F.col("event_type") != "view", v / 20)).alias("level"))


EFFECTIVE = """eff as (select e.edge_id, e.street_id, coalesce(s.risk_score, e.risk_score) as score,
  case when s.risk_label in ('low', 'medium', 'high') then s.risk_label when coalesce(s.risk_score, e.risk_score) >= 0.6e0 then 'high' when coalesce(s.risk_score, e.risk_score) >= 0.35e0 then 'medium' else 'low' end as label
  from fx_static e left join fx_score s on s.street_id = e.street_id)"""


@query("f14_effective_risk", f"with {EFFECTIVE} select edge_id, round(score, 6) as score, label from eff")
def _(T):
    return r6(V.effective_risk(T.fx_static, T.fx_score).select("edge_id", "score", "label"))


@query("j17_spread_to_edges", f"with {EFFECTIVE} select edge_id, street_id, round(score, 6) as score from eff")
def _(T):
    return r6(V.spread_to_edges(T.fx_score, T.fx_static).select("edge_id", "street_id", "score"))


@query("w10_current_run", f"""with r as (select *, row_number() over (partition by scenario order by computed_at desc) as k from fx_run)
  select scenario, run_id, {ts('computed_at')} as computed_at, scenario = 'live' and date_diff('second', computed_at, timestamp '2024-01-31 04:00:00') > 10800 as stale from r where k = 1""")
def _(T):
    return text(V.current_run(T.fx_run, "2024-01-31 04:00:00"), "computed_at")


@query("a27_label_counts", """select concat('r', ord) as run_id, count(*) filter (where lb = 'low') as low, count(*) filter (where lb = 'medium') as medium, count(*) filter (where lb = 'high') as high, count(*) filter (where lb is null) as none, count(*) as streets_scored
  from (select length(street_id) as ord, risk_label as lb from fx_score) t group by ord""")
def _(T):
    return V.label_counts(T.fx_score.select(F.concat(F.lit("r"), F.length("street_id").cast("string")).alias("run_id"), "risk_label"))


ACTIVE = """ac as (select edge_id, bool_or(coalesce(full_closure, false)) as closed, bool_or(not coalesce(full_closure, false)) as slowed from fx_closure where start <= timestamp '1998-06-01' and ("end" is null or "end" >= timestamp '1998-06-01') group by edge_id)"""


@query("j18_closure_flags", f"with {ACTIVE} select e.edge_id, coalesce(closed, false) as closed, coalesce(slowed, false) as slowed from fx_edge e left join ac on ac.edge_id = e.edge_id")
def _(T):
    return V.closure_flags(T.fx_edge, T.fx_closure, "1998-06-01 00:00:00").select("edge_id", "closed", "slowed")


@query("a9_closure_summary", "select source, kind, count(distinct closure_id) as closures, count(distinct c.edge_id) as edges, count(*) as links, round(sum(length) / 1000, 6) as km from fx_closure c join fx_edge e on e.edge_id = c.edge_id group by source, kind")
def _(T):
    return r6(V.closure_summary(T.fx_closure, T.fx_edge, ["source", "kind"]))


@query("t1_largest_closures", "select closure_id, edges, km from (select closure_id, count(distinct c.edge_id) as edges, round(sum(length) / 1000, 6) as km from fx_closure c join fx_edge e on e.edge_id = c.edge_id group by closure_id) t order by km desc, closure_id limit 10")
def _(T):
    s = r6(V.closure_summary(T.fx_closure, T.fx_edge, ["closure_id"]))
    return L.top_n(s, [F.desc("km"), F.asc("closure_id")], 10).select("closure_id", "edges", "km")


@query("s15_closure_links", "select distinct concat(closure_id, '|', edge_id) as id, closure_id, edge_id from fx_closure")
def _(T):
    """The closure links written as a keyed set, then read back."""
    links = T.fx_closure.select(F.concat_ws("|", "closure_id", "edge_id").alias("id"), "closure_id", "edge_id").distinct()
    path = f"{shared_folder(links.sparkSession)}/links-{uuid.uuid4().hex}"
    replace_keyed(links, path, "id")
    return links.sparkSession.read.parquet(path)


# ------------------------------------------------------------------ live conditions
@query("j19_nearest_in_time", f"""with o as (select event_id, ts as t, user_id % 3 as key from events where event_type = 'error'), p as (select distinct user_id % 3 as key, ts as t, value as v from events where event_type = 'view'),
  m as (select o.event_id, o.t, o.key, p.t as pt, p.v, abs(date_diff('second', timestamp '2000-01-01', date_trunc('second', o.t)) - date_diff('second', timestamp '2000-01-01', date_trunc('second', p.t))) as gap from o left join p on p.key = o.key and p.t between o.t - interval 361 second and o.t + interval 361 second)
  select event_id, predicted, gap_s from (select event_id, case when gap <= 360 then v end as predicted, case when gap <= 360 then gap end as gap_s, row_number() over (partition by event_id order by case when gap <= 360 then gap end nulls last, pt, v) as r from m) q where r = 1""")
def _(T):
    e = T.events.withColumn("key", F.col("user_id") % 3)
    obs = e.where("event_type = 'error'").select("event_id", "key", F.col("ts").alias("t"))
    pred = e.where("event_type = 'view'").select("key", F.col("ts").alias("t"), F.col("value").alias("v")).distinct()
    return V.nearest_in_time(obs, pred).select("event_id", "predicted", "gap_s")


@query("x32_tide_peak", """with q as (select event_id as req_id, user_id % 3 as key, ts as at, ts - interval 10 minute as now from events where event_type = 'signup'),
  p as (select distinct user_id % 3 as key, date_trunc('second', ts) as t, value as v from events where event_type = 'view'),
  k as (select req_id, max(p.v) as peak from q join p on p.key = q.key and abs(date_diff('second', p.t, date_trunc('second', q.at))) <= 3600 group by req_id)
  select q.req_id, round(peak, 6) as predicted_peak, coalesce(peak >= 300, null) as above_minor, coalesce(peak >= 450, false) as above_moderate, case when peak is null then 'unavailable' else 'ok' end as status from q left join k on k.req_id = q.req_id""")
def _(T):
    e = T.events.withColumn("key", F.col("user_id") % 3)
    req = e.where("event_type = 'signup'").select(F.col("event_id").alias("req_id"), "key", F.col("ts").alias("at"), F.expr("ts - interval 10 minutes").alias("now"))
    pred = e.where("event_type = 'view'").select("key", F.date_trunc("second", "ts").alias("t"), F.col("value").alias("v")).distinct()
    obs = pred.where("v < 0")
    levels = e.select("key").distinct().select("key", F.lit(300.0).alias("minor"), F.lit(450.0).alias("moderate"))
    return r6(V.tide_peak(req, pred, obs, levels).select("req_id", "predicted_peak", "above_minor", "above_moderate", "status"))


# readings two minutes after a third of the predictions of the first half, so early requests have a fresh one and late ones a stale one
@query("x32_tide_anomaly", """with q as (select event_id as req_id, user_id % 3 as key, ts as at, ts - interval 10 minute as now from events where event_type = 'signup'),
  p as (select distinct user_id % 3 as key, date_trunc('second', ts) as t, value as v from events where event_type = 'view'),
  o as (select user_id % 3 as key, date_trunc('second', ts) + interval 2 minute as t, max(value) + 7e0 as v from events where event_type = 'view' and event_id % 3 = 0 and ts < timestamp '2024-01-16' group by 1, 2),
  l as (select key, max(t) as t from o group by key),
  a as (select l.key, l.t, o.v, p.v as pv, row_number() over (partition by l.key order by abs(date_diff('second', p.t, l.t)), p.t, p.v) as r from l join o on o.key = l.key and o.t = l.t left join p on p.key = l.key and abs(date_diff('second', p.t, l.t)) <= 360),
  k as (select req_id, max(p.v) as peak from q join p on p.key = q.key and abs(date_diff('second', p.t, date_trunc('second', q.at))) <= 3600 group by req_id),
  e as (select q.req_id, peak, case when date_diff('second', a.t, date_trunc('second', q.now)) <= 1800 then a.v - a.pv end as anomaly from q left join k on k.req_id = q.req_id left join a on a.key = q.key and a.r = 1)
  select req_id, round(anomaly, 6) as anomaly, round(peak + coalesce(anomaly, 0), 6) as expected_peak, coalesce(peak + coalesce(anomaly, 0) >= 300, null) as above_minor, case when peak is null then 'unavailable' else 'ok' end as status from e""")
def _(T):
    e = T.events.withColumn("key", F.col("user_id") % 3)
    req = e.where("event_type = 'signup'").select(F.col("event_id").alias("req_id"), "key", F.col("ts").alias("at"), F.expr("ts - interval 10 minutes").alias("now"))
    pred = e.where("event_type = 'view'").select("key", F.date_trunc("second", "ts").alias("t"), F.col("value").alias("v")).distinct()
    obs = e.where("event_type = 'view' and event_id % 3 = 0 and ts < timestamp '2024-01-16'").groupBy("key", F.expr("date_trunc('second', ts) + interval 2 minutes").alias("t")).agg((F.max("value") + 7.0).alias("v"))
    levels = e.select("key").distinct().select("key", F.lit(300.0).alias("minor"), F.lit(450.0).alias("moderate"))
    return r6(V.tide_peak(req, pred, obs, levels).select("req_id", "anomaly", "expected_peak", "above_minor", "status"))


@query("x33_rain_sums", """with r as (select event_id as req_id, ts as now, ts + interval 30 minute as depart, epoch(date_trunc('second', ts))::bigint as n from events where event_type = 'purchase'),
  g as (select req_id, n, unnest(generate_series(cast(floor((n - 7200) / 900) as bigint) + 1, cast(floor((n + 5400) / 900) as bigint))) as q from r),
  m as (select g.req_id, g.q * 900 as t, n, mm from g left join (select epoch(q)::bigint as e, mm from fx_quarter) k on k.e = g.q * 900)
  select req_id, round(case when count(*) filter (where t <= n) = count(mm) filter (where t <= n) then coalesce(sum(mm) filter (where t <= n), 0) end, 6) as past_2h_mm,
    round(case when count(*) filter (where t > n and t <= n + 1800) = count(mm) filter (where t > n and t <= n + 1800) then coalesce(sum(mm) filter (where t > n and t <= n + 1800), 0) end, 6) as before_departure_mm,
    round(case when count(*) filter (where t > n + 1800) = count(mm) filter (where t > n + 1800) then coalesce(sum(mm) filter (where t > n + 1800), 0) end, 6) as during_trip_mm,
    round(case when count(*) = count(mm) then max(mm) end, 6) as max_15min_mm from m group by req_id""")
def _(T):
    req = T.events.where("event_type = 'purchase'").select(F.col("event_id").alias("req_id"), F.lit(1).alias("key"), F.col("ts").alias("now"), F.expr("ts + interval 30 minutes").alias("depart"))
    return r6(V.rain_sums(req, T.fx_quarter.select(F.lit(1).alias("key"), F.col("q").alias("t"), "mm")))


@query("x35_traffic_delay", """select u as route_id, case when ok % 3 = 0 then sec else sec * 1.5e0 end as seconds_, 0 as z from (select u, ok, round(length, 6) as sec from fx_edge) t where false
  union all select ok, round(case when ok % 3 = 0 then length else length * 1.5e0 end, 6), case when ok % 3 = 0 then null else round(greatest(case when ok % 2 = 0 then 20 else 0 end, length * 1.5e0 - case when ok % 5 = 0 then length * 1.5e0 else length end, 0), 6) end from fx_edge where fwd_ = 1""".replace("from fx_edge where fwd_ = 1", "from (select ok, min(length) as length from fx_edge group by ok) e"))
def _(T):
    r = T.fx_edge.groupBy(F.col("ok").alias("route_id")).agg(F.min("length").alias("free_flow_s"))
    k = F.col("route_id")
    a = r.where(k % 3 != 0).select("route_id", (F.col("free_flow_s") * 1.5).alias("traffic_s"), F.when(k % 5 != 0, F.col("free_flow_s")).alias("no_traffic_s"),
                                   F.when(k % 2 == 0, 20.0).alias("incident_s"), F.lit(True).alias("live"))
    return r6(V.with_traffic(r, a).select("route_id", F.col("seconds").alias("seconds_"), F.col("delay_s").alias("z")))


@query("a17_area_index", """with s as (select d, e.street_id, min_by(risk_score * d / 3e0, edge_id) as sc, bool_or(is_bridge) as br from fx_static e, (select unnest([1, 2, 3]) as d) x group by d, e.street_id),
  l as (select street_id, case when min(length) > 0 then max(length) end as len from fx_static group by street_id)
  select d as forecast_date, round(sum(case when not br then sc * len end) / sum(case when not br and len is not null then len end), 6) as relative_risk_index, count(*) filter (where not br) as modelled_streets, count(*) filter (where br) as fallback_streets,
    count(*) filter (where not br and len > 0) as streets_in_index, count(*) as total_streets, round(coalesce(sum(case when not br then len end), 0), 6) as modelled_length_m, d = 3 as out_of_range from s join l on l.street_id = s.street_id group by d""")
def _(T):
    e = T.fx_static.select("*", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("d"))
    per = T.fx_static.groupBy("street_id").agg(F.max("is_bridge").alias("br"))
    sc = e.join(per, "street_id").select(F.col("d").alias("forecast_date"), "street_id", "edge_id", (F.col("risk_score") * F.col("d") / 3.0).alias("risk_score"),
                  F.when(F.col("br"), "bridge_policy_fallback").otherwise("model_reference_percentile").alias("score_source"), (F.col("d") == 3).alias("out_of_range"))
    ln = T.fx_static.groupBy("street_id").agg(F.when(F.min("length") > 0, F.max("length")).alias("length"))
    return r6(V.area_index(sc, ln))


# ------------------------------------------------------------------ parking
LEVELS = "case cast(s_suppkey % 5 as int) when 0 then 'none' when 1 then 'light' when 2 then 'moderate' when 3 then 'heavy' end"
FACTOR = "case cast(s_suppkey % 5 as int) when 0 then 0.4e0 when 1 then 0.6e0 when 2 then 0.8e0 else 1e0 end"


def _level():
    k = F.col("s_suppkey") % 5
    return F.when(k == 0, "none").when(k == 1, "light").when(k == 2, "moderate").when(k == 3, "heavy")


@query("x25_lot_hazard", f"select lot_id, round(score * {FACTOR}, 6) as hazard, case when score * {FACTOR} >= 0.6e0 then 'high' when score * {FACTOR} >= 0.35e0 then 'medium' else 'low' end as label from fx_lot")
def _(T):
    h, label = S.lot_hazard("score", _level())
    return r6(T.fx_lot.select("lot_id", h.alias("hazard"), label.alias("label")))


@query("x11_parking_score", """select lot_id, round((0.35e0 * least(greatest(score / 0.5e0, 0), 1) + 0.2e0 * least(greatest((0.5e0 - (score - 0.5e0)) / 1.5e0, 0), 1) + case when access is null then 0.25e0 * score else 0 end)
  / (0.55e0 + case when access is null then 0.25e0 else 0 end), 6) as parking_score from fx_lot""")
def _(T):
    lots = T.fx_lot.select("lot_id", F.col("score").alias("pond_frac"), (F.col("score") - 0.5).alias("freeboard_p10_m"), F.when(F.col("access").isNull(), F.col("score")).alias("access_risk_min"))
    return r6(V.parking_score(lots).select("lot_id", "parking_score"))


@query("t2_lot_alternatives", """with h as (select *, case when score >= 0.6e0 then 'high' when score >= 0.35e0 then 'medium' else 'low' end as hl from fx_lot),
  g as (select * from h where hl = 'low' and name not like '%Unnamed%' and name not like '%Staff%' and coalesce(access, '') <> 'private'),
  p as (select a.lot_id, g.lot_id as alternative, cast(round_even(round(sqrt(power(a.x - g.x, 2) + power(a.y - g.y, 2)), 6), 0) as bigint) as distance_m,
    row_number() over (partition by a.lot_id order by g.type <> 'garage', round(sqrt(power(a.x - g.x, 2) + power(a.y - g.y, 2)), 6), g.lot_id) as rank from h a join g on a.lot_id <> g.lot_id where a.hl = 'high')
  select lot_id, rank, alternative, distance_m from p where rank <= 3""")
def _(T):
    return R.lot_alternatives(T.fx_lot.withColumn("hazard_label", S.cutoff_label("score")))


@query("j15_pick_lot", """with r as (select t.trip_id as req_id, b.x, b.y, u.preferred_lot from fx_trip t join fx_building b on b.node_id = t.to_node join fx_user u on u.user_id = t.user_id),
  g as (select * from fx_lot where name not like '%Unnamed%' and name not like '%Staff%' and coalesce(access, '') <> 'private'),
  pl as (select distinct x, y from r), nr as (select pl.x, pl.y, min(round(sqrt(power(g.x - pl.x, 2) + power(g.y - pl.y, 2)), 6)) as d, arg_min(g.lot_id, (round(sqrt(power(g.x - pl.x, 2) + power(g.y - pl.y, 2)), 6), g.lot_id)) as lot from pl, g group by pl.x, pl.y)
  select req_id, coalesce(p.lot_id, case when nr.d <= 800 then nr.lot end) as lot_id,
    coalesce(cast(round_even(case when p.lot_id is not null then round(sqrt(power(p.x - r.x, 2) + power(p.y - r.y, 2)), 6) when nr.d <= 800 then nr.d end * 1.3e0 / 80, 0) as bigint), 0) as walk_min
  from r left join nr on nr.x = r.x and nr.y = r.y left join fx_lot p on p.lot_id = r.preferred_lot""")
def _(T):
    req = T.fx_trip.select(F.col("trip_id").alias("req_id"), "to_node", "user_id").join(T.fx_building.select(F.col("node_id").alias("to_node"), "x", "y"), "to_node") \
        .join(T.fx_user.select("user_id", "preferred_lot"), "user_id").select("req_id", "x", "y", "preferred_lot")
    return R.pick_lot(req, T.fx_lot).select("req_id", "lot_id", "walk_min")


# ------------------------------------------------------------------ routes and trips
@query("x24_safe_cost", f"""with {EFFECTIVE}, {ACTIVE} select e.edge_id, round(length * case when coalesce(slowed, false) then 1.5e0 else 1 end * (1 + 2 * score) * case when label = 'high' then 5 else 1 end, 6) as cost
  from fx_edge e join eff on eff.edge_id = e.edge_id left join ac on ac.edge_id = e.edge_id""")
def _(T):
    f = V.closure_flags(T.fx_edge, T.fx_closure, "1998-06-01 00:00:00").join(V.effective_risk(T.fx_static, T.fx_score).drop("street_id"), "edge_id")
    return r6(f.select("edge_id", S.safe_cost("length", "slowed", "score", "label").alias("cost")))


@query("a21_worst_street", """with m as (select route_id, name, sum(round_even(length, 0)) as m from fx_route_edge where label = 'high' and name is not null group by route_id, name)
  select route_id, name as street from (select *, row_number() over (partition by route_id order by m desc, name) as r from m) t where r = 1""")
def _(T):
    return R.worst_street(T.fx_route_edge, ["route_id"])


@query("a22_describe_routes", """select route_id as route, concat('r_', substr(sha1(string_agg(edge_id, '|' order by seq)), 1, 8)) as route_id, cast(round_even(sum(length), 0) as bigint) as distance_m, round(sum(seconds), 6) as free_flow_s, count(*) as edges,
  round(max(score), 6) as max_risk, case max(case label when 'high' then 2 when 'medium' then 1 else 0 end) when 2 then 'high' when 1 then 'medium' else 'low' end as risk_label,
  coalesce(sum(case when label = 'high' then cast(round_even(length, 0) as bigint) end), 0)::bigint as high_risk_m, coalesce(string_agg(case when label <> 'low' then edge_id end, ',' order by seq), '') as pieces from fx_route_edge group by route_id""")
def _(T):
    d = R.describe_routes(T.fx_route_edge.withColumnRenamed("route_id", "route"), ["route"])
    return r6(d.select("route", "route_id", "distance_m", "free_flow_s", "edges", "max_risk", "risk_label", "high_risk_m", F.array_join(F.transform("risk_segments", lambda s: s["edge_id"]), ",").alias("pieces")))


@query("w13_itinerary", f"""with l as (select o_custkey as journey_id, row_number() over (partition by o_custkey order by o_orderkey) as leg, cast(floor(o_totalprice) as bigint) % 90 + 5 as minutes, o_orderkey % 10 <> 9 as in_area from orders),
  s as (select *, sum(minutes) over (partition by journey_id order by leg) as tot, bool_or(not in_area) over (partition by journey_id order by leg) as stopped from l)
  select journey_id, leg, stopped, case when not stopped then {ts("timestamp '2026-09-28 12:00:00' + to_minutes(cast(tot - minutes as bigint))")} end as depart, case when not stopped then {ts("timestamp '2026-09-28 12:00:00' + to_minutes(cast(tot as bigint))")} end as arrive from s""")
def _(T):
    from pyspark.sql import Window
    o = T.orders.select(F.col("o_custkey").alias("journey_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("leg"),
                        (F.floor("o_totalprice") % 90 + 5).cast("double").alias("minutes"), (F.col("o_orderkey") % 10 != 9).alias("in_area"), F.lit("2026-09-28 12:00:00").cast("timestamp").alias("start_ts"))
    return text(R.itinerary(o).select("journey_id", "leg", "stopped", "depart", "arrive"), "depart", "arrive")


@query("w14_detours", """with s as (select route_id, seq, x1 as x, y1 as y, seq % 7 in (0, 3) as onu from fx_route_edge), us as (select distinct route_id, x, y from s where onu), v as (select s.route_id, s.seq, s.x, s.y, us.x is not null as on_ from s left join us on us.route_id = s.route_id and us.x = s.x and us.y = s.y),
  k as (select *, sum(case when on_ then 1 else 0 end) over (partition by route_id order by seq) as run from v), r as (select route_id, run, count(*) as n, min(seq) as f, list(x order by seq) as xs, list(y order by seq) as ys from k where not on_ group by route_id, run),
  z as (select *, row_number() over (partition by route_id order by n desc, f) as rank from r) select route_id, rank, n, xs[cast(floor(n / 2) as int) + 1] as x, ys[cast(floor(n / 2) as int) + 1] as y from z where rank <= 3""")
def _(T):
    s = T.fx_route_edge.select("route_id", "seq", F.col("x1").alias("x"), F.col("y1").alias("y"))
    return R.detours(s, s.where((F.col("seq") % 7).isin(0, 3)).select("route_id", "x", "y"))


# journeys of one to five legs; the detours of a leg are the vertices of its roads off the town's main rows
@query("w14_waypoints", """with recursive l as (select journey_id, leg, journey_id * 10e0 + leg as x, leg * 1e0 as y from (select distinct route_id as journey_id, route_id % 5 + 1 as k from fx_route_edge) j, range(5) as r(leg) where leg < k),
  d as (select l.journey_id, l.leg, x1 as x, y1 as y, row_number() over (partition by l.journey_id, l.leg order by seq) as rank from fx_route_edge e join l on l.journey_id = e.route_id and l.leg = e.seq % 5 where e.seq % 3 > 0),
  n as (select l.journey_id, l.leg, count(d.leg) as n, any_value(k.legs) as legs from l left join d on d.journey_id = l.journey_id and d.leg = l.leg join (select journey_id, count(*) as legs from l group by journey_id) k on k.journey_id = l.journey_id group by l.journey_id, l.leg),
  s(journey_id, leg, room, take) as (select journey_id, leg, 4 - legs, least(n, greatest(0, cast(ceil((4 - legs) / legs) as bigint))) from n where leg = 0
    union all select n.journey_id, n.leg, s.room - s.take, least(n.n, greatest(0, cast(ceil((s.room - s.take) / (n.legs - n.leg)) as bigint))) from s join n on n.journey_id = s.journey_id and n.leg = s.leg + 1),
  v as (select d.journey_id, d.leg, 'detour' as kind, rank, d.x, d.y from d join s on s.journey_id = d.journey_id and s.leg = d.leg where rank <= take
    union all select l.journey_id, l.leg, 'stop', 0, x, y from l join (select journey_id, max(leg) as last from l group by journey_id) m on m.journey_id = l.journey_id where leg < last)
  select journey_id, row_number() over (partition by journey_id order by leg, kind, rank) as position, kind, leg, x, y from v""")
def _(T):
    from pyspark.sql import Window
    k = F.col("route_id")
    legs = T.fx_route_edge.select("route_id").distinct().select(k.alias("journey_id"), F.explode(F.sequence(F.lit(0).cast("long"), (k % 5).cast("long"))).alias("leg")).withColumns(
        {"x": F.col("journey_id") * 10.0 + F.col("leg"), "y": F.col("leg").cast("double")})
    e = T.fx_route_edge.where("seq % 3 > 0").select(k.alias("journey_id"), (F.col("seq") % 5).cast("long").alias("leg"), F.col("x1").alias("x"), F.col("y1").alias("y"), "seq")
    e = e.join(legs.select("journey_id", "leg"), ["journey_id", "leg"])
    rank = F.row_number().over(Window.partitionBy("journey_id", "leg").orderBy("seq"))
    return R.waypoints(legs, e.withColumn("rank", rank).drop("seq"))


REC = """rc as (select route_id, um, sm, sm = um and um > 0 as same, um >= 200 as comp, extra, greatest(0, um - sm) as av, st from (select r.route_id, coalesce(sum(case when label = 'high' then cast(round_even(length, 0) as bigint) end), 0)::bigint as um,
    coalesce(sum(case when label = 'high' and highway_ok then cast(round_even(length, 0) as bigint) end), 0)::bigint as sm, (r.route_id % 25) / 10e0 as extra, case when r.route_id % 3 = 0 then null else concat('Street ', r.route_id % 9) end as st
    from (select *, seq % 3 = 0 as highway_ok from fx_route_edge) r group by r.route_id) q)"""
DIST = "case when {m} >= 1000 then printf('%.1f km', {m} / 1000e0) else concat({m}, ' m') end"
EXTRA = "case when extra > 0 then concat('+', case when extra = floor(extra) then cast(cast(extra as bigint) as varchar) else cast(extra as varchar) end, ' min') else 'no extra time' end"


def _rec(T):
    metres = F.bround("length", 0).cast("bigint")
    high = F.col("label") == "high"
    r = T.fx_route_edge.groupBy("route_id").agg(F.coalesce(F.sum(F.when(high, metres)), F.lit(0)).alias("um"), F.coalesce(F.sum(F.when(high & (F.col("seq") % 3 == 0), metres)), F.lit(0)).alias("sm"))
    k = F.col("route_id")
    return r.withColumns({"same": (F.col("sm") == F.col("um")) & (F.col("um") > 0), "comp": F.col("um") >= 200, "extra": (k % 25) / 10.0, "av": F.greatest(F.lit(0), F.col("um") - F.col("sm")),
                          "st": F.when(k % 3 != 0, F.concat(F.lit("Street "), (k % 9).cast("string")))})


@query("x28_recommend", f"""with {REC} select route_id, case when not comp then 'safe' when same then 'no_alternative' when sm < 200 then 'reroute' else 'reroute_caution' end as action,
  case when not comp then 'No high flood-risk roads on your usual route.' when same then concat('No safer route: your trip has to cross ', {DIST.format(m='um')}, ' of flood-prone road. Consider leaving later.')
    when sm < 200 then concat('High flood risk ', case when st is null then 'on your usual route' else concat('on ', st) end, '. Take the safer route (', {EXTRA}, ').')
    else concat('The safer route avoids ', {DIST.format(m='av')}, ' of flood-prone road but still crosses ', {DIST.format(m='sm')}, '. Drive carefully (', {EXTRA}, ').') end as message from rc""")
def _(T):
    a, m = X.recommend("comp", "same", "um", "sm", "extra", "av", "st")
    return _rec(T).select("route_id", a.alias("action"), m.alias("message"))


@query("x29_trip_record", f"""with {REC}, t as (select *, case when comp and not same then 'safe' else 'usual' end as take from rc), o as (select *, take = 'safe' and not same as os from t)
  select route_id, take, case when os then av else 0 end as high_risk_m_avoided, case when os then extra else 0 end as extra_minutes,
    round_even(case when comp then greatest(0, 15 * (case when um = 0 then 0 else (case when os then av else 0 end) / um end) - case when os then extra else 0 end) else 0 end, 1) as time_saved_minutes from o""")
def _(T):
    a, _ = X.recommend("comp", "same", "um", "sm", "extra", "av", "st")
    p = _rec(T).select("route_id", F.col("comp").alias("compromised"), F.col("same").alias("same_route"), F.col("um").alias("usual_high_m"), a.alias("action"), F.col("extra").alias("extra_minutes"),
                       F.col("av").alias("high_risk_m_avoided"), F.lit(0).alias("high_risk_segments_avoided"))
    return R.record_trips(p, None).select("route_id", "take", F.col("high_risk_m_avoided").cast("bigint").alias("high_risk_m_avoided"), "extra_minutes", "time_saved_minutes")


def trip_graph(T):
    """Edges with cost inputs for routing at one moment."""
    f = V.closure_flags(T.fx_edge, T.fx_closure, "1998-06-01 00:00:00").join(V.effective_risk(T.fx_static, T.fx_score).drop("street_id"), "edge_id")
    return f.select("u", "v", "edge_id", "name", "length", (F.col("length") / 10).alias("seconds"), "closed", "slowed", "score", "label")


# distances to every target, each node's entry replaced while it still falls
DISTANCES = f"""{EFFECTIVE}, {ACTIVE}, opened as materialized (select e.u, e.v, length / 10 * case when coalesce(slowed, false) then 1.5e0 else 1 end as b, score, label
    from fx_edge e join eff on eff.edge_id = e.edge_id left join ac on ac.edge_id = e.edge_id where not coalesce(closed, false) and e.u <> e.v),
  arcs as materialized (select kind, u, v, min(cost) as cost from (select 'usual' as kind, u, v, b as cost from opened
    union all select 'safe', u, v, b * (1 + 2 * score) * case when label = 'high' then 5 else 1 end from opened) t group by kind, u, v),
  pr as materialized (select distinct from_node as source, to_node as target from fx_trip where from_node <> to_node),
  d(kind, root, node, dist) using key (kind, root, node) as (select kind, target, target, 0e0 from (select distinct target from pr) t, (values ('usual'), ('safe')) k(kind)
    union select a.kind, d.root, a.u, min(d.dist + a.cost) from d join arcs a on a.kind = d.kind and a.v = d.node left join recurring.d o on o.kind = a.kind and o.root = d.root and o.node = a.u
      group by a.kind, d.root, a.u, o.dist having o.dist is null or min(d.dist + a.cost) < o.dist)"""


@query("g4_batch_paths", f"""with recursive {DISTANCES} select k.kind, source, target, round(dist, 6) as total
  from pr cross join (values ('usual'), ('safe')) k(kind) left join d on d.kind = k.kind and d.root = pr.target and d.node = pr.source""")
def _(T):
    from highwater.operators.graph import batch_paths
    pairs = T.fx_trip.select(F.col("from_node").alias("source"), F.col("to_node").alias("target")).distinct()
    return r6(batch_paths(R.route_costs(trip_graph(T)), pairs)[1])


@query("g5_compare_routes")
def _(T):
    c = R.compare_routes(T.fx_trip.select("trip_id", "from_node", "to_node"), trip_graph(T))
    return c.select("trip_id", "status", "compromised", "same_route", "extra_minutes", "high_risk_m_avoided", "high_risk_segments_avoided", "action", "message")


# every trip as a request by place: some start off the node, every eleventh far outside, every thirteenth without a start
REQUEST = """select trip_id, arrive_by, case when trip_id % 13 = 0 then null when trip_id % 11 = 0 then -900e0 - (trip_id % 5) * 100e0 else (from_node % 40) * 100e0 + (trip_id % 4) * 9e0 end as from_x,
  floor(from_node / 40e0) * 100e0 + (trip_id % 3) * 7e0 as from_y, (to_node % 40) * 100e0 - (trip_id % 2) * 11e0 as to_x, floor(to_node / 40e0) * 100e0 as to_y from fx_trip"""


@query("g5_plan_trips", f"""with recursive rq as materialized ({REQUEST}), places as (select distinct from_x as x, from_y as y from rq where from_x is not null union select distinct to_x, to_y from rq),
  snap as materialized (select x, y, n.node as node, n.m as m from (select p.x, p.y, min(row(round(sqrt(power(p.x - f.x, 2) + power(p.y - f.y, 2)), 6), f.node_id)) as b from places p, fx_node f group by p.x, p.y) t,
    lateral (select b[2] as node, b[1] as m) n),
  st as materialized (select trip_id, arrive_by, a.node as from_node, b.node as to_node, a.m as from_m, b.m as to_m from rq left join snap a on a.x = from_x and a.y = from_y left join snap b on b.x = to_x and b.y = to_y),
  {DISTANCES.replace("select distinct from_node as source, to_node as target from fx_trip where from_node <> to_node",
                     "select distinct from_node as source, to_node as target from st where from_node <> to_node")}
  select trip_id, from_node, to_node, case when from_node is null then 'no_place' when from_node = to_node then 'same_place' when d.dist is null then 'unreachable' else 'ok' end as status,
    from_m <= 300 as origin_in_area, to_m <= 300 as destination_in_area,
    nullif(concat_ws(' ', case when from_m > 300 then printf('Start is outside the mapped area; the route begins at the nearest mapped road (%.1f km away).', from_m / 1000) end,
      case when to_m > 300 then printf('Destination is outside the mapped area; the route ends at the nearest mapped road (%.1f km away).', to_m / 1000) end), '') as note,
    round_even(d.dist / 60, 1) as usual_minutes, strftime(arrive_by - to_microseconds(cast(round_even(d.dist * 1000000, 0) as bigint)), '%Y-%m-%dT%H:%M:%SZ') as usual_departs
  from st left join d on d.kind = 'usual' and d.root = st.to_node and d.node = st.from_node and st.from_node <> st.to_node""")
def _(T):
    from highwater.operators.planning import plan_trips
    k, trip = F.col("trip_id"), T.fx_trip
    away = F.when(k % 13 == 0, None).when(k % 11 == 0, -900.0 - (k % 5) * 100).otherwise((F.col("from_node") % 40) * 100.0 + (k % 4) * 9)
    requests = trip.select("trip_id", "arrive_by", F.lit(None).cast("timestamp").alias("depart_at"), away.alias("from_x"),
                           (F.floor(F.col("from_node") / 40) * 100.0 + (k % 3) * 7).alias("from_y"),
                           ((F.col("to_node") % 40) * 100.0 - (k % 2) * 11).alias("to_x"), (F.floor(F.col("to_node") / 40) * 100.0).alias("to_y"))
    edges = T.lines().join(V.effective_risk(T.fx_static, T.fx_score).drop("street_id"), "edge_id").select(
        "u", "v", "edge_id", "name", "length", (F.col("length") / 10).alias("seconds"), "score", "label", "geom")
    closures = T.fx_closure.select("edge_id", "closure_id", F.lit(None).cast("string").alias("name"), "kind", "full_closure", "start", "end")
    p = plan_trips(requests, T.fx_node, edges, closures, "1998-06-01 00:00:00")
    return p.select("trip_id", "from_node", "to_node", "status", "origin_in_area", "destination_in_area", "note",
                    F.col("usual.eta_minutes").alias("usual_minutes"), F.col("usual.depart_at").alias("usual_departs"))


# one-way roads up the numbers, and some back inside a row of the town: components of many sizes
@query("g3_strong_components", """with recursive arcs as materialized (select distinct u, v from fx_base_edge where u <> v union select distinct v, u from fx_base_edge where j >= 4 and status <> 'P' and u // 40 = v // 40),
  reach(a, b) as (select u, v from arcs union select reach.a, arcs.v from reach join arcs on arcs.u = reach.b),
  n as (select u as id from arcs union select v from arcs), m as (select r.a as id, min(r.b) as low from reach r join reach s on s.a = r.b and s.b = r.a group by r.a)
  select n.id, least(n.id, coalesce(low, n.id)) as component from n left join m on m.id = n.id""")
def _(T):
    from highwater.operators.graph import strong_components
    e = T.fx_base_edge.select("u", "v", "j", "status")
    row = lambda c: F.floor(F.col(c) / 40)
    back = e.where((F.col("j") >= 4) & (F.col("status") != "P") & (row("u") == row("v"))).select(F.col("v").alias("u"), F.col("u").alias("v"))
    return strong_components(e.select("u", "v").unionByName(back))


@query("g3_largest_scc", """with recursive arcs as materialized (select distinct u, v from fx_edge where u <> v),
  reach(a, b) as (select u, v from arcs union select reach.a, arcs.v from reach join arcs on arcs.u = reach.b),
  n as (select u as id from arcs union select v from arcs), m as (select r.a as id, min(r.b) as low from reach r join reach s on s.a = r.b and s.b = r.a group by r.a),
  c as (select n.id, least(n.id, coalesce(low, n.id)) as component from n left join m on m.id = n.id)
  select id from c where component = (select component from c group by component order by count(*) desc, component limit 1)""")
def _(T):
    from highwater.operators.graph import largest_scc
    return largest_scc(T.unkept("fx_edge").select("u", "v"))


# ------------------------------------------------------------------ people
@query("x26_search_minutes", f"""select trip_id, case t.type when 'garage' then 5 when 'surface' then 3 when 'street_side' then 5 else 3 end
  + case when isodow(loc) < 6 and extract(hour from loc) + extract(minute from loc) / 60e0 >= 7.5 and extract(hour from loc) + extract(minute from loc) / 60e0 < 11 then 4 else 0 end as minutes
  from (select trip_id, case cast(trip_id % 4 as int) when 0 then 'garage' when 1 then 'surface' when 2 then 'street_side' else 'other' end as type, timezone('America/New_York', timezone('UTC', created_at + to_minutes(trip_id % 900))) as loc from fx_trip) t""")
def _(T):
    k = F.col("trip_id") % 4
    kind = F.when(k == 0, "garage").when(k == 1, "surface").when(k == 2, "street_side").otherwise("other")
    at = F.expr("created_at + make_dt_interval(0, 0, cast(trip_id % 900 as int))")
    return T.fx_trip.select("trip_id", X.search_minutes(kind, at).alias("minutes"))


@query("x27_leave_by", f"""select trip_id, {ts("date_trunc('minute', arrive_by - to_microseconds(cast((trip_id % 30 + trip_id % 12 + trip_id % 5) * 60000000 + (trip_id % 1999) * 1000000 as bigint)))")} as leave_by,
  cast(round_even((trip_id % 977) * 1.3e0 / 80, 0) as bigint) as walk from fx_trip""")
def _(T):
    k = F.col("trip_id")
    return text(T.fx_trip.select("trip_id", X.leave_by("arrive_by", k % 30, k % 12, k % 5, k % 1999).alias("leave_by"), X.walk_minutes(k % 977).alias("walk")), "leave_by")


RESOLVE = """rs as (select event_id, user_id, start_ts, location, case when lower(location) like 'zoom%' or location is null or location = 'Unknown place' then null
   when location like 'room nati%' then concat('B', split_part(location, ' ', 3)) else upper(split_part(location, ' ', 1)) end as code from fx_event)"""


@query("j16_resolve_location", f"with {RESOLVE} select event_id, code from rs")
def _(T):
    return R.resolve_location(T.fx_event, T.fx_building).select("event_id", "code")


@query("w11_next_event", f"""with p as (select *, row_number() over (partition by user_id order by start_ts, event_id) as r from fx_event where start_ts >= timestamp '1998-01-01' and location is not null and location not like 'Zoom%')
  select user_id, event_id, {ts('start_ts')} as start_ts from p where r = 1""")
def _(T):
    return text(R.next_events(T.fx_event, "1998-01-01 00:00:00").select("user_id", "event_id", "start_ts"), "start_ts")


@query("c1_expand_schedule", f"""with c as (select c_custkey as class_id, c_custkey % 7 + 1 as dow, 480 + (c_custkey % 10) * 30 as m from customer), d as (select cast(unnest(generate_series(date '2024-03-04', date '2024-03-18', interval 1 day)) as date) as d),
  e as (select class_id, d, timezone('UTC', timezone('America/New_York', cast(d as timestamp) + to_minutes(m))) as s from c join d on isodow(d) in (dow, dow % 7 + 1))
  select class_id, concat('ev', class_id, '_', strftime(d, '%Y%m%d')) as event_id, {ts('s')} as start_ts from e where s >= timestamp '2024-03-04 14:00:00' and s < timestamp '2024-03-18 14:00:00'""")
def _(T):
    return text(R.expand_schedule(_classes(T), "2024-03-04 14:00:00", "2024-03-18 14:00:00").select("class_id", "event_id", "start_ts"), "start_ts")


def _classes(T):
    codes = F.array(*[F.lit(x) for x in R.WEEKDAYS])
    k = F.col("c_custkey")
    at = lambda i: F.element_at(codes, (i % 7 + 1).cast("int"))
    return T.customer.select(k.alias("class_id"), F.array(at(k), at(k + 1)).alias("days"), (480 + (k % 10) * 30).alias("start_min"), (555 + (k % 10) * 30).alias("end_min"))


@query("c2_expand_exceptions", f"""with c as (select c_custkey as class_id, c_custkey % 7 + 1 as dow, 480 + (c_custkey % 10) * 30 as m from customer), d as (select cast(unnest(generate_series(date '2024-03-04', date '2024-03-18', interval 1 day)) as date) as d),
  e as (select class_id, d, m, timezone('UTC', timezone('America/New_York', cast(d as timestamp) + to_minutes(m))) as s from c join d on isodow(d) in (dow, dow % 7 + 1)),
  k as (select * from e where s >= timestamp '2024-03-04 14:00:00' and s < timestamp '2024-03-18 14:00:00')
  select concat('ev', class_id, '_', strftime(d, '%Y%m%d')) as event_id, {ts("case when d = date '2024-03-08' then timestamp '2024-03-09 15:00:00' else s end")} as start_ts from k where d <> date '2024-03-06'""")
def _(T):
    c = _classes(T)
    every = c.select("class_id", "days").withColumn("date", F.to_date(F.lit("2024-03-06"))).select("class_id", "date")
    on = lambda d, code: c.where(F.array_contains("days", code)).select("class_id", F.to_date(F.lit(d)).alias("date"))
    at = lambda s: F.lit(s).cast("timestamp")
    moved = on("2024-03-08", "FR").select("class_id", "date", at("2024-03-09 15:00:00").alias("start_ts"), at("2024-03-09 16:00:00").alias("end_ts"))
    return text(R.expand_with_exceptions(c, every, moved, "2024-03-04 14:00:00", "2024-03-18 14:00:00").select("event_id", "start_ts"), "start_ts")


@query("c5_add_test_events", """select event_id from fx_event where start_ts >= timestamp '1999-01-01' union all select concat('t', user_id) from fx_user where buffer < 20""")
def _(T):
    base = T.fx_event.where("start_ts >= '1999-01-01'").select("event_id", "user_id", "start_ts")
    extra = T.fx_user.select(F.concat(F.lit("t"), F.col("user_id")).alias("event_id"), "user_id", F.expr("timestamp '1999-01-01' + make_dt_interval(buffer)").alias("start_ts"))
    return R.add_test_events(base, extra, "1999-01-01 00:00:00", "1999-01-21 00:00:00").select("event_id")


GOODLOT = "gl as (select * from fx_lot where name not like '%Unnamed%' and name not like '%Staff%' and coalesce(access, '') <> 'private')"
QUERYSQL = f"""{RESOLVE}, {GOODLOT}, nr as (select b.code, min(round(sqrt(power(g.x - b.x, 2) + power(g.y - b.y, 2)), 6)) as d, arg_min(g.lot_id, (round(sqrt(power(g.x - b.x, 2) + power(g.y - b.y, 2)), 6), g.lot_id)) as lot from fx_building b, gl g group by b.code),
  j as (select rs.*, b.x as bx, b.y as by_, u.buffer, p.lot_id as pl, round(sqrt(power(p.x - b.x, 2) + power(p.y - b.y, 2)), 6) as pd, case when nr.d <= 800 then nr.lot end as nl, nr.d as nd from rs left join fx_building b on b.code = rs.code left join fx_user u on u.user_id = rs.user_id left join fx_lot p on p.lot_id = u.preferred_lot left join nr on nr.code = rs.code),
  w as (select *, case when bx is null then null else coalesce(pl, nl) end as lot_id, case when bx is null then null else coalesce(cast(round_even(case when pl is not null then pd when nl is not null then nd end * 1.3e0 / 80, 0) as bigint), 0) end as walk_min from j),
  v as (select w.*, l.type, timezone('America/New_York', timezone('UTC', start_ts - to_minutes(cast(buffer + walk_min as bigint)))) as loc from w left join fx_lot l on l.lot_id = w.lot_id),
  q as (select *, case when bx is null then null when lot_id is null then 0 else case type when 'surface' then 3 else 5 end + case when isodow(loc) < 6 and extract(hour from loc) + extract(minute from loc) / 60e0 >= 7.5 and extract(hour from loc) + extract(minute from loc) / 60e0 < 11 then 4 else 0 end end as search_min from v)"""


@query("c3_events_with_queries", f"with {QUERYSQL} select event_id, code as building, lot_id, walk_min, search_min::double as search_min, {ts('start_ts - to_minutes(cast(buffer + walk_min + search_min as bigint))')} as arrive_by from q")
def _(T):
    e = R.events_with_queries(T.fx_event, T.fx_user, T.fx_building, T.fx_lot)
    return text(e.select("event_id", "building", "lot_id", "walk_min", "search_min", "arrive_by"), "arrive_by")


@query("c4_next_trip", f"""with {QUERYSQL}, nx as (select *, row_number() over (partition by user_id order by start_ts, event_id) as r from q where start_ts >= timestamp '1998-01-01' and location is not null and location not like 'Zoom%'),
  lv as (select user_id, event_id, start_ts, date_trunc('minute', start_ts - to_minutes(cast(buffer + walk_min + search_min as bigint)) - to_seconds(cast(regexp_extract(event_id, '[0-9]+') as bigint) % 1999)) as lb from nx where r = 1)
  select user_id, event_id, {ts('lb')} as leave_by, cast(round_even(date_diff('second', timestamp '1998-01-01', lb) / 60e0, 0) as bigint) as leave_in_minutes from lv""")
def _(T):
    nxt = R.next_events(T.fx_event, "1998-01-01 00:00:00")
    q = R.events_with_queries(nxt, T.fx_user, T.fx_building, T.fx_lot)
    plans = nxt.select("event_id", "user_id", F.lit("usual").alias("take"), (F.regexp_extract("event_id", "[0-9]+", 0).cast("bigint") % 1999).alias("drive_s"))
    return text(R.next_trips(q, plans, "1998-01-01 00:00:00").select("user_id", "event_id", "leave_by", "leave_in_minutes"), "leave_by")


def _alert_table(T, half: str):
    a = T.fx_alert_event.withColumn("alert_id", F.col("alert_key"))
    part = a.where(F.col("ts") < "2024-01-16") if half == "old" else a.where(F.col("ts") >= "2024-01-16")
    g = part.groupBy("user_id", "alert_id").agg(F.max_by(F.struct("source", "severity", "event_id"), "ts").alias("r"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max("checked").alias("checked"))
    return g.select("user_id", "alert_id", "r.source", "r.severity", "r.event_id", "created_at", "updated_at")


OLDNEW = """o as (select user_id, alert_key as alert_id, max_by(source, ts) as source, max_by(severity, ts) as severity, max_by(event_id, ts) as event_id, min(ts) as created_at, max(ts) as updated_at from fx_alert_event where ts < timestamp '2024-01-16' group by user_id, alert_key),
  n0 as (select user_id, alert_key as alert_id, max_by(source, ts) as source, max_by(severity, ts) as severity, max_by(event_id, ts) as event_id from fx_alert_event where ts >= timestamp '2024-01-16' group by user_id, alert_key),
  n as (select * from n0 where event_id % 3 <> 0), ck as (select distinct user_id, source from fx_alert_event where checked and event_id % 7 = 0)"""


def _existing(T):
    return _alert_table(T, "old").select("user_id", "alert_id", "source", "severity", (F.col("event_id") % 5 != 0).alias("active"), (F.col("event_id") % 2 == 0).alias("read"), "created_at", "updated_at", F.lit(None).cast("timestamp").alias("resolved_at"))


@query("u4_diff_alerts", f"""with {OLDNEW}, j as (select coalesce(o.user_id, n.user_id) as user_id, coalesce(o.alert_id, n.alert_id) as alert_id, o.source as os, n.source as ns, o.severity as ov, n.severity as nv, coalesce(o.event_id % 5 <> 0, false) as was, coalesce(o.event_id % 2 = 0, false) as rd, o.created_at, o.updated_at, n.user_id is not null as isn, o.user_id is not null as iso from o full join n on o.user_id = n.user_id and o.alert_id = n.alert_id),
  k as (select j.*, not isn and was and ck.user_id is not null as gone from j left join ck on ck.user_id = j.user_id and ck.source = j.os)
  select user_id, alert_id, coalesce(ns, os) as source, coalesce(nv, ov) as severity, case when isn then true when gone then false else was end as active, case when isn then was and rd and {RANK.format(c='nv')} <= {RANK.format(c='ov')} else rd end as read,
    {ts("case when isn and not was then timestamp '2024-02-01' else created_at end")} as created_at, {ts("case when isn or gone then timestamp '2024-02-01' else updated_at end")} as updated_at, case when gone then '2024-02-01 00:00:00' end as resolved_at from k""")
def _(T):
    fresh = _alert_table(T, "new").where(F.col("event_id") % 3 != 0)
    checked = T.fx_alert_event.where("checked").where(F.col("event_id") % 7 == 0).select("user_id", "source")
    return text(R.diff_alerts(_existing(T), fresh, checked, "2024-02-01 00:00:00"), "created_at", "updated_at", "resolved_at")


@query("t3_list_alerts", f"with {OLDNEW} select user_id, alert_id, severity, {RANK.format(c='severity')} as severity_rank, {ts('updated_at')} as updated_at from o where event_id % 5 <> 0")
def _(T):
    return text(R.list_alerts(_existing(T)).select("user_id", "alert_id", "severity", "severity_rank", "updated_at"), "updated_at")


@query("f28_mark_read", f"with {OLDNEW} select user_id, alert_id, event_id % 2 = 0 or exists (select 1 from n where n.user_id = o.user_id and n.alert_id = o.alert_id) as read from o")
def _(T):
    req = _alert_table(T, "new").where(F.col("event_id") % 3 != 0)
    return C.mark_read(_existing(T), req)[0].select("user_id", "alert_id", "read")


@query("f28_unknown_alerts", f"with {OLDNEW} select user_id, alert_id from n where not exists (select 1 from o where n.user_id = o.user_id and n.alert_id = o.alert_id and o.event_id % 5 <> 0)")
def _(T):
    req = _alert_table(T, "new").where(F.col("event_id") % 3 != 0)
    return C.mark_read(_existing(T).where("active"), req)[1]


@query("s17_upsert", f"""with {OLDNEW} select coalesce(n0.user_id, o.user_id) as user_id, coalesce(n0.alert_id, o.alert_id) as alert_id, coalesce(n0.severity, o.severity) as severity from o full join n0 on o.user_id = n0.user_id and o.alert_id = n0.alert_id""")
def _(T):
    a = T.fx_alert_event.select("user_id", F.col("alert_key").alias("alert_id"), "severity", "ts")
    old = _alert_table(T, "old").select("user_id", "alert_id", "severity", F.col("updated_at").alias("ts"))
    return R.upsert(old, a.where(F.col("ts") >= "2024-01-16"), ["user_id", "alert_id"], "ts").select("user_id", "alert_id", "severity")


@query("s18_delete_where", "select trip_id from fx_trip where not (user_id = 'u7' and status = 'P')")
def _(T):
    return C.delete_where(T.fx_trip.withColumn("demo", F.col("status") == "P"), "u7", "demo").select("trip_id")


@query("x30_trip_alerts", f"""with t as (select trip_id, user_id, concat('e', trip_id) as e, concat('Class ', trip_id % 40) as nm, ltrim(strftime(timezone('America/New_York', timezone('UTC', arrive_by)), '%I:%M %p'), '0') as lv, status, prio, trip_id % 20 as dl,
    {ts("arrive_by + interval 1 hour")} as ends, case when from_node % 9 > 0 then ' around Street ' || (from_node % 9) else '' end as wh, case when trip_id % 4 > 0 then 'Park at Lot ' || (trip_id % 11) || ' instead.' else 'No nearby lot is clearly safer, so allow extra time.' end as other
    from fx_trip where arrive_by + interval 1 hour <= timestamp '1997-01-01 12:00:00'),
  r as (select user_id, 'route_flood|' || e as alert_key, 'trip' as source, 'route_flood' as type, case when status = 'P' then 'critical' else 'warning' end as severity, case when status = 'P' then 'Critical' else 'Warning' end || ': Flooding expected on your route to ' || nm as title,
      'Estimated flood levels are high on your usual route' || wh || '. ' || case status when 'P' then 'There is no safer way around. Drive carefully, or leave later if you can.' when 'O' then 'Take the safer route and drive carefully: it avoids most of the flooding, not all of it.' else 'Take the safer route.' end || ' Leave by ' || lv || '.' as message,
      e as event_id, 's' || (trip_id % 13) as segment_id, null as parking_id, ends as expires_at from t where prio = '1-URGENT'
    union all select user_id, 'parking_flood|' || e, 'trip', 'parking_flood', 'warning', 'Warning: Lot ' || (trip_id % 7) || ' may flood', 'Estimated flood levels are high at Lot ' || (trip_id % 7) || '. ' || other, e, null, 'p' || (trip_id % 7), ends from t where prio = '2-HIGH'
    union all select user_id, 'leave_earlier|' || e, 'trip', 'leave_earlier', 'info', 'Info: Heavy traffic on the way to ' || nm, 'Traffic is heavier than usual. Leave by ' || lv || '.', e, null, null, ends from t where dl >= 10
    union all select user_id, 'closure|' || e || '|c' || x, 'trip', 'closure', 'info', 'Info: Road work on your route to ' || nm, 'Main St ' || x || ' is ' || case when x = 1 then 'closed' else 'under construction' end || '. Your leave-by time already allows for it.', e, null, null, ends
      from t, (values (1), (2)) v(x) where status = 'F' and x <= trip_id % 3)
  select *, 'al_' || substr(sha1(alert_key), 1, 10) as alert_id from r""")
def _(T):
    k = F.col("trip_id")
    named = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    works = F.transform(F.sequence(F.lit(1), F.lit(2)), lambda x: F.struct(named("c", x).alias("closure_id"), named("Main St ", x).alias("name"), (x == 1).alias("full")))
    t = T.fx_trip.select("user_id", named("e", k).alias("event_id"), named("Class ", k % 40).alias("event_name"), F.expr("arrive_by + interval 1 hour").alias("start_ts"), F.col("arrive_by").alias("leave_by"),
                         (F.col("prio") == "1-URGENT").alias("compromised"), F.when(F.col("status") == "P", "no_alternative").when(F.col("status") == "O", "reroute_caution").otherwise("reroute").alias("action"),
                         F.when(F.col("from_node") % 9 > 0, named("Street ", F.col("from_node") % 9)).alias("street"), named("s", k % 13).alias("segment_id"), named("p", k % 7).alias("lot_id"),
                         named("Lot ", k % 7).alias("lot_name"), (F.col("prio") == "2-HIGH").alias("lot_hazardous"), F.when(k % 4 > 0, named("Lot ", k % 11)).alias("other_lot"), (k % 20).cast("double").alias("delay_minutes"),
                         F.when(F.col("status") == "F", F.slice(works, F.lit(1), (k % 3).cast("int"))).alias("closures"))
    return text(R.trip_alerts(t, "1997-01-01 00:00:00"), "expires_at")


@query("x31_area_alerts", f"""with w as (select concat('u', user_id) as user_id, concat('nws|', event_id) as alert_key, case event_type when 'error' then 'Severe' when 'signup' then 'Moderate' when 'view' then 'Unknown' when 'click' then 'Minor' end as sv, {ts("ts + interval 6 hour")} as ends from events),
  s as (select *, case sv when 'Severe' then 'critical' when 'Moderate' then 'warning' else 'info' end as severity from w)
  select user_id, alert_key, 'nws' as source, 'weather_warning' as type, severity, upper(severity[1]) || severity[2:] || ': Flood Warning' as title,
    'The National Weather Service has issued this for your area' || case when sv is null or sv = 'Unknown' then '.' else ' (severity: ' || lower(sv) || ').' end || ' Avoid low-lying and flooded roads.' as message, null as event_id, null as segment_id, null as parking_id, ends as expires_at, 'al_' || substr(sha1(alert_key), 1, 10) as alert_id from s
  union all select concat('u', user_id), 'tide|' || strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d'), 'tide', 'tide', case when value >= 450 then 'critical' else 'warning' end, case when value >= 450 then 'Critical' else 'Warning' end || ': High tide in Biscayne Bay',
    'Estimated water levels in Biscayne Bay are at the ' || case when value >= 450 then 'moderate' else 'minor' end || ' flood level. Low-lying bayfront streets (Brickell, near the Miami River) may flood even without rain.', null, null, null, null, 'al_' || substr(sha1('tide|' || strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d')), 1, 10) from events where value >= 300""")
def _(T):
    u = F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id")
    k = F.col("event_type")
    sev = F.when(k == "error", "Severe").when(k == "signup", "Moderate").when(k == "view", "Unknown").when(k == "click", "Minor")
    w = T.events.select(u, F.col("event_id").cast("string").alias("id"), F.lit("Flood Warning").alias("event"), sev.alias("severity"), F.expr("ts + interval 6 hours").alias("ends"))
    t = T.events.select(u, F.col("ts").alias("at"), (F.col("value") >= 300).alias("above_minor"), (F.col("value") >= 450).alias("above_moderate"))
    return text(R.weather_alert_rows(w).unionByName(R.tide_alert_rows(t)), "expires_at")


TRIPREC = """tr as (select trip_id, user_id, created_at, (trip_id % 90) / 10e0 as saved, trip_id % 4 as segs, (trip_id * 7) % 900 as av, trip_id % 3 = 0 as comp, case when trip_id % 2 = 0 then 'safe' else 'usual' end as take from fx_trip)"""


def _trips(T):
    k = F.col("trip_id")
    return T.fx_trip.select("trip_id", "user_id", "created_at", ((k % 90) / 10.0).alias("time_saved_minutes"), (k % 4).alias("high_risk_segments_avoided"), ((k * 7) % 900).alias("high_risk_m_avoided"), (k % 3 == 0).alias("compromised"), F.when(k % 2 == 0, "safe").otherwise("usual").alias("take"))


@query("a18_dashboard", f"""with {TRIPREC}, d as (select user_id, count(*) as trips_planned, cast(round_even(sum(saved), 0) as bigint) as time_saved_minutes, sum(segs)::bigint as risky_segments_avoided, round_even(sum(av) / 1000e0, 1) as high_risk_km_avoided, count(*) filter (where comp) as compromised_trips, count(*) filter (where take = 'safe' and av > 0) as safer_routes_taken from tr group by user_id),
  a as (select user_id, count(*) as alerts_received from (select distinct user_id, alert_key from fx_alert_event) t group by user_id)
  select coalesce(d.user_id, a.user_id) as user_id, coalesce(trips_planned, 0) as trips_planned, coalesce(time_saved_minutes, 0) as time_saved_minutes, coalesce(risky_segments_avoided, 0) as risky_segments_avoided, coalesce(high_risk_km_avoided, 0) as high_risk_km_avoided,
    coalesce(compromised_trips, 0) as compromised_trips, coalesce(safer_routes_taken, 0) as safer_routes_taken, coalesce(alerts_received, 0) as alerts_received from d full join a on a.user_id = d.user_id""")
def _(T):
    return R.dashboard(_trips(T), T.fx_alert_event.select("user_id", "alert_key").distinct())


@query("t4_recent_trips", "select user_id, trip_id, position from (select user_id, trip_id, row_number() over (partition by user_id order by created_at desc, trip_id desc) as position from fx_trip) t where position <= 5")
def _(T):
    return R.recent_trips(T.fx_trip).select("user_id", "trip_id", "position")
