"""Domain tables derived from the shared test tables.

Each is one SELECT in the common part of Spark SQL and ANSI SQL, so the check engine can run the same text. Every
projection reads its whole source table. Names start with ``fx_``; a projection may use earlier ones.
"""
import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from highwater.functions.geometry import box_ring, line

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


class SparkText:
    """The few places where the two engines spell things differently."""
    add_days = staticmethod(lambda ts, n: f"({ts} + make_dt_interval(cast({n} as int)))")
    add_hours = staticmethod(lambda ts, n: f"({ts} + make_dt_interval(0, cast({n} as int)))")
    add_minutes = staticmethod(lambda ts, n: f"({ts} + make_dt_interval(0, 0, cast({n} as int)))")


class CheckText:
    add_days = staticmethod(lambda ts, n: f"({ts} + to_days(cast({n} as integer)))")
    add_hours = staticmethod(lambda ts, n: f"({ts} + to_hours(cast({n} as bigint)))")
    add_minutes = staticmethod(lambda ts, n: f"({ts} + to_minutes(cast({n} as bigint)))")


FX = {}


def projection(f):
    FX[f.__name__] = f
    return f


@projection
def fx_n(d):
    return "select count(*) as n from customer"


@projection
def fx_base_edge(d):
    return """select ok, u, v, j, prio, status, odate from (
  select o_orderkey as ok, o_custkey as u,
         o_custkey + case cast(o_orderkey % 4 as int) when 0 then 1 when 1 then 40 when 2 then 41 else 39 end as v,
         cast(floor(o_totalprice) as bigint) % 6 as j, o_orderpriority as prio, o_orderstatus as status, o_orderdate as odate
  from orders) t where v < (select n from fx_n)"""


@projection
def fx_edge(d):
    return """select edge_id, min(edge_id) over (partition by ok) as street_id, ok, u, v, key, status, odate, prio as highway, j,
  case when ok % 7 = 0 then null else concat('Street ', cast(ok % 50 as string)) end as name,
  x0, y0, xm, ym, x1, y1,
  sqrt(power(xm - x0, 2) + power(ym - y0, 2)) + sqrt(power(x1 - xm, 2) + power(y1 - ym, 2)) as length,
  ok % 37 = 0 as is_bridge, ok % 43 = 0 as is_tunnel, ok % 41 = 0 as mixed_tags,
  case when ok % 3 = 0 then 'county' else 'city' end as jurisdiction,
  case when ok % 6 = 0 then null else cast(30 + (ok % 5) * 10 as double) end as speed_kph
from (select *, concat(cast(u as string), '_', cast(v as string), '_', cast(key as string)) as edge_id,
        (x0 + x1) / 2 + j as xm, (y0 + y1) / 2 + j as ym
      from (select *, row_number() over (partition by u, v order by ok) - 1 as key,
              (u % 40) * 100e0 as x0, floor(u / 40e0) * 100e0 as y0, (v % 40) * 100e0 as x1, floor(v / 40e0) * 100e0 as y1
            from (select ok, u, v, j, prio, status, odate from fx_base_edge
                  union all select ok, v as u, u as v, j, prio, status, odate from fx_base_edge where status <> 'P') b) k) e"""


@projection
def fx_edge_seg(d):
    return """select edge_id, is_bridge, 0 as seg, x0 as ax, y0 as ay, xm as ex, ym as ey from fx_edge
union all select edge_id, is_bridge, 1 as seg, xm as ax, ym as ay, x1 as ex, y1 as ey from fx_edge"""


@projection
def fx_fema(d):
    return """select edge_id,
  case highway when '1-URGENT' then 'AE' when '4-NOT SPECIFIED' then null else 'X' end as zone,
  case highway when '2-HIGH' then '0.2 PCT ANNUAL CHANCE FLOOD HAZARD' when '3-MEDIUM' then 'AREA OF MINIMAL FLOOD HAZARD'
    when '5-LOW' then 'AREA OF MINIMAL FLOOD HAZARD' else null end as subtype,
  case highway when '1-URGENT' then true when '4-NOT SPECIFIED' then null else false end as sfha
from fx_edge"""


@projection
def fx_sample(d):
    return """select e.edge_id, nullif(l.l_quantity, 13e0) / 10e0 - 0.5e0 as z, l.l_discount * 10e0 as depth,
  l.l_tax * 10e0 + 1e0 as criteria from lineitem l join fx_edge e on l.l_orderkey = e.ok"""


@projection
def fx_report(d):
    return """select event_id, case when event_id % 100 in (1, 2) then event_id - event_id % 100 else event_id end as ticket_id,
  ts, cast(ts as date) as date, user_id as street_id, event_type as type,
  case event_type when 'error' then 'flood' else 'drain' end as category,
  case when user_id % 3 = 0 then 'county' else 'city' end as source,
  cast((event_id * 97) % 4000 as double) as x, cast((event_id * 61) % cast(floor((select n from fx_n) / 40e0) * 100 as bigint) as double) as y
from events where event_type in ('error', 'signup')"""


@projection
def fx_point(d):
    return """select event_id as point_id, event_type as type, cast((event_id * 97) % 4000 as double) as x,
  cast((event_id * 61) % cast(floor((select n from fx_n) / 40e0) * 100 as bigint) as double) as y from events"""


@projection
def fx_link(d):
    return """select e.edge_id, r.date, r.category, r.source, r.type, r.ticket_id, cast(r.event_id % 31 as double) as snap_m
from fx_report r join fx_edge e on e.ok = r.event_id"""


@projection
def fx_static(d):
    return """select edge_id, street_id, ok, name, length * case when ok % 19 = 0 then -1 else 1 end as length, is_bridge, is_tunnel, jurisdiction,
  cast(ok % 5 as int) as fema_risk_level, (ok % 60) / 10e0 - 0.5e0 as elev_p10,
  case when ok % 11 = 0 then null else (ok % 23) / 10e0 - 0.2e0 end as sink_p90, cast(ok % 13 - 1 as double) as drain_count,
  ok % 17 = 0 as elev_water_only, ((ok * 37) % 1001) / 1000e0 as risk_score from fx_edge"""


@projection
def fx_street(d):
    return """select user_id as street_id, case when user_id % 3 = 0 then 'county' else 'city' end as jurisdiction,
  user_id % 29 = 0 as is_bridge, case when user_id % 11 = 0 then null else cast(user_id % 3 + 1 as double) end as fema_risk_level,
  case when user_id % 11 = 0 then null else (user_id % 50) / 10e0 end as elev_p10,
  case when user_id % 11 = 0 or user_id % 7 = 0 then null else (user_id % 13) / 10e0 end as sink_p90,
  cast(user_id % 200 + 20 as double) as length, cast(user_id % 9 as double) as drain_count, cast(user_id % 2 as double) as is_tunnel
from (select distinct user_id from events) t"""


@projection
def fx_positive(d):
    return """select distinct r.street_id, r.date from fx_report r join fx_street s on r.street_id = s.street_id
where r.category = 'flood' and not s.is_bridge and (
  (s.jurisdiction = 'city' and r.date between date '2024-01-01' and date '2024-01-30')
  or (s.jurisdiction = 'county' and r.date between date '2024-01-05' and date '2024-01-25'))"""


@projection
def fx_weather_raw(d):
    return "select cast(ts as date) as date, round(sum(value) / 100e0, 2) as rain_mm from events where event_type = 'view' group by cast(ts as date)"


@projection
def fx_weather(d):
    return """select w.date, w.rain_mm, coalesce(w.rain_mm * 0.5e0, 0e0) as rain_lag1_mm, w.rain_mm * 1.5e0 as rain_prior3_mm from fx_weather_raw w"""


@projection
def fx_quarter(d):
    return f"""select q, sum(value) / 100e0 as mm from (select value,
  {d.add_minutes("cast(cast(ts as date) as timestamp)", "cast(floor((extract(hour from ts) * 60 + extract(minute from ts)) / 15e0) as int) * 15 + 15")} as q
  from events) t group by q"""


@projection
def fx_pred(d):
    return """select round((cast(floor(l_extendedprice) as bigint) % 10007) / 10007e0, 4) as p, case when l_returnflag = 'R' then 1 else 0 end as target,
  l_quantity as w, case when l_linestatus = 'O' then 'city' else 'county' end as jurisdiction from lineitem"""


@projection
def fx_zone(d):
    return """select n_nationkey as zone_id, n_regionkey as priority, (n_nationkey % 5) * 800e0 as zx0, floor(n_nationkey / 5e0) * h as zy0,
  (n_nationkey % 5) * 800e0 + 800e0 as zx1, floor(n_nationkey / 5e0) * h + h as zy1
from (select n_nationkey, n_regionkey, ceil((select n from fx_n) / 200e0) * 100e0 as h from nation) t"""


@projection
def fx_lot(d):
    return """select concat('L', cast(s_suppkey as string)) as lot_id, s_suppkey, x0, y0, x0 + 60 as x1, y0 + 40 as y1, x0 + 30 as x, y0 + 20 as y,
  case cast(s_suppkey % 3 as int) when 0 then 'garage' when 1 then 'surface' else 'street_side' end as type,
  (s_suppkey * 13 % 100) / 100e0 as score, case when s_suppkey % 17 = 0 then 'private' else null end as access,
  case when s_suppkey % 13 = 0 then concat('Staff ', s_name) when s_suppkey % 19 = 0 then 'Unnamed lot' else s_name end as name
from (select *, (spot % 40) * 100e0 as x0, floor(spot / 40e0) * 100e0 as y0
      from (select s_suppkey, s_name, (s_suppkey * 37) % (select n from fx_n) as spot from supplier) s) t"""


@projection
def fx_cell(d):
    return """select cx, cy, round(avg(l_discount) * 2, 6) as depth, round(avg(l_quantity) / 10e0 - 0.5e0, 6) as z
from (select l_orderkey % 100 as cx, l_partkey % 100 as cy, l_discount, l_quantity from lineitem) t group by cx, cy"""


@projection
def fx_closure(d):
    return f"""select concat('c', cast(ok as string)) as closure_id, edge_id, odate as start,
  case when u % 7 = 0 then null else {d.add_days("odate", "u % 400")} end as "end",
  case cast(ok % 3 as int) when 0 then null when 1 then true else false end as full_closure,
  case cast(ok % 5 as int) when 0 then 'Northbound' when 1 then 'Eastbound' when 2 then 'Southbound' when 3 then 'Westbound' else null end as direction,
  case when ok % 2 = 0 then 'fl511' else 'county_ucc' end as source, case when ok % 3 = 1 then 'closure' else 'roadwork' end as kind
from fx_edge where highway = '1-URGENT'"""


@projection
def fx_node(d):
    return "select c_custkey as node_id, (c_custkey % 40) * 100e0 as x, floor(c_custkey / 40e0) * 100e0 as y from customer"


@projection
def fx_building(d):
    return """select concat('B', cast(n_nationkey as string)) as code, n_name as name, n_nationkey as ord, n_nationkey * 5 as node_id,
  ((n_nationkey * 5) % 40) * 100e0 as x, floor(n_nationkey * 5 / 40e0) * 100e0 as y from nation"""


@projection
def fx_trip(d):
    return f"""select o_orderkey as trip_id, o_custkey as from_node, c_nationkey * 5 as to_node, concat('u', cast(o_custkey as string)) as user_id,
  {d.add_hours("o_orderdate", 13)} as arrive_by, o_totalprice as price, o_orderstatus as status, o_orderpriority as prio, o_orderdate as created_at
from orders join customer on o_custkey = c_custkey"""


@projection
def fx_user(d):
    return """select concat('u', cast(c_custkey as string)) as user_id, (c_custkey % 40) * 100e0 as home_x, floor(c_custkey / 40e0) * 100e0 as home_y,
  cast(c_custkey % 30 as int) as buffer, case when c_custkey % 3 = 0 then concat('L', cast(c_custkey % 10 as string)) else null end as preferred_lot,
  c_name as name from customer"""


@projection
def fx_event(d):
    return f"""select concat('e', cast(o_orderkey as string)) as event_id, concat('u', cast(o_custkey as string)) as user_id,
  {d.add_minutes("o_orderdate", "480 + (o_orderkey % 20) * 30")} as start_ts, o_orderstatus = 'P' as is_all_day,
  case when o_orderpriority = '5-LOW' then 'cancelled' else 'confirmed' end as status,
  case when o_orderkey % 6 = 0 then 'Zoom meeting' when o_orderkey % 7 = 0 then null
    when o_orderkey % 5 = 0 then concat('room nati ', cast(o_custkey % 25 as string), ' annex') when o_orderkey % 11 = 0 then 'Unknown place'
    else concat('b', cast(o_custkey % 25 as string), ' 100') end as location from orders"""


@projection
def fx_alert_event(d):
    return """select concat('u', cast(user_id as string)) as user_id, event_type as alert_key, event_id, ts, value,
  case when value < 50 then 'info' when value < 150 then 'warning' else 'critical' end as severity, event_id % 13 <> 0 as checked,
  case when event_type in ('view', 'click') then 'trip' when event_type = 'error' then 'nws' else 'tide' end as source from events"""


@projection
def fx_run(d):
    return """select concat('run-', cast(cast(ts as date) as string)) as run_id,
  case when extract(day from ts) % 2 = 0 then 'storm' else 'live' end as scenario, max(ts) as computed_at
from events where event_type = 'signup' group by cast(ts as date), extract(day from ts) % 2"""


@projection
def fx_score(d):
    return """select street_id, max(((ok * 53) % 997) / 996e0) as risk_score, max(case cast(ok % 5 as int) when 0 then 'high' when 1 then 'medium'
  when 2 then 'low' when 3 then 'unrated' else null end) as risk_label from fx_edge where highway <> '5-LOW' group by street_id"""


@projection
def fx_route_edge(d):
    return """select u as route_id, row_number() over (partition by u order by ok, edge_id) as seq, edge_id, name, length, length / 10e0 as seconds,
  ((ok * 37) % 1001) / 1000e0 as score, case when ((ok * 37) % 1001) >= 600 then 'high' when ((ok * 37) % 1001) >= 350 then 'medium' else 'low' end as label,
  x0, y0, xm, ym, x1, y1 from fx_edge"""


def needed(text: str) -> list[str]:
    """Projections a text uses, dependencies first."""
    out: list[str] = []

    def visit(t):
        for name in FX:
            if name not in out and re.search(rf"\b{name}\b", t):
                visit(FX[name](CheckText))
                if name not in out:
                    out.append(name)

    visit(text)
    return out


def with_projections(sql: str) -> str:
    """A self-contained query for the check engine: the projections it names, as CTEs."""
    names = needed(sql)
    body = sql.strip()
    ctes = [f"{n} as ({FX[n](CheckText)})" for n in names]
    if not ctes:
        return body
    if body.lower().startswith("with recursive"):
        return "with recursive " + ", ".join(ctes) + ", " + body[len("with recursive"):].lstrip()
    if body.lower().startswith("with "):
        return "with " + ", ".join(ctes) + ", " + body[5:]
    return "with " + ", ".join(ctes) + " " + body


class Tables:
    """Base tables and projections of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._made = spark, path, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            df = self._fx(name) if name.startswith("fx_") else self._base(name)
            # the edge table stands for a stored one that every layer of a job reads; keep it instead of deriving it again
            self._made[name] = df.persist() if name == "fx_edge" else df
        return self._made[name]

    def unkept(self, name: str) -> DataFrame:
        """A projection for a query that reads it once: nothing is kept, so only the columns it asks for are derived."""
        return self._fx(name)

    def _base(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        local = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df

    def _fx(self, name: str) -> DataFrame:
        text = FX[name](SparkText).replace('"end"', "`end`")
        used = {n: getattr(self, n) for n in [*FX, *BASE] if n != name and re.search(rf"\b{n}\b", text)}
        for n in used:
            text = re.sub(rf"\b{n}\b", "{" + n + "}", text)
        return self.spark.sql(text, **used)

    def lines(self, name: str = "fx_edge", kept: bool = True) -> DataFrame:
        """A projection with its three-vertex line as ``geom``."""
        return (getattr(self, name) if kept else self.unkept(name)).withColumn("geom", line("x0", "y0", "xm", "ym", "x1", "y1"))

    def zones(self) -> DataFrame:
        return self.fx_zone.withColumn("rings", box_ring("zx0", "zy0", "zx1", "zy1"))

    def lots(self) -> DataFrame:
        return self.fx_lot.withColumn("rings", box_ring("x0", "y0", "x1", "y1"))
