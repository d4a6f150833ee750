"""Row filters, small table operations and validation audits."""
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from highwater.functions.geometry import col
from highwater.functions.text import local_date
from highwater.operators.ranges import number_rows
from highwater.settings import (BBOX, DRAIN_TYPES, FLOOD_TYPES, NOT_SUGGESTED, ONLINE_PATTERN, PROJECT_DONE,
                                PROJECT_EXCLUDED_AGENCIES, PROJECT_MAX_DAYS)


# ------------------------------------------------------------------ row filters
def locate(reports: DataFrame, bbox=BBOX, to_lonlat=None) -> DataFrame:
    """lat/lon, or the projected pair ``px, py`` when either is missing or 0; kept inside the box.

    ``to_lonlat(x, y)`` turns the projected pair into struct<x: lon, y: lat>; without it the pair is used as is.
    """
    bad = (F.col("lat").isNull() | F.col("lon").isNull() | (F.col("lat") == 0) | (F.col("lon") == 0))
    alt = to_lonlat("px", "py") if to_lonlat else F.struct(F.col("px").alias("x"), F.col("py").alias("y"))
    w, s, e, n = bbox
    return (reports.withColumn("from_xy", bad).withColumn("_alt", alt)
            .withColumns({"lon": F.when(bad, F.col("_alt.x")).otherwise(F.col("lon")),
                          "lat": F.when(bad, F.col("_alt.y")).otherwise(F.col("lat"))}).drop("_alt")
            .where(F.col("lon").between(w, e) & F.col("lat").between(s, n)))


def categorise(reports: DataFrame, type_col="type", flood=FLOOD_TYPES, drain=DRAIN_TYPES) -> DataFrame:
    """Adds flood/drain by type; other types are dropped."""
    kept = reports.where(F.col(type_col).isin(list(flood) + list(drain)))
    return kept.withColumn("category", F.when(F.col(type_col).isin(list(flood)), "flood").otherwise("drain"))


def since(reports: DataFrame, first_day: str, ts_col="ts", zone="America/New_York") -> DataFrame:
    return reports.withColumn("date", local_date(ts_col, zone)).where(F.col("date") >= F.lit(first_day).cast("date"))


def active_at(closures: DataFrame, t) -> DataFrame:
    """Closures in force at t, both ends included, no end meaning open; an unknown full flag is "not full"."""
    t = t if isinstance(t, Column) else F.lit(t).cast("timestamp")
    return closures.where((F.col("start") <= t) & (F.col("end").isNull() | (F.col("end") >= t))) \
        .withColumn("full_closure", F.coalesce("full_closure", F.lit(False)))


def keep_projects(projects: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """Planned works that matter now, and how many rows each (overlapping) reason drops."""
    now = F.lit(now).cast("timestamp") if not isinstance(now, Column) else now
    window = F.floor((F.unix_seconds(F.col("end").cast("timestamp")) - F.unix_seconds(F.col("start").cast("timestamp"))) / 86400)
    agency = F.coalesce(F.col("agency").isin(PROJECT_EXCLUDED_AGENCIES), F.lit(False))
    done = F.coalesce(F.col("status").isin(PROJECT_DONE), F.lit(False))
    flagged = projects.withColumns({"_agency": agency, "_done": done, "_ended": F.col("end").cast("timestamp") < now,
                                    "_long": window > PROJECT_MAX_DAYS, "_nogeom": F.col("geom").isNull()})
    ok = (~F.col("_agency") & ~F.col("_done") & (F.col("end").cast("timestamp") >= now)
          & (window <= PROJECT_MAX_DAYS) & ~F.col("_nogeom"))
    drops = flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("kept"),
                        F.count_if("_agency").alias("agency"), F.count_if("_done").alias("complete"),
                        F.count_if("_ended").alias("ended"), F.count_if("_long").alias("too_long"))
    return flagged.where(ok).drop("_agency", "_done", "_ended", "_long", "_nogeom"), drops


def suggestable(lots: DataFrame, blocked=NOT_SUGGESTED) -> DataFrame:
    """Lots a driver may be sent to."""
    named = reduce(lambda a, b: a | b, [F.col("name").contains(w) for w in blocked])
    return lots.where(~named & ~F.coalesce(F.col("access") == "private", F.lit(False)))


def in_person(events: DataFrame) -> DataFrame:
    return events.where(F.col("location").isNotNull() & (F.col("location") != "") & ~F.col("location").rlike(ONLINE_PATTERN))


def timed(events: DataFrame, t0, t1) -> DataFrame:
    """Timed, not cancelled, starting in [t0, t1)."""
    t0, t1 = (x if isinstance(x, Column) else F.lit(x).cast("timestamp") for x in (t0, t1))
    return events.where(~F.col("is_all_day") & ~F.coalesce(F.upper("status") == "CANCELLED", F.lit(False))
                        & (F.col("start_ts") >= t0) & (F.col("start_ts") < t1))


def flood_alerts(alerts: DataFrame, t) -> DataFrame:
    """Flood-related weather alerts still in effect at t, one row per id."""
    t = t if isinstance(t, Column) else F.lit(t).cast("timestamp")
    end = F.coalesce("ends", "expires")
    kept = alerts.where(F.lower("event").contains("flood") & (end.isNull() | (end >= t)))
    return kept.dropDuplicates(["id"])


def dedupe_points(points: DataFrame) -> DataFrame:
    """Empty points and exact repeats (same type, same place) removed; the smallest id of a repeat stays."""
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("type", "x", "y").agg(
        F.min("point_id").alias("point_id"))


def type_lots(features: DataFrame) -> DataFrame:
    kind = F.when(F.col("parking") == "multi-storey", "garage").otherwise(F.coalesce("parking", F.lit("surface")))
    return features.withColumn("type", kind).withColumn(
        "name", F.coalesce("name", F.concat(F.lit("Unnamed "), F.col("type"), F.lit(" lot ("), F.col("osm_id"), F.lit(")"))))


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key; an aggregate rather than a window, so repeats shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
                                   .alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def near_minimum(df: DataFrame, keys: list[str], distance: str, tolerance: float = 0.0) -> DataFrame:
    """Rows within a tolerance of their key's smallest distance. The minimum is a partial aggregate joined back."""
    least = df.groupBy(*keys).agg(F.min(distance).alias("_least"))
    return df.join(least, keys).where(F.col(distance) <= F.col("_least") + tolerance).drop("_least")


def street_rows(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("edge_id") == F.col("street_id"))


def pick_scenario(requests: DataFrame, state: DataFrame) -> DataFrame:
    """The request's own scenario, else the shared switch, else live."""
    shared = state.agg(F.max("scenario")).scalar()
    return requests.select(*[c for c in requests.columns if c != "scenario"],
                           F.coalesce("scenario", shared, F.lit("live")).alias("scenario"))


def with_defaults(users: DataFrame, defaults: DataFrame) -> DataFrame:
    """Saved fields over the one-row default profile."""
    d = defaults.agg(F.first(F.struct(*defaults.columns))).scalar()
    u = users.select("*", d.alias("_d"))
    both = [c for c in defaults.columns if c in users.columns and c != "user_id"]
    extra = [c for c in defaults.columns if c not in users.columns]
    return u.select(*[F.coalesce(c, F.col(f"_d.{c}")).alias(c) if c in both else F.col(c) for c in users.columns],
                    *[F.col(f"_d.{c}").alias(c) for c in extra])


def mark_read(alerts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alerts with ``read`` set for requested ids, and the requests that match no alert."""
    keys = ["user_id", "alert_id"]
    wanted = requests.select(*keys).distinct()
    marked = alerts.join(wanted.withColumn("_hit", F.lit(True)), keys, "left").withColumn(
        "read", F.col("read") | F.coalesce("_hit", F.lit(False))).drop("_hit")
    return marked.select(*alerts.columns), wanted.join(alerts.select(*keys), keys, "left_anti")


def patch_profiles(users: DataFrame, patches: DataFrame, lots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply profile patches: only sent fields change.

    ``patches``: user_id, ``sent`` array of field names, and the new values. Returns (users, rejected patches).
    """
    p = patches.join(lots.select(F.col("lot_id").alias("_lot")), patches["preferred_lot"] == F.col("_lot"), "left")
    sent = lambda f: F.array_contains("sent", f)
    p = p.withColumn("errors", F.filter(F.array(
        F.when(sent("home") & F.col("home").isNull(), "home can be changed but not removed"),
        F.when(sent("buffer") & F.col("buffer").isNull(), "buffer can be changed but not removed"),
        F.when(sent("buffer") & ~F.col("buffer").between(0, 120), "buffer must be 0 to 120"),
        F.when(sent("preferred_lot") & F.col("preferred_lot").isNotNull() & F.col("_lot").isNull(), "unknown lot")),
        lambda e: e.isNotNull())).drop("_lot")
    good = p.where(F.size("errors") == 0).select("user_id", F.struct(
        "sent", "home", "buffer", "preferred_lot", F.when(F.trim("name") != "", F.trim("name")).alias("name")).alias("p"))
    fields = ["home", "buffer", "preferred_lot", "name"]
    out = users.join(good, "user_id", "left").select(
        *[F.when(F.array_contains("p.sent", c), F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
          for c in users.columns])
    return out, p.where(F.size("errors") > 0)


def validate_trips(requests: DataFrame, lots: DataFrame) -> DataFrame:
    """Adds ``errors``: one destination kind, known lot, not both times, times with a zone (ISO text), ranges."""
    r = requests.join(lots.select(F.col("lot_id").alias("_lot")), requests["parking_id"] == F.col("_lot"), "left")
    has_lot, has_point = F.col("parking_id").isNotNull(), F.col("to_lat").isNotNull() | F.col("to_lon").isNotNull()
    full_point = F.col("to_lat").isNotNull() & F.col("to_lon").isNotNull()
    zone = r"(Z|[+-]\d\d:?\d\d)$"
    rules = [F.when(has_lot & has_point, "two destinations"),
             F.when(has_lot & ~has_point & F.col("_lot").isNull(), "unknown lot"),
             F.when(~has_lot & ~full_point, "no destination"),
             F.when(F.col("depart_at").isNotNull() & F.col("arrive_by").isNotNull(), "two times"),
             F.when(~F.col("depart_at").rlike(zone), "depart_at needs a zone"),
             F.when(~F.col("arrive_by").rlike(zone), "arrive_by needs a zone"),
             F.when(~F.col("from_lat").between(-90, 90) | ~F.col("from_lon").between(-180, 180), "start out of range")]
    return r.withColumn("errors", F.filter(F.array(*rules), lambda e: e.isNotNull())).drop("_lot")


# ------------------------------------------------------------------ joins and sets
def join_checked(a: DataFrame, b: DataFrame, key: str, how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """Join that fails at run time when the right (or, one_to_one, either) side repeats a key.

    The test rides on the right side's own aggregate, so it costs no extra pass over the left.
    """
    def once(df):
        rest = [c for c in df.columns if c != key]
        g = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(F.lit(1).alias("_one"), *rest)).alias("_r"))
        fail = F.raise_error(F.concat(F.lit("key is not unique: "), F.col(key).cast("string")))
        return g.where(F.when(F.col("_n") == 1, F.lit(True)).otherwise(fail.cast("boolean"))).select(key, "_r.*").drop("_one")
    left = once(a) if cardinality == "one_to_one" else a
    return left.join(once(b), key, how)


def keep_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_semi")


def drop_keys(df: DataFrame, keys: DataFrame, on) -> DataFrame:
    return df.join(keys, on, "left_anti")


def stack(*feeds: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def distinct_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.select(*key).distinct()


def key_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys of a with ``side``: 'only_a' (a minus b) or 'both'."""
    ka, kb = a.select(*key).distinct(), b.select(*key).distinct().withColumn("_b", F.lit(True))
    return ka.join(kb, key, "left").withColumn("side", F.when(F.col("_b"), "both").otherwise("only_a")).drop("_b")


def compare_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in a, only in b, in both."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(
        b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    return both.agg(F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"),
                    F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def load_report(old: DataFrame, new: DataFrame, bridges: DataFrame, key: str = "edge_id") -> DataFrame:
    o = old.select(key).distinct().withColumn("_o", F.lit(1))
    n = new.select(key).distinct().withColumn("_n", F.lit(1))
    b = bridges.select(key).distinct().withColumn("_b", F.lit(1))
    j = o.join(n, key, "full").join(b, key, "full")
    has = lambda c: F.col(c).isNotNull()
    return j.agg(F.count_if(has("_o")).alias("previous"), F.count_if(has("_o") & has("_n")).alias("common"),
                 F.count_if(has("_o") & ~has("_n")).alias("only_previous"),
                 F.count_if(has("_n") & ~has("_o")).alias("only_new"),
                 F.count_if(has("_b") & has("_o")).alias("bridges_present"), F.count_if(has("_b")).alias("bridges"))


# ------------------------------------------------------------------ audits: every one returns rows, none prints
def check_keys(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """(check, violations). Missing columns count as one violation each."""
    missing = [c for c in required if c not in df.columns]
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    stats = per_key.agg(F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)).alias("null_key"),
                        F.count_if(F.col(key).isNotNull() & (F.col("_n") > 1)).alias("repeated_key"),
                        (F.count(F.lit(1)) == 0).cast("int").alias("empty"))
    return _unpivot(stats.withColumn("missing_columns", F.lit(len(missing))),
                    ["empty", "missing_columns", "null_key", "repeated_key"])


def _unpivot(row: DataFrame, checks: list[str]) -> DataFrame:
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("violations"))
                                          for c in checks])).alias("r")).select("r.*")


def check_domains(segments: DataFrame, jurisdictions: list[str],
                  flags=("is_bridge", "is_tunnel", "elev_water_only")) -> DataFrame:
    per_street = segments.groupBy("street_id").agg(
        F.min("jurisdiction").alias("_a"), F.max("jurisdiction").alias("_b"),
        F.count_if(~F.coalesce(F.col("jurisdiction").isin(jurisdictions), F.lit(False))).alias("_bad"),
        F.sum(sum((F.col(f).isNull().cast("int") for f in flags[1:]), F.col(flags[0]).isNull().cast("int"))).alias("_null"))
    stats = per_street.agg(F.sum("_bad").alias("unknown_jurisdiction"), F.sum("_null").alias("missing_flags"),
                           F.count_if(F.col("_a") != F.col("_b")).alias("twins_disagree"))
    return _unpivot(stats, ["unknown_jurisdiction", "missing_flags", "twins_disagree"])


def day_gaps(weather: DataFrame) -> DataFrame:
    """Days whose next calendar day is missing although later days exist (equi-join on the next day)."""
    w = weather.select("date").distinct()
    last = w.agg(F.max("date")).scalar()
    nxt = w.select(F.date_sub("date", 1).alias("date"))
    return w.join(nxt, "date", "left_anti").select("date", last.alias("_last")).where(F.col("date") < F.col("_last")).select("date")


def check_weather(weather: DataFrame) -> DataFrame:
    """Weather rows: date, rain_mm, unit, zone."""
    bad = F.col("rain_mm").isNull() | F.isnan("rain_mm") | F.col("rain_mm").isin(float("inf"), float("-inf")) | (F.col("rain_mm") < 0)
    stats = weather.agg((F.count(F.lit(1)) == 0).cast("int").alias("empty"), F.count_if(F.col("unit") != "mm").alias("unit"),
                        F.count_if(F.col("zone") != "America/New_York").alias("zone"), F.count_if(bad).alias("bad_rain"),
                        (F.count("date") - F.count_distinct("date")).alias("repeated_date"))
    gaps = day_gaps(weather).agg(F.count(F.lit(1))).scalar()
    return _unpivot(stats.select("*", gaps.alias("gaps")), ["empty", "unit", "zone", "bad_rain", "repeated_date", "gaps"])


def check_horizon(days: DataFrame, max_days: int = 7) -> DataFrame:
    """Forecast days: seq, date, the three rain columns, updated_at."""
    d = number_rows(days.select("seq", "date"), [F.col("seq"), F.col("date")], "_n")
    after = d.select((F.col("_n") - 1).alias("_n"), F.col("date").alias("_next"))
    stats = days.agg(
        (~F.count(F.lit(1)).between(1, max_days)).cast("int").alias("length"),
        (F.count_distinct("updated_at") > 1).cast("int").alias("retrievals"),
        F.count_if(F.col("rain_mm").isNull() | F.col("rain_lag1_mm").isNull() | F.col("rain_prior3_mm").isNull()).alias("missing_rain"))
    broken = d.join(after, "_n").agg(F.count_if(F.date_diff("_next", "date") != 1)).scalar()
    return _unpivot(stats.select("*", broken.alias("not_consecutive")),
                    ["length", "retrievals", "missing_rain", "not_consecutive"])


def check_pairs(edges: DataFrame) -> DataFrame:
    """Streets must be one edge, or two reversed ones, and be named after a member."""
    g = edges.groupBy("street_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"),
        F.max("v").alias("v1"), F.max(F.col("edge_id") == F.col("street_id")).alias("member"),
        F.min_by("v", F.struct("u", "edge_id")).alias("v_of_min"))
    reversed_ok = (F.col("u0") == F.col("v0")) & (F.col("u1") == F.col("v1"))
    stats = g.agg(F.count_if(~F.col("n").isin(1, 2)).alias("size"),
                  F.count_if((F.col("n") == 2) & ~reversed_ok).alias("not_reversed"),
                  F.count_if(~F.col("member")).alias("not_a_member"))
    return _unpivot(stats, ["size", "not_reversed", "not_a_member"])


def audit_splits(panel: DataFrame, train_end: str, validation_end: str) -> DataFrame:
    te, ve = F.lit(train_end).cast("date"), F.lit(validation_end).cast("date")
    s, d = F.col("split"), F.col("date")
    late = ((s == "train") & (d > te)) | ((s == "validation") & ((d <= te) | (d > ve))) \
        | (s.isin("future_test", "unseen_streets_test") & (d <= ve))
    stats = panel.agg(F.count_if(late).alias("outside_bounds"), F.count_if("is_bridge").alias("bridges"))
    groups = panel.groupBy("split_group").agg(F.max(s.isin("train", "validation")).alias("dev"),
                                              F.max(s == "unseen_streets_test").alias("unseen"))
    shared = groups.agg(F.count_if(F.col("dev") & F.col("unseen"))).scalar()
    repeats = panel.groupBy("street_id", "date").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1)).scalar()
    return _unpivot(stats.select("*", shared.alias("shared_groups"), repeats.alias("repeated_days")),
                    ["outside_bounds", "shared_groups", "bridges", "repeated_days"])


def audit_scores(scores: DataFrame, segments: DataFrame) -> DataFrame:
    per_street = scores.groupBy("street_id").agg(
        F.min("risk_score").alias("a"), F.max("risk_score").alias("b"), F.count(F.lit(1)).alias("n"),
        F.count_if(~F.coalesce(F.col("risk_score").between(0, 1), F.lit(False))).alias("bad"))
    stats = per_street.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("out_of_range"),
                           F.count_if(F.col("a") != F.col("b")).alias("twins_differ"), F.sum("n").alias("_n"))
    want = segments.agg(F.count(F.lit(1))).scalar()
    return _unpivot(stats.select("*", F.abs(F.col("_n") - want).alias("row_difference")),
                    ["out_of_range", "twins_differ", "row_difference"])


def scenario_response(dry: DataFrame, wet: DataFrame) -> DataFrame:
    """How modelled edges move between two weather scenarios, with exact medians."""
    from highwater.operators.ranges import exact_quantiles
    m = F.col("score_source") == "model_reference_percentile"
    j = dry.where(m).select("edge_id", F.col("risk_score").alias("dry")).join(
        wet.where(m).select("edge_id", F.col("risk_score").alias("wet")), "edge_id")
    med = {s: exact_quantiles(j, [], s, [0.5]).agg(F.max("q")).scalar() for s in ("dry", "wet")}
    return j.agg(F.count_if(F.col("wet") > F.col("dry")).alias("up"), F.count_if(F.col("wet") < F.col("dry")).alias("down")) \
        .select("*", med["dry"].alias("dry_median"), med["wet"].alias("wet_median"))


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls"))
                                          for c in df.columns])).alias("r")).select("r.*")


def zone_mismatches(fema: DataFrame) -> DataFrame:
    """A* and V* zones should be inside the flood area, others outside."""
    hazard = F.col("fema_zone").startswith("A") | F.col("fema_zone").startswith("V")
    return fema.where(F.col("fema_zone").isNotNull()).agg(F.count_if(hazard != F.col("in_sfha")).alias("mismatches"),
                                                          F.count(F.lit(1)).alias("zoned"))


def delete_where(df: DataFrame, user_id: str, flag: str) -> DataFrame:
    return df.where(~((F.col("user_id") == user_id) & F.coalesce(col(flag), F.lit(False))))
