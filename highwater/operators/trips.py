"""Routes, trips, parking choice, schedules, alerts, dashboards: request tables in, answer tables out."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from highwater.functions.geometry import col, join_paths
from highwater.functions.scoring import base_cost, label_rank, safe_cost
from highwater.functions.text import (clock, fill, iso_utc, leave_by, minus_minutes, recommend, search_minutes, stable_id, time_saved,
                                      walk_minutes)
from highwater.operators.checks import first_by, in_person, suggestable
from highwater.operators.graph import batch_routes
from highwater.operators.nearest import k_nearest
from highwater.operators.serving import with_traffic
from highwater.settings import (ALERT_LOOKAHEAD_HOURS, COMPROMISED_M, GENERIC_PLACE_WORDS, LABELS, MAX_LOT_WALK_M, MAX_WAYPOINTS,
                                ONLINE_PATTERN, SEVERITY_RANK, TIME_ZONE, TRAFFIC_ALERT_MINUTES, WEATHER_SEVERITY, WEEKDAYS)


# ------------------------------------------------------------------ routes
def route_costs(edges: DataFrame) -> DataFrame:
    """Usual and safe cost of every open edge. edges: u, v, edge_id, seconds, closed, slowed, score, label."""
    return edges.where(~F.col("closed")).select("u", "v", "edge_id", F.explode(F.array(
        F.struct(F.lit("usual").alias("kind"), base_cost("seconds", "slowed").alias("cost")),
        F.struct(F.lit("safe").alias("kind"), safe_cost("seconds", "slowed", "score", "label").alias("cost")))).alias("c")).select(
        "u", "v", "edge_id", "c.kind", "c.cost")


def worst_street(route_edges: DataFrame, keys: list[str]) -> DataFrame:
    """Named street with the most high-risk metres per route (ties: first name)."""
    m = route_edges.where((F.col("label") == "high") & F.col("name").isNotNull()).groupBy(*keys, "name").agg(
        F.sum(F.bround("length", 0)).alias("_m"))
    return m.groupBy(*keys).agg(F.min_by("name", F.struct((-F.col("_m")).alias("m"), "name")).alias("street"))


def describe_routes(route_edges: DataFrame, keys: list[str], closures: DataFrame | None = None) -> DataFrame:
    """One row per route. route_edges: keys, seq, edge_id, length, seconds, score, label, name (+ geom).

    Medium and high pieces are listed in driving order; a route's list is as long as the route.
    """
    metres = F.bround("length", 0).cast("bigint")
    piece = F.struct("seq", "edge_id", "name", F.bround("score", 3).alias("score"), "label", metres.alias("length_m"))
    ordered = F.sort_array(F.collect_list(F.struct("seq", "edge_id")))
    aggs = [F.concat(F.lit("r_"), F.substring(F.sha1(F.array_join(F.transform(ordered, lambda s: s["edge_id"]), "|").cast("binary")), 1, 8))
            .alias("route_id"),
            F.bround(F.sum("length"), 0).cast("bigint").alias("distance_m"), F.sum("seconds").alias("free_flow_s"),
            F.count(F.lit(1)).alias("edges"), F.bround(F.max("score"), 3).alias("max_risk"),
            F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.max(label_rank("label")) + 1).cast("int")).alias("risk_label"),
            F.coalesce(F.sum(F.when(F.col("label") == "high", metres)), F.lit(0)).cast("bigint").alias("high_risk_m"),
            F.sort_array(F.collect_list(F.when(F.col("label") != "low", piece))).alias("risk_segments")]
    if "geom" in route_edges.columns:
        paths = F.transform(F.sort_array(F.collect_list(F.struct("seq", "geom"))), lambda s: s["geom"])
        aggs.append(join_paths(paths).alias("path"))
    routes = route_edges.groupBy(*keys).agg(*aggs)
    routes = routes.join(worst_street(route_edges, keys), keys, "left")
    if closures is not None:
        n = route_edges.join(closures.select("edge_id", "closure_id"), "edge_id").select(*keys, "closure_id").distinct().groupBy(*keys).agg(
            F.count(F.lit(1)).alias("closures"))
        routes = routes.join(n, keys, "left").withColumn("closures", F.coalesce("closures", F.lit(0)))
    return routes


def route_closures(route_edges: DataFrame, keys: list[str], closures: DataFrame) -> DataFrame:
    """The closures met on each route, every one once, by id. closures: edge_id, closure_id, name, kind, full_closure."""
    met = route_edges.select(*keys, "edge_id").join(closures.select("edge_id", "closure_id", F.struct("closure_id", "name", "kind", "full_closure").alias("c")), "edge_id")
    once = met.groupBy(*keys, "closure_id").agg(F.min("c").alias("c"))
    return once.groupBy(*keys).agg(F.sort_array(F.collect_list("c")).alias("closures"))


ALONG = {"length": "sum", "seconds": "sum", "score": "max", "rank": "max", "high_m": "sum", "h1": "xor", "h2": "xor"}  # what routes are compared by


def route_facts(edges: DataFrame) -> DataFrame:
    """edge_id once, with what ``ALONG`` puts together along a route. ``h1`` and ``h2`` name the set of its edges, which is the route."""
    least = F.lit(float("-inf"))
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    high = F.col("label") == "high"
    return edges.groupBy("edge_id").agg(
        sums("length").alias("length"), sums(base_cost("seconds", "slowed")).alias("seconds"), F.coalesce(F.max(F.col("score").cast("double")), least).alias("score"),
        F.coalesce(F.max(label_rank("label")).cast("double"), least).alias("rank"), sums(F.when(high, F.bround("length", 0))).alias("high_m"),
        F.coalesce(F.max(high), F.lit(False)).alias("marked")).withColumns({"h1": F.xxhash64("edge_id"), "h2": F.xxhash64("edge_id", F.lit(1))})


def _high_roads(high: DataFrame, keys: list[str]) -> DataFrame:
    """keys, street (the named one with the most high-risk metres, ties: first name), high_ids. high: keys, edge_id, name, length."""
    m = high.repartition("source", "target").groupBy(*keys, "name").agg(F.sum(F.bround("length", 0)).alias("_m"), F.collect_set("edge_id").alias("_ids"))
    named = F.col("name").isNotNull()
    return m.groupBy(*keys).agg(F.min_by("name", F.when(named, F.struct((-F.col("_m")).alias("m"), "name"))).alias("street"), F.flatten(F.collect_list("_ids")).alias("high_ids"))


def compare_pairs(edges: DataFrame, pairs: DataFrame, closures: DataFrame | None = None, traffic: DataFrame | None = None) -> DataFrame:
    """Usual against safe route for distinct (source, target) pairs, with action and message.

    An unreachable pair keeps its row with status 'unreachable'; equal ends get 'same_place'. With ``geom`` on the edges routes
    carry their path, with ``closures`` in force the ones they meet, with ``traffic`` (see ``with_traffic``) times come from it.

    What a route adds up to comes from its legs, and only its high-risk roads are listed to compare the two. All its roads are
    listed only where ``route_id``, ``risk_segments``, ``path`` or ``closures`` of a route are read.
    """
    of_high = edges.where(F.col("label") == "high").select("edge_id", "name", "length")
    paths, summary, high = batch_routes(route_costs(edges), pairs, route_facts(edges), ALONG, of_high)
    lines = [c for c in ("geom",) if c in edges.columns]
    on = paths.select("kind", "source", "target", "seq", "edge_id").join(
        edges.select("edge_id", "length", base_cost("seconds", "slowed").alias("seconds"), "score", "label", "name", *lines), "edge_id")
    keys = ["kind", "source", "target"]
    known = lambda c: F.when(F.col(c) > float("-inf"), F.col(c))
    routes = summary.where(F.col("total").isNotNull()).select(
        *keys, F.bround("length", 0).cast("bigint").alias("distance_m"), F.col("seconds").alias("free_flow_s"), F.bround(known("score"), 3).alias("max_risk"),
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), (known("rank") + 1).cast("int")).alias("risk_label"), F.col("high_m").cast("bigint").alias("high_risk_m"), "h1", "h2")
    listed, more = describe_routes(on, keys).select(*keys, "route_id", "risk_segments", *(["path"] if lines else [])), ["path"] if lines else []
    routes = routes.join(listed, keys, "left").join(_high_roads(high, keys), keys, "left")
    if closures is not None:
        routes, more = routes.join(route_closures(on, keys, closures), keys, "left"), [*more, F.coalesce("closures", F.array()).alias("closures")]
    if traffic is not None:
        routes = with_traffic(routes, traffic)
    else:
        routes = routes.withColumns({"seconds": F.col("free_flow_s"), "delay_s": F.lit(None).cast("double"), "eta_source": F.lit("free_flow")})
    route = F.struct("route_id", "distance_m", "free_flow_s", "max_risk", "risk_label", "high_risk_m", "risk_segments", "street",
                     "seconds", "delay_s", "eta_source", *more)
    # what the two are compared by stands beside the route, so that a reader of the answer does not ask for the whole route
    beside = ["high_risk_m", "street", "seconds", "h1", "h2"]
    none = F.array().cast("array<" + edges.schema["edge_id"].dataType.simpleString() + ">")
    side = lambda k: routes.where(F.col("kind") == k).select(
        "source", "target", route.alias(k), F.lit(True).alias(f"_{k}"), F.coalesce("high_ids", none).alias(f"_{k}_high_ids"), *[F.col(c).alias(f"_{k}_{c}") for c in beside])
    j = pairs.select("source", "target").distinct().join(side("usual"), ["source", "target"], "left").join(
        side("safe"), ["source", "target"], "left")
    eta = lambda k: F.bround(F.col(f"_{k}_seconds") / 60, 1)
    j = j.withColumns({
        "compromised": F.col("_usual_high_risk_m") >= COMPROMISED_M,
        "same_route": (F.col("_usual_h1") == F.col("_safe_h1")) & (F.col("_usual_h2") == F.col("_safe_h2")),
        "extra_minutes": F.bround(eta("safe") - eta("usual"), 1),
        "high_risk_m_avoided": F.greatest(F.lit(0), F.col("_usual_high_risk_m") - F.col("_safe_high_risk_m")),
        "high_risk_segments_avoided": F.size(F.array_except("_usual_high_ids", "_safe_high_ids")),
        "usual_minutes": eta("usual"), "safe_minutes": eta("safe"),
        "status": F.when(F.col("source") == F.col("target"), "same_place").when(F.col("_usual").isNull(), "unreachable").otherwise("ok")})
    action, message = recommend("compromised", "same_route", "_usual_high_risk_m", "_safe_high_risk_m", "extra_minutes",
                                "high_risk_m_avoided", "_usual_street")
    ok = F.col("status") == "ok"
    return j.withColumns({"action": F.when(ok, action), "message": F.when(ok, message)}).drop(
        *[f"_{k}{c}" for k in ("usual", "safe") for c in ("", "_high_ids", *[f"_{x}" for x in beside])])


def compare_routes(trips: DataFrame, edges: DataFrame) -> DataFrame:
    """Route comparison for a trips table (trip_id, from_node, to_node). Each distinct pair is searched once."""
    pairs = trips.select(F.col("from_node").alias("source"), F.col("to_node").alias("target")).distinct()
    return trips.join(compare_pairs(edges, pairs).withColumnsRenamed({"source": "from_node", "target": "to_node"}), ["from_node", "to_node"])


def record_trips(plans: DataFrame, take: str | None = "take") -> DataFrame:
    """Trip records: route taken (default: what was recommended), metres avoided, minutes saved."""
    default = F.when(F.col("action").isin("reroute", "reroute_caution"), "safe").otherwise("usual")
    taken = F.coalesce(take, default) if take else default
    on_safe = (F.col("_take") == "safe") & ~F.col("same_route")
    p = plans.withColumn("_take", taken).withColumns({
        "_avoided": F.when(on_safe, F.col("high_risk_m_avoided")).otherwise(0), "_extra": F.when(on_safe, F.col("extra_minutes")).otherwise(0.0),
        "_segments": F.when(on_safe, F.col("high_risk_segments_avoided")).otherwise(0)})
    rest = [c for c in plans.columns if c not in (take, "extra_minutes", "high_risk_m_avoided", "high_risk_segments_avoided")]
    return p.select(*rest, F.col("_take").alias("take"), F.bround("_extra", 1).alias("extra_minutes"),
                    F.col("_avoided").alias("high_risk_m_avoided"), F.col("_segments").alias("high_risk_segments_avoided"),
                    F.bround(time_saved("compromised", "_avoided", "usual_high_m", "_extra"), 1).alias("time_saved_minutes"))


def itinerary(legs: DataFrame) -> DataFrame:
    """Each leg departs when the one before arrives; from the first leg outside the area on, times are null.

    legs: journey_id, leg, start_ts (of the journey), minutes, in_area. A journey's legs are few.
    """
    w = Window.partitionBy("journey_id").orderBy("leg")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    total, bad = F.sum("minutes").over(upto), F.max(~F.col("in_area")).over(upto)
    seconds = lambda m: F.bround(m * 60, 0).cast("bigint")
    at = lambda m: F.timestamp_seconds(F.unix_seconds("start_ts") + seconds(m))
    return legs.withColumns({"_total": total, "stopped": bad}).withColumns({
        "depart": F.when(~F.col("stopped"), at(F.col("_total") - F.col("minutes"))),
        "arrive": F.when(~F.col("stopped"), at(F.col("_total")))}).drop("_total")


def detours(suggested: DataFrame, usual: DataFrame, budget: int = 3) -> DataFrame:
    """Middle vertex of the longest runs of suggested-route vertices that are off the usual route.

    suggested: route_id, seq, x, y. usual: route_id, x, y. At most ``budget`` per route (the feature's own limit).
    """
    on = usual.select("route_id", "x", "y", F.lit(True).alias("_on")).distinct()
    v = suggested.join(on, ["route_id", "x", "y"], "left").withColumn("_off", F.col("_on").isNull())
    w = Window.partitionBy("route_id").orderBy("seq")
    v = v.withColumn("_run", F.count_if(~F.col("_off")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_off")
    runs = v.groupBy("route_id", "_run").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"),
                                             F.sort_array(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    mid = F.element_at("p", (F.floor(F.col("n") / 2) + 1).cast("int"))
    ranked = runs.withColumn("rank", F.row_number().over(Window.partitionBy("route_id").orderBy(F.desc("n"), "first")))
    return ranked.where(F.col("rank") <= budget).select("route_id", "rank", "n", mid["x"].alias("x"), mid["y"].alias("y"))


def waypoints(legs: DataFrame, detours: DataFrame, most: int = MAX_WAYPOINTS) -> DataFrame:
    """Via points of one map link per journey: all stops, and detours of the legs as far as the link has room.

    Stops come first; what is left of ``most`` is shared out leg by leg, each getting an equal part of the rest (rounded up) or
    as many as it has. legs: journey_id, leg, x, y (its end). detours: journey_id, leg, rank, x, y. Returns journey_id,
    position, kind, leg, x, y in driving order; the end of the last leg is no via point. A journey's legs are few.
    """
    has = detours.groupBy("journey_id", "leg").agg(F.count(F.lit(1)).alias("n"))
    all_legs = legs.select("journey_id", "leg").join(has, ["journey_id", "leg"], "left").groupBy("journey_id").agg(
        F.sort_array(F.collect_list(F.struct("leg", F.coalesce("n", F.lit(0)).alias("n")))).alias("legs"))
    count = F.size("legs").cast("long")
    start = F.struct((F.lit(most) - count + 1).alias("room"), count.alias("left"), F.array().cast("array<struct<leg:bigint,take:bigint>>").alias("out"))

    def share(a, leg):
        take = F.least(leg["n"], F.greatest(F.lit(0).cast("long"), F.ceil(a["room"] / a["left"])))
        return F.struct((a["room"] - take).alias("room"), (a["left"] - 1).alias("left"),
                        F.concat(a["out"], F.array(F.struct(leg["leg"].cast("long").alias("leg"), take.alias("take")))).alias("out"))

    shares = all_legs.select("journey_id", F.explode(F.aggregate("legs", start, share, lambda a: a["out"])).alias("s")).select("journey_id", "s.leg", "s.take")
    via = detours.join(shares, ["journey_id", "leg"]).where(F.col("rank") <= F.col("take")).select("journey_id", "leg", F.lit("detour").alias("kind"), "rank", "x", "y")
    last = legs.groupBy("journey_id").agg(F.max("leg").alias("_last"))
    stops = legs.join(last, "journey_id").where("leg < _last").select("journey_id", "leg", F.lit("stop").alias("kind"), F.lit(0).alias("rank"), "x", "y")
    order = Window.partitionBy("journey_id").orderBy("leg", "kind", "rank")
    return via.unionByName(stops).withColumn("position", F.row_number().over(order)).select("journey_id", "position", "kind", "leg", "x", "y")


# ------------------------------------------------------------------ parking choice
def nearest_k(points: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Up to k nearest targets per point (ties by id), however far. points: point_id, x, y. targets: target_id, x, y.

    Rows without coordinates have no neighbours."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")
    t = targets.where(ok).select("target_id", F.col("x").alias("tx"), F.col("y").alias("ty"))
    return k_nearest(points.where(ok).select("point_id", "x", "y"), t, k,
                     lambda x, y, tx, ty: F.sqrt(F.pow(tx - x, 2) + F.pow(ty - y, 2)))


def lot_alternatives(lots: DataFrame, n: int = 3) -> DataFrame:
    """For lots rated high: up to n low, suggestable lots, garages first, then the closest.

    Worked out once per lot and not per trip. lots: lot_id, type, x, y, hazard_label, name, access.
    """
    high = lots.where(F.col("hazard_label") == "high").select(F.col("lot_id").alias("point_id"), "x", "y")
    good = suggestable(lots).where(F.col("hazard_label") == "low").select(F.col("lot_id").alias("target_id"), "x", "y", "type")
    picked = [nearest_k(high, good.where(cond).drop("type"), n).withColumn("garage_last", F.lit(i))
              for i, cond in enumerate([F.col("type") == "garage", F.col("type") != "garage"])]
    both = picked[0].unionByName(picked[1])
    order = Window.partitionBy("point_id").orderBy("garage_last", "dist", "target_id")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        F.col("point_id").alias("lot_id"), "rank", F.col("target_id").alias("alternative"), F.bround("dist", 0).cast("bigint").alias("distance_m"))


def pick_lot(requests: DataFrame, lots: DataFrame, max_walk_m: float = MAX_LOT_WALK_M) -> DataFrame:
    """Lot for a building: the preferred one however far, else the nearest suggestable within reach, else none.

    requests: req_id, x, y, preferred_lot. Adds lot_id, walk_min (0 without a lot). Buildings are few next to requests, so
    the nearest lot is found per distinct place.
    """
    cell = lambda c: F.floor(F.col(c) / max_walk_m).cast("bigint")
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    places = requests.select("x", "y").distinct()
    p = places.select("x", "y", F.explode(around).alias("_i")).select("*", F.explode(around).alias("_j")).select(
        "x", "y", (cell("x") + F.col("_i")).alias("cx"), (cell("y") + F.col("_j")).alias("cy"))
    t = suggestable(lots).select("lot_id", F.col("x").alias("lx"), F.col("y").alias("ly")).withColumns({"cx": cell("lx"), "cy": cell("ly")})
    d = lambda: F.round(F.sqrt(F.pow(F.col("lx") - F.col("x"), 2) + F.pow(F.col("ly") - F.col("y"), 2)), 6)
    near = p.join(t, ["cx", "cy"]).withColumn("d", d()).where(F.col("d") <= max_walk_m).groupBy("x", "y").agg(
        F.min(F.struct("d", "lot_id")).alias("near"))
    pref = lots.select(F.col("lot_id").alias("preferred_lot"), F.col("x").alias("lx"), F.col("y").alias("ly"))
    j = requests.join(near, ["x", "y"], "left").join(pref, "preferred_lot", "left")
    has_pref = F.col("lx").isNotNull()
    dist = F.when(has_pref, d()).otherwise(F.col("near.d"))
    return j.select(*requests.columns, F.when(has_pref, F.col("preferred_lot")).otherwise(F.col("near.lot_id")).alias("lot_id"),
                    F.coalesce(walk_minutes(dist), F.lit(0)).alias("walk_min"))


# ------------------------------------------------------------------ places and schedules
def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), F.lit("([a-z0-9]+)"), F.lit(1))


def _digits(w: Column) -> Column:
    return w.rlike("^[0-9]+$")


def _word_key(w: Column) -> Column:
    return F.when(_digits(w) | (F.length(w) < 3), w).otherwise(F.substring(w, 1, 3))


def resolve_location(events: DataFrame, buildings: DataFrame) -> DataFrame:
    """Adds ``code``: a building code written in the location, else the building whose name its words spell.

    Distinct texts are resolved once. Codes are an equi-join of the text's capital-letter tokens. Names are an equi-join on
    the start of a name's rarest word, so that words many names share (hall, center) bring nothing together, then checked: the name (or its last two or more words, not all generic) must appear in
    order, words may be shortened to three letters or more, numbers not at all. The longest match wins, a whole name
    before a partial one. buildings: code, name, ord.
    """
    texts = events.select("location").distinct().where(F.col("location").isNotNull() & ~F.col("location").rlike(ONLINE_PATTERN))
    tokens = texts.select("location", F.posexplode(F.regexp_extract_all(F.upper("location"), F.lit("([A-Z][A-Z0-9/]*)"), F.lit(1))).alias("pos", "t"))
    tries = tokens.select("location", "pos", F.posexplode(F.array("t", F.regexp_replace("t", "[0-9]+$", ""))).alias("try", "code"))
    by_code = tries.join(buildings.select("code"), "code").groupBy("location").agg(F.min_by("code", F.struct("pos", "try")).alias("code"))
    rest = texts.join(by_code, "location", "left_anti").withColumn("words", _words(F.col("location")))
    name = buildings.select("code", "ord", _words(F.col("name")).alias("name"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("name") - 2, F.lit(0)))
    parts = name.where(F.size("name") > 0).select("code", "ord", F.explode(starts).alias("start"), "name").select(
        "code", "ord", "start", F.slice("name", F.col("start") + 1, F.size("name")).alias("part"))
    generic = F.array(*[F.lit(w) for w in GENERIC_PLACE_WORDS])
    parts = parts.where((F.col("start") == 0) | F.exists("part", lambda w: ~F.array_contains(generic, w) & ~_digits(w)))
    # a text that spells a name has all its words, so one is enough to find it: the one that fewest names share
    words = parts.select("code", "ord", "start", F.explode(F.array_distinct(F.transform("part", _word_key))).alias("k"))
    shared = words.groupBy("k").agg(F.count_distinct("code").alias("_names"))
    rarest = words.join(shared, "k").groupBy("code", "ord", "start").agg(F.min_by("k", F.struct("_names", "k")).alias("k"))
    keyed = parts.join(rarest, ["code", "ord", "start"])
    cands = rest.withColumn("k", F.explode(F.array_distinct(F.transform("words", _word_key)))).join(keyed, "k")

    def advance(i, w):
        n = F.try_element_at("part", i + 1)
        same = (w == n) | ((F.length(w) >= 3) & ~_digits(w) & ~_digits(n) & n.startswith(w))
        return F.when((i < F.size("part")) & F.coalesce(same, F.lit(False)), i + 1).otherwise(i)

    match = F.aggregate("words", F.lit(0), advance) == F.size("part")
    by_name = cands.where(match).groupBy("location").agg(F.min_by("code", F.struct(
        (-F.size("part")).alias("n"), (F.col("start") != 0).alias("partial"), "ord")).alias("code"))
    return events.join(by_code.unionByName(by_name), "location", "left")


def expand_schedule(classes: DataFrame, t0: str, t1: str, zone: str = TIME_ZONE) -> DataFrame:
    """Weekly classes -> dated events starting in [t0, t1).

    classes: class_id, days (array of MO..SU), start_min and end_min (minutes after local midnight), plus payload.
    """
    lo, hi = F.lit(t0).cast("timestamp"), F.lit(t1).cast("timestamp")
    first, last = (F.to_date(F.from_utc_timestamp(t, zone)) for t in (lo, hi))
    d = classes.withColumn("date", F.explode(F.sequence(first, last)))
    codes = F.array(*[F.lit(x) for x in WEEKDAYS])
    d = d.where(F.array_contains("days", F.element_at(codes, F.weekday("date") + 1)))
    at = lambda m: F.to_utc_timestamp(F.timestamp_seconds(F.unix_seconds(F.col("date").cast("timestamp")) + F.col(m) * 60), zone)
    keep = [c for c in classes.columns if c not in ("days", "start_min", "end_min")]
    out = d.select(*keep, "date", at("start_min").alias("start_ts"), at("end_min").alias("end_ts"))
    return out.where((F.col("start_ts") >= lo) & (F.col("start_ts") < hi)).withColumn(
        "event_id", F.concat(F.lit("ev"), F.col("class_id").cast("string"), F.lit("_"), F.date_format("date", "yyyyMMdd")))


def expand_with_exceptions(classes: DataFrame, skipped: DataFrame, moved: DataFrame, t0: str, t1: str, zone: str = TIME_ZONE) -> DataFrame:
    """The schedule without skipped dates and with moved instances at their new time.

    skipped: class_id, date. moved: class_id, date (the replaced one), start_ts, end_ts.
    """
    base = expand_schedule(classes, t0, t1, zone)
    gone = skipped.select("class_id", "date").unionByName(moved.select("class_id", "date"))
    kept = base.join(gone, ["class_id", "date"], "left_anti")
    payload = [c for c in classes.columns if c not in ("days", "start_min", "end_min", "class_id")]
    lo, hi = F.lit(t0).cast("timestamp"), F.lit(t1).cast("timestamp")
    extra = moved.where((F.col("start_ts") >= lo) & (F.col("start_ts") < hi)).join(classes.select("class_id", *payload), "class_id")
    eid = F.concat(F.lit("ev"), F.col("class_id").cast("string"), F.lit("_"), F.date_format("date", "yyyyMMdd"))
    return kept.unionByName(extra.withColumn("event_id", eid).select(*kept.columns))


def add_test_events(events: DataFrame, extra: DataFrame, t0, t1) -> DataFrame:
    lo, hi = F.lit(t0).cast("timestamp"), F.lit(t1).cast("timestamp")
    return events.unionByName(extra.where((F.col("start_ts") >= lo) & (F.col("start_ts") < hi)), allowMissingColumns=True)


def next_events(events: DataFrame, now) -> DataFrame:
    """The next in-person event of each user."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    return first_by(in_person(events.where(F.col("start_ts") >= now)), ["user_id"], [F.col("start_ts"), F.col("event_id")])


def events_with_queries(events: DataFrame, users: DataFrame, buildings: DataFrame, lots: DataFrame, zone: str = TIME_ZONE) -> DataFrame:
    """Events with the trip each needs: lot or building, and when to arrive. Null for online, unknown places or no home.

    users: user_id, home_x, home_y, buffer, preferred_lot. buildings: code, name, ord, x, y.
    """
    e = resolve_location(events, buildings.select("code", "name", "ord"))
    e = e.join(buildings.select("code", F.col("x").alias("bx"), F.col("y").alias("by")), "code", "left").join(users, "user_id", "left")
    asked = e.select(F.col("event_id").alias("req_id"), "user_id", F.col("bx").alias("x"), F.col("by").alias("y"), "preferred_lot").where(
        F.col("x").isNotNull())
    lot = pick_lot(asked, lots).join(lots.select("lot_id", F.col("type").alias("lot_type")), "lot_id", "left").select(
        F.col("req_id").alias("event_id"), "user_id", "lot_id", "walk_min", "lot_type")
    j = e.join(lot, ["event_id", "user_id"], "left")
    parked = minus_minutes("start_ts", F.col("buffer") + F.col("walk_min"))
    j = j.withColumn("search_min", F.when(F.col("lot_id").isNotNull(), search_minutes("lot_type", parked, zone)).otherwise(0.0))
    ok = F.col("bx").isNotNull() & F.col("home_x").isNotNull()
    return j.select("event_id", "user_id", "start_ts", "location", F.col("code").alias("building"), F.when(ok, F.col("lot_id")).alias("lot_id"),
                    F.when(ok, F.col("walk_min")).alias("walk_min"), F.when(ok, F.col("search_min")).alias("search_min"),
                    F.when(ok, minus_minutes("start_ts", F.col("buffer") + F.col("walk_min") + F.col("search_min"))).alias("arrive_by"),
                    "buffer", F.when(ok, F.col("home_x")).alias("from_x"), F.when(ok, F.col("home_y")).alias("from_y"))


def next_trips(queries: DataFrame, plans: DataFrame, now) -> DataFrame:
    """Next event with its leave-by time. plans: event_id, user_id, take, drive_s (null without a trip)."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    j = queries.join(plans, ["event_id", "user_id"], "left")
    leave = leave_by("start_ts", "buffer", "walk_min", "search_min", "drive_s")
    return j.withColumn("leave_by", leave).withColumn(
        "leave_in_minutes", F.bround((F.unix_seconds("leave_by") - F.unix_seconds(now)) / 60, 0).cast("bigint"))


# ------------------------------------------------------------------ alerts and dashboards
ALERT = ["alert_key", "source", "type", "severity", "title", "message", "event_id", "segment_id", "parking_id", "expires_at"]


def _alert(key, source, kind, severity, title, message, **more) -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    rest = [more.get(c, F.lit(None)).cast("timestamp" if c == "expires_at" else "string").alias(c) for c in ALERT[6:]]
    return F.struct(key.alias("alert_key"), F.lit(source).alias("source"), F.lit(kind).alias("type"), severity.alias("severity"),
                    F.concat(F.initcap(severity), F.lit(": "), title).alias("title"), message.alias("message"), *rest)


def trip_alerts(trips: DataFrame, now=None, zone: str = TIME_ZONE) -> DataFrame:
    """Alert rows a planned trip gives rise to; texts name levels, never measurements.

    trips: user_id, event_id, event_name, start_ts, leave_by, compromised, action, street, segment_id (the worst segment of high
    risk on the usual route), lot_id, lot_name, lot_hazardous, other_lot, delay_minutes, closures
    array<struct<closure_id,name,full>>. Alerts expire when the event starts. With ``now``, only events that start within the
    lookahead give rise to any.
    """
    if now is not None:
        trips = trips.where(F.unix_micros("start_ts") - F.unix_micros(F.lit(now).cast("timestamp")) <= ALERT_LOOKAHEAD_HOURS * 3_600_000_000)
    event, leave = F.col("event_name"), clock("leave_by", zone)
    base = {"event_id": F.col("event_id"), "expires_at": F.col("start_ts")}
    key = lambda kind, *more: F.concat_ws("|", F.lit(kind), F.col("event_id"), *more)
    advice = (F.when(F.col("action") == "reroute", fill("advice_reroute")).when(F.col("action") == "reroute_caution", fill("advice_caution"))
              .otherwise(fill("advice_none")))
    around = F.coalesce(fill("around", street="street"), F.lit(""))
    route = F.when(F.col("compromised"), _alert(
        key("route_flood"), "trip", "route_flood", F.when(F.col("action") == "no_alternative", "critical").otherwise("warning"),
        fill("route_flood_title", event=event), fill("route_flood", around=around, advice=advice, time=leave), segment_id=F.col("segment_id"), **base))
    instead = F.coalesce(fill("park_instead", lot="other_lot"), fill("no_lot"))
    lot = F.when(F.coalesce("lot_hazardous", F.lit(False)), _alert(
        key("parking_flood"), "trip", "parking_flood", "warning", fill("parking_title", lot="lot_name"), fill("parking", lot="lot_name", instead=instead),
        parking_id=F.col("lot_id"), **base))
    slow = F.when(F.col("delay_minutes") >= TRAFFIC_ALERT_MINUTES, _alert(
        key("leave_earlier"), "trip", "leave_earlier", "info", fill("traffic_title", event=event), fill("traffic", time=leave), **base))
    works = F.transform(F.coalesce("closures", F.array().cast("array<struct<closure_id:string,name:string,full:boolean>>")), lambda c: _alert(
        key("closure", c["closure_id"]), "trip", "closure", "info", fill("closure_title", event=event),
        fill("closure", name=c["name"], what=F.when(c["full"], fill("closed")).otherwise(fill("works"))), **base))
    rows = F.filter(F.concat(F.array(route, lot, slow), works), lambda a: a.isNotNull())
    return with_alert_id(trips.select("user_id", F.explode(rows).alias("a")).select("user_id", "a.*"))


def weather_alert_rows(weather: DataFrame) -> DataFrame:
    """user_id, id, event, severity, ends -> alert rows that expire when the warning ends."""
    sev = F.lit("info")
    for name, level in WEATHER_SEVERITY.items():
        sev = F.when(F.col("severity") == name, level).otherwise(sev)
    said = F.col("severity").isNotNull() & (F.col("severity") != "Unknown")
    msg = fill("weather", severity=F.when(said, fill("weather_severity", level=F.lower("severity"))).otherwise(""))
    a = _alert(F.concat(F.lit("nws|"), F.col("id")), "nws", "weather_warning", sev, F.col("event"), msg, expires_at=F.col("ends"))
    return with_alert_id(weather.select("user_id", a.alias("a")).select("user_id", "a.*"))


def tide_alert_rows(tide: DataFrame, zone: str = TIME_ZONE) -> DataFrame:
    """user_id, at, above_minor, above_moderate -> alert rows, none below the minor level."""
    sev = F.when(F.col("above_moderate"), "critical").otherwise("warning")
    msg = fill("tide", level=F.when(F.col("above_moderate"), "moderate").otherwise("minor"))
    day = F.date_format(F.from_utc_timestamp("at", zone), "yyyy-MM-dd")
    a = _alert(F.concat(F.lit("tide|"), day), "tide", "tide", sev, fill("tide_title"), msg)
    return with_alert_id(tide.where("above_minor").select("user_id", a.alias("a")).select("user_id", "a.*"))


def with_alert_id(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("alert_id", stable_id("al_", "alert_key", 10))


def severity_rank(c) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in SEVERITY_RANK.items():
        out = F.when(col(c) == name, rank).otherwise(out)
    return out


def diff_alerts(existing: DataFrame, fresh: DataFrame, checked: DataFrame, now) -> DataFrame:
    """The alert table after one rebuild: new and repeated ones written, gone ones resolved where their source was checked.

    ``read`` survives unless the severity rose or the alert had been resolved. existing: user_id, alert_id, source, severity,
    active, read, created_at, updated_at, resolved_at. fresh: user_id, alert_id, source, severity. checked: user_id, source.
    """
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    old = existing.select("user_id", "alert_id", F.struct(*[c for c in existing.columns if c not in ("user_id", "alert_id")]).alias("o"))
    new = fresh.select("user_id", "alert_id", F.struct("source", "severity").alias("n"))
    seen = checked.select("user_id", F.col("source").alias("_src"), F.lit(True).alias("_checked")).distinct()
    j = old.join(new, ["user_id", "alert_id"], "full").join(
        seen.withColumnRenamed("user_id", "_u"), (F.col("user_id") == F.col("_u")) & (F.col("o.source") == F.col("_src")), "left").drop("_u", "_src")
    is_new, was = F.col("n").isNotNull(), F.coalesce(F.col("o.active"), F.lit(False))
    gone = ~is_new & was & F.coalesce("_checked", F.lit(False))
    still_read = was & F.coalesce(F.col("o.read"), F.lit(False)) & (severity_rank("n.severity") <= severity_rank("o.severity"))
    return j.select(
        "user_id", "alert_id", F.coalesce("n.source", "o.source").alias("source"), F.coalesce("n.severity", "o.severity").alias("severity"),
        F.when(is_new, True).when(gone, False).otherwise(F.col("o.active")).alias("active"),
        F.when(is_new, F.coalesce(still_read, F.lit(False))).otherwise(F.col("o.read")).alias("read"),
        F.when(is_new & ~was, now).otherwise(F.col("o.created_at")).alias("created_at"),
        F.when(is_new | gone, now).otherwise(F.col("o.updated_at")).alias("updated_at"),
        F.when(is_new, F.lit(None).cast("timestamp")).when(gone, now).otherwise(F.col("o.resolved_at")).alias("resolved_at"))


def list_alerts(alerts: DataFrame, include_resolved: bool = False) -> DataFrame:
    """Most severe first, then the most recently updated."""
    kept = alerts if include_resolved else alerts.where("active")
    return kept.withColumn("severity_rank", severity_rank("severity")).orderBy(
        "user_id", F.desc("severity_rank"), F.desc("updated_at"), "alert_id")


def recent_trips(trips: DataFrame, n: int = 5) -> DataFrame:
    """The newest n trips per user, with their position."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("trip_id"))
    return trips.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def dashboard(trips: DataFrame, alerts: DataFrame) -> DataFrame:
    t = trips.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("trips_planned"), F.bround(F.sum("time_saved_minutes"), 0).cast("bigint").alias("time_saved_minutes"),
        F.sum("high_risk_segments_avoided").cast("bigint").alias("risky_segments_avoided"),
        F.bround(F.sum("high_risk_m_avoided") / 1000, 1).alias("high_risk_km_avoided"),
        F.count_if("compromised").alias("compromised_trips"),
        F.count_if((F.col("take") == "safe") & (F.col("high_risk_m_avoided") > 0)).alias("safer_routes_taken"))
    a = alerts.groupBy("user_id").agg(F.count(F.lit(1)).alias("alerts_received"))
    out = t.join(a, "user_id", "full")
    return out.select("user_id", *[F.coalesce(c, F.lit(0).cast(out.schema[c].dataType)).alias(c) for c in out.columns if c != "user_id"])


def upsert(existing: DataFrame, changes: DataFrame, key: list[str], ts: str) -> DataFrame:
    """Replace by key or insert; of several changes to one key the latest wins. A max-by aggregate, so hot keys shrink map-side."""
    rest = [c for c in existing.columns if c not in key]
    tagged = existing.withColumn("_new", F.lit(0)).unionByName(changes.select(*existing.columns).withColumn("_new", F.lit(1)))
    return tagged.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("_new", ts)).alias("r")).select(
        *key, "r.*").select(*existing.columns)


def coverage_note(d_from, d_to, limit_m: float) -> Column:
    def part(d, name):
        return F.when(col(d) > limit_m, fill(name, km=F.format_string("%.1f", col(d) / 1000.0)))
    parts = F.filter(F.array(part(d_from, "start_outside"), part(d_to, "end_outside")), lambda p: p.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(parts, " "))


def trip_times(routes: DataFrame, seconds: str = "seconds") -> DataFrame:
    """Departure and arrival of a route as text, from ``arrive_by`` or ``depart_at``."""
    s = F.bround(F.col(seconds) * 1e6, 0).cast("bigint")
    depart = F.when(F.col("arrive_by").isNotNull(), F.timestamp_micros(F.unix_micros("arrive_by") - s)).otherwise(F.col("depart_at"))
    arrive = F.coalesce("arrive_by", F.timestamp_micros(F.unix_micros("depart_at") + s))
    return routes.withColumns({"departs": iso_utc(depart), "arrives": iso_utc(arrive)})
