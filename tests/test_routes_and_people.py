"""Graph searches against plain algorithms; people-facing operators on hand-made rows."""
import datetime as d
import heapq
import random

import pytest
from pyspark.sql import functions as F

from highwater.functions import text as X
from highwater.operators import checks as C, graph as N, trips as R

T0 = d.datetime(2026, 9, 28, 12, 0)


def dijkstra(arcs, start):
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        c, n = heapq.heappop(heap)
        if c > dist[n]:
            continue
        for m, w in arcs.get(n, []):
            if c + w < dist.get(m, 1e18):
                dist[m] = c + w
                heapq.heappush(heap, (c + w, m))
    return dist


@pytest.mark.parametrize("fan", ["many sources", "many targets"])
def test_batch_paths_equal_dijkstra(spark, fan):
    rnd = random.Random(7)
    edges = [(rnd.randrange(25), rnd.randrange(25), f"e{i}", rnd.randint(0, 20)) for i in range(70)]
    rows = [(u, v, e, k, float(c if k == "usual" else (c * 7) % 23)) for u, v, e, c in edges for k in ("usual", "safe")]
    pairs = [(s, t) for s in range(20) for t in (3, 9)] if fan == "many sources" else [(s, t) for s in (3, 9) for t in range(20)]
    df = spark.createDataFrame(rows, "u int, v int, edge_id string, kind string, cost double")
    paths, summary = N.batch_paths(df, spark.createDataFrame(pairs, "source int, target int"))
    got = {(r["kind"], r["source"], r["target"]): r["total"] for r in summary.collect()}
    ends = {e: (u, v) for u, v, e, _ in edges}
    legs = {}
    for r in paths.orderBy("seq").collect():
        legs.setdefault((r["kind"], r["source"], r["target"]), []).append((r["edge_id"], r["cost"]))
    for k in ("usual", "safe"):
        arcs = {}
        for u, v, e, kind, c in rows:
            if kind == k:
                arcs.setdefault(u, []).append((v, c))
        for s, t in set(pairs):
            if s == t:
                continue
            want = dijkstra(arcs, s).get(t)
            assert got[(k, s, t)] == want
            if want is not None:
                route = legs[(k, s, t)]
                assert abs(sum(c for _, c in route) - want) < 1e-9
                assert ends[route[0][0]][0] == s and ends[route[-1][0]][1] == t
                assert all(ends[a][1] == ends[b][0] for (a, _), (b, _) in zip(route, route[1:]))
            else:
                assert (k, s, t) not in legs


def test_largest_scc(spark):
    e = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 7), (7, 4), (8, 1), (7, 9), (5, 4)]
    assert sorted(r["id"] for r in N.largest_scc(spark.createDataFrame(e, "u int, v int")).collect()) == [4, 5, 6, 7]


def test_components_of_a_long_chain(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 501)]
    got = {r["id"]: r["component"] for r in N.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500


def road_edges(spark):
    """1 -> 2 straight is flooded; 1 -> 3 -> 2 is dry and longer; 4 cannot be reached."""
    rows = [(1, 2, "1_2_0", "Flood St", 900.0, 60.0, False, False, .9, "high"), (1, 3, "1_3_0", "Dry Rd", 600.0, 50.0, False, False, .1, "low"),
            (3, 2, "3_2_0", "Dry Rd", 600.0, 50.0, False, False, .1, "low"), (1, 2, "1_2_1", "Shut", 100.0, 5.0, True, False, .1, "low"),
            (2, 5, "2_5_0", "Only Way", 1500.0, 80.0, False, False, .8, "high"), (4, 1, "4_1_0", None, 10.0, 1.0, False, True, .1, "low")]
    return spark.createDataFrame(rows, "u int, v int, edge_id string, name string, length double, seconds double, closed boolean, slowed boolean, score double, label string")


def test_compare_routes(spark):
    trips = spark.createDataFrame([("reroute", 1, 2), ("none", 2, 5), ("safe", 3, 2), ("mixed", 1, 5), ("same", 1, 1), ("lost", 1, 4), ("work", 4, 3)], "trip_id string, from_node int, to_node int")
    r = {x["trip_id"]: x for x in R.compare_routes(trips, road_edges(spark)).collect()}
    assert r["reroute"]["action"] == "reroute" and r["reroute"]["high_risk_m_avoided"] == 900 and r["reroute"]["extra_minutes"] == 0.7
    assert r["reroute"]["message"] == "High flood risk on Flood St. Take the safer route (+0.7 min)."
    assert r["none"]["action"] == "no_alternative" and r["none"]["message"].startswith("No safer route: your trip has to cross 1.5 km")
    assert r["safe"]["action"] == "safe" and r["safe"]["same_route"]
    assert r["mixed"]["action"] == "reroute_caution" and r["mixed"]["high_risk_segments_avoided"] == 1
    assert r["same"]["status"] == "same_place" and r["lost"]["status"] == "unreachable" and r["lost"]["action"] is None
    assert r["work"]["usual"]["free_flow_s"] == 51.5


def test_roads_of_a_route_are_listed_only_where_they_are_read(spark):
    """What routes are compared by comes from legs; only route_id, segments, path and closures ask for every road."""
    trips = spark.createDataFrame([("a", 1, 2), ("b", 2, 5), ("c", 1, 5)], "trip_id string, from_node int, to_node int")
    r = R.compare_routes(trips, road_edges(spark))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    few = r.select("trip_id", "status", "action", "message", "same_route", "extra_minutes", "high_risk_segments_avoided")
    assert "posexplode" in plan(r) and "posexplode" not in plan(few)
    assert "inline" not in plan(r.select("trip_id", "status", "usual.seconds", "usual.distance_m")).replace("inline(array_compact", "")
    whole = {x["trip_id"]: x for x in r.collect()}
    assert {x["trip_id"]: x["high_risk_segments_avoided"] for x in few.collect()} == {"a": 1, "b": 0, "c": 1}
    u = whole["c"]["usual"]
    assert u["distance_m"] == 2400 and u["high_risk_m"] == 2400 and u["street"] == "Only Way" and [s["edge_id"] for s in u["risk_segments"]] == ["1_2_0", "2_5_0"]
    assert not whole["c"]["same_route"] and whole["b"]["same_route"] and whole["b"]["usual"]["route_id"] == whole["b"]["safe"]["route_id"]


def test_distance_text_rounds_the_double(spark):
    ms = [340, 999, 1000, 1050, 1150, 1250, 1350, 2450, 10050, 12345]
    got = [r[0] for r in spark.createDataFrame([(m,) for m in ms], "m int").select(X.distance_text("m")).collect()]
    assert got == [f"{m / 1000:.1f} km" if m >= 1000 else f"{m} m" for m in ms]


def test_coverage_note(spark):
    df = spark.createDataFrame([(10.0, 20.0), (450.0, 20.0), (450.0, 2000.0)], "a double, b double")
    got = [r[0] for r in df.select(R.coverage_note("a", "b", 300.0)).collect()]
    assert got[0] is None and got[1].endswith("(0.5 km away).") and got[2].count("away") == 2


BUILDINGS = [("PC", "Primera Casa"), ("GC", "Ernest R. Graham University Center"), ("CP", "Chemistry & Physics"), ("GL", "Steven and Dorothea Green Library"), ("PG6", "Parking Garage 6"),
             ("PG5", "Parking Garage 5"), ("AHC5", "Academic Health Center 5"), ("AHC1", "Academic Health Center 1"), ("SIPA", "School of International and Public Affairs")]


def test_locations(spark):
    want = {"PC 213": "PC", "PC213": "PC", "Graham Center (GC) 243": "GC", "gl 100": "GL", "Chem & Physics 197": "CP", "Green Library 100": "GL", "Parking Garage 6 115": "PG6", "Parking Garage 7": None,
            "Parking Garage": None, "Academic Health Center 5 room 1": "AHC5", "Online": None, "Zoom PC": None, "Somewhere": None, "Public Affairs": "SIPA", "Library": None, None: None}
    ev = spark.createDataFrame([(k,) for k in want], "location string")
    b = spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(BUILDINGS)], "code string, name string, ord int")
    assert {r["location"]: r["code"] for r in R.resolve_location(ev, b).collect()} == want


def test_generic_names_bring_nothing_together(spark):
    """Three hundred names end in the same word: each text meets the names that share its rarest word, not all of them."""
    b = spark.createDataFrame([(f"H{i}", f"Quarter{i:03d} Memorial Hall", i) for i in range(300)] + [("MH", "Memorial Hall", 300), ("OM", "Old Memorial", 301)], "code string, name string, ord int")
    want = {f"room at quarter{i:03d} memorial hall": f"H{i}" for i in range(0, 300, 25)} | {"the memorial hall": "MH", "hall": None, "quarter hall": None, "old memorial steps": "OM"}
    ev = spark.createDataFrame([(k,) for k in want], "location string")
    assert {r["location"]: r["code"] for r in R.resolve_location(ev, b).collect()} == want


def test_schedule_across_the_clock_change(spark):
    c = spark.createDataFrame([(1, ["MO", "WE"], 510, 585)], "class_id int, days array<string>, start_min int, end_min int")
    rows = R.expand_schedule(c, "2026-03-04 00:00:00", "2026-03-12 00:00:00").orderBy("start_ts").collect()
    assert [str(r["start_ts"]) for r in rows] == ["2026-03-04 13:30:00", "2026-03-09 12:30:00", "2026-03-11 12:30:00"]
    skipped = spark.createDataFrame([(1, d.date(2026, 3, 9))], "class_id int, date date")
    moved = spark.createDataFrame([(1, d.date(2026, 3, 11), d.datetime(2026, 3, 10, 15), d.datetime(2026, 3, 10, 16))], "class_id int, date date, start_ts timestamp, end_ts timestamp")
    got = [str(r["start_ts"]) for r in R.expand_with_exceptions(c, skipped, moved, "2026-03-04 00:00:00", "2026-03-12 00:00:00").orderBy("start_ts").collect()]
    assert got == ["2026-03-04 13:30:00", "2026-03-10 15:00:00"]


def lots(spark):
    rows = [("A", "Gold Garage", "garage", 0.0, 0.0, None, "low"), ("B", "Lot 5", "surface", 100.0, 0.0, None, "high"), ("C", "Staff Lot", "surface", 110.0, 0.0, None, "low"),
            ("D", "Lot 9", "surface", 130.0, 0.0, None, "low"), ("E", "Far Garage", "garage", 900.0, 0.0, None, "low"), ("F", "Gated", "surface", 101.0, 0.0, "private", "low")]
    return spark.createDataFrame(rows, "lot_id string, name string, type string, x double, y double, access string, hazard_label string")


def test_lot_alternatives(spark):
    got = R.lot_alternatives(lots(spark)).orderBy("lot_id", "rank").collect()
    assert [(r["lot_id"], r["alternative"], r["distance_m"]) for r in got] == [("B", "A", 100), ("B", "E", 800), ("B", "D", 30)]


def test_pick_lot(spark):
    req = spark.createDataFrame([(1, 105.0, 0.0, None), (2, 105.0, 0.0, "E"), (3, 5000.0, 0.0, None), (4, 5000.0, 0.0, "A")], "req_id int, x double, y double, preferred_lot string")
    got = {r["req_id"]: (r["lot_id"], r["walk_min"]) for r in R.pick_lot(req, lots(spark)).collect()}
    assert got == {1: ("B", 0), 2: ("E", 13), 3: (None, 0), 4: ("A", 81)}


def test_leave_by_and_search(spark):
    df = spark.createDataFrame([("garage", d.datetime(2026, 9, 28, 12, 0)), ("surface", d.datetime(2026, 9, 27, 12, 0)), ("x", d.datetime(2026, 9, 28, 15, 0))], "t string, at timestamp")
    assert [r[0] for r in df.select(X.search_minutes("t", "at")).collect()] == [9.0, 3.0, 3.0]  # 8:00 Monday, 8:00 Sunday, 11:00 Monday
    r = df.limit(1).select(X.leave_by("at", F.lit(10), F.lit(3), F.lit(9.0), F.lit(601.0)).alias("l")).first()
    assert str(r["l"]) == "2026-09-28 11:27:00"


def test_alert_rows(spark):
    leave, start = d.datetime(2026, 9, 28, 12, 25), d.datetime(2026, 9, 28, 13, 0)
    rows = [("u", "e1", "Physics", start, leave, True, "no_alternative", "SW 8th St", "s9", "p5", "Lot 5", True, "Gold Garage", 12.0, [("c1", "SW 8th St", False)]),
            ("u", "e2", "Math", start, leave, False, "safe", None, None, "p6", "Lot 6", False, None, 9.0, None),
            ("u", "e3", "Art", start + d.timedelta(days=1), leave, True, "reroute", None, None, None, None, False, None, 0.0, None)]
    trips = spark.createDataFrame(rows, "user_id string, event_id string, event_name string, start_ts timestamp, leave_by timestamp, compromised boolean, action string, street string, segment_id string, lot_id string, "
                                        "lot_name string, lot_hazardous boolean, other_lot string, delay_minutes double, closures array<struct<closure_id:string,name:string,full:boolean>>")
    a = R.trip_alerts(trips, "2026-09-28 01:00:00")
    got = {r["type"]: r for r in a.collect()}
    assert set(got) == {"route_flood", "parking_flood", "leave_earlier", "closure"} and got["route_flood"]["severity"] == "critical"
    assert got["route_flood"]["title"] == "Critical: Flooding expected on your route to Physics" and got["route_flood"]["message"].endswith("Leave by 8:25 AM.")
    assert "Park at Gold Garage instead." in got["parking_flood"]["message"] and "under construction" in got["closure"]["message"]
    assert not any(ch.isdigit() and "km" in r["message"] for r in got.values() for ch in r["message"])
    assert {(r["event_id"], r["expires_at"]) for r in got.values()} == {("e1", start)}
    assert {k: (r["segment_id"], r["parking_id"]) for k, r in got.items()} == {"route_flood": ("s9", None), "parking_flood": (None, "p5"), "leave_earlier": (None, None), "closure": (None, None)}
    assert {r["event_id"] for r in R.trip_alerts(trips).collect()} == {"e1", "e3"}  # without a moment no lookahead
    assert R.trip_alerts(trips, "2026-09-28 00:59:59").count() == 0


def test_alert_lifecycle(spark):
    ex = "user_id string, alert_id string, source string, severity string, active boolean, read boolean, created_at timestamp, updated_at timestamp, resolved_at timestamp"
    old = spark.createDataFrame([("u", "keep", "trip", "warning", True, True, T0, T0, None), ("u", "rise", "trip", "info", True, True, T0, T0, None), ("u", "gone", "trip", "info", True, False, T0, T0, None),
                                 ("u", "unchecked", "tide", "info", True, False, T0, T0, None), ("u", "back", "trip", "info", False, True, T0, T0, T0)], ex)
    fresh = spark.createDataFrame([("u", "keep", "trip", "warning"), ("u", "rise", "trip", "critical"), ("u", "back", "trip", "info"), ("u", "new", "nws", "info")], "user_id string, alert_id string, source string, severity string")
    checked = spark.createDataFrame([("u", "trip"), ("u", "nws")], "user_id string, source string")
    r = {x["alert_id"]: x for x in R.diff_alerts(old, fresh, checked, "2026-09-28 13:00:00").collect()}
    assert r["keep"]["read"] and not r["rise"]["read"] and not r["back"]["read"] and not r["new"]["read"]
    assert not r["gone"]["active"] and str(r["gone"]["resolved_at"]) == "2026-09-28 13:00:00" and r["unchecked"]["active"]
    assert r["keep"]["created_at"] == T0 and r["back"]["created_at"] != T0 and r["unchecked"]["updated_at"] == T0


def test_trip_records(spark):
    rows = [("a", True, False, 1000, "reroute", 2.0, 800, 3, None), ("b", True, True, 1000, "no_alternative", 0.0, 0, 0, None), ("c", True, False, 1000, "reroute", 2.0, 800, 3, "usual"), ("d", True, False, 1000, "reroute", 14.0, 800, 3, None)]
    p = spark.createDataFrame(rows, "trip_id string, compromised boolean, same_route boolean, usual_high_m int, action string, extra_minutes double, high_risk_m_avoided int, high_risk_segments_avoided int, take string")
    got = {r["trip_id"]: (r["take"], r["time_saved_minutes"], r["high_risk_m_avoided"]) for r in R.record_trips(p).collect()}
    assert got == {"a": ("safe", 10.0, 800), "b": ("usual", 0.0, 0), "c": ("usual", 0.0, 0), "d": ("safe", 0.0, 800)}


def test_profile_defaults_and_scenario(spark):
    users = spark.createDataFrame([("u1", None, 5)], "user_id string, home double, buffer int")
    d_ = spark.createDataFrame([(1.5, 10, None)], "home double, buffer int, name string")
    assert C.with_defaults(users, d_).first().asDict() == {"user_id": "u1", "home": 1.5, "buffer": 5, "name": None}
    state = spark.createDataFrame([("storm",)], "scenario string")
    req = spark.createDataFrame([(1, None), (2, "live")], "id int, scenario string")
    assert {r["id"]: r["scenario"] for r in C.pick_scenario(req, state).collect()} == {1: "storm", 2: "live"}
    assert C.pick_scenario(req, state.limit(0)).where("id = 1").first()["scenario"] == "live"


def test_tide(spark):
    from highwater.operators.serving import tide_peak
    m = d.timedelta(minutes=1)
    pred = spark.createDataFrame([("s", T0 + 6 * i * m, 1.0 + 0.1 * i) for i in range(-5, 30)], "key string, t timestamp, v double")
    levels = spark.createDataFrame([("s", 2.5, 4.0)], "key string, minor double, moderate double")
    req = spark.createDataFrame([(1, "s", T0 + 30 * m, T0 + 5 * m), (2, "s", T0 + 30 * m, T0 + 200 * m), (3, "s", T0 + 9000 * m, T0), (4, "x", T0, T0)], "req_id int, key string, at timestamp, now timestamp")
    obs = spark.createDataFrame([("s", T0 - 100 * m, 9.0), ("s", T0, 1.7)], "key string, t timestamp, v double")
    r = {x["req_id"]: x for x in tide_peak(req, pred, obs, levels).collect()}
    assert abs(r[1]["predicted_peak"] - 2.5) < 1e-9 and abs(r[1]["anomaly"] - 0.7) < 1e-9 and r[1]["above_minor"] and not r[1]["above_moderate"]
    assert r[2]["anomaly"] is None and r[3]["status"] == "unavailable" and r[4]["status"] == "unavailable"


def test_rain_sums(spark):
    from highwater.operators.serving import rain_sums
    q = d.timedelta(minutes=15)
    quarters = spark.createDataFrame([("p", T0 + i * q, 2.0) for i in range(-7, 9)] + [("h", T0 + i * q, 2.0) for i in range(-7, 9) if i != 1], "key string, t timestamp, mm double")
    req = spark.createDataFrame([(1, "p", T0, T0 + 2 * q), (2, "h", T0, T0 + 2 * q), (3, "p", T0, T0)], "req_id int, key string, now timestamp, depart timestamp")
    r = {x["req_id"]: x for x in rain_sums(req, quarters).collect()}
    assert (r[1]["past_2h_mm"], r[1]["before_departure_mm"], r[1]["during_trip_mm"], r[1]["max_15min_mm"]) == (16, 4, 8, 2)
    assert r[2]["before_departure_mm"] is None and r[2]["past_2h_mm"] == 16 and r[2]["max_15min_mm"] is None and r[3]["before_departure_mm"] == 0
