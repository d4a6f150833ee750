"""Streaming jobs driven to completion from files, with late and repeated rows."""
import datetime as d

import pytest
from pyspark.sql import functions as F

from highwater.sources.writers import read_versioned
from highwater.streaming import jobs as J

T0 = d.datetime(2026, 9, 28, 12, 0)
Q = d.timedelta(minutes=15)


class Feed:
    """A folder that a stream reads one file per batch from."""

    def __init__(self, spark, tmp_path, schema):
        self.spark, self.path, self.schema, self.n = spark, tmp_path / "in", schema, 0
        self.path.mkdir()

    def add(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/b{self.n}")

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/*")


def run(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_rain_windows(spark, tmp_path):
    f = Feed(spark, tmp_path, "key string, t timestamp, mm double")
    f.add([("p", T0 + i * Q, 1.0) for i in range(1, 5)] + [("gap", T0 + i * Q, 1.0) for i in (1, 2, 4)])
    f.add([("p", T0 + i * Q, 1.0) for i in range(5, 20)])
    f.add([("p", T0 + 20 * Q, 1.0)])
    f.add([("p", T0 + Q, 50.0)])  # too late: the watermark of the batch before counts
    f.add([("p", T0 + 30 * Q, 0.0)])
    t = run(J.rain_windows(f.stream(), "1 hour", "15 minutes", "30 minutes"), "append", "rain_w", tmp_path)
    rows = {(r["key"], r["start"]): r["mm"] for r in t.collect()}
    assert rows[("p", T0)] == 4.0 and rows[("gap", T0)] is None and rows[("p", T0 + 4 * Q)] == 4.0


def test_repeats_and_daily_counts(spark, tmp_path):
    f = Feed(spark, tmp_path, "street_id string, t timestamp")
    f.add([("s", T0), ("s", T0 + Q), ("r", T0)])
    f.add([("s", T0 - Q), ("s", T0 + d.timedelta(days=1))])  # late but inside the watermark; next day
    f.add([("z", T0 + d.timedelta(days=9))])
    f.add([("z", T0 + d.timedelta(days=10))])
    t = run(J.daily_report_counts(f.stream()), "append", "report_days", tmp_path)
    rows = {(str(r["day"]), r["street_id"]): r["report_days"] for r in t.collect()}
    assert rows[("2026-09-28", "s")] == 1 and rows[("2026-09-29", "s")] == 1 and rows[("2026-09-28", "r")] == 1


def test_dedupe(spark, tmp_path):
    f = Feed(spark, tmp_path, "id string, t timestamp")
    f.add([("a", T0), ("a", T0)])
    f.add([("a", T0 + Q), ("b", T0 + Q)])
    assert sorted(r["id"] for r in run(J.dedupe_stream(f.stream(), ["id"]), "append", "dedupe", tmp_path).collect()) == ["a", "b"]


POLL = ("user_id string, t timestamp, checked array<string>, candidates array<struct<alert_id:string,source:string,severity:string>>, read_ids array<string>")


def test_alert_state(spark, tmp_path):
    f = Feed(spark, tmp_path, POLL)
    f.add([("u", T0, ["trip"], [("a", "trip", "warning"), ("b", "tide", "info")], None)])
    f.add([("u", T0 + Q, ["trip"], [("a", "trip", "warning")], ["a"])])           # a read; tide not checked: b stays
    f.add([("u", T0 + 2 * Q, ["trip", "tide"], [("a", "trip", "critical")], None)])  # severity rises; b resolved
    f.add([("u", T0 + 3 * Q, ["trip", "tide"], [], None)])
    t = run(J.alert_state(f.stream()), "update", "alerts_s", tmp_path)
    rows = {(r["alert_id"], r["updated_at"]): r for r in t.collect()}
    assert rows[("a", T0 + Q)]["read"] and rows[("a", T0 + Q)]["created_at"] == T0
    assert not rows[("a", T0 + 2 * Q)]["read"] and ("b", T0 + Q) not in rows
    assert not rows[("b", T0 + 2 * Q)]["active"] and rows[("b", T0 + 2 * Q)]["resolved_at"] == T0 + 2 * Q
    assert not rows[("a", T0 + 3 * Q)]["active"]


def test_throttle(spark, tmp_path):
    s = d.timedelta(seconds=1)
    f = Feed(spark, tmp_path, "user_id string, t timestamp, scenario string")
    f.add([("u", T0, "live"), ("u", T0 + 30 * s, "live"), ("v", T0 + 30 * s, "live")])
    f.add([("u", T0 + 40 * s, "storm"), ("u", T0 + 59 * s, "storm"), ("u", T0 + 100 * s, "storm")])
    got = {(r["user_id"], r["t"]) for r in run(J.throttle(f.stream()), "append", "throttled", tmp_path).collect()}
    assert got == {("u", T0), ("v", T0 + 30 * s), ("u", T0 + 40 * s), ("u", T0 + 100 * s)}


def run_more(df, mode, folder):
    """One run into files, so that a second run goes on from the checkpoint of the first."""
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True)
         .foreachBatch(lambda b, e: b.write.mode("overwrite").parquet(f"{folder}/out/batch={e}")).start())
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.read.parquet(f"{folder}/out").drop("batch")


def state_rows(spark, folder, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/ck").count()


def test_alert_state_survives_a_restart_and_ends_empty(spark, tmp_path):
    f = Feed(spark, tmp_path, POLL)
    f.add([("u", T0, ["trip"], [("a", "trip", "warning"), ("b", "tide", "info")], None), ("v", T0, ["trip"], [("c", "trip", "info")], None)])
    f.add([("u", T0 + Q, ["trip"], [("a", "trip", "warning")], ["a"])])
    run_more(J.alert_state(f.stream()), "update", tmp_path)
    assert state_rows(spark, tmp_path, "live") == 3
    f.add([("u", T0 + 2 * Q, ["trip", "tide"], [("a", "trip", "warning")], None), ("v", T0 + 2 * Q, ["trip"], None, None)])
    f.add([("u", T0 + 3 * Q, ["trip", "tide"], [], None)])
    rows = {(r["alert_id"], r["updated_at"]): r for r in run_more(J.alert_state(f.stream()), "update", tmp_path).collect()}
    assert rows[("a", T0 + 2 * Q)]["read"] and rows[("a", T0 + 2 * Q)]["created_at"] == T0  # known from before the restart
    assert rows[("a", T0 + 3 * Q)]["resolved_at"] == T0 + 3 * Q and not rows[("c", T0 + 2 * Q)]["active"]
    assert state_rows(spark, tmp_path, "live") == 0


def test_alerts_lapse_by_timer(spark, tmp_path):
    f, h = Feed(spark, tmp_path, POLL), 4 * Q
    f.add([("u", T0, ["trip"], [("a", "trip", "warning"), ("b", "tide", "info")], None)])
    f.add([("u", T0 + h, ["trip"], [("a", "trip", "warning")], None)])
    f.add([("w", T0 + 2 * h + 2 * Q, ["trip"], [], None)])  # the watermark passes b's lapse, not yet a's
    rows = {r["alert_id"]: r for r in run_more(J.alert_state(f.stream(), "2 hours"), "update", tmp_path).where("not active").collect()}
    assert sorted(rows) == ["b"] and rows["b"]["resolved_at"] == T0 + 2 * h and rows["b"]["created_at"] == T0
    assert state_rows(spark, tmp_path, "live") == 1
    f.add([("w", T0 + 9 * h, ["trip"], [], None)])
    rows = {r["alert_id"]: r for r in run_more(J.alert_state(f.stream(), "2 hours"), "update", tmp_path).where("not active").collect()}
    assert rows["a"]["resolved_at"] == T0 + 3 * h and state_rows(spark, tmp_path, "live") == 0


def test_throttle_forgets_and_survives_a_restart(spark, tmp_path):
    s = d.timedelta(seconds=1)
    f = Feed(spark, tmp_path, "user_id string, t timestamp, scenario string")
    f.add([("u", T0, "live"), ("v", T0, "live")])
    run_more(J.throttle(f.stream()), "append", tmp_path)
    assert state_rows(spark, tmp_path, "last") == 2
    f.add([("u", T0 + 30 * s, "live"), ("u", T0 + 61 * s, "live")])
    f.add([("x", T0 + 600 * s, "live")])
    f.add([("y", T0 + 601 * s, "live")])
    got = {(r["user_id"], r["t"]) for r in run_more(J.throttle(f.stream()), "append", tmp_path).collect()}
    assert got == {("u", T0), ("v", T0), ("u", T0 + 61 * s), ("x", T0 + 600 * s), ("y", T0 + 601 * s)}
    assert state_rows(spark, tmp_path, "last") == 2  # u and v are forgotten


def test_closure_refresh_and_upsert(spark, tmp_path):
    f = Feed(spark, tmp_path, "snapshot bigint, closure_id string, edge_id string, start timestamp, end timestamp, full_closure boolean")
    f.add([(1, "c1", "e1", T0, None, True), (1, "c2", "e2", T0, T0 + Q, None)])
    f.add([(2, "c2", "e2", T0, T0 + Q, None), (2, "c3", "e3", T0 + 9 * Q, None, True)])
    path = str(tmp_path / "closures")
    q = J.closure_refresh(f.stream(), path, str(tmp_path / "ck1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["closure_id"] for r in read_versioned(spark, path).collect()) == ["c2", "c3"]
    assert [(r["closure_id"], r["full_closure"]) for r in J.closures_now(spark, path, "2026-09-28 12:10:00").collect()] == [("c2", False)]
    (tmp_path / "late").mkdir()
    late = Feed(spark, tmp_path / "late", "snapshot bigint, closure_id string, edge_id string, start timestamp, end timestamp, full_closure boolean")
    late.add([(1, "c9", "e9", T0, None, True)])
    J.closure_refresh(late.stream(), path, str(tmp_path / "ck3")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["closure_id"] for r in read_versioned(spark, path).collect()) == ["c2", "c3"]
    up = str(tmp_path / "table")
    q = J.upsert_stream(f.stream(), up, ["closure_id"], "snapshot", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["closure_id"]: r["snapshot"] for r in read_versioned(spark, up).collect()} == {"c1": 1, "c2": 2, "c3": 2}


def test_freshness_and_health(spark, tmp_path):
    f = Feed(spark, tmp_path, "scenario string, t timestamp")
    f.add([("live", T0), ("storm", T0 - 9 * Q), ("none", T0)])
    runs = spark.createDataFrame([("live", "old", T0 - 20 * Q), ("storm", "s", T0 - 400 * Q)], "scenario string, run_id string, computed_at timestamp")
    rows = {r["scenario"]: r for r in run(J.freshness(f.stream(), runs, F.lit(T0)), "append", "fresh", tmp_path).collect()}
    assert rows["live"]["run_stale"] and not rows["storm"]["run_stale"] and rows["none"]["run_stale"]
    assert rows["storm"]["obs_stale"] and not rows["live"]["obs_stale"]
    polls = spark.createDataFrame([("nws", T0, "{}", None), ("tide", T0, None, "timeout"), ("rain", T0, None, None)], "source string, t timestamp, body string, error string")
    assert {r["source"]: (r["status"], r["error"]) for r in J.source_health(polls).collect()} == {
        "nws": ("ok", None), "tide": ("unavailable", "timeout"), "rain": ("unavailable", "empty answer")}


if __name__ == "__main__":
    pytest.main([__file__])
