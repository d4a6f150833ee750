"""Structured Streaming jobs over the polled feeds."""
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from highwater.operators.checks import active_at
from highwater.session import cut_lineage
from highwater.settings import ALERT_REFRESH_SECONDS, RUN_STALE_HOURS, SEVERITY_RANK
from highwater.sources.writers import read_versioned, upsert_table, write_versioned


def rain_windows(stream: DataFrame, size: str = "2 hours", slide: str = "15 minutes", delay: str = "30 minutes") -> DataFrame:
    """Sliding rain sums per key over 15-minute readings; a window that misses a reading is null, never less.

    Each reading covers the quarter hour that ends at ``t``, so it is placed just before its end.
    """
    expected = int(pd.Timedelta(size) / pd.Timedelta("15 minutes"))
    covered = stream.withColumn("covers", F.timestamp_micros(F.unix_micros("t") - 1)).withWatermark("covers", delay)
    g = covered.groupBy("key", F.window("covers", size, slide).alias("w")).agg(F.sum("mm").alias("mm"), F.count("mm").alias("n"))
    return g.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"),
                    F.when(F.col("n") == expected, F.col("mm")).alias("mm"), "n")


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str = "t", delay: str = "1 hour") -> DataFrame:
    """The first of repeated readings or alerts inside the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def daily_report_counts(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Streets with a report per day: each (street, day) counts once, late ones inside the watermark too."""
    once = (stream.withWatermark("t", delay).withColumn("day", F.to_date("t"))
            .dropDuplicatesWithinWatermark(["street_id", "day"]))
    return once.groupBy(F.window("t", "1 day").alias("w"), "street_id").agg(F.count(F.lit(1)).alias("report_days")).select(
        F.to_date("w.start").alias("day"), "street_id", "report_days")


def freshness(stream: DataFrame, runs: DataFrame, now=None, run_hours: float = RUN_STALE_HOURS, obs_minutes: float = 30) -> DataFrame:
    """Readings with the newest run of their scenario and two flags: run stale, observation stale."""
    now = now if now is not None else F.current_timestamp()
    newest = runs.groupBy("scenario").agg(F.max_by(F.struct("run_id", "computed_at"), "computed_at").alias("run"))
    age = lambda c: F.unix_seconds(now) - F.unix_seconds(c)
    j = stream.join(newest, "scenario", "left")
    stale = F.col("run.run_id").isNull() | ((F.col("scenario") == "live") & (age("run.computed_at") > run_hours * 3600))
    return j.select(*stream.columns, F.col("run.run_id").alias("run_id"), stale.alias("run_stale"), (age("t") > obs_minutes * 60).alias("obs_stale"))


def source_health(stream: DataFrame) -> DataFrame:
    """Raw polls (source, t, body, error) -> status per poll; one failing source leaves the others as they are."""
    bad = F.col("error").isNotNull() | F.col("body").isNull()
    return stream.select("source", "t", F.when(bad, "unavailable").otherwise("ok").alias("status"),
                         F.when(bad, F.coalesce("error", F.lit("empty answer"))).alias("error"), F.when(~bad, F.col("body")).alias("body"))


def closure_refresh(stream: DataFrame, path: str, checkpoint: str):
    """Each snapshot of the closure feed replaces an older one; readers keep the last complete version. A snapshot that
    arrives late, older than the table's, is ignored."""
    def replace(batch: DataFrame, _epoch: int) -> None:
        batch = cut_lineage(batch)
        last, table = batch.agg(F.max("snapshot")).first()[0], read_versioned(batch.sparkSession, path)
        if last is not None and (table is None or table.where(F.col("snapshot") > F.lit(last)).isEmpty()):
            write_versioned(batch.where(F.col("snapshot") == F.lit(last)), path)
    return stream.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint)


def closures_now(spark, path: str, t) -> DataFrame | None:
    table = read_versioned(spark, path)
    return None if table is None else active_at(table, t)


def upsert_stream(stream: DataFrame, path: str, key: list[str], ts: str, checkpoint: str):
    """Replace-or-insert every micro-batch. Writing the same batch twice gives the same table."""
    return stream.writeStream.foreachBatch(lambda b, _e: upsert_table(b, path, key, ts)).option("checkpointLocation", checkpoint)


# ------------------------------------------------------------------ keyed state
ALERT_OUT = "user_id string, alert_id string, source string, severity string, active boolean, read boolean, created bigint, updated bigint, resolved bigint"


class AlertLife(StatefulProcessor):
    """Active alerts of one user: a map from alert id to what is known of it. Resolved alerts leave the map, so a user without
    alerts has no state. Times are microseconds."""

    def __init__(self, lapse: int | None):
        self.lapse = lapse

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getMapState("live", "alert_id string", "source string, severity string, read boolean, created bigint, checked bigint")

    def handleInputRows(self, key, rows, timerValues):
        live = {k[0]: tuple(v) for k, v in self.live.iterator()}
        before, out = dict(live), {}

        def emit(aid, alert, active, at):
            source, severity, read, created, _ = alert
            out[aid] = Row(user_id=key[0], alert_id=aid, source=source, severity=severity, active=active, read=read, created=created,
                           updated=at, resolved=None if active else at)

        for poll in sorted(rows, key=lambda r: r["at"]):
            at, fresh = poll["at"], {c["alert_id"]: c for c in poll["candidates"] or []}
            for aid in poll["read_ids"] or []:
                if aid in live:
                    live[aid] = (*live[aid][:2], True, *live[aid][3:])
                    emit(aid, live[aid], True, at)
            for aid, c in fresh.items():
                old = live.get(aid)
                keep_read = bool(old and old[2] and SEVERITY_RANK[c["severity"]] <= SEVERITY_RANK[old[1]])
                live[aid] = (c["source"], c["severity"], keep_read, old[3] if old else at, at)
                emit(aid, live[aid], True, at)
            checked = set(poll["checked"] or [])
            for aid in [a for a, v in live.items() if a not in fresh and v[0] in checked]:
                emit(aid, live.pop(aid), False, at)
        for aid in before.keys() - live.keys():
            self.live.removeKey((aid,))
        for aid, alert in live.items():
            if before.get(aid) != alert:
                self.live.updateValue((aid,), alert)
        self._wake(live)
        yield from out.values()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        live, now = {k[0]: tuple(v) for k, v in self.live.iterator()}, expiredTimerInfo.getExpiryTimeInMs() * 1000
        for aid in [a for a, v in live.items() if v[4] + self.lapse <= now]:
            source, severity, read, created, checked = live.pop(aid)
            self.live.removeKey((aid,))
            yield Row(user_id=key[0], alert_id=aid, source=source, severity=severity, active=False, read=read, created=created,
                      updated=checked + self.lapse, resolved=checked + self.lapse)
        self._wake(live)

    def _wake(self, live: dict) -> None:
        """One timer per user: when the alert confirmed longest ago lapses."""
        if self.lapse is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if live:
            self.handle.registerTimer(-(-(min(v[4] for v in live.values()) + self.lapse) // 1000))


def alert_state(polls: DataFrame, lapse: str | None = None, delay: str = "15 minutes") -> DataFrame:
    """Alert lifecycle per user: stable ids, ``read`` kept unless severity rises, gone alerts resolved where their source was checked.

    polls: user_id, t, checked array<string>, candidates array<struct<alert_id,source,severity>>, read_ids array<string>.
    With ``lapse`` (such as "6 hours") an alert that no poll confirmed for so long, by the watermark of ``t`` less ``delay``, is
    resolved by a timer at that moment; without it only a poll resolves. A micro-batch's polls of one user are sorted in memory;
    the source's rate limit bounds them. State lives in RocksDB (``build_session`` sets the provider).
    """
    if lapse:
        polls = polls.withWatermark("t", delay)
    slim = polls.select("user_id", *(["t"] if lapse else []), F.unix_micros("t").alias("at"), "checked", "candidates", "read_ids")
    span = int(pd.Timedelta(lapse).value // 1000) if lapse else None
    out = slim.groupBy("user_id").transformWithState(AlertLife(span), ALERT_OUT, "update", "EventTime" if lapse else "None")
    return out.select("user_id", "alert_id", "source", "severity", "active", "read",
                      *[F.timestamp_micros(c).alias(f"{c}_at") for c in ("created", "updated", "resolved")])


class Throttle(StatefulProcessor):
    """The last request let through. Once the watermark is an interval past it, it can hold nothing back and is forgotten."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, scenario string")

    def handleInputRows(self, key, rows, timerValues):
        at, scenario = tuple(self.last.get()) if self.last.exists() else (None, None)
        kept = []
        for r in sorted(rows, key=lambda r: r["at"]):
            if at is None or r["scenario"] != scenario or r["at"] - at >= self.gap:
                at, scenario = r["at"], r["scenario"]
                kept.append(Row(user_id=key[0], at=at, scenario=scenario))
        if kept:
            self.last.update((at, scenario))
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(-(-(at + self.gap) // 1000))
        yield from kept

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        yield from ()


def throttle(requests: DataFrame, seconds: int = ALERT_REFRESH_SECONDS, delay: str = "1 minute") -> DataFrame:
    """Rebuild requests let through: at most one per user and interval, or at once when the scenario changes.

    Requests later than ``delay`` are dropped; a user's state goes when the watermark has passed its interval.
    """
    slim = requests.withWatermark("t", delay).select("user_id", "t", F.unix_micros("t").alias("at"), "scenario")
    out = slim.groupBy("user_id").transformWithState(
        Throttle(seconds * 1_000_000), "user_id string, at bigint, scenario string", "append", "EventTime")
    return out.select("user_id", F.timestamp_micros("at").alias("t"), "scenario")
