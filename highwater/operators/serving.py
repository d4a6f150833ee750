"""Risk as served: runs, labels, closures, maps, parking hazard, reports."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from highwater.functions.geometry import envelope, segment_hits_box
from highwater.functions.scoring import cutoff_label, label_rank, lot_hazard, weighted_mean_of, scale01
from highwater.functions.text import traffic_delay
from highwater.operators.checks import active_at
from highwater.operators.spatial import _cell, line_segments, segment_cells
from highwater.settings import (LABELS, MAP_LIMIT, PARKING_RANGE, PARKING_WEIGHTS, RISK_HIGH, RISK_MEDIUM,
                                RUN_STALE_HOURS)


def scenario_scores(segments: DataFrame, scenario: str) -> DataFrame:
    """Scores derived from the static one when there is no model run: dry scales down, storm pushes up. No labels."""
    streets = segments.groupBy("street_id").agg(F.min_by("risk_score", "edge_id").alias("s"))
    score = F.col("s") * 0.4 if scenario == "live" else F.pow("s", F.lit(0.6))
    return streets.select("street_id", score.alias("risk_score"), F.lit(None).cast("string").alias("risk_label"))


def current_run(runs: DataFrame, now, max_age_hours: float = RUN_STALE_HOURS) -> DataFrame:
    """Newest run per scenario; a live run older than the limit is stale, a storm run never."""
    now = now if isinstance(now, Column) else F.lit(now).cast("timestamp")
    rest = [c for c in runs.columns if c != "scenario"]
    newest = runs.groupBy("scenario").agg(F.max_by(F.struct(*rest), "computed_at").alias("r")).select("scenario", "r.*")
    age = F.unix_seconds(now) - F.unix_seconds(F.col("computed_at").cast("timestamp"))
    return newest.withColumn("stale", (F.col("scenario") == "live") & (age > max_age_hours * 3600))


def spread_to_edges(run_scores: DataFrame, segments: DataFrame) -> DataFrame:
    """Street scores onto both directions; a street the run skipped keeps its static score."""
    s = run_scores.select("street_id", F.col("risk_score").alias("_run"), F.col("risk_label").alias("_label"))
    return segments.join(s, "street_id", "left").withColumn("score", F.coalesce("_run", "risk_score"))


def effective_risk(segments: DataFrame, run_scores: DataFrame) -> DataFrame:
    """edge_id, score, label: the run's label when it is one of ours, else by cutoffs."""
    e = spread_to_edges(run_scores, segments)
    label = F.coalesce(F.when(F.col("_label").isin(LABELS), F.col("_label")), cutoff_label("score"))
    return e.select("edge_id", "street_id", "score", label.alias("label"))


def label_counts(scores: DataFrame) -> DataFrame:
    """Streets per label and run, unlabelled ones as ``none``."""
    label = F.coalesce("risk_label", F.lit("none"))
    return scores.groupBy("run_id").agg(*[F.count_if(label == x).alias(x) for x in [*LABELS, "none"]],
                                        F.count(F.lit(1)).alias("streets_scored"))


def closure_flags(edges: DataFrame, closures: DataFrame, t) -> DataFrame:
    """Edges with ``closed`` and ``slowed`` at time t."""
    flags = active_at(closures, t).groupBy("edge_id").agg(F.max("full_closure").alias("closed"),
                                                          F.max(~F.col("full_closure")).alias("slowed"))
    return edges.join(flags, "edge_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("closed", "slowed")})


def closure_summary(links: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """Distinct closures, distinct edges and kilometres per group."""
    km = links.join(edges.select("edge_id", "length"), "edge_id")
    pairs = km.groupBy(*by).agg(F.sum("length").alias("_m"), F.count(F.lit(1)).alias("links"))
    closures = km.select(*by, "closure_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("closures"))
    edges_n = km.select(*by, "edge_id").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("edges"))
    out = pairs.join(edges_n, by).join(closures, by) if by != ["closure_id"] else pairs.join(edges_n, by).withColumn("closures", F.lit(1).cast("bigint"))
    return out.select(*by, "closures", "edges", "links", (F.col("_m") / 1000.0).alias("km"))


def report_counts(reports: DataFrame, links: DataFrame) -> DataFrame:
    """Per source, category, type: reports in the box, reports snapped, distinct dates of snapped ones."""
    keys = ["source", "category", "type"]
    snapped = links.select("ticket_id").distinct().withColumn("_s", F.lit(True))
    tickets = reports.select(*keys, "ticket_id", "date").join(snapped, "ticket_id", "left")
    per_date = tickets.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("_n"), F.count_if("_s").alias("_sn"))
    return per_date.groupBy(*keys).agg(F.sum("_n").cast("bigint").alias("in_box"), F.sum("_sn").cast("bigint").alias("snapped"),
                                       F.count_if(F.col("_sn") > 0).alias("distinct_dates"))


def source_crosscheck(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Unique reports by their source and the jurisdiction of the edge they were snapped to (first edge by id)."""
    j = links.join(edges.select("edge_id", "jurisdiction"), "edge_id")
    one = j.groupBy("source", "ticket_id").agg(F.min_by("jurisdiction", "edge_id").alias("jurisdiction"))
    return one.groupBy("source").agg(*[F.count_if(F.col("jurisdiction") == x).alias(x) for x in ("city", "county")])


def map_box(streets: DataFrame, risk: DataFrame, boxes: DataFrame, closed_streets: DataFrame, limit: int = MAP_LIMIT,
            base: float = 400.0) -> DataFrame:
    """Streets that meet each box with at least its minimum label, riskiest first, at most ``limit`` per box.

    boxes: box_id, x0, y0, x1, y1, min_label. Adds ``truncated`` and ``closed``. Boxes sit on the grid level of their
    own size; the limit is a per-group top-k, which Spark applies before the shuffle.
    """
    size = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(float(base)))
    b = boxes.withColumn("level", F.ceil(F.log2(size / base)).cast("int"))
    levels = b.agg(F.sort_array(F.collect_set("level"))).scalar()
    side = F.lit(float(base)) * F.pow(F.lit(2.0), F.col("level"))
    b = (b.withColumn("cx", F.explode(F.sequence(_cell(F.col("x0"), side), _cell(F.col("x1"), side))))
         .withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), side), _cell(F.col("y1"), side)))))
    segs = line_segments(streets, ["edge_id"]).select("*", levels.alias("_l")).withColumn("level", F.explode("_l")).drop("_l")
    cells = segment_cells(segs, side, 0.0)
    hits = cells.join(b, ["level", "cx", "cy"]).where(segment_hits_box(
        *[F.col(c) for c in ("ax", "ay", "bx", "by", "x0", "y0", "x1", "y1")])).select("box_id", "edge_id", "min_label").distinct()
    rated = (hits.join(risk.select("edge_id", "street_id", "score", "label"), "edge_id")
             .withColumn("_rank", label_rank("label")).where(F.col("_rank") >= label_rank("min_label")))
    totals = rated.groupBy("box_id").agg((F.count(F.lit(1)) > limit).alias("truncated"))
    order = Window.partitionBy("box_id").orderBy(F.desc("_rank"), F.desc("score"), "edge_id")
    top = rated.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)
    return (top.join(totals, "box_id").join(closed_streets.select("street_id", F.lit(True).alias("_c")).distinct(), "street_id", "left")
            .select("box_id", "position", "edge_id", "score", "label", F.coalesce("_c", F.lit(False)).alias("closed"), "truncated"))


# ------------------------------------------------------------------ parking
def parking_score(lots: DataFrame) -> DataFrame:
    """Weighted mean of the fixed-range parts a lot has; higher is worse."""
    parts = {c: scale01(c, lo, hi) for c, (lo, hi) in PARKING_RANGE.items() if c in lots.columns}
    return lots.withColumn("parking_score", weighted_mean_of(parts, PARKING_WEIGHTS))


def rate_lots(lots: DataFrame, level: Column) -> DataFrame:
    hazard, label = lot_hazard("score", level)
    return lots.withColumns({"hazard": F.bround(hazard, 3), "hazard_label": cutoff_label(hazard, RISK_MEDIUM, RISK_HIGH)})


# ------------------------------------------------------------------ closures feed
def inside_box(df: DataFrame, geom: str, bbox) -> DataFrame:
    """Rows whose line meets an axis-parallel box (a single point counts as a line of no length)."""
    w, s, e, n = (F.lit(float(v)) for v in bbox)
    env = envelope(geom)
    g = F.col(geom)
    one = F.size(geom) == 1
    hit = F.exists(F.zip_with(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(1))), F.slice(g, F.when(one, 1).otherwise(2), F.greatest(F.size(g) - 1, F.lit(1))),
                              lambda a, b: F.struct(a.alias("a"), b.alias("b"))),
                   lambda q: segment_hits_box(q["a"]["x"], q["a"]["y"], q["b"]["x"], q["b"]["y"], w, s, e, n))
    return df.where((env["x0"] <= e) & (env["x1"] >= w) & (env["y0"] <= n) & (env["y1"] >= s) & hit)


# ------------------------------------------------------------------ live conditions
def nearest_in_time(obs: DataFrame, pred: DataFrame, max_gap_min: int = 6) -> DataFrame:
    """Each observation with the closest prediction at most max_gap_min away (earlier one on a tie).

    Time is cut into buckets as long as the gap, so only neighbouring buckets meet.
    obs: key, t, v. pred: key, t, v.
    """
    width = max_gap_min * 60
    bucket = lambda c: F.floor(F.unix_seconds(c) / width)
    p = pred.select("key", F.col("t").alias("pred_t"), F.col("v").alias("predicted"),
                    F.explode(F.array(*[bucket(F.col("t")) + i for i in (-1, 0, 1)])).alias("_b"))
    gap = F.abs(F.unix_seconds("pred_t") - F.unix_seconds("t"))
    near = obs.withColumn("_b", bucket(F.col("t"))).join(p, ["key", "_b"]).where(gap <= width)
    best = near.groupBy("key", "t").agg(F.min(F.struct(gap.alias("gap"), "pred_t", "predicted")).alias("b"))
    return obs.join(best, ["key", "t"], "left").select(*obs.columns, "b.pred_t", "b.predicted", F.col("b.gap").alias("gap_s"))


def tide_peak(requests: DataFrame, pred: DataFrame, obs: DataFrame, levels: DataFrame, window_min: int = 60,
              stale_min: int = 30, max_gap_min: int = 6) -> DataFrame:
    """Expected peak around each request: the highest prediction within the window plus the current anomaly.

    requests: req_id, key, at, now. pred and obs: key, t, v. levels: key, minor, moderate. A missing or stale
    observation means no anomaly; no cover or no level gives ``status`` 'unavailable'.
    """
    width = window_min * 60
    bucket = lambda c: F.floor(F.unix_seconds(c) / width)
    ask = requests.withColumn("_b", F.explode(F.array(*[bucket(F.col("at")) + i for i in (-1, 0, 1)])))
    p = pred.select("key", F.col("t").alias("pt"), F.col("v").alias("pv"), bucket(F.col("t")).alias("_b"))
    peak = ask.join(p, ["key", "_b"]).where(F.abs(F.unix_seconds("pt") - F.unix_seconds("at")) <= width) \
        .groupBy("req_id").agg(F.max("pv").alias("predicted_peak"))
    matched = nearest_in_time(obs, pred, max_gap_min)
    last = matched.groupBy("key").agg(F.max_by(F.struct("t", "v", "predicted"), "t").alias("o"))
    j = requests.join(peak, "req_id", "left").join(last, "key", "left").join(levels, "key", "left")
    fresh = (F.unix_seconds("now") - F.unix_seconds("o.t")) <= stale_min * 60
    anomaly = F.when(fresh, F.col("o.v") - F.col("o.predicted"))
    j = j.withColumn("anomaly", anomaly).withColumn("expected_peak", F.col("predicted_peak") + F.coalesce("anomaly", F.lit(0.0)))
    ok = F.col("predicted_peak").isNotNull() & F.col("minor").isNotNull()
    return j.select("req_id", "key", "predicted_peak", "anomaly", "expected_peak", (F.col("minor") - F.col("expected_peak")).alias("margin"),
                    (F.col("expected_peak") >= F.col("minor")).alias("above_minor"),
                    F.coalesce(F.col("expected_peak") >= F.col("moderate"), F.lit(False)).alias("above_moderate"),
                    F.when(ok, "ok").otherwise("unavailable").alias("status"))


def rain_sums(requests: DataFrame, quarters: DataFrame, trip_min: int = 60) -> DataFrame:
    """Rain in the two hours before now, until departure, during the trip, and the worst quarter hour.

    A quarter hour's value covers the fifteen minutes that end at its time; a window missing any of its quarters is null.
    requests: req_id, key, now, depart. quarters: key, t, mm.
    """
    q = 900
    end = F.unix_seconds("depart") + trip_min * 60
    start = F.unix_seconds("now") - 7200
    ask = requests.withColumn("_q", F.explode(F.sequence(F.floor(start / q) + 1, F.floor(end / q))))
    m = ask.join(quarters.select("key", (F.unix_seconds("t") / q).cast("bigint").alias("_q"), "mm"), ["key", "_q"], "left")
    t, now, dep = F.col("_q") * q, F.unix_seconds("now"), F.unix_seconds("depart")

    def total(lo, hi):
        inside = (t > lo) & (t <= hi)
        n, known = F.count_if(inside), F.count_if(inside & F.col("mm").isNotNull())
        return F.when(n == known, F.coalesce(F.sum(F.when(inside, F.col("mm"))), F.lit(0.0)))

    return m.groupBy("req_id").agg(
        total(now - 7200, now).alias("past_2h_mm"), total(now, dep).alias("before_departure_mm"),
        total(dep, dep + trip_min * 60).alias("during_trip_mm"),
        F.when(F.count_if(F.col("mm").isNull()) == 0, F.max("mm")).alias("max_15min_mm"))


def with_traffic(routes: DataFrame, answers: DataFrame) -> DataFrame:
    """Traffic answers onto routes; without one the free-flow time stands. answers: route_id, traffic_s, no_traffic_s, incident_s, live."""
    j = routes.join(answers, "route_id", "left")
    have = F.col("traffic_s").isNotNull()
    return j.select(*routes.columns, F.coalesce("traffic_s", "free_flow_s").alias("seconds"),
                    F.when(have, traffic_delay("traffic_s", "no_traffic_s", "incident_s")).alias("delay_s"),
                    F.when(have & F.col("live"), "live_traffic").when(have, "predicted_traffic").otherwise("free_flow").alias("eta_source"))


def area_index(scores: DataFrame, streets: DataFrame) -> DataFrame:
    """One row per forecast day: length-weighted mean score of modelled streets, each street once."""
    once = scores.groupBy("forecast_date", "street_id").agg(
        F.min_by(F.struct("risk_score", "score_source", "out_of_range"), "edge_id").alias("s")).select("forecast_date", "street_id", "s.*")
    j = once.join(streets.select("street_id", "length"), "street_id", "left")
    modelled = F.col("score_source") == "model_reference_percentile"
    usable = modelled & (F.col("length") > 0)
    w = F.when(usable, F.col("length"))
    return j.groupBy("forecast_date").agg(
        (F.sum(w * F.col("risk_score")) / F.sum(w)).alias("relative_risk_index"), F.count_if(modelled).alias("modelled_streets"),
        F.count_if(~modelled).alias("fallback_streets"), F.count_if(usable).alias("streets_in_index"),
        F.count(F.lit(1)).alias("total_streets"), F.coalesce(F.sum(w), F.lit(0.0)).alias("modelled_length_m"),
        F.max("out_of_range").alias("out_of_range"))
