"""Panels lay out days after the joins: street-days are neither joined nor sorted."""
import datetime as dt

from pyspark.sql import functions as F

from highwater.operators import panel as P

WINDOWS = {"city": ("2024-01-01", "2024-01-20")}
day = lambda n: dt.date(2024, 1, n)


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _streets(spark, ids):
    return spark.createDataFrame([(i, "city", False, i % 2 == 0 if i is not None else False) for i in ids],
                                 "street_id long, jurisdiction string, is_bridge boolean, heldout_street boolean")


def test_days_are_laid_out_after_the_join(spark):
    positives = spark.createDataFrame([(1, day(3)), (1, day(3)), (2, day(9)), (None, day(4))], "street_id long, date date")
    el = P.eligible_days(_streets(spark, [1, 2, 2, 3, None]), positives, WINDOWS)
    plan = _optimized(el)
    assert plan.index("Generate") < plan.index("Join")  # printed from the top down
    hits = {(r["street_id"], r["date"].day, r["count"]) for r in el.where("target = 1").groupBy("street_id", "date").count().collect()}
    assert hits == {(1, 3, 1), (2, 9, 2)} and el.count() == 100


def test_history_counts_without_an_order(spark):
    positives = spark.createDataFrame([(1, day(3)), (1, day(3)), (1, day(6)), (None, day(4)), (2, None), (1, None)], "street_id long, date date")
    told = P.with_report_days(_streets(spark, [1, 2, 3, None]), positives)
    h = P.report_history(P.street_days(told, WINDOWS), positives, WINDOWS, gap=2, min_days=3, freeze="2024-01-08")
    plan = _optimized(h)
    assert "Window" not in plan and plan.index("Generate") < plan.index("Join")
    facts = {1: [None, 3, 6], 2: [None], 3: [], None: [4]}
    for r in h.collect():
        until = min(r["date"].day - 2, 8)
        seen = sum(d is None or d < until for d in facts[r["street_id"]])
        want = seen / ((until - 1) / 365.25) if until - 1 >= 3 else None
        assert (r["report_rate"] is None) == (want is None) and (want is None or abs(r["report_rate"] - want) < 1e-9)


def test_only_the_boundary_of_a_sample_is_ordered(spark):
    panel = spark.range(4000).select(F.col("id").alias("street_id"), F.lit(day(5)).alias("date"), (F.col("id") % 100 == 0).cast("int").alias("target"),
                                     (F.col("id") % 2).alias("s"))
    s = P.sample_negatives(panel, 0.25, ["s"])
    plan = _optimized(s)
    assert "Union" in plan and plan.count("Window") == 1 and plan.index("Union") < plan.index("Window")
    assert s.where("target = 1").count() == 40
    import hashlib
    for half, n in ((0, 1960), (1, 2000)):
        ids = [i for i in range(4000) if i % 2 == half and i % 100]
        want = sorted(ids, key=lambda i: (int(hashlib.sha256(f"42:{i}:2024-01-05".encode()).hexdigest()[:8], 16), i))[:-(-n // 4)]
        got = s.where(f"target = 0 and s = {half}").collect()
        assert sorted(r["street_id"] for r in got) == sorted(want) and {r["sample_weight"] for r in got} == {n / len(want)}


def test_what_belongs_to_a_day_is_worked_out_once(spark):
    from highwater.operators import models as ML
    calls = []

    class Half:
        def predict(self, panel, out="p"):
            calls.append(out)
            return panel.withColumn(out, F.lit(0.5))

    segments = spark.createDataFrame([("a", "a", 1, 2.0, 0.1, 50.0, 1.0, False, False, False, "city"), ("b", "a", 1, 2.0, 0.1, 50.0, 1.0, False, False, False, "city")],
                                     "edge_id string, street_id string, fema_risk_level int, elev_p10 double, sink_p90 double, length double, drain_count double, "
                                     "is_tunnel boolean, is_bridge boolean, elev_water_only boolean, jurisdiction string")
    days = spark.createDataFrame([(day(9), 1.0, 0.0, 0.0, "f", "u")], "date date, rain_mm double, rain_lag1_mm double, rain_prior3_mm double, source string, updated_at string")
    model = Half()
    knots = spark.createDataFrame([(0, 0.0), (1, 1.0)], "k int, p double")
    history = spark.createDataFrame([("a", day(3))], "street_id string, date date")
    b = ML.Bundle(model=model, reference=knots, history=history, weather_max={"rain_mm": 5.0, "rain_lag1_mm": 5.0, "rain_prior3_mm": 5.0}, alert_model=model,
                  alert_cutoff=0.4, windows=WINDOWS, gap=3, min_days=2)
    scored = ML.score_segments(segments, b, days)
    plan = _optimized(scored)
    assert len(calls) == 1 and "from_utc_timestamp" not in plan[:plan.index("Generate")]  # printed from the top down
    assert [(r["edge_id"], r["alert_probability"], r["report_alert"], r["valid_from"], r["valid_to"]) for r in scored.orderBy("edge_id").collect()] == [
        (e, 0.5, True, "2024-01-09T00:00:00-05:00", "2024-01-10T00:00:00-05:00") for e in "ab"]
    ML.score_segments(segments, ML.Bundle(**{**b.__dict__, "alert_model": Half()}), days)
    assert len(calls) == 3
