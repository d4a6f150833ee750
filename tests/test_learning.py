"""Panels, history, metrics, cutoffs and models on hand-made rows."""
import datetime as d
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from highwater.functions import scoring as S, text as X
from highwater.operators import checks as C, layers as L, metrics as M, models as ML, panel as P, ranges as Q
from highwater.operators.serving import area_index
from highwater.settings import RAIN_FEATURES

DAY = lambda s: d.date.fromisoformat(s)


def weather(spark, start="2022-01-01", days=1000):
    first = DAY(start)
    return spark.createDataFrame([(first + d.timedelta(i), float((i * 7) % 30)) for i in range(days)], "date date, rain_mm double")


def segments(spark, n=40):
    rows = [(f"{i}_{i + 1}_0", f"{i}_{i + 1}_0", "city" if i % 2 else "county", i == 5, False, False, i % 4, 0.1 * i, 0.02 * i, 50.0 + i, float(i % 6)) for i in range(n)]
    rows.append(("1_0_0", "0_1_0", "county", False, False, False, 0, 0.0, 0.0, 50.0, 0.0))
    return spark.createDataFrame(rows, "edge_id string, street_id string, jurisdiction string, is_bridge boolean, is_tunnel boolean, elev_water_only boolean, "
                                       "fema_risk_level int, elev_p10 double, sink_p90 double, length double, drain_count double")


def test_rain_lags_exclude_today(spark):
    w = spark.createDataFrame([(DAY("2023-09-27") + d.timedelta(i), float(i + 1)) for i in range(7)], "date date, rain_mm double")
    r = {str(x["date"]): x for x in P.rain_lags(w).collect()}
    assert (r["2023-09-30"]["rain_mm"], r["2023-09-30"]["rain_lag1_mm"], r["2023-09-30"]["rain_prior3_mm"]) == (4, 3, 6)
    assert r["2023-09-29"]["rain_prior3_mm"] is None and r["2023-09-27"]["rain_lag1_mm"] is None


def test_weather_checks(spark):
    def bad(rows):
        df = spark.createDataFrame(rows, "date date, rain_mm double, unit string, zone string")
        return {r["check"] for r in C.check_weather(df).collect() if r["violations"]}
    ok = [(DAY("2023-09-27") + d.timedelta(i), 1.0, "mm", "America/New_York") for i in range(4)]
    assert bad(ok) == set()
    assert bad(ok[:1] + ok[2:]) == {"gaps"}
    assert bad([(*ok[0][:2], "inch", ok[0][3]), *ok[1:]]) == {"unit"}
    assert bad([(ok[0][0], None, *ok[0][2:]), *ok[1:]]) == {"bad_rain"}
    assert bad([ok[0], *ok]) == {"repeated_date"}


def test_horizon_checks(spark):
    def bad(days, stamp="a"):
        rows = [(i, DAY("2023-09-30") + d.timedelta(k), 1.0, 1.0, 1.0, stamp if i else "a") for i, k in enumerate(days)]
        return {r["check"] for r in C.check_horizon(spark.createDataFrame(rows, "seq int, date date, rain_mm double, rain_lag1_mm double, rain_prior3_mm double, updated_at string")).collect() if r["violations"]}
    assert bad([0, 1, 2]) == set() and bad([0, 2]) == {"not_consecutive"} and bad([0, 0]) == {"not_consecutive"}
    assert bad(range(8)) == {"length"} and bad([0, 1], "b") == {"retrievals"}


def test_baseline_unknown_is_half(spark):
    df = spark.createDataFrame([(None, None, None), (3.0, None, None), (3.0, 0.5, 1.0)], "fema_risk_level double, elev_p10 double, sink_p90 double")
    r = S.physical_baseline(df).collect()
    assert r[0]["physical"] == 0.5 and r[0]["coverage"] == 0 and r[1]["physical"] == 1.0 and abs(r[2]["coverage"] - 1) < 1e-12


def test_key_and_domain_checks(spark):
    s = segments(spark)
    assert {r["check"]: r["violations"] for r in C.check_keys(s.unionByName(s.limit(1)), "edge_id", ["length", "nope"]).collect()} == {
        "empty": 0, "missing_columns": 1, "null_key": 0, "repeated_key": 1}
    odd = s.withColumn("jurisdiction", F.when(F.col("edge_id") == "1_0_0", "city").otherwise(F.col("jurisdiction"))).withColumn("is_tunnel", F.when(F.col("edge_id") != "2_3_0", F.col("is_tunnel")))
    assert {r["check"]: r["violations"] for r in C.check_domains(odd, ["city"]).collect()} == {"unknown_jurisdiction": 20, "missing_flags": 1, "twins_disagree": 1}
    with pytest.raises(Exception, match="not unique"):
        C.join_checked(s, s.unionByName(s.limit(1)).select("edge_id", F.lit(1).alias("one")), "edge_id").collect()
    with pytest.raises(ValueError, match="already present"):
        L.join_layers(s, {"x": s.select("edge_id", "length")})


def test_scale_and_mean_edge_cases(spark):
    df = spark.createDataFrame([(None,), (2.0,), (4.0,)], "x double")
    assert [r[0] for r in df.select(S.scale01("x", 2.0, 4.0)).collect()] == [None, 0.0, 1.0]
    assert [r["s"] for r in L.scale_by_data(df.where("x = 2"), "x", "s").collect()] == [0.0]
    assert df.limit(1).select(S.weighted_mean({"x": 1.0})).first()[0] is None


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.one_of(st.none(), st.integers(0, 5))), min_size=1, max_size=30))
def test_pct_within_property(spark, rows):
    df = spark.createDataFrame([(i, g, v) for i, (g, v) in enumerate(rows)], "i int, g string, v int")
    for r in L.pct_within(df, "v", "g", "p").collect():
        if r["v"] is None:
            assert r["p"] is None
            continue
        pos = [v for g, v in rows if g == r["g"] and v]
        want = 0.0 if r["v"] == 0 else (sum(v < r["v"] for v in pos) + (sum(v == r["v"] for v in pos) + 1) / 2) / len(pos)
        assert abs(r["p"] - want) < 1e-12


@settings(max_examples=6, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=40))
def test_exact_quantiles_property(spark, values):
    import numpy as np
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["prob"]: r["q"] for r in Q.exact_quantiles(df, [], "v", [0.0, 0.1, 0.5, 0.9, 1.0]).collect()}
    assert all(abs(got[p] - np.quantile(values, p)) < 1e-9 for p in got) and len(got) == 5


def test_history_dates(spark):
    pos = spark.createDataFrame([("s", DAY("2023-01-01")), ("s", DAY("2023-06-25"))], "street_id string, date date")
    win = {"city": ("2022-10-01", "2024-08-09")}
    ask = lambda *days: spark.createDataFrame([("s", "city", DAY(x)) for x in days], "street_id string, jurisdiction string, date date")
    r = {str(x["date"]): x["report_rate"] for x in P.report_history(ask("2023-06-30", "2022-10-20", "2024-08-17"), pos, win).collect()}
    assert abs(r["2023-06-30"] - 1 / (265 / 365.25)) < 1e-12 and r["2022-10-20"] is None and abs(r["2024-08-17"] - 2 / (679 / 365.25)) < 1e-12
    frozen = P.report_history(ask("2024-08-17"), pos, win, freeze="2023-01-01").first()["report_rate"]
    assert frozen == 0


def reports(spark):
    rows = [("0_1_0", "2023-01-10", "flood", "city", "t1"), ("2_3_0", "2023-01-10", "flood", "city", "t1"), ("4_5_0", "2023-01-10", "flood", "city", "t1"),
            ("1_2_0", "2020-01-01", "flood", "city", "t2"), ("3_4_0", "2023-02-01", "drain", "city", "t3"), ("5_6_0", "2023-03-01", "flood", "city", "t4")]
    return spark.createDataFrame([(a, DAY(b), c, s, t) for a, b, c, s, t in rows], "edge_id string, date date, category string, source string, ticket_id string")


@pytest.fixture(scope="module")
def built(spark):
    w = P.rain_lags(weather(spark, "2021-12-20")).where("date >= '2022-01-01'")
    streets, pos, panel, audit = P.prepare_panel(segments(spark), reports(spark), w, 0.1)
    return streets, pos, panel.persist(), audit, w


def test_panel_statistics(built):
    streets, pos, panel, audit, _ = built
    a = audit.first()
    assert (a["flood_links"], a["outside_window_links"], a["bridge_links"]) == (5, 1, 1) and pos.count() == 3
    groups = {r["street_id"]: r["split_group"] for r in streets.collect()}
    assert groups["2_3_0"] == groups["4_5_0"] == groups["0_1_0"] == "0_1_0"
    assert panel.groupBy("street_id", "date").count().where("count > 1").isEmpty() and panel.where("is_bridge").isEmpty()
    used = streets.where("not is_bridge")
    n = {(r["jurisdiction"], r["heldout_street"]): r["count"] for r in used.groupBy("jurisdiction", "heldout_street").count().collect()}
    days = {"city": 679, "county": 730}
    late = {"city": 314, "county": 92}
    want = sum(c * (late[j] if h else days[j]) for (j, h), c in n.items())
    assert abs(panel.agg(F.sum("sample_weight")).first()[0] - want) < 1e-6
    assert {r["check"] for r in C.audit_splits(panel, "2023-06-30", "2023-09-30").collect() if r["violations"]} == set()


def test_labels_never_reach_features(built):
    _, _, panel, _, _ = built
    flipped = panel.withColumns({"target": 1 - F.col("target"), "sample_weight": F.lit(9.0)})
    cols = ["street_id", "date", *ML.MODEL_FEATURES]
    a, b = (S.model_features(x).select(*cols).where("street_id = '7_8_0'").orderBy("date").collect() for x in (panel, flipped))
    assert a == b and a


def test_missing_weather_stops(spark):
    days = spark.createDataFrame([(DAY("2022-01-01"),)], "date date")
    w = spark.createDataFrame([(DAY("2022-01-02"), 1.0, 1.0, 1.0)], "date date, rain_mm double, rain_lag1_mm double, rain_prior3_mm double")
    with pytest.raises(Exception, match="no weather"):
        P.add_weather(days, w).collect()


# ------------------------------------------------------------------ thresholds
def preds(spark, y, p, w=None):
    return spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, p, w or [1] * len(y))], "target int, p double, w double")


def test_undo_prior(spark):
    assert [round(r[0], 12) for r in preds(spark, [0, 1], [.5, .9]).select(F.round(S.undo_prior("p", 9.0), 12)).collect()] == [.1, .5]


def test_budget_ties(spark):
    assert M.budget_cutoff(preds(spark, [0] * 4, [.9, .8, .8, .1]), .5).first()[0] == .9
    assert M.budget_cutoff(preds(spark, [0] * 4, [1.0] * 4), .5).first()[0] > 1
    with pytest.raises(Exception, match="outside"):
        M.budget_cutoff(preds(spark, [0], [1.5]), .5).collect()


def test_f2_prefers_the_higher_cutoff(spark):
    got = M.f2_cutoff(preds(spark, [1, 0, 0, 1], [.9, .8, .3, .2], [10, 1, 30, 1])).first()["cutoff"]
    assert got == .9


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 8), st.integers(1, 4)), min_size=2, max_size=30))
def test_metrics_property(spark, rows):
    pr = preds(spark, [a for a, _, _ in rows], [b / 8 for _, b, _ in rows], [c for _, _, c in rows])
    m = M.metrics(pr).first()
    pos = [(b, w) for y, b, w in rows if y]
    neg = [(b, w) for y, b, w in rows if not y]
    if not pos or not neg:
        assert m["roc_auc"] is None and m["average_precision"] is None
        return
    p_w, n_w = sum(w for _, w in pos), sum(w for _, w in neg)
    auc = sum(wp * wn * ((bp > bn) + (bp == bn) / 2) for bp, wp in pos for bn, wn in neg) / (p_w * n_w)
    ap, before = 0.0, 0.0
    for t in sorted({b for _, b, _ in rows}, reverse=True):
        tp, fp = sum(w for b, w in pos if b >= t), sum(w for b, w in neg if b >= t)
        ap, before = ap + (tp - before) / p_w * tp / (tp + fp), tp
    assert abs(m["roc_auc"] - auc) < 1e-9 and abs(m["average_precision"] - ap) < 1e-9


def test_confusion_null_precision(spark):
    m = M.confusion(preds(spark, [1, 0], [.1, .2]), 0.9).first()
    assert m["precision"] is None and m["recall"] == 0 and m["tn"] == 1 and m["accuracy"] == .5


def test_labels(spark):
    df = spark.createDataFrame([(.002,), (.001,), (.0006,), (.0004,), (None,)], "p double")
    assert [r[0] for r in df.select(S.alert_label("p", .001)).collect()] == ["high", "high", "medium", "low", None]


def test_relative_score_ties_and_ends(spark):
    knots = spark.createDataFrame([(0, .1), (1, .2), (2, .2), (3, .2), (4, .5)], "k int, p double")
    x = spark.createDataFrame([(.05,), (.1,), (.15,), (.2,), (.35,), (.5,), (.6,), (None,)], "p double")
    got = [r["relative"] for r in M.relative_score(x, knots).collect()]
    assert [None if v is None else round(v, 9) for v in got] == [0, 0, .25, .5, .75, 1, 1, None]


# ------------------------------------------------------------------ models
@pytest.fixture(scope="module")
def learned(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        rain, elev = rnd.uniform(0, 60), rnd.uniform(0, 5)
        y = int(rnd.random() < (0.02 + 0.9 * (rain > 40) * (elev < 2)))
        rows.append((f"s{i % 60}", DAY("2023-01-01") + d.timedelta(i // 6), y, 1.0 if y else 2.0, float(i % 3 + 1), elev if i % 9 else None, .3, 100.0, 2.0, 0.0,
                     "city" if i % 2 else "county", rain, rain / 2, rain, rnd.random() if i % 5 else None))
    return spark.createDataFrame(rows, "street_id string, date date, target int, sample_weight double, fema_risk_level double, elev_p10 double, sink_p90 double, length double, "
                                       "drain_count double, is_tunnel double, jurisdiction string, rain_mm double, rain_lag1_mm double, rain_prior3_mm double, report_rate double").persist()


@pytest.mark.parametrize("name", ["logistic", "gradient_boosting", "balanced_boosting"])
def test_models_beat_the_constant(learned, name):
    model = ML.fit(name, learned, 15)
    m = M.metrics(model.predict(learned), "target", "p", "sample_weight").first()
    assert m["roc_auc"] > 0.75 and m["average_precision"] > 2 * m["prevalence"]
    assert set(model.indicators) == {"elev_p10", "log_report_rate"}
    assert (model.multiplier > 1) == (name == "balanced_boosting")


def test_fit_needs_both_classes(learned):
    with pytest.raises(ValueError):
        ML.fit("logistic", learned.where("target = 0"))


def test_rolling_selection_uses_the_past(learned):
    model, m, winner = ML.select_and_refit(learned, ("logistic",), [("2023-02-10", "2023-02-11", "2023-03-05"), ("2023-03-05", "2023-03-06", "2023-04-05")])
    assert winner["candidate"] == model.name == "logistic" and m.count() == 2


def test_alert_policy(learned):
    best = ML.fit_alert_policy(learned, learned, 0.1, ("logistic", "balanced_boosting"), 5)
    n = learned.count()
    assert best["metrics"]["tp"] + best["metrics"]["fp"] <= n * 0.1 and best["rank"][0] > 0


@pytest.fixture(scope="module")
def bundle(learned, built):
    model = ML.fit("logistic", learned)
    pos = built[1]
    return ML.make_bundle(model, learned, pos, alert_model=model, alert_cutoff=0.3, created_at="2024-01-01")


def wx(spark, *rows):
    return spark.createDataFrame([(DAY(a), b, c, e, "test", "2026-03-07T12:00:00Z") for a, b, c, e in rows],
                                 "date date, rain_mm double, rain_lag1_mm double, rain_prior3_mm double, source string, updated_at string")


def test_serving_contract(spark, bundle):
    s = segments(spark)
    dry = ML.score_segments(s, bundle, wx(spark, ("2026-03-08", 0.0, 0.0, 0.0))).persist()
    wet = ML.score_segments(s, bundle, wx(spark, ("2026-03-08", 59.0, 20.0, 40.0)))
    assert dry.count() == 41 and {r["check"] for r in C.audit_scores(dry, s).collect() if r["violations"]} == set()
    b = dry.where("edge_id = '5_6_0'").first()
    assert b["report_alert"] is None and b["risk_score"] <= 0.1 and b["score_source"] == "bridge_policy_fallback"
    one = dry.first()
    assert one["valid_from"] == "2026-03-08T00:00:00-05:00" and one["valid_to"] == "2026-03-09T00:00:00-04:00"
    r = C.scenario_response(dry, wet).first()
    assert r["up"] > r["down"] and r["wet_median"] > r["dry_median"]


@pytest.mark.parametrize("rain", [(-1.0, 0.0, 0.0), (1.0, 5.0, 3.0), (float("nan"), 0.0, 0.0)])
def test_bad_rain_stops(spark, bundle, rain):
    with pytest.raises(Exception, match="bad weather"):
        ML.score_segments(segments(spark), bundle, wx(spark, ("2026-03-08", *rain))).collect()


def test_horizon_area_index(spark, bundle):
    s = segments(spark)
    scored = ML.score_segments(s, bundle, wx(spark, ("2026-03-08", 10.0, 1.0, 2.0), ("2026-03-09", 80.0, 10.0, 12.0)))
    rows = {str(r["forecast_date"]): r for r in area_index(scored, L.street_table(s)).collect()}
    assert len(rows) == 2 and rows["2026-03-08"]["total_streets"] == 40 and rows["2026-03-08"]["fallback_streets"] == 1
    assert not rows["2026-03-08"]["out_of_range"] and rows["2026-03-09"]["out_of_range"]


def test_horizon_job(spark, bundle):
    s = segments(spark)
    good = wx(spark, ("2026-03-09", 80.0, 10.0, 12.0), ("2026-03-08", 10.0, 1.0, 2.0))
    scores, summary = ML.predict_horizon(s, bundle, good)
    rows = {str(r["forecast_date"]): r for r in summary.collect()}
    assert scores.count() == 2 * s.count() and sorted(rows) == ["2026-03-08", "2026-03-09"]
    r = rows["2026-03-09"]
    assert r["total_streets"] == 40 and r["flood_probability_estimate"] is None and r["prediction_target"] == "recorded_flood_report"
    assert r["weather_updated_at"] == "2026-03-07T12:00:00Z" and r["valid_from"] < r["valid_to"] and r["out_of_range"]
    a, b = ("2026-03-08", 10.0, 1.0, 2.0), ("2026-03-10", 10.0, 1.0, 2.0)
    late = good.withColumn("updated_at", F.date_format("date", "dd"))
    backwards = good.withColumn("seq", F.datediff(F.lit("2026-04-01").cast("date"), "date"))
    for bad, why in ((wx(spark, a, a), "not_consecutive"), (wx(spark, a, b), "not_consecutive"), (good.limit(0), "length"), (late, "retrievals"),
                     (backwards, "not_consecutive"), (wx(spark, *[(f"2026-03-{i:02}", 1.0, 0.0, 0.0) for i in range(1, 9)]), "length")):
        with pytest.raises(ValueError, match=why):
            ML.predict_horizon(s, bundle, bad)
    with pytest.raises(ValueError, match="twice"):
        ML.predict_horizon(s.unionByName(s), bundle, good)


def test_model_metadata(spark, learned, bundle):
    p = learned.withColumn("split", F.when(F.col("date") < "2023-03-01", "train").otherwise("validation"))
    m = M.metrics(bundle.model.predict(learned), "target", "p", "sample_weight").withColumn("population", F.lit("future"))
    v = spark.createDataFrame([("logistic", i, 0.5 + i, 0.7) for i in (1, 0)], "candidate string, window int, average_precision double, roc_auc double")
    r = ML.model_metadata(p, {"b": learned.select("target"), "a": learned.select("date")}, "logistic", v, m, "2024-01-01 00:00:00").collect()
    assert len(r) == 1 and sorted(r[0]["data_fingerprints"]) == ["a", "b"] and len(r[0]["data_fingerprints"]["a"]) == 64
    assert [(x["split"], x["rows"]) for x in r[0]["splits"]] == [(k, p.where(F.col("split") == k).count()) for k in ("train", "validation")]
    assert [x["window"] for x in r[0]["validation"]] == [0, 1] and r[0]["tests"][0]["population"] == "future"


def test_run_rows(spark, bundle):
    run, scores = ML.build_run("storm", segments(spark), bundle, wx(spark, ("2026-09-26", 80.0, 30.0, 60.0)), "2026-09-26 13:05:00")
    r = run.first()
    assert r["run_id"] == "2026-09-26T13:05Z-storm" and r["streets_scored"] == 40 == scores.count() and r["labels"]["none"] == 1 and sum(r["labels"]) == 40
    assert r["label_rule"]["medium_at"] == 0.15 and r["out_of_range"]


def test_full_population_scored_once(built, bundle):
    streets, pos, _, _, w = built
    pop = ML.population(streets, pos, w, False, "2023-12-01", "2023-12-10")
    pred, m = ML.evaluate_population(pop, bundle.model, 0.01)
    n = streets.where("not is_bridge and not heldout_street").count()
    assert pred.count() == n * 10 == pred.select("street_id", "date").distinct().count()
    assert {r["scorer"] for r in m.where("group = 'overall'").collect()} == {"model", "physical_baseline", "constant_baseline"}


def test_fingerprint_ignores_order(spark):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    a, b, c = (ML.fingerprint({"t": x}).first()["fingerprint"] for x in (df, df.orderBy(F.desc("id")).repartition(3), df.where("id < 49")))
    assert a == b != c and RAIN_FEATURES
