"""Registered queries: panels, history, sampling, metrics, cutoffs, components, model jobs."""
from pyspark.sql import functions as F

from highwater.functions import scoring as S, text as X
from highwater.operators import graph as N, metrics as M, models as ML, panel as P
from highwater.operators.layers import street_table
from highwater.plans.registry import query, r6, text
from highwater.session import cut_lineage, stored

WINDOWS = {"city": ("2024-01-01", "2024-01-30"), "county": ("2024-01-05", "2024-01-25")}
BOUNDS = {"train_end": "2024-01-18", "validation_end": "2024-01-23"}
LIMITS = {"gap": 3, "min_days": 5}

START = "case jurisdiction when 'city' then date '2024-01-01' else date '2024-01-05' end"
END = "case jurisdiction when 'city' then date '2024-01-30' else date '2024-01-25' end"
DAYS = f"days as (select s.*, cast(unnest(generate_series({START}, {END}, interval 1 day)) as date) as date from fx_street s)"
HELD = "('0x' || substr(sha256('42:' || {g}), 1, 8))::ubigint % 5 = 0"


def rate(alias: str, cutoff: str, positives: str = "fx_positive") -> str:
    """SQL: report-days per year before a cutoff, by brute force."""
    days = f"date_diff('day', case {alias}.jurisdiction when 'city' then date '2024-01-01' else date '2024-01-05' end, least(case {alias}.jurisdiction when 'city' then date '2024-01-31' else date '2024-01-26' end, cast({cutoff} as date)))"
    return f"case when {days} >= 5 then (select count(*) from {positives} f where f.street_id = {alias}.street_id and f.date < {cutoff}) / ({days} / 365.25e0) end"


def streets(T):
    return T.fx_street.withColumn("heldout_street", X.held_out("street_id")).withColumn("split_group", F.col("street_id"))


@query("j11_street_days", f"with {DAYS} select street_id, cast(date as varchar) as date from days")
def _(T):
    return text(P.street_days(T.fx_street, WINDOWS).select("street_id", "date"), "date")


@query("w1_rain_lags", """select cast(date as varchar) as date, round(rain_mm, 6) as rain_mm, round(lag(rain_mm) over (order by date), 6) as rain_lag1_mm,
  round(case when count(rain_mm) over (order by date rows between 3 preceding and 1 preceding) = 3 then sum(rain_mm) over (order by date rows between 3 preceding and 1 preceding) end, 6) as rain_prior3_mm from fx_weather_raw""")
def _(T):
    return text(r6(P.rain_lags(T.fx_weather_raw)), "date")


@query("j12_add_weather", f"with {DAYS} select street_id, cast(d.date as varchar) as date, round(rain_mm, 6) as rain_mm, round(rain_prior3_mm, 6) as rain_prior3_mm from days d join fx_weather w on w.date = d.date")
def _(T):
    p = P.add_weather(P.street_days(T.fx_street, WINDOWS), T.fx_weather)
    return text(r6(p.select("street_id", "date", "rain_mm", "rain_prior3_mm")), "date")


@query("j13_report_history", f"with {DAYS} select street_id, cast(date as varchar) as date, round({rate('d', '(d.date - 3)')}, 6) as report_rate from days d")
def _(T):
    p = P.report_history(P.street_days(T.fx_street, WINDOWS), T.fx_positive, WINDOWS, **LIMITS)
    return text(r6(p.select("street_id", "date", "report_rate")), "date")


FROZEN = "least(d.date - 3, date '2024-01-24')"


@query("j13_frozen_history", f"with {DAYS} select street_id, cast(date as varchar) as date, round({rate('d', FROZEN)}, 6) as report_rate from days d")
def _(T):
    p = P.report_history(P.street_days(T.fx_street, WINDOWS), T.fx_positive, WINDOWS, freeze="2024-01-24", **LIMITS)
    return text(r6(p.select("street_id", "date", "report_rate")), "date")


ELIGIBLE = f"{DAYS}, el as (select d.*, {HELD.format(g='d.street_id')} as heldout, case when f.street_id is null then 0 else 1 end as target from days d left join fx_positive f on f.street_id = d.street_id and f.date = d.date where not is_bridge)"
SAMPLE = """ng as (select *, row_number() over (partition by date, jurisdiction, heldout order by ('0x' || substr(sha256(concat('42:', street_id, ':', date)), 1, 8))::ubigint, street_id) as r,
    count(*) over (partition by date, jurisdiction, heldout) as n from el where target = 0),
  sampled as (select *, 1e0 as w from el where target = 1 union all
    select * exclude (r, n), n / least(n, greatest(1, ceil(n * 0.1e0))) as w from ng where r <= least(n, greatest(1, ceil(n * 0.1e0))))"""


@query("w5_sample_negatives", f"with {ELIGIBLE}, {SAMPLE} select street_id, cast(date as varchar) as date, target::int as target, round(w, 6) as sample_weight from sampled")
def _(T):
    el = P.eligible_days(streets(T), T.fx_positive, WINDOWS)
    s = P.sample_negatives(el, 0.1, ["date", "jurisdiction", "heldout_street"])
    return text(r6(s.select("street_id", "date", "target", "sample_weight")), "date")


SPLIT = "case when heldout then case when date > date '2024-01-23' then 'unseen_streets_test' else 'unused' end when date <= date '2024-01-18' then 'train' when date <= date '2024-01-23' then 'validation' else 'future_test' end"


def panel(T):
    return P.panel_from_streets(streets(T), T.fx_positive, T.fx_weather, 0.1, WINDOWS, **BOUNDS, **LIMITS)


@query("a19_split_summary", f"with {ELIGIBLE}, {SAMPLE} select {SPLIT} as split, count(*) as rows, sum(target)::bigint as positives, round(sum(w), 6) as represented_days from sampled where {SPLIT} <> 'unused' group by 1")
def _(T):
    return r6(P.split_summary(panel(T)))


@query("v8_audit_splits", """select 'outside_bounds' as "check", 0::bigint as violations union all select 'shared_groups', 0 union all select 'bridges', count(*) from fx_street where false
  union all select 'repeated_days', 0""")
def _(T):
    from highwater.operators.checks import audit_splits
    return audit_splits(panel(T), BOUNDS["train_end"], BOUNDS["validation_end"])


PLANTED = """pl as (select user_id as street_id, cast(ts as date) as date, case event_type when 'error' then 'unseen_streets_test' when 'signup' then 'validation' when 'view' then 'train' else 'future_test' end as split,
  user_id % 29 = 0 as is_bridge, user_id % 50 as split_group from events)"""


@query("v8_planted_splits", f"""with {PLANTED}, g as (select split_group, bool_or(split in ('train', 'validation')) as dev, bool_or(split = 'unseen_streets_test') as unseen from pl group by split_group)
  select 'outside_bounds' as "check", count(*) filter (where (split = 'train' and date > date '2024-01-18') or (split = 'validation' and (date <= date '2024-01-18' or date > date '2024-01-23'))
    or (split in ('future_test', 'unseen_streets_test') and date <= date '2024-01-23')) as violations from pl
  union all select 'shared_groups', count(*) filter (where dev and unseen) from g union all select 'bridges', count(*) filter (where is_bridge) from pl
  union all select 'repeated_days', count(*) from (select street_id, date from pl group by street_id, date having count(*) > 1) t""")
def _(T):
    from highwater.operators.checks import audit_splits
    k = F.col("event_type")
    split = F.when(k == "error", "unseen_streets_test").when(k == "signup", "validation").when(k == "view", "train").otherwise("future_test")
    planted = T.events.select(F.col("user_id").alias("street_id"), F.to_date("ts").alias("date"), split.alias("split"), (F.col("user_id") % 29 == 0).alias("is_bridge"), (F.col("user_id") % 50).alias("split_group"))
    return audit_splits(planted, "2024-01-18", "2024-01-23")


LINKS = """lk as (select l.date, l.source, l.ticket_id, s.street_id, s.jurisdiction, st.is_bridge,
    (s.jurisdiction = 'city' and l.date between date '2024-01-01' and date '2024-01-30') or (s.jurisdiction = 'county' and l.date between date '2024-01-05' and date '2024-01-25') as ok
  from fx_link l join fx_static s on s.edge_id = l.edge_id join (select street_id, bool_or(is_bridge) as is_bridge from fx_static group by street_id) st on st.street_id = s.street_id where l.category = 'flood')"""


@query("m1_label_audit", f"with {LINKS} select count(*) as flood_links, count(*) filter (where not ok) as outside_window_links, count(*) filter (where is_bridge) as bridge_links from lk")
def _(T):
    return P.label_days(T.fx_static, street_table(T.fx_static), T.fx_link, WINDOWS)[1]


@query("m1_positive_days", f"with {LINKS} select distinct street_id, cast(date as varchar) as date from lk where ok and not is_bridge")
def _(T):
    links = P.label_days(T.fx_static, street_table(T.fx_static), T.fx_link, WINDOWS)[0]
    return text(links.select("street_id", "date").distinct(), "date")


@query("g1_ticket_groups", """with recursive l as (select distinct street_id, source, ticket_id from fx_report where category = 'flood'),
  adj as (select distinct x.street_id as a, y.street_id as b from l x join l y on x.source = y.source and x.ticket_id = y.ticket_id),
  reach(a, b) as (select street_id, street_id from fx_street union select reach.a, adj.b from reach join adj on adj.a = reach.b)
  select a as street_id, min(b) as split_group from reach group by a""")
def _(T):
    return N.ticket_groups(T.fx_street, T.fx_report.where("category = 'flood'")).select("street_id", "split_group")


M2 = f"""with recursive {LINKS}, st as (select street_id, any_value(jurisdiction) as jurisdiction, bool_or(is_bridge) as is_bridge from fx_static group by street_id),
  good as (select * from lk where ok and not is_bridge), pos as (select distinct street_id, date from good),
  adj as (select distinct x.street_id as a, y.street_id as b from good x join good y on x.source = y.source and x.ticket_id = y.ticket_id and x.street_id <> y.street_id),
  reach(a, b) as (select a, a from adj union select reach.a, adj.b from reach join adj on adj.a = reach.b),
  grp as (select a as street_id, min(b) as g from reach group by a),
  sg as (select st.*, coalesce(grp.g, st.street_id) as split_group from st left join grp on grp.street_id = st.street_id where not is_bridge),
  days as (select s.*, {HELD.format(g='split_group')} as heldout, cast(unnest(generate_series({START}, {END}, interval 1 day)) as date) as date from sg s),
  el as (select d.*, case when f.street_id is null then 0 else 1 end as target from days d left join pos f on f.street_id = d.street_id and f.date = d.date),
  el2 as (select * from el where {SPLIT} <> 'unused'), {SAMPLE.replace('from el ', 'from el2 ')}"""


@query("m2_prepare_panel", M2 + f""" select {SPLIT} as split, jurisdiction, target::int as target, count(*) as n, round(sum(w), 6) as weight, count(distinct split_group) as groups,
  count(r) as with_history, round(avg(r), 6) as mean_rate from (select d.*, {rate('d', '(d.date - 3)', 'pos')} as r from sampled d) q group by 1, 2, 3""")
def _(T):
    p = P.prepare_panel(T.fx_static, T.fx_link, T.fx_weather, 0.1, WINDOWS, **BOUNDS, **LIMITS)[2]
    return r6(p.groupBy("split", "jurisdiction", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("sample_weight").alias("weight"), F.count_distinct("split_group").alias("groups"),
                                                                F.count("report_rate").alias("with_history"), F.avg("report_rate").alias("mean_rate")))


@query("x16_model_features", f"""with {DAYS}, p as (select d.*, w.rain_mm, w.rain_lag1_mm, w.rain_prior3_mm, case when street_id % 4 = 0 then null else (street_id % 5) / 10e0 end as report_rate from days d join fx_weather w on w.date = d.date),
  b as (select *, fema_risk_level / 3e0 as a_, case when elev_p10 is null then null else 1 - least(greatest((elev_p10 - 0.5e0) / 4.5e0, 0), 1) end as b_, case when sink_p90 is null then null else least(greatest(sink_p90, 0), 1) end as c_ from p),
  f as (select *, coalesce((coalesce(a_ * 0.35e0, 0) + coalesce(b_ * 0.25e0, 0) + coalesce(c_ * 0.1e0, 0)) / nullif(case when a_ is null then 0 else 0.35e0 end + case when b_ is null then 0 else 0.25e0 end + case when c_ is null then 0 else 0.1e0 end, 0), 0.5e0) as risk from b)
  select street_id, cast(date as varchar) as date, fema_risk_level, elev_p10, sink_p90, is_tunnel, round(ln(1 + length), 6) as log_length, round(ln(1 + drain_count), 6) as log_drain_count, case when jurisdiction = 'city' then 1e0 else 0e0 end as city,
    round(ln(1 + rain_mm), 6) as log_rain, round(ln(1 + rain_lag1_mm), 6) as log_rain_lag1, round(ln(1 + rain_prior3_mm), 6) as log_rain_prior3, round(ln(1 + rain_mm) * risk, 6) as rain_x_static,
    round(ln(1 + report_rate), 6) as log_report_rate, round(ln(1 + rain_mm) * coalesce(ln(1 + report_rate), 0), 6) as rain_x_history from f""")
def _(T):
    p = P.add_weather(P.street_days(T.fx_street, WINDOWS), T.fx_weather).withColumn("report_rate", F.when(F.col("street_id") % 4 != 0, (F.col("street_id") % 5) / 10.0))
    return text(r6(S.model_features(p).select("street_id", "date", *ML.MODEL_FEATURES)), "date")


@query("a26_range_flags", """select cast(date as varchar) as date, rain_mm > t.a or rain_lag1_mm > t.b or rain_prior3_mm > t.c as out_of_range from fx_weather,
  (select max(rain_mm) as a, max(rain_lag1_mm) as b, max(rain_prior3_mm) as c from fx_weather where date <= date '2024-01-18') t""")
def _(T):
    return text(P.range_flags(T.fx_weather.where("date <= '2024-01-18'"), T.fx_weather).select("date", "out_of_range"), "date")


# ------------------------------------------------------------------ metrics
CURVE = """s as (select g, p, sum(w * target) as tp, sum(w * (1 - target)) as fp, count(*) as n, sum(target) as pos, sum(w * power(p - target, 2)) as sq
    from (select jurisdiction as g, * from fx_pred union all select 'overall', * from fx_pred) u group by g, p),
  c as (select *, sum(tp) over (partition by g order by p desc) as ctp, sum(fp) over (partition by g order by p desc) as cfp, sum(n) over (partition by g order by p desc) as cn from s)"""


@query("w6_curve", f"""with {CURVE} select g as "group", p as score, round(ctp, 6) as cum_tp, round(cfp, 6) as cum_fp, cn::bigint as cum_n from c""")
def _(T):
    return r6(M.curve(T.fx_pred, by="jurisdiction").select("group", "score", "cum_tp", "cum_fp", F.col("cum_n").cast("bigint").alias("cum_n")), "cum_tp", "cum_fp")


@query("a15_metrics", f"""with {CURVE} select g as "group", sum(n)::bigint as evaluated_rows, sum(pos)::bigint as positive_rows, round(sum(tp + fp), 6) as represented_days, round(sum(tp) / sum(tp + fp), 6) as prevalence,
  round(sum(tp * ctp / nullif(ctp + cfp, 0)) / sum(tp), 6) as average_precision, round(sum(fp * (ctp - tp / 2)) / (sum(tp) * sum(fp)), 6) as roc_auc, round(sum(sq) / sum(tp + fp), 6) as brier_score from c group by g""")
def _(T):
    return r6(M.metrics(T.fx_pred, by="jurisdiction"))


@query("a14_rank_auc", """with u as (select jurisdiction as g, p, target from fx_pred union all select 'overall', p, target from fx_pred),
  r as (select g, target, rank() over (partition by g order by p) + (count(*) over (partition by g, p) - 1) / 2e0 as rk from u)
  select g as "group", count(*) as n, sum(target)::bigint as positives, round((sum(case when target = 1 then rk else 0 end) - sum(target) * (sum(target) + 1) / 2e0) / (sum(target)::double * (count(*) - sum(target))), 6) as auc from r group by g""")
def _(T):
    return r6(M.rank_auc(T.fx_pred, "p", "target", "jurisdiction"))


@query("a16_confusion", """with u as (select jurisdiction as g, * from fx_pred union all select 'overall', * from fx_pred),
  k as (select g, sum(case when target = 1 and p >= 0.8 then w else 0 end) as tp, sum(case when target = 0 and p >= 0.8 then w else 0 end) as fp, sum(case when target = 1 and p < 0.8 then w else 0 end) as fn, sum(case when target = 0 and p < 0.8 then w else 0 end) as tn from u group by g)
  select g as "group", tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) as precision, round(tp / nullif(tp + fn, 0), 6) as recall, round(fp / nullif(fp + tn, 0), 6) as false_positive_rate, round(fp / nullif(tp + fp, 0), 6) as false_discovery_rate,
    round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy, round((tp + fp) / (tp + fp + fn + tn), 6) as alert_rate, round(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 6) as f2 from k""")
def _(T):
    return r6(M.confusion(T.fx_pred, 0.8, by="jurisdiction"))


@query("w7_budget_cutoff", """with c as (select p, sum(count(*)) over (order by p desc) as cn from fx_pred group by p) select coalesce(min(p) filter (where cn <= floor((select count(*) from fx_pred) * 0.01e0)), 1.0000000000000002e0) as cutoff from c""")
def _(T):
    return M.budget_cutoff(T.fx_pred, 0.01)


@query("w8_f2_cutoff", """with s as (select p, sum(w * target) as tp, sum(w * (1 - target)) as fp from fx_pred group by p), c as (select p, sum(tp) over (order by p desc) as ctp, sum(fp) over (order by p desc) as cfp from s),
  f as (select p, 5 * ctp / (4 * (select sum(tp) from s) + ctp + cfp) as f2 from c) select p as cutoff, round(f2, 6) as f2 from f order by f2 desc, p desc limit 1""")
def _(T):
    return r6(M.f2_cutoff(T.fx_pred), "f2")


KNOTS = """t as (select p, sum(w) as w, min(w) as fw from fx_pred group by p), c as (select *, sum(w) over (order by p) as cw, lag(p) over (order by p) as pp, sum(w) over () as tot from t),
  q as (select k, k / 1000e0 * tot as x from (select unnest(range(0, 1001)) as k) r, (select max(tot) as tot from c) m),
  m as (select k, x, min(p) as p from q join c on (c.cw >= x - 1e-9) group by k, x),
  kn as (select m.k, case when c.pp is null then c.p else c.pp + (c.p - c.pp) * greatest(least(1, (m.x - (c.cw - c.w)) / c.fw), 0) end as p from m join c on c.p = m.p)"""


@query("a20_reference_quantiles", f"with {KNOTS} select k::int as k, round(p, 5) as p from kn")
def _(T):
    return M.reference_quantiles(T.fx_pred).select("k", F.round("p", 5).alias("p"))


@query("w9_relative_score", f"""with {KNOTS}, kr as (select round(p, 5) as p, avg(k / 1000e0) as r from kn group by round(p, 5)),
  d as (select distinct l_discount * 4 + l_tax * 3 as x from lineitem),
  b as (select x, max(kr.p) filter (where kr.p <= x) as lo, min(kr.p) filter (where kr.p > x) as hi from d, kr group by x)
  select round(x, 6) as x, round(case when lo is null then 0 when hi is null then (case when x > lo then 1 else a.r end) else a.r + (z.r - a.r) * (x - lo) / (hi - lo) end, 6) as relative
  from b left join kr a on a.p = lo left join kr z on z.p = hi""")
def _(T):
    knots = M.reference_quantiles(T.fx_pred).select("k", F.round("p", 5).alias("p"))
    x = T.lineitem.select((F.col("l_discount") * 4 + F.col("l_tax") * 3).alias("x")).distinct()
    return r6(M.relative_score(x, knots, "x"))


@query("w15_select_model", """with m as (select l_returnflag as candidate, l_linenumber, avg(l_discount) as ap, avg(l_tax) as auc from lineitem group by 1, 2)
  select candidate, round(quantile_cont(ap, 0.5), 6) as median_average_precision, round(avg(auc), 6) as mean_roc_auc from m group by candidate order by 2 desc, 3 desc, 1 limit 1""")
def _(T):
    m = T.lineitem.groupBy(F.col("l_returnflag").alias("candidate"), "l_linenumber").agg(F.avg("l_discount").alias("average_precision"), F.avg("l_tax").alias("roc_auc"))
    return r6(M.select_model(m))


@query("x23_undo_prior", "select p, round(p / (9 * (1 - p) + p), 6) as q from (select distinct p from fx_pred) t")
def _(T):
    return r6(T.fx_pred.select("p").distinct().select("p", S.undo_prior("p", 9.0).alias("q")), "q")


@query("f13_alert_label", "select p, case when p >= 0.8 then 'high' when p >= 0.4 then 'medium' else 'low' end as label from (select distinct p from fx_pred) t where p is not null")
def _(T):
    return T.fx_pred.select("p").distinct().select("p", S.alert_label("p", 0.8).alias("label"))


# ------------------------------------------------------------------ model jobs: rows-only, their numbers are checked in tests
def _dev(T):
    """Development rows, written once: fitting passes over them several times."""
    return cut_lineage(panel(T).where(F.col("split").isin("train", "validation")))


@query("m3_fit_logistic")
def _(T):
    p = _dev(T)
    return M.metrics(ML.fit("logistic", p).predict(p), "target", "p", "sample_weight", "jurisdiction")


@query("m4_fit_balanced")
def _(T):
    p = _dev(T)
    return M.metrics(cut_lineage(ML.fit_balanced(p).predict(p)), "target", "p", "sample_weight", "jurisdiction")


ROLLING = [("2024-01-08", "2024-01-09", "2024-01-12"), ("2024-01-12", "2024-01-13", "2024-01-17"), ("2024-01-17", "2024-01-18", "2024-01-23")]


@query("m5_select_and_refit")
def _(T):
    return ML.select_and_refit(_dev(T), windows=ROLLING)[1]


@query("m6_evaluate_population")
def _(T):
    p = _dev(T)
    s = p.agg(F.sum(F.col("target") * F.col("sample_weight")) / F.sum("sample_weight")).first()[0]
    model, parts = ML.fit("logistic", p), []
    for name, heldout in (("future", False), ("unseen_streets", True)):
        pop = ML.population(streets(T), T.fx_positive, T.fx_weather, heldout, "2024-01-24", None, WINDOWS, **LIMITS)
        parts.append(ML.evaluate_population(pop, model, s)[1].withColumn("population", F.lit(name)))
    return parts[0].unionByName(parts[1])


@query("m7_alert_policy")
def _(T):
    train = cut_lineage(panel(T).where(F.col("split") == "train"))
    val = cut_lineage(ML.population(streets(T), T.fx_positive, T.fx_weather, False, "2024-01-19", "2024-01-23", WINDOWS, **LIMITS))
    best = ML.fit_alert_policy(train, val, 0.1)
    periods = {"validation": val} | {name: ML.population(streets(T), T.fx_positive, T.fx_weather, heldout, "2024-01-24", None, WINDOWS, **LIMITS)
                                     for name, heldout in (("future", False), ("unseen_streets", True))}
    parts = [M.confusion(cut_lineage(best["model"].predict(rows)), best["cutoff"], w=None, by="jurisdiction").withColumns(
        {"period": F.lit(name), "candidate": F.lit(best["name"])}) for name, rows in periods.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def bundle(T, static):
    p = _dev(T)
    model = ML.fit("logistic", p)
    links = P.label_days(static, street_table(static), T.fx_link, WINDOWS)[0]
    return ML.make_bundle(model, p, links.select("street_id", "date").distinct(), alert_model=model, alert_cutoff=0.1, windows=WINDOWS, created_at="2024-01-24", **LIMITS)


def _days(T, first: str, last: str):
    return T.fx_weather.where(F.col("date").between(first, last)).withColumns({"source": F.lit("forecast"), "updated_at": F.lit("2024-01-24T00:00:00Z")})


@query("m8_score_segments")
def _(T):
    static = stored(T.fx_static)  # derived once; labels, scores and summary read it
    return ML.score_segments(static, bundle(T, static), _days(T, "2024-01-24", "2024-01-24"))


@query("m9_predict_horizon")
def _(T):
    static = stored(T.fx_static)
    return ML.predict_horizon(static, bundle(T, static), _days(T, "2024-01-24", "2024-01-26"))[1]


@query("m10_build_run")
def _(T):
    static = stored(T.fx_static)
    return ML.build_run("storm", static, bundle(T, static), _days(T, "2024-01-24", "2024-01-24"), "2024-01-24 06:00:00")[1]


@query("m11_fingerprint")
def _(T):
    return ML.fingerprint({"edges": T.fx_edge.drop("odate"), "positives": T.fx_positive, "weather": T.fx_weather})


@query("m11_model_metadata", f"""with {ELIGIBLE}, {SAMPLE} select 'daily_report_v2' as version, 'logistic' as selected_model, '2024-01-18' as training_end, '2024-01-23' as refit_through, split, rows, positives, represented_days,
    'edges,positives,weather' as tables, 3::bigint as validation_fits
  from (select {SPLIT} as split, count(*) as rows, sum(target)::bigint as positives, round(sum(w), 6) as represented_days from sampled where {SPLIT} <> 'unused' group by 1) t""")
def _(T):
    """The metadata row of a model, one line per split; its rolling windows hold the logistic candidate."""
    p = cut_lineage(panel(T))
    dev = p.where(F.col("split").isin("train", "validation"))
    validation = ML.rolling_validation(dev, ["logistic"], ROLLING)
    tables = {"edges": T.fx_edge.drop("odate"), "positives": T.fx_positive, "weather": T.fx_weather}
    tests = M.metrics(cut_lineage(ML.fit("logistic", dev).predict(p)), "target", "p", "sample_weight").withColumn("population", F.lit("panel"))
    m = ML.model_metadata(p, tables, "logistic", validation, tests, "2024-01-24 06:00:00", training_end=BOUNDS["train_end"], refit_through=BOUNDS["validation_end"])
    return r6(m.select("version", "selected_model", F.col("training_end").cast("string").alias("training_end"), F.col("refit_through").cast("string").alias("refit_through"),
                       F.array_join(F.map_keys("data_fingerprints"), ",").alias("tables"), F.size("validation").cast("bigint").alias("validation_fits"),
                       F.inline("splits")), "represented_days")
