"""Weighted ranking metrics, cutoffs and score distributions.

Predictions are first collapsed to distinct scores (a partial aggregate), then summed in score order range by range.
"""
from pyspark.sql import DataFrame, functions as F

from highwater.operators.ranges import exact_quantiles, prefix_sums
from highwater.session import cut_lineage

OVERALL = "overall"


def _by_score(pred: DataFrame, y: str, p: str, w: str, by: str | None) -> DataFrame:
    """Distinct scores per group, plus the same for all rows as group 'overall'."""
    weight = F.col(w) if w else F.lit(1.0)
    yes = (F.col(y) == 1)
    base = pred.select(*([F.col(by).alias("group")] if by else []), F.col(p).cast("double").alias("score"),
                       F.when(yes, weight).otherwise(0.0).alias("tp"), F.when(yes, 0.0).otherwise(weight).alias("fp"),
                       yes.cast("bigint").alias("pos"), (weight * F.pow(F.col(p) - yes.cast("double"), 2)).alias("sq"))
    sums = lambda n: [F.sum(c).alias(c) for c in ("tp", "fp", "pos", "sq")] + [n.alias("n")]
    if not by:
        return base.groupBy("score").agg(*sums(F.count(F.lit(1)))).withColumn("group", F.lit(OVERALL))
    t = base.groupBy("group", "score").agg(*sums(F.count(F.lit(1))))
    whole = t.groupBy("score").agg(*sums(F.sum("n"))).withColumn("group", F.lit(OVERALL))
    return t.unionByName(whole)


def curve(pred: DataFrame, y="target", p="p", w="w", by: str | None = None) -> DataFrame:
    """Cumulative true and false positives by descending score, ties closed together."""
    return prefix_sums(_by_score(pred, y, p, w, by), ["group"], "score", ["tp", "fp", "n"], descending=True)


def metrics(pred: DataFrame, y="target", p="p", w="w", by: str | None = None, is_probability: bool = True) -> DataFrame:
    """Rows, positives, weight, prevalence, average precision, ROC-AUC, Brier; overall and per group.

    Average precision is the step sum over distinct scores. One class only gives null for both rankings.
    """
    c = curve(pred, y, p, w, by)
    hit = F.when(F.col("cum_tp") + F.col("cum_fp") > 0, F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")))
    g = c.groupBy("group").agg(
        F.sum("n").cast("bigint").alias("evaluated_rows"), F.sum("pos").cast("bigint").alias("positive_rows"),
        F.sum(F.col("tp") + F.col("fp")).alias("represented_days"), F.sum("tp").alias("_p"), F.sum("fp").alias("_f"),
        F.sum(hit).alias("_ap"), F.sum(F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)).alias("_auc"), F.sum("sq").alias("_sq"))
    both = (F.col("_p") > 0) & (F.col("_f") > 0)
    return g.select("group", "evaluated_rows", "positive_rows", "represented_days",
                    (F.col("_p") / F.col("represented_days")).alias("prevalence"),
                    F.when(both, F.col("_ap") / F.col("_p")).alias("average_precision"),
                    F.when(both, F.col("_auc") / (F.col("_p") * F.col("_f"))).alias("roc_auc"),
                    F.when(F.lit(is_probability), F.col("_sq") / F.col("represented_days")).alias("brier_score"))


def rank_auc(df: DataFrame, score: str, label: str, by: str | None = None) -> DataFrame:
    """ROC-AUC of a raw feature by rank sums, higher meaning label true."""
    known = df.where(F.col(score).isNotNull()).withColumn("_y", F.col(label).cast("int"))
    m = metrics(known, "_y", score, "", by, False)
    return m.select("group", F.col("evaluated_rows").alias("n"), F.col("positive_rows").alias("positives"), F.col("roc_auc").alias("auc"))


def confusion(pred: DataFrame, cutoff, y="target", p="p", w: str | None = "w", by: str | None = None) -> DataFrame:
    """Weighted confusion counts and rates at a cutoff; a zero denominator gives null."""
    weight = F.col(w) if w else F.lit(1.0)
    yes, flagged = F.col(y) == 1, F.col(p) >= cutoff
    cells = {"tp": yes & flagged, "fp": ~yes & flagged, "fn": yes & ~flagged, "tn": ~yes & ~flagged}
    agg = [F.sum(F.when(c, weight).otherwise(0.0)).alias(k) for k, c in cells.items()]
    if by:
        g = pred.rollup(by).agg(F.grouping(by).alias("_all"), *agg).withColumn(
            "group", F.when(F.col("_all") == 1, OVERALL).otherwise(F.col(by))).drop(by, "_all")
    else:
        g = pred.agg(*agg).withColumn("group", F.lit(OVERALL))
    tp, fp, fn, tn = (F.col(k) for k in cells)
    total = tp + fp + fn + tn
    ratio = lambda a, b: F.try_divide(a, b)
    return g.select("group", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
                    ratio(fp, fp + tn).alias("false_positive_rate"), ratio(fp, tp + fp).alias("false_discovery_rate"),
                    ratio(tp + tn, total).alias("accuracy"), ratio(tp + fp, total).alias("alert_rate"),
                    ratio(5 * tp, 5 * tp + 4 * fn + fp).alias("f2"))


def check_probabilities(pred: DataFrame, p="p") -> DataFrame:
    """Stops the job on a missing, non-finite or out-of-range probability."""
    ok = F.col(p).isNotNull() & ~F.isnan(p) & F.col(p).between(0, 1)
    return pred.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("probability outside 0..1")).cast("boolean")))


def budget_cutoff(pred: DataFrame, rate: float, p="p") -> DataFrame:
    """Lowest cutoff that flags at most floor(n * rate) rows with ties whole; just above 1 when even the top tie is too big."""
    if not 0 < rate <= 1:
        raise ValueError("alert budget must be in (0, 1]")
    counts = check_probabilities(pred, p).groupBy(F.col(p).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    c = prefix_sums(counts, [], "score", ["n"], descending=True)
    total = counts.agg(F.sum("n")).scalar()
    return c.select("*", total.alias("_total")).agg(F.coalesce(
        F.min(F.when(F.col("cum_n") <= F.floor(F.col("_total") * rate), F.col("score"))), F.lit(1.0000000000000002)).alias("cutoff"))


def f2_cutoff(pred: DataFrame, y="target", p="p", w="w") -> DataFrame:
    """Cutoff with the best weighted F2; of equals the highest."""
    c = curve(check_probabilities(pred, p), y, p, w)
    total = pred.agg(F.sum(F.when(F.col(y) == 1, F.col(w)))).scalar()
    c = c.select("*", total.alias("_pos"))
    f2 = F.coalesce(F.try_divide(5 * F.col("cum_tp"), 4 * F.col("_pos") + F.col("cum_tp") + F.col("cum_fp")), F.lit(0.0))
    return c.agg(F.max_by(F.col("score"), F.struct(f2.alias("f"), F.col("score").alias("s"))).alias("cutoff"), F.max(f2).alias("f2"))


def reference_quantiles(pred: DataFrame, p="p", w="w", knots: int = 1001) -> DataFrame:
    """(k, p): the score at each evenly spaced share of the cumulative weight, linearly interpolated.

    Each distinct score knows the shares it covers, so knots are produced in place; no join. Inside a tie only the
    first row's weight is climbed; the rest of the tie is flat.
    """
    t = pred.groupBy(F.col(p).cast("double").alias("score")).agg(F.sum(w).alias("w"), F.min(w).alias("first_w"))
    c = prefix_sums(t, [], "score", ["w"], previous=True)
    total = t.agg(F.sum("w")).scalar()
    c = c.select("*", total.alias("_total")).withColumn("_before", F.col("cum_w") - F.col("w"))
    last = knots - 1
    lo = F.when(F.col("prev_value").isNull(), F.lit(0)).otherwise(F.floor(F.col("_before") * last / F.col("_total")) + 1)
    hi = F.when(F.col("cum_w") >= F.col("_total") * (1 - 1e-12), F.lit(last)).otherwise(F.floor(F.col("cum_w") * last / F.col("_total")))
    rows = c.where(lo <= hi).select("*", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("k"))
    t_ = F.least(F.lit(1.0), (F.col("k") / last * F.col("_total") - F.col("_before")) / F.col("first_w"))
    return rows.select("k", F.when(F.col("prev_value").isNull(), F.col("score")).otherwise(
        F.col("prev_value") + (F.col("score") - F.col("prev_value")) * F.greatest(t_, F.lit(0.0))).alias("p"))


def relative_score(pred: DataFrame, knots: DataFrame, p="p", out="relative") -> DataFrame:
    """Place a probability among reference knots (k, p): mid-ranks for ties, linear between, 0 below and 1 above.

    The knots travel as one array; each row finds its place by bisection, in as many halvings as the array needs.
    """
    knots = cut_lineage(knots)
    last = knots.agg(F.max("k")).scalar()
    ranks = knots.select("p", "k", last.alias("_last")).groupBy("p").agg(F.avg(F.col("k") / F.col("_last")).alias("r"))
    table = ranks.agg(F.sort_array(F.collect_list(F.struct("p", "r"))).alias("t")).scalar()
    df = pred.select("*", table.alias("_t"))
    n, x = F.size("_t"), F.col(p)
    powers = F.transform(F.sequence(F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int"), F.lit(0), F.lit(-1)), lambda e: F.pow(F.lit(2.0), e).cast("int"))
    pos = F.aggregate(powers, F.lit(0), lambda i, s: F.when(
        (i + s <= n) & (F.try_element_at("_t", i + s)["p"] <= x), i + s).otherwise(i))
    df = df.withColumn("_i", pos)
    a, b = F.try_element_at("_t", F.greatest(F.col("_i"), F.lit(1))), F.try_element_at("_t", F.col("_i") + 1)
    between = a["r"] + (b["r"] - a["r"]) * (x - a["p"]) / (b["p"] - a["p"])
    score = (F.when(x.isNull(), F.lit(None).cast("double")).when(F.col("_i") == 0, 0.0)
             .when((F.col("_i") == n) & (x > a["p"]), 1.0).when(F.col("_i") == n, a["r"]).otherwise(between))
    return df.withColumn(out, score).drop("_t", "_i")


def select_model(windows: DataFrame) -> DataFrame:
    """window metrics (candidate, average_precision, roc_auc) -> the winner by median AP, then mean AUC."""
    g = windows.groupBy("candidate").agg(F.percentile("average_precision", F.lit(0.5)).alias("median_average_precision"),
                                         F.avg("roc_auc").alias("mean_roc_auc"))
    return g.orderBy(F.desc("median_average_precision"), F.desc("mean_roc_auc"), "candidate").limit(1)


# ------------------------------------------------------------------ descriptive tables
def distribution(df: DataFrame, cols: list[str], pcts: list[float], cuts: list[float]) -> DataFrame:
    """column, stat, value: mean, sd, min, max, exact percentiles, shares at 0, at 1 and above cutoffs."""
    stats = []
    for c in cols:
        x = F.col(c).cast("double")
        share = lambda cond: F.avg(F.when(x.isNotNull(), cond.cast("double")))  # noqa: E731,B023
        named = {"mean": F.avg(x), "sd": F.stddev_samp(x), "min": F.min(x), "max": F.max(x), "share_0": share(x == 0),
                 "share_1": share(x == 1), **{f"share_above_{v:g}": share(x > v) for v in cuts}}
        row = df.agg(*[e.alias(k) for k, e in named.items()])
        stats.append(row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("stat"), F.col(f"`{k}`").alias("value"))
                                                    for k in named])).alias("r")).select("r.*"))
        q = exact_quantiles(df, [], c, pcts)
        stats.append(q.select(F.lit(c).alias("column"), F.concat(F.lit("p"), F.bround(F.col("prob") * 100, 0).cast("int").cast("string"))
                              .alias("stat"), F.col("q").alias("value")))
    out = stats[0]
    for s in stats[1:]:
        out = out.unionByName(s)
    return out


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.agg(F.corr(x, y).alias("correlation"), F.count(F.lit(1)).alias("n"))


def group_median(df: DataFrame, x: str, by: list[str]) -> DataFrame:
    return exact_quantiles(df, by, x, [0.5]).select(*by, F.col("q").alias("median"), "n")


def long_outliers(edges: DataFrame, k: float = 3.0) -> DataFrame:
    """Bridges longer than Q3 + k * IQR, or with mixed tags."""
    b = edges.where("is_bridge")
    q = exact_quantiles(b, [], "length", [0.25, 0.75]).agg(F.max(F.when(F.col("prob") == 0.25, F.col("q"))).alias("q1"),
                                                           F.max(F.when(F.col("prob") == 0.75, F.col("q"))).alias("q3"))
    cut = q.select((F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("c")).agg(F.max("c")).scalar()
    flagged = b.select("*", cut.alias("cutoff")).withColumn("long_outlier", F.col("length") > F.col("cutoff"))
    return flagged.where(F.col("long_outlier") | F.col("mixed_tags"))


def inlet_medians(drains: DataFrame, min_len: float = 20.0) -> DataFrame:
    """Medians of inlet counts and inlets per 100 m: both by jurisdiction on long edges, the second also by short/long.

    drains: drain_count, drains_per_100m, length, jurisdiction. Returns group, measure, median, n.
    """
    sized = drains.select(F.when(F.col("length") < min_len, "short").otherwise("long").alias("group"), F.lit("drains_per_100m").alias("measure"),
                          F.col("drains_per_100m").alias("v"))
    by_jurisdiction = drains.where(F.col("length") >= min_len).select(F.col("jurisdiction").alias("group"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in ("drain_count", "drains_per_100m")])).alias("m")).select("group", "m.*")
    return group_median(sized.unionByName(by_jurisdiction), "v", ["group", "measure"])
