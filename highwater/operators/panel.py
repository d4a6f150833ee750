"""Street-by-day panels: windows, labels, leakage-safe history, sampling."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from highwater.functions.text import hash_fraction_bits, held_out, split_name
from highwater.operators.graph import ticket_groups
from highwater.operators.layers import street_table
from highwater.session import cut_lineage, n_buckets, stored
from highwater.settings import (HISTORY_GAP_DAYS, HISTORY_MIN_DAYS, RAIN_FEATURES, SEED, TRAIN_END, VALIDATION_END,
                                WINDOWS)


def window_bounds(windows: dict, jurisdiction="jurisdiction") -> tuple[Column, Column]:
    """Observation start and end by jurisdiction, as expressions: no join for a handful of constants."""
    start = end = F.lit(None).cast("date")
    for name, (a, b) in windows.items():
        hit = F.col(jurisdiction) == name
        start, end = F.when(hit, F.lit(a).cast("date")).otherwise(start), F.when(hit, F.lit(b).cast("date")).otherwise(end)
    return start, end


def street_days(streets: DataFrame, windows: dict = WINDOWS, first: str | None = None, last: str | None = None) -> DataFrame:
    """One row per street and day of its jurisdiction's window, optionally clipped. No shuffle."""
    start, end = window_bounds(windows)
    if first:
        start = F.greatest(start, F.lit(first).cast("date"))
    if last:
        end = F.least(end, F.lit(last).cast("date"))
    days = F.when(start <= end, F.sequence(start, end))
    return streets.select("*", F.explode(days).alias("date"))


def rain_lags(weather: DataFrame) -> DataFrame:
    """Yesterday's rain and the sum of the three days before today; null unless all of those days exist.

    Each day adds itself to the following days, so no ordered pass over the whole table is needed.
    """
    ahead = weather.select(F.col("date").alias("_d"), "rain_mm", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("k"))
    g = ahead.groupBy(F.date_add("_d", F.col("k")).alias("date")).agg(
        F.max(F.when(F.col("k") == 0, F.col("rain_mm"))).alias("rain_mm"), F.count_if(F.col("k") == 0).alias("_own"),
        F.max(F.when(F.col("k") == 1, F.col("rain_mm"))).alias("rain_lag1_mm"),
        F.sum(F.when(F.col("k") > 0, F.col("rain_mm"))).alias("_sum"),
        F.count(F.when(F.col("k") > 0, F.col("rain_mm"))).alias("_n"))
    return g.where(F.col("_own") > 0).select("date", "rain_mm", "rain_lag1_mm",
                                             F.when(F.col("_n") == 3, F.col("_sum")).alias("rain_prior3_mm"))


def add_weather(panel: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather onto the panel by day; a panel day without weather stops the job.

    The days are written first, so that their true size is known when the join is planned and the panel stays where it is.
    """
    w = stored(weather.select("date", *RAIN_FEATURES, F.lit(True).alias("_have")))
    missing = F.raise_error(F.concat(F.lit("no weather for "), F.col("date").cast("string"))).cast("boolean")
    return panel.join(w, "date", "left").where(F.coalesce("_have", missing)).drop("_have")


def label_days(segments: DataFrame, streets: DataFrame, reports: DataFrame, windows: dict = WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Flood links -> links inside the jurisdiction's window on non-bridge streets, plus an audit row.

    reports: edge_id, date, category, source, ticket_id.
    """
    links = (reports.where(F.col("category") == "flood").join(segments.select("edge_id", "street_id"), "edge_id")
             .join(streets.select("street_id", "jurisdiction", "is_bridge"), "street_id"))
    start, end = window_bounds(windows)
    flagged = links.withColumn("_in", F.coalesce(F.col("date").between(start, end), F.lit(False)))
    audit = flagged.agg(F.count(F.lit(1)).alias("flood_links"), F.count_if(~F.col("_in")).alias("outside_window_links"),
                        F.count_if("is_bridge").alias("bridge_links"))
    return flagged.where(F.col("_in") & ~F.col("is_bridge")).drop("_in"), audit


def with_report_days(streets: DataFrame, positives: DataFrame) -> DataFrame:
    """Adds ``_told``: a street's distinct report days, at most one per day of the calendar, and whether one has no date.

    Done once per street, before its days are laid out, targets and history need no join of street-days. A table that has
    the column already stays as it is.
    """
    if "_told" in streets.columns:
        return streets
    told = stored(positives.groupBy("street_id").agg(F.struct(
        F.collect_set("date").alias("days"), F.max(F.col("date").isNull().cast("int")).alias("undated")).alias("_told")))
    unnamed = told.where(F.col("street_id").isNull()).agg(F.first("_told")).scalar()  # at most one row
    return streets.join(told, "street_id", "left").select(
        *streets.columns, F.coalesce("_told", F.when(F.col("street_id").isNull(), unnamed)).alias("_told"))


def report_history(panel: DataFrame, positives: DataFrame, windows: dict = WINDOWS, gap: int = HISTORY_GAP_DAYS,
                   min_days: int = HISTORY_MIN_DAYS, freeze: str | None = None) -> DataFrame:
    """Adds ``report_rate``: report-days per year strictly before min(date - gap, freeze), null when too little was seen.

    A row counts in its street's list of report days, which is no longer than the calendar, whatever the number of reports;
    no range join is built, and nothing is sorted.
    """
    cutoff = F.date_sub("date", gap)
    if freeze:
        cutoff = F.least(cutoff, F.lit(freeze).cast("date"))
    start, end = window_bounds(windows)
    cols = [c for c in panel.columns if c != "_told"]
    asked = with_report_days(panel, positives).withColumn("_t", cutoff)
    seen = F.size(F.filter("_told.days", lambda d: d < F.col("_t"))) + F.when(F.col("_t").isNotNull(), F.col("_told.undated")).otherwise(0)
    n = F.when(F.col("_told").isNotNull(), seen).otherwise(0).cast("bigint")
    exposure = F.date_diff(F.least(F.date_add(end, 1), F.col("_t")), start)
    return asked.select(*cols, F.when(exposure >= min_days, n / (exposure / F.lit(365.25))).alias("report_rate"))


def sample_negatives(panel: DataFrame, fraction: float, strata: list[str], seed: int = SEED) -> DataFrame:
    """All positives (weight 1) and, per stratum, the ceil(n * fraction) negatives with the smallest seeded hash.

    Weight n / k keeps the sums. Hash ranges are counted first: ranges wholly inside the sample pass as they are, without a
    shuffle, and only the rows of the range at the boundary are ordered, so a stratum may be any size.
    """
    buckets = 64 * n_buckets(panel.sparkSession)  # a range shrinks as the cluster grows
    text = F.concat_ws(":", F.lit(str(seed)), F.col("street_id").cast("string"), F.col("date").cast("string"))
    positive, negative = F.col("target") == 1, F.col("target") == 0
    rows = panel.where(positive | negative).withColumn("_h", F.when(negative, hash_fraction_bits(text))).withColumn(
        "_b", F.coalesce(F.floor(F.col("_h") / (2**32 / buckets)), F.lit(-1)))  # never null: no test for it that hashes again
    counts = rows.where(negative).groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*strata)
    before = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.select(*strata, F.col("_b").alias("_cut"), "_c", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
                         F.sum("_c").over(w).alias("_n"))
    k = F.least(F.col("_n"), F.greatest(F.lit(1), F.ceil(F.col("_n") * fraction)))
    plan = plan.withColumn("_k", k).where((F.col("_before") < F.col("_k")) & (F.col("_k") <= F.col("_before") + F.col("_c")))
    plan = stored(plan.drop("_c"))  # one row per stratum, of true size, so that it goes to the rows
    planned = rows.join(plan, strata, "left")
    weight = (F.col("_n") / F.col("_k")).alias("sample_weight")
    whole = planned.where(positive | (negative & (F.col("_b") < F.col("_cut")))).select(
        *panel.columns, F.when(positive, 1.0).otherwise(weight).alias("sample_weight"))
    order = Window.partitionBy(*strata).orderBy("_h", "street_id")
    last = planned.where(negative & (F.col("_b") == F.col("_cut"))).withColumn("_r", F.row_number().over(order)).where(
        F.col("_before") + F.col("_r") <= F.col("_k"))
    return whole.unionByName(last.select(*panel.columns, weight))


def eligible_days(streets: DataFrame, positives: DataFrame, windows: dict = WINDOWS, first=None, last=None) -> DataFrame:
    """Every non-bridge street-day of the windows with its 0/1 target."""
    told = with_report_days(streets.where(~F.col("is_bridge")), positives)
    hit = F.array_contains("_told.days", F.col("date")) & F.col("street_id").isNotNull()
    return street_days(told, windows, first, last).select(
        "street_id", "date", *[c for c in streets.columns if c != "street_id"], F.coalesce(hit.cast("int"), F.lit(0)).alias("target"))


def panel_from_streets(streets: DataFrame, positives: DataFrame, weather: DataFrame, fraction: float = 0.02,
                       windows: dict = WINDOWS, train_end: str = TRAIN_END, validation_end: str = VALIDATION_END,
                       gap: int = HISTORY_GAP_DAYS, min_days: int = HISTORY_MIN_DAYS) -> DataFrame:
    """streets (with split_group, heldout_street) x days -> the sampled, weighted, split panel with history and weather."""
    streets = with_report_days(streets, positives)
    days = eligible_days(streets, positives, windows).withColumn(
        "split", split_name("date", "heldout_street", train_end, validation_end)).where(F.col("split") != "unused")
    sampled = sample_negatives(days, fraction, ["date", "jurisdiction", "heldout_street"])
    return add_weather(report_history(sampled, positives, windows, gap, min_days), weather)


def prepare_panel(segments: DataFrame, reports: DataFrame, weather: DataFrame, fraction: float = 0.02,
                  windows: dict = WINDOWS, train_end: str = TRAIN_END, validation_end: str = VALIDATION_END,
                  gap: int = HISTORY_GAP_DAYS, min_days: int = HISTORY_MIN_DAYS):
    """Segments, reports, weather -> (streets, positives, panel, label audit)."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    streets = street_table(segments)
    links, audit = label_days(segments, streets, reports, windows)
    links = cut_lineage(links)  # a small table that labels, groups, sampling and history all read
    streets = cut_lineage(ticket_groups(streets, links).withColumn("heldout_street", held_out("split_group")))
    positives = links.select("street_id", "date").distinct()
    panel = panel_from_streets(streets, positives, weather, fraction, windows, train_end, validation_end, gap, min_days)
    return streets, positives, panel, audit


def split_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.sum("target").cast("bigint").alias("positives"),
                                      F.sum("sample_weight").alias("represented_days"))


def range_flags(train: DataFrame, scored: DataFrame, cols: list[str] = RAIN_FEATURES) -> DataFrame:
    """Scored days whose rain exceeds anything in training."""
    top = train.agg(F.struct(*[F.max(c).alias(c) for c in cols])).scalar()
    over = None
    for c in cols:
        hit = F.col(c) > F.col(f"_top.{c}")
        over = hit if over is None else over | hit
    return scored.select("*", top.alias("_top")).withColumn("out_of_range", F.coalesce(over, F.lit(False))).drop("_top")
