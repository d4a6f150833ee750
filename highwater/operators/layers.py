"""Road feature layers and the segment risk score."""
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from highwater.functions.geometry import col
from highwater.functions.scoring import apply_bridge_cap, per_100m, scale01, weighted_mean_of, zone_risk_level
from highwater.operators.ranges import prefix_sums
from highwater.settings import (RISK_INVERT, RISK_PERCENTILE_WITHIN, RISK_RANGE, RISK_WEIGHTS, ZERO_WHEN_MISSING)


def join_layers(roads: DataFrame, layers: dict[str, DataFrame], key: str = "edge_id") -> tuple[DataFrame, DataFrame]:
    """Left join of feature layers, one row per key each.

    A column two tables share is an error before anything runs. The audit has one row per layer:
    rows, duplicate keys, keys unknown to the roads.
    """
    seen = set(roads.columns)
    for name, layer in layers.items():
        clash = (set(layer.columns) & seen) - {key}
        if clash:
            raise ValueError(f"{name}: columns already present {sorted(clash)}")
        seen |= set(layer.columns)
    keys = roads.select(key)
    audits = []
    for name, layer in layers.items():
        per_key = layer.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        known = per_key.join(keys.withColumn("_known", F.lit(True)), key, "left")
        audits.append(known.agg(
            F.lit(name).alias("layer"), F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"),
            F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).cast("bigint").alias("unmatched")))
    joined = reduce(lambda acc, layer: acc.join(layer, key, "left"), layers.values(), roads)
    return joined, reduce(DataFrame.unionByName, audits)


def fill_zero(segments: DataFrame, cols: list[str] = ZERO_WHEN_MISSING) -> DataFrame:
    present = [c for c in cols if c in segments.columns]
    return segments.fillna(0, subset=present) if present else segments


def clean_floats(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column, on ingest."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    bad = lambda c: F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c in floats}) if floats else df


def mask_implausible(segments: DataFrame) -> DataFrame:
    """Values that cannot be physical become unknown."""
    return segments.withColumns({
        "elev_p10": F.when(~F.col("elev_water_only"), F.col("elev_p10")),
        "fema_risk_level": F.when(F.col("fema_risk_level").isin(1, 2, 3), F.col("fema_risk_level")),
        **{c: F.when(F.col(c) >= 0, F.col(c)) for c in ("sink_p90", "length", "drain_count")}})


def fema_layer(zones_by_edge: DataFrame) -> DataFrame:
    """edge_id, zone, subtype, sfha -> the flood-zone layer."""
    return zones_by_edge.select("edge_id", F.col("zone").alias("fema_zone"), F.col("subtype").alias("zone_subtype"),
                                F.col("sfha").alias("in_sfha"),
                                zone_risk_level("zone", "subtype", "sfha").alias("fema_risk_level"))


def elevation_features(samples: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean, minimum and 10th percentile of ground samples; edges wholly below 0 m are on water, not scored."""
    agg = samples.groupBy("edge_id").agg(
        F.avg("z").alias("elev_mean"), F.min("z").alias("elev_min"), F.percentile("z", F.lit(0.1)).alias("_p10"),
        F.max("z").alias("_max"), F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("z").isNull()).alias("n_null"))
    water = F.coalesce((F.col("_max") < 0) & ~F.col("is_bridge"), F.lit(False))
    return edges.select("edge_id", "is_bridge").join(agg, "edge_id", "left").select(
        "edge_id", "elev_mean", "elev_min", F.when(~water, F.col("_p10")).alias("elev_p10"),
        water.alias("elev_water_only"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        F.coalesce("n_null", F.lit(0)).alias("n_null"))


def ponding_features(samples: DataFrame) -> DataFrame:
    return samples.groupBy("edge_id").agg(F.max("depth").alias("sink_depth"),
                                          F.percentile("depth", F.lit(0.9)).alias("sink_p90"))


def freeboard_features(samples: DataFrame) -> DataFrame:
    """Ground minus flood criteria: 10th percentile and share below zero among known samples."""
    fb = F.col("z") - F.col("criteria")
    s = samples.withColumn("_fb", fb)
    return s.groupBy("edge_id").agg(
        F.avg("criteria").alias("flood_criteria_m"), F.percentile("_fb", F.lit(0.1)).alias("freeboard_p10_m"),
        F.avg(F.when(F.col("_fb").isNotNull(), (F.col("_fb") < 0).cast("double"))).alias("below_criteria_frac"))


def report_days(links: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct report dates per edge and category, zero for edges without any.

    Repeats of a date are removed before the pivot, so a storm's burst of tickets on one road is summed map-side.
    """
    days = links.groupBy("edge_id", "category", "date").agg(F.lit(1).alias("_d"))
    per_edge = days.groupBy("edge_id").agg(F.count_if(F.col("category") == "flood").alias("flood_report_days"),
                                           F.count_if(F.col("category") == "drain").alias("drain_issue_days"))
    return edges.select("edge_id").join(per_edge, "edge_id", "left").select(
        "edge_id", *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("flood_report_days", "drain_issue_days")])


def drain_layer(counts: DataFrame, edges: DataFrame) -> DataFrame:
    n = F.coalesce("n", F.lit(0)).cast("int")
    return edges.select("edge_id", "length").join(counts, "edge_id", "left").select(
        "edge_id", n.alias("drain_count"), per_100m(n, "length").alias("drains_per_100m"))


def pct_within(df: DataFrame, value: str, group: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Average-rank percentile among values > 0 of the group; 0 or less gives 0, null stays null.

    Ranks come from running counts of distinct values, so a group may be most of the table. ``source`` is a cheaper
    table with the same (group, value) rows.
    """
    counts = (source if source is not None else df).where((F.col(value) > 0) & F.col(group).isNotNull()).groupBy(group, value).agg(
        F.count(F.lit(1)).alias("_n"))
    cum = prefix_sums(counts, [group], value, ["_n"]).join(counts.groupBy(group).agg(F.sum("_n").alias("_total")), group)
    ranks = cum.select(group, F.col(value).alias("_value"),
                       ((F.col("cum__n") - (F.col("_n") - 1) / 2.0) / F.col("_total")).alias("_pct"))
    keyed = df.withColumn("_value", F.when(F.col(value) > 0, F.col(value)))
    return keyed.join(ranks, [group, "_value"], "left").withColumn(
        out, F.when(F.col(value).isNotNull(), F.coalesce("_pct", F.lit(0.0)))).drop("_pct", "_value")


def scaled_parts(segments: DataFrame, weights: dict = RISK_WEIGHTS, sources: dict | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Adds a 0..1 column per weighted feature that is present; returns their names."""
    df, parts = segments, {}
    for name in [c for c in weights if c in segments.columns]:
        out = f"part_{name}"
        if name in RISK_PERCENTILE_WITHIN and RISK_PERCENTILE_WITHIN[name] in segments.columns:
            df = pct_within(df, name, RISK_PERCENTILE_WITHIN[name], out, (sources or {}).get(name))
        elif name in RISK_RANGE:
            df = df.withColumn(out, scale01(name, *RISK_RANGE[name], invert=name in RISK_INVERT))
        else:
            df = scale_by_data(df, name, out, invert=name in RISK_INVERT)
        parts[name] = out
    return df, parts


def scale_by_data(df: DataFrame, name: str, out: str, invert: bool = False) -> DataFrame:
    """0..1 by the column's own minimum and maximum."""
    bounds = df.agg(F.struct(F.min(name).cast("double").alias("lo"), F.max(name).cast("double").alias("hi"))).scalar()
    return df.select("*", bounds.alias("_b")).withColumn(
        out, scale01(name, F.col("_b.lo"), F.col("_b.hi"), invert)).drop("_b")


def risk_score(segments: DataFrame, weights: dict = RISK_WEIGHTS, keep_parts: bool = False, sources: dict | None = None) -> DataFrame:
    df, parts = scaled_parts(segments, weights, sources)
    score = weighted_mean_of({k: F.col(v) for k, v in parts.items()}, weights)
    df = df.withColumn("risk_score", score)
    return df if keep_parts else df.drop(*parts.values())


def build_segments(roads: DataFrame, layers: dict[str, DataFrame]) -> DataFrame:
    """The scored segment table: layers joined, gaps filled, weighted score, bridge cap and note.

    Percentile ranks are counted from the layer that holds the value, not from the joined table.
    """
    joined, _ = join_layers(roads, layers)
    sources = {}
    for value, group in RISK_PERCENTILE_WITHIN.items():
        owner = next((x for x in layers.values() if value in x.columns), None)
        holder = next((x for x in [roads, *layers.values()] if group in x.columns), None)
        if owner is not None and holder is not None:
            some = owner.where(F.col(value) > 0).select("edge_id", value, *([group] if holder is owner else []))
            sources[value] = some if holder is owner else some.join(holder.select("edge_id", group), "edge_id")
    return apply_bridge_cap(risk_score(fill_zero(clean_floats(joined)), sources=sources))


def street_table(segments: DataFrame) -> DataFrame:
    """One row per street from its one or two edges."""
    statics = ["fema_risk_level", "elev_p10", "sink_p90", "length", "drain_count"]
    s = mask_implausible(clean_floats(segments))
    return s.groupBy("street_id").agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in statics],
        F.avg(F.col("is_tunnel").cast("double")).alias("is_tunnel"),
        F.max("is_bridge").alias("is_bridge"), F.max("elev_water_only").alias("elev_water_only"),
        F.min_by("jurisdiction", "edge_id").alias("jurisdiction"))


def street_summary(segments: DataFrame) -> DataFrame:
    """First name, highest risk, edge count, longest edge; ``at_top`` marks streets tied at the highest risk."""
    streets = segments.groupBy("street_id").agg(
        F.min_by("name", F.when(F.col("name").isNotNull(), F.col("edge_id"))).alias("name"),
        F.max("risk_score").alias("risk_score"), F.count(F.lit(1)).alias("edges"), F.max("length").alias("length_m"))
    top = segments.agg(F.max("risk_score")).scalar()
    return streets.select("*", top.alias("_top")).withColumn("at_top", F.col("risk_score") == F.col("_top")).drop("_top")


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def travel_times(edges: DataFrame) -> DataFrame:
    """Seconds per edge; a missing speed takes the mean of its highway class, then of all edges.

    Class means are a small aggregate joined back, so one class may hold most of the edges.
    """
    means = edges.groupBy("highway").agg(F.avg("speed_kph").alias("_mean"))
    overall = edges.agg(F.avg("speed_kph")).scalar()
    return (edges.join(means, edges["highway"].eqNullSafe(means["highway"]), "left").drop(means["highway"])
            .select("*", overall.alias("_all"))
            .withColumn("speed_kph", F.coalesce("speed_kph", "_mean", "_all"))
            .withColumn("seconds", col("length") / (F.col("speed_kph") / 3.6)).drop("_mean", "_all"))
