"""Global orders without a one-task window.

Rows are cut into value ranges at approximate quantiles (a fixed number of ranges, so what travels between
them is small); each range is summed on its own and the totals of the earlier ranges are added. The cut
points only balance the work: the result is exact wherever they fall.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from highwater.session import cut_lineage, n_buckets


def with_range_bucket(df: DataFrame, value: str, name: str = "_bucket", k: int | None = None) -> DataFrame:
    """Adds the number of cut points below the value. The place among the cuts is found by halving, so a row takes log2(k)
    steps however many ranges there are; ``df`` is evaluated once for the cuts and the rows."""
    k = k or n_buckets(df.sparkSession)
    df = cut_lineage(df)
    v = F.col(value).cast("double")
    cuts = df.agg(F.percentile_approx(v, [i / k for i in range(1, k)]).alias("c")).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(k.bit_length()))])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_cuts", at + step - 1) < F.col("_at"), at + step).otherwise(at))
    return df.select("*", cuts.alias("_cuts"), v.alias("_at")).withColumn(name, place).drop("_cuts", "_at")


def prefix_sums(df: DataFrame, by: list[str], value: str, sums: list[str], descending: bool = False,
                previous: bool = False) -> DataFrame:
    """Adds ``cum_<name>`` = running total of each sum in order of ``value`` within ``by``.

    With ``previous`` also adds ``prev_value``, the value just before in that order.

    ``df`` must already hold one row per (by, value), so ties close together.
    """
    t = with_range_bucket(df, value)
    order = F.col(value).desc() if descending else F.col(value).asc()
    group = Window.partitionBy(*(by or [F.lit(1)]))  # over range totals only: at most k rows per group
    order, bucket_order = [F.col(c).desc() if descending else F.col(c).asc() for c in (value, "_bucket")]
    local_order = Window.partitionBy(*by, "_bucket").orderBy(order)
    inside = local_order.rowsBetween(Window.unboundedPreceding, 0)
    before = group.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.min if descending else F.max
    totals = t.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums], edge(value).alias("_edge"))
    offsets = totals.select(*by, "_bucket", edge("_edge").over(before).alias("_pv"),
                            *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums])
    local = t.select("*", F.lag(value).over(local_order).alias("_lag"),
                     *[F.sum(s).over(inside).alias(f"_l_{s}") for s in sums])
    extra = [F.coalesce("_lag", "_pv").alias("prev_value")] if previous else []
    return local.join(offsets, [*by, "_bucket"]).select(
        *df.columns, *extra, *[(F.col(f"_l_{s}") + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums])


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, for groups too large for one task.

    Returns by..., ``prob``, ``q``, ``n``. Nulls are ignored. Only the value ranges that hold a wanted rank
    are looked at row by row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    t = with_range_bucket(counts, "_v")
    group = Window.partitionBy(*(by or [F.lit(1)]))
    totals = t.groupBy(*by, "_bucket").agg(F.sum("_n").alias("_c"))
    upto = F.sum("_c").over(group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranks = (totals.select("*", upto.alias("_upto"), F.sum("_c").over(group).alias("n"))
             .withColumn("_before", F.col("_upto") - F.col("_c"))
             .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
             .withColumn("_h", (F.col("n") - 1) * F.col("prob"))
             .withColumns({"_lo": F.floor("_h"), "_hi": F.ceil("_h")})
             .where(((F.col("_before") <= F.col("_lo")) & (F.col("_lo") < F.col("_upto")))
                    | ((F.col("_before") <= F.col("_hi")) & (F.col("_hi") < F.col("_upto"))))
             .drop("_c", "_upto"))
    inside = Window.partitionBy(*by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    local = t.withColumn("_cum", F.sum("_n").over(inside)).join(ranks, [*by, "_bucket"])
    last, first = F.col("_before") + F.col("_cum"), F.col("_before") + F.col("_cum") - F.col("_n")
    near = local.where(((first <= F.col("_lo")) & (F.col("_lo") < last))
                       | ((first <= F.col("_hi")) & (F.col("_hi") < last)))
    return near.groupBy(*by, "prob", "n", "_h", "_lo").agg(F.min("_v").alias("_a"), F.max("_v").alias("_b")).select(
        *by, "prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_lo"))).alias("q"), "n")


def number_rows(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """1..n over the whole table in the given total order.

    A range-partitioned sort, fixed by a checkpoint; then only the per-partition counts are summed.
    """
    fixed = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    local = F.col("_mid") - F.shiftleft(F.shiftright("_mid", 33), 33)
    counts = fixed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return (fixed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + local + 1).drop("_part", "_before", "_mid"))
