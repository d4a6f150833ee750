"""Risk scores, labels, costs and model features as column expressions."""
from pyspark.sql import Column, DataFrame, functions as F

from highwater.functions.geometry import col
from highwater.settings import (BASELINE_WEIGHTS, BRIDGE_CAP, HIGH_RISK_PENALTY, LABELS, MEDIUM_FRACTION,
                                RAIN_3H_CUTS, RAIN_DAY_CUTS, RAIN_FACTOR, RISK_HIGH, RISK_MEDIUM, RISK_WEIGHT,
                                ROADWORK_FACTOR, SUBTYPE_02PCT, SUBTYPE_MINIMAL)


def zone_risk_level(zone, subtype, sfha) -> Column:
    return (F.when(F.coalesce(col(sfha), F.lit(False)), 3)
            .when((col(zone) == "X") & (col(subtype) == SUBTYPE_02PCT), 2)
            .when((col(zone) == "X") & (col(subtype) == SUBTYPE_MINIMAL), 1)
            .otherwise(0))


def scale01(x, lo, hi, invert=False) -> Column:
    """Clip to 0..1 over a range. A range given high-to-low inverts; an empty range gives 0; null stays null."""
    x, lo, hi = col(x).cast("double"), F.lit(lo) if not isinstance(lo, Column) else lo, \
        F.lit(hi) if not isinstance(hi, Column) else hi
    s = F.least(F.greatest((x - lo) / F.when(hi != lo, hi - lo), F.lit(0.0)), F.lit(1.0))
    s = F.when(x.isNotNull(), F.when(hi != lo, s).otherwise(F.lit(0.0)))
    return 1 - s if invert else s


def weighted_mean(parts: dict) -> Column:
    """Mean of {column: weight} with the weights of null parts left out; all null gives null."""
    items = [(col(c), float(w)) for c, w in parts.items()]
    num = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in items[1:]), F.coalesce(items[0][0] * items[0][1], F.lit(0.0)))
    den = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in items[1:]),
              F.when(items[0][0].isNotNull(), items[0][1]).otherwise(0.0))
    return num / F.when(den > 0, den)


def baseline_parts() -> dict:
    return {"fema": F.col("fema_risk_level") / 3.0,
            "low_ground": 1 - scale01("elev_p10", 0.5, 5.0),
            "ponding": scale01("sink_p90", 0.0, 1.0)}


def physical_baseline(streets: DataFrame) -> DataFrame:
    """Adds ``physical`` (0.5 when nothing is known) and ``coverage`` (share of the weights known)."""
    parts = baseline_parts()
    known = sum((F.when(c.isNotNull(), BASELINE_WEIGHTS[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    means = weighted_mean_of(parts, BASELINE_WEIGHTS)
    return streets.withColumns({"physical": F.coalesce(means, F.lit(0.5)),
                                "coverage": known / sum(BASELINE_WEIGHTS.values())})


def weighted_mean_of(parts: dict, weights: dict) -> Column:
    num = sum((F.coalesce(c * weights[k], F.lit(0.0)) for k, c in parts.items()), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), weights[k]).otherwise(0.0) for k, c in parts.items()), F.lit(0.0))
    return num / F.when(den > 0, den)


def apply_bridge_cap(df: DataFrame, cap=BRIDGE_CAP) -> DataFrame:
    """Bridge decks are capped; the bridge note wins over the water-only note."""
    note = F.when(F.col("is_bridge"), "bridge_capped")
    if "elev_water_only" in df.columns:
        note = note.when(F.coalesce("elev_water_only", F.lit(False)), "elev_water_only")
    return df.withColumns({
        "risk_score": F.when(F.col("is_bridge") & F.col("risk_score").isNotNull(),
                             F.least("risk_score", F.lit(cap))).otherwise(F.col("risk_score")),
        "score_note": note})


def per_100m(n, length) -> Column:
    return col(n) / F.when(col(length) != 0, col(length)) * 100.0


def cutoff_label(score, medium=RISK_MEDIUM, high=RISK_HIGH) -> Column:
    return F.when(col(score) >= high, "high").when(col(score) >= medium, "medium").otherwise("low")


def rain_level(day_mm, next_3h_mm=None) -> Column:
    """none/light/moderate/heavy; the day's total wins over the next three hours; neither gives null."""
    def level(mm, cuts):
        return F.when(mm < cuts[0], "none").when(mm < cuts[1], "light").when(mm < cuts[2], "moderate").otherwise("heavy")
    out = F.when(col(day_mm).isNotNull(), level(col(day_mm), RAIN_DAY_CUTS))
    return out if next_3h_mm is None else out.when(col(next_3h_mm).isNotNull(), level(col(next_3h_mm), RAIN_3H_CUTS))


def alert_label(p, cutoff) -> Column:
    p, cutoff = col(p), cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return F.when(p.isNotNull(), F.when(p >= cutoff, "high").when(p >= cutoff * MEDIUM_FRACTION, "medium")
                  .otherwise("low"))


def label_rank(label) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LABELS]), col(label)) - 1


def undo_prior(p, multiplier) -> Column:
    """Undo the odds shift of training with positives weighted by ``multiplier``."""
    p, m = col(p), multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    return p / (m * (1 - p) + p)


def base_cost(seconds, slowed) -> Column:
    return col(seconds) * F.when(col(slowed), ROADWORK_FACTOR).otherwise(1.0)


def safe_cost(seconds, slowed, risk, label) -> Column:
    cost = base_cost(seconds, slowed) * (1 + RISK_WEIGHT * col(risk))
    return cost * F.when(col(label) == "high", HIGH_RISK_PENALTY).otherwise(1.0)


def rain_factor(level) -> Column:
    out = F.lit(1.0)
    for name, factor in RAIN_FACTOR.items():
        out = F.when(col(level) == name, factor).otherwise(out)
    return out


def lot_hazard(score, level) -> tuple[Column, Column]:
    """(hazard, label) of a lot under a rain level; an unknown level assumes full rain."""
    hazard = col(score) * rain_factor(level)
    return hazard, cutoff_label(hazard)


def model_features(panel: DataFrame) -> DataFrame:
    """The 13 model inputs as columns next to the panel's own (needs ``report_rate``)."""
    df = physical_baseline(panel)
    log_rain = F.log1p("rain_mm")
    log_rate = F.log1p("report_rate")
    return df.withColumns({
        "fema_risk_level": F.col("fema_risk_level").cast("double"),
        "is_tunnel": F.col("is_tunnel").cast("double"),
        "log_length": F.log1p("length"), "log_drain_count": F.log1p("drain_count"),
        "city": (F.col("jurisdiction") == "city").cast("double"),
        "log_rain": log_rain, "log_rain_lag1": F.log1p("rain_lag1_mm"), "log_rain_prior3": F.log1p("rain_prior3_mm"),
        "rain_x_static": log_rain * F.col("physical"),
        "log_report_rate": log_rate,
        "rain_x_history": log_rain * F.coalesce(log_rate, F.lit(0.0))})
