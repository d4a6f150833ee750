"""Report-likelihood models: fit, select, evaluate on every street-day, alert policy, scoring, publishing."""
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from highwater.functions.scoring import alert_label, model_features, physical_baseline, undo_prior
from highwater.functions.text import local_iso, run_id
from highwater.operators.checks import check_horizon
from highwater.operators.layers import street_table
from highwater.operators.metrics import budget_cutoff, confusion, metrics, reference_quantiles, relative_score, select_model
from highwater.operators.panel import add_weather, eligible_days, range_flags, report_history, split_summary, with_report_days
from highwater.operators.ranges import exact_quantiles
from highwater.operators.serving import area_index
from highwater.session import cut_lineage
from highwater.settings import (ALERT_BUDGET, BRIDGE_CAP, FORECAST_AREA, FORECAST_TEXTS, HISTORY_GAP_DAYS, HISTORY_MIN_DAYS, METADATA_TEXTS,
                                MODEL_FEATURES, PREDICTION_TARGET, RAIN_FEATURES, ROLLING_WINDOWS, SEED, STORM_RAIN, TRAIN_END, VALIDATION_END,
                                WINDOWS)


@dataclass
class Fitted:
    """A fitted model: medians and indicator columns decided on its training rows, the pipeline, the prior correction."""
    name: str
    medians: dict
    indicators: list
    pipeline: PipelineModel
    multiplier: float = 1.0

    def predict(self, panel: DataFrame, out: str = "p") -> DataFrame:
        """The panel with a probability column; needs ``report_rate`` and the rain columns."""
        x = _impute(_inputs(panel), self.medians, self.indicators)
        p = vector_to_array("probability")[1]
        done = self.pipeline.transform(x).withColumn(out, undo_prior(p, self.multiplier) if self.multiplier != 1.0 else p)
        return done.select(*panel.columns, out)


@dataclass
class Bundle:
    """Everything scoring needs."""
    model: Fitted
    reference: DataFrame
    history: DataFrame
    weather_max: dict
    version: str = "daily_report_v2"
    created_at: str = ""
    alert_model: Fitted | None = None
    alert_cutoff: float | None = None
    windows: dict = field(default_factory=lambda: WINDOWS)
    gap: int = HISTORY_GAP_DAYS
    min_days: int = HISTORY_MIN_DAYS


def _inputs(panel: DataFrame) -> DataFrame:
    f = model_features(panel)
    return f.select(*[F.col(c) for c in panel.columns], *[F.col(c).cast("double").alias(f"in_{c}") for c in MODEL_FEATURES])


def _impute(x: DataFrame, medians: dict, indicators: list) -> DataFrame:
    flagged = x.withColumns({f"miss_{c}": F.col(f"in_{c}").isNull().cast("double") for c in indicators}) if indicators else x
    return flagged.withColumns({f"in_{c}": F.coalesce(f"in_{c}", F.lit(medians[c])) for c in MODEL_FEATURES})


def fit(name: str, panel: DataFrame, iterations: int = 120) -> Fitted:
    """Median-impute (exact), flag what was missing, scale, fit. Weights are scaled to mean 1.

    Names: logistic, gradient_boosting, balanced_boosting (positives weighted up to balance, undone on output).
    """
    s = panel.agg(F.avg("sample_weight").alias("mean_w"), F.count(F.lit(1)).alias("n"),
                  F.sum(F.when(F.col("target") == 1, F.col("sample_weight"))).alias("w1"),
                  F.sum(F.when(F.col("target") == 0, F.col("sample_weight"))).alias("w0")).first()
    if s["w1"] is None or s["w0"] is None:
        raise ValueError("training needs positive and negative labels")
    x = _inputs(panel)
    medians, missing = _medians(x)
    multiplier = float(s["w0"] / s["w1"]) if name == "balanced_boosting" else 1.0
    w = F.col("sample_weight") * F.when(F.col("target") == 1, multiplier).otherwise(1.0)
    mean_w = (s["w1"] * multiplier + s["w0"]) / s["n"]
    train = _impute(x, medians, missing).withColumns({"_w": w / mean_w, "label": F.col("target").cast("double")})
    cols = [f"in_{c}" for c in MODEL_FEATURES] + [f"miss_{c}" for c in missing]
    stages = [VectorAssembler(inputCols=cols, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=True)]
    if name == "logistic":
        stages.append(LogisticRegression(featuresCol="x", weightCol="_w", maxIter=1000, regParam=1.0 / s["n"], elasticNetParam=0.0,
                                         standardization=False))
    elif name in ("gradient_boosting", "balanced_boosting"):
        stages.append(GBTClassifier(featuresCol="x", weightCol="_w", maxIter=iterations, maxDepth=3, minInstancesPerNode=60, stepSize=0.1,
                                    seed=SEED))
    else:
        raise ValueError(f"unknown model {name}")
    return Fitted(name, medians, missing, Pipeline(stages=stages).fit(train), multiplier)


def _medians(x: DataFrame) -> tuple[dict, list]:
    """Exact medians by rank in one pass over (feature, value) counts; an all-null feature is filled with 0."""
    long = x.select(F.explode(F.array(*[F.struct(F.lit(c).alias("f"), F.col(f"in_{c}").alias("v")) for c in MODEL_FEATURES])).alias("r")).select("r.*")
    med = {r["f"]: float(r["q"]) for r in exact_quantiles(long, ["f"], "v", [0.5]).collect()}  # one row per feature
    null = x.agg(*[F.count_if(F.col(f"in_{c}").isNull()).alias(c) for c in MODEL_FEATURES]).first()
    return {c: med.get(c, 0.0) for c in MODEL_FEATURES}, [c for c in MODEL_FEATURES if null[c] > 0]


def fit_balanced(panel: DataFrame, iterations: int = 120) -> Fitted:
    return fit("balanced_boosting", panel, iterations)


def rolling_validation(panel: DataFrame, names: list[str], windows=ROLLING_WINDOWS, iterations: int = 120) -> DataFrame:
    """Fit through each cutoff and score the following window: candidate, window, average_precision, roc_auc."""
    panel, parts = cut_lineage(panel), []
    for name in names:
        for i, (train_end, start, end) in enumerate(windows):
            model = fit(name, panel.where(F.col("date") <= F.lit(train_end).cast("date")), iterations)
            rows = panel.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
            m = metrics(cut_lineage(model.predict(rows)), "target", "p", "sample_weight")
            parts.append(m.select(F.lit(name).alias("candidate"), F.lit(i).alias("window"), "average_precision", "roc_auc"))
    return reduce(DataFrame.unionByName, parts)


def select_and_refit(panel: DataFrame, names=("logistic", "gradient_boosting"), windows=ROLLING_WINDOWS, iterations: int = 120):
    """Pick by median AP then mean AUC over the windows, refit on all development rows."""
    m = rolling_validation(panel, list(names), windows, iterations)
    winner = select_model(m).first()
    return fit(winner["candidate"], panel, iterations), m, winner


def population(streets: DataFrame, positives: DataFrame, weather: DataFrame, heldout: bool, first: str, last: str | None = None,
               windows: dict = WINDOWS, gap: int = HISTORY_GAP_DAYS, min_days: int = HISTORY_MIN_DAYS) -> DataFrame:
    """Every eligible street-day of a period, history frozen at its first day, weather attached."""
    told = with_report_days(streets.where(F.col("heldout_street") == heldout), positives)
    days = eligible_days(told, positives, windows, first, last)
    return add_weather(report_history(days, positives, windows, gap, min_days, freeze=first), weather)


def evaluate_population(pop: DataFrame, model: Fitted, prevalence: float) -> tuple[DataFrame, DataFrame]:
    """(predictions, metrics) for a full population: the model, the physical baseline and a constant. No sampling."""
    pred = cut_lineage(model.predict(physical_baseline(pop), "report_probability_estimate")).withColumn("_w", F.lit(1.0))  # inferred once
    named = [("model", "report_probability_estimate", True), ("physical_baseline", "physical", False), ("constant_baseline", "_c", True)]
    pred = pred.withColumn("_c", F.lit(float(prevalence)))
    m = reduce(DataFrame.unionByName, [metrics(pred, "target", c, "_w", "jurisdiction", prob).withColumn("scorer", F.lit(n)) for n, c, prob in named])
    return pred.select("street_id", "date", "jurisdiction", "target", "report_probability_estimate",
                       F.col("physical").alias("physical_baseline")), m


def fit_alert_policy(train: DataFrame, validation: DataFrame, budget: float = ALERT_BUDGET,
                     names=("logistic", "gradient_boosting", "balanced_boosting"), iterations: int = 120) -> dict:
    """Candidates fit on training rows only; the cutoff comes from the whole validation population; best recall, then precision."""
    best = None
    for name in names:
        model = fit(name, train, iterations)
        pred = cut_lineage(model.predict(validation))
        cutoff = budget_cutoff(pred, budget).first()["cutoff"]
        m = confusion(pred, cutoff, w=None).first()
        rank = (m["recall"] or 0.0, m["precision"] or 0.0)
        if best is None or rank > best["rank"]:
            best = {"name": name, "model": model, "cutoff": cutoff, "rank": rank, "metrics": m.asDict()}
    return best


def score_segments(segments: DataFrame, bundle: Bundle, days: DataFrame) -> DataFrame:
    """Scores for every edge and forecast day.

    Bridges and streets without any known feature get policy fallbacks and null alerts; both directions share one score.
    days: date, the three rain columns, source, updated_at. Bad rain stops the job.
    """
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf")) for c in RAIN_FEATURES])
    ok = F.coalesce(ok & (F.col("rain_prior3_mm") + 1e-9 >= F.col("rain_lag1_mm")) & F.col("updated_at").isNotNull()
                    & (F.trim("source") != ""), F.lit(False))
    d = days.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("bad weather input")).cast("boolean")))
    d = _flag_range(d, bundle.weather_max).withColumns({"valid_from": local_iso("date"), "valid_to": local_iso(F.date_add("date", 1))})
    streets = with_report_days(street_table(segments), bundle.history)
    grid = streets.select("*", _day_list(d).alias("_d")).select(
        *streets.columns, F.explode("_d").alias("w")).select(*streets.columns, "w.*")
    rated = physical_baseline(report_history(grid, bundle.history, bundle.windows, bundle.gap, bundle.min_days))
    p = bundle.model.predict(rated, "_p")
    p = relative_score(p, bundle.reference, "_p", "_relative")
    if bundle.alert_model is not None:
        p = p.withColumn("_ap", F.col("_p")) if bundle.alert_model is bundle.model else bundle.alert_model.predict(p, "_ap")
    supported = ~F.col("is_bridge") & (F.col("coverage") > 0)
    alert = F.when(supported, F.col("_ap")) if bundle.alert_model is not None else F.lit(None).cast("double")
    cutoff = F.lit(bundle.alert_cutoff).cast("double")
    out = p.select(
        "street_id", F.col("date").alias("forecast_date"),
        F.when(F.col("is_bridge"), F.least("physical", F.lit(BRIDGE_CAP))).when(supported, F.col("_relative")).otherwise(F.col("physical")).alias("risk_score"),
        F.when(supported, F.col("_p")).alias("report_probability_estimate"), alert.alias("alert_probability"),
        F.when(alert.isNotNull(), alert >= cutoff).alias("report_alert"),
        F.when(F.col("is_bridge"), "bridge_policy_fallback").when(supported, "model_reference_percentile").otherwise("physical_fallback").alias("score_source"),
        F.when(F.col("is_bridge"), "no_bridge_training_labels").when(~supported, "insufficient_static_features")
        .when(F.col("coverage") < 1, "partial_static_features").otherwise("").alias("score_note"),
        F.col("coverage").alias("feature_coverage"), "out_of_range", F.lit(bundle.version).alias("model_version"),
        "valid_from", "valid_to", F.col("source").alias("weather_source"), F.col("updated_at").alias("weather_updated_at"))
    return segments.select("edge_id", "street_id").join(out, "street_id")


def predict_horizon(segments: DataFrame, bundle: Bundle, days: DataFrame, area: str = FORECAST_AREA) -> tuple[DataFrame, DataFrame]:
    """(scores of every edge and day, one summary row per day) for a forecast of one to seven days.

    days: as ``score_segments``, with ``seq`` where their order matters. Days that are empty, too many, repeated, out of order or
    not consecutive, that lack rain or come from several retrievals stop the job, and so does an edge scored twice for a day.
    """
    ordered = days if "seq" in days.columns else days.withColumn("seq", F.datediff("date", F.lit("1970-01-01").cast("date")))
    wrong = [r["check"] for r in check_horizon(ordered).collect() if r["violations"]]  # one row per check
    if wrong:
        raise ValueError(f"bad forecast horizon: {', '.join(sorted(wrong))}")
    scored = cut_lineage(score_segments(segments, bundle, days.drop("seq")))
    if not scored.groupBy("edge_id", "forecast_date").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("an edge is scored twice for one day")
    same = [F.min(c).alias(c) for c in ("valid_from", "valid_to", "weather_source", "weather_updated_at", "model_version")]
    summary = area_index(scored, street_table(segments)).join(scored.groupBy("forecast_date").agg(*same), "forecast_date")
    return scored, summary.withColumns({
        "area": F.lit(area), "prediction_target": F.lit(PREDICTION_TARGET), "flood_probability_estimate": F.lit(None).cast("double"),
        **{k: F.lit(v) for k, v in FORECAST_TEXTS.items()}})


def model_metadata(panel: DataFrame, tables: dict[str, DataFrame], selected: str, validation: DataFrame, tests: DataFrame,
                   created_at: str, version: str = "daily_report_v2", training_end: str = TRAIN_END, refit_through: str = VALIDATION_END) -> DataFrame:
    """The row kept with a model: what it was trained on, how it was chosen, how it did, and fingerprints of its input tables.

    validation: rows of ``rolling_validation``; tests: rows of ``evaluate_population`` with the ``population`` they belong to. All
    three lists and the map hold one entry per split, fit, scorer and table.
    """
    def rows(df):
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns)))).scalar()

    prints = fingerprint(tables)
    data = prints.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("table", "fingerprint"))))).scalar()
    return panel.sparkSession.range(1).select(
        F.lit(version).alias("version"), F.lit(created_at).cast("timestamp").alias("created_at"), F.lit(selected).alias("selected_model"),
        F.array(*[F.lit(c) for c in MODEL_FEATURES]).alias("features"), F.lit(PREDICTION_TARGET).alias("prediction_target"),
        F.lit(training_end).cast("date").alias("training_end"), F.lit(refit_through).cast("date").alias("refit_through"),
        rows(split_summary(panel)).alias("splits"), data.alias("data_fingerprints"), rows(validation).alias("validation"), rows(tests).alias("tests"),
        *[F.lit(v).alias(k) for k, v in METADATA_TEXTS.items()])


def _flag_range(days: DataFrame, top: dict) -> DataFrame:
    over = reduce(lambda a, b: a | b, [F.col(c) > float(top[c]) for c in RAIN_FEATURES])
    return days.withColumn("out_of_range", over)


def _day_list(days: DataFrame) -> Column:
    """The forecast days (at most a week) as one array. What belongs to a day is worked out here, not once per street."""
    return days.agg(F.sort_array(F.collect_list(F.struct("date", *RAIN_FEATURES, "source", "updated_at", "out_of_range", "valid_from", "valid_to")))).scalar()


def make_bundle(model: Fitted, panel: DataFrame, positives: DataFrame, **kw) -> Bundle:
    pred = model.predict(panel)
    top = panel.agg(*[F.max(c).alias(c) for c in RAIN_FEATURES]).first().asDict()
    return Bundle(model=model, reference=reference_quantiles(pred, "p", "sample_weight"), history=positives.select("street_id", "date"),
                  weather_max=top, **kw)


def build_run(scenario: str, segments: DataFrame, bundle: Bundle, days: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(run row, street scores) for one day of weather, ready to publish. The storm scenario takes its fixed rain, whatever the
    day's; the run keeps the rain it was scored on."""
    if scenario == "storm":
        days = days.withColumns({c: F.lit(float(STORM_RAIN[c])) for c in RAIN_FEATURES})
    rain = days.agg(F.min_by(F.struct(*RAIN_FEATURES), "date")).scalar()
    scored = score_segments(segments, bundle, days)
    once = scored.groupBy("street_id").agg(F.min_by(F.struct("risk_score", "alert_probability", "score_source", "out_of_range"), "edge_id").alias("s")).select(
        "street_id", "s.*")
    rid = run_id(F.lit(now).cast("timestamp"), F.lit(scenario))
    scores = once.select("street_id", F.lit(scenario).alias("scenario"), rid.alias("run_id"), F.bround("risk_score", 6).alias("risk_score"),
                         alert_label("alert_probability", bundle.alert_cutoff).alias("risk_label"), "score_source", "out_of_range")
    counts = scores.agg(F.count(F.lit(1)).alias("streets_scored"), F.max("out_of_range").alias("out_of_range"),
                        *[F.count_if(F.coalesce("risk_label", F.lit("none")) == x).alias(x) for x in ("low", "medium", "high", "none")])
    run = counts.select(rid.alias("run_id"), F.lit(scenario).alias("scenario"), F.lit(now).cast("timestamp").alias("computed_at"),
                        F.lit(bundle.version).alias("model_version"), "streets_scored",
                        F.struct("low", "medium", "high", "none").alias("labels"),
                        F.struct(F.lit(bundle.alert_cutoff).alias("high_at"), F.lit(bundle.alert_cutoff * 0.5).alias("medium_at")).alias("label_rule"),
                        rain.alias("rain"), "out_of_range")
    return run, scores.drop("out_of_range")


def fingerprint(tables: dict[str, DataFrame]) -> DataFrame:
    """table, rows, fingerprint: independent of row order and partitioning.

    Row digests are added up in three numbers, a partial aggregate, instead of sorting all rows into one hash.
    """
    def one(name, df):
        digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        part = lambda i: F.sum(F.conv(F.substring(digest, i, 15), 16, 10).cast("decimal(38,0)"))
        return df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
                      F.sha2(F.concat_ws("|", part(1), part(16), part(31), F.count(F.lit(1))), 256).alias("fingerprint"))
    return reduce(DataFrame.unionByName, [one(k, v) for k, v in tables.items()])


__all__ = ["Bundle", "Fitted", "build_run", "evaluate_population", "fingerprint", "fit", "fit_alert_policy", "fit_balanced", "make_bundle",
           "model_metadata", "population", "predict_horizon", "range_flags", "rolling_validation", "score_segments", "select_and_refit"]
