"""Weights, ranges, cutoffs and word lists the results depend on."""

# --- road risk score -------------------------------------------------------------------------
RISK_WEIGHTS = {"fema_risk_level": 0.35, "elev_p10": 0.25, "flood_report_days": 0.20,
                "pct_impervious": 0.10, "sink_p90": 0.10}
RISK_RANGE = {"fema_risk_level": (0.0, 3.0), "elev_p10": (0.5, 5.0), "sink_p90": (0.0, 1.0)}
RISK_INVERT = {"elev_p10"}
RISK_PERCENTILE_WITHIN = {"flood_report_days": "jurisdiction"}
ZERO_WHEN_MISSING = ["flood_report_days", "drain_issue_days", "drains_per_100m"]
BRIDGE_CAP = 0.1
BASELINE_WEIGHTS = {"fema": 0.35, "low_ground": 0.25, "ponding": 0.10}

# --- flood zones -----------------------------------------------------------------------------
SUBTYPE_02PCT = "0.2 PCT ANNUAL CHANCE FLOOD HAZARD"
SUBTYPE_MINIMAL = "AREA OF MINIMAL FLOOD HAZARD"

# --- geometry --------------------------------------------------------------------------------
BBOX = (-80.39, 25.72, -80.18, 25.80)
TWIN_TOLERANCE_M = 1.0
SAMPLE_STEP_M = 10.0
MIN_SAMPLES = 5
REPORT_SNAP_M = 30.0
DRAIN_DISTANCE_M = 50.0
US_FOOT = 1200.0 / 3937.0
M_PER_DEG_LAT = 110540.0
M_PER_DEG_LON = 111320.0

# --- reports ---------------------------------------------------------------------------------
REPORTS_SINCE = "2022-01-01"
FLOOD_TYPES = ["COMPWSF", "FLOODING / STANDING WATER - LOCALIZED"]
DRAIN_TYPES = ["DRAIN CLOGGED / CLEANING", "DRAIN - REPAIR", "RER DRAINAGE CANALS FLOOD COMPLAINT", "CANAL - BLOCKED"]
INLET_TYPES = ["CATCH BASIN", "RISER CATCH BASIN", "YARD DRAIN"]

# --- closures --------------------------------------------------------------------------------
CLOSURE_EVENT_TYPES = ["roadwork", "closures"]
CLOSURE_SNAP_M = 30.0
CLOSURE_BUFFER_M = 20.0
CLOSURE_MIN_OVERLAP = 0.5
CLOSURE_TOLERANCE_DEG = 60.0
BEARINGS = {"northbound": 0.0, "eastbound": 90.0, "southbound": 180.0, "westbound": 270.0}
PROJECT_DONE = ["Const.Complete", "Closed"]
PROJECT_EXCLUDED_AGENCIES = ["FDOT"]
PROJECT_MAX_DAYS = 730

# --- parking ---------------------------------------------------------------------------------
POND_MIN_DEPTH_M = 0.10
HOTSPOT_MIN_DEPTH_M = 0.15
HOTSPOT_MIN_AREA_M2 = 50.0
ACCESS_NEAR_M = 25.0
ACCESS_FAR_M = 200.0
PARKING_WEIGHTS = {"pond_frac": 0.35, "pond_depth_p90": 0.20, "freeboard_p10_m": 0.20, "access_risk_min": 0.25}
PARKING_RANGE = {"pond_frac": (0.0, 0.5), "pond_depth_p90": (0.0, 0.5), "freeboard_p10_m": (0.5, -1.0),
                 "access_risk_min": (0.0, 1.0)}
NOT_SUGGESTED = ["Unnamed", "Loading Area", "Staff", "Compound"]
RAIN_FACTOR = {"none": 0.4, "light": 0.6, "moderate": 0.8, "heavy": 1.0}
SEARCH_MINUTES = {"garage": 5.0, "surface": 3.0, "street_side": 5.0}
SEARCH_DEFAULT_MINUTES = 3.0
PEAK_EXTRA_MINUTES = 4.0
PEAK_HOURS = (7.5, 11.0)
MAX_LOT_WALK_M = 800.0
MAX_WAYPOINTS = 3
WALK_M_PER_MIN = 80.0
WALK_DETOUR = 1.3

# --- labels and runs -------------------------------------------------------------------------
LABELS = ["low", "medium", "high"]
RISK_MEDIUM = 0.35
RISK_HIGH = 0.6
RAIN_DAY_CUTS = (1.0, 10.0, 25.0)
RAIN_3H_CUTS = (1.0, 7.5, 20.0)
MEDIUM_FRACTION = 0.5
RUN_STALE_HOURS = 3
MAP_LIMIT = 5000

# --- routing ---------------------------------------------------------------------------------
RISK_WEIGHT = 2.0
HIGH_RISK_PENALTY = 5.0
ROADWORK_FACTOR = 1.5
COMPROMISED_M = 200.0
COVERAGE_M = 300.0
FLOOD_DETOUR_MINUTES = 15.0
TRAFFIC_ALERT_MINUTES = 10.0
ALERT_LOOKAHEAD_HOURS = 12

# --- people ----------------------------------------------------------------------------------
SEVERITY_RANK = {"info": 0, "warning": 1, "critical": 2}
WEATHER_SEVERITY = {"Extreme": "critical", "Severe": "critical", "Moderate": "warning"}
ALERT_REFRESH_SECONDS = 60
ONLINE_PATTERN = r"(?i)\b(online|zoom|teams|remote|virtual)\b"
GENERIC_PLACE_WORDS = ["academic", "and", "annex", "building", "center", "centre", "complex", "field", "garage",
                       "hall", "health", "house", "lab", "laboratory", "labs", "library", "of", "parking", "the",
                       "tower", "towers"]
WEEKDAYS = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]

# --- model -----------------------------------------------------------------------------------
TIME_ZONE = "America/New_York"
WINDOWS = {"city": ("2022-10-01", "2024-08-09"), "county": ("2022-01-01", "2023-12-31")}
TRAIN_END = "2023-06-30"
VALIDATION_END = "2023-09-30"
SEED = 42
HISTORY_GAP_DAYS = 7
HISTORY_MIN_DAYS = 30
ROLLING_WINDOWS = [("2022-12-31", "2023-01-01", "2023-03-31"), ("2023-03-31", "2023-04-01", "2023-06-30"),
                   ("2023-06-30", "2023-07-01", "2023-09-30")]
RAIN_FEATURES = ["rain_mm", "rain_lag1_mm", "rain_prior3_mm"]
STATIC_FEATURES = ["fema_risk_level", "elev_p10", "sink_p90", "length", "drain_count", "is_tunnel"]
MODEL_FEATURES = ["fema_risk_level", "elev_p10", "sink_p90", "log_length", "log_drain_count", "is_tunnel", "city",
                  "log_rain", "log_rain_lag1", "log_rain_prior3", "rain_x_static", "log_report_rate",
                  "rain_x_history"]
ALERT_BUDGET = 0.01
STORM_RAIN = {"rain_mm": 80.0, "rain_lag1_mm": 30.0, "rain_prior3_mm": 60.0}

# --- texts -----------------------------------------------------------------------------------
TEXT = {
    "safe": "No high flood-risk roads on your usual route.",
    "no_alternative": "No safer route: your trip has to cross {m} of flood-prone road. Consider leaving later.",
    "on_street": "on {street}",
    "on_route": "on your usual route",
    "reroute": "High flood risk {where}. Take the safer route ({extra}).",
    "reroute_caution": "The safer route avoids {avoided} of flood-prone road but still crosses {m}. Drive carefully ({extra}).",
    "extra": "+{min} min",
    "no_extra": "no extra time",
    "start_outside": "Start is outside the mapped area; the route begins at the nearest mapped road ({km} km away).",
    "end_outside": "Destination is outside the mapped area; the route ends at the nearest mapped road ({km} km away).",
    "route_flood_title": "Flooding expected on your route to {event}",
    "route_flood": "Estimated flood levels are high on your usual route{around}. {advice} Leave by {time}.",
    "around": " around {street}",
    "advice_reroute": "Take the safer route.",
    "advice_caution": "Take the safer route and drive carefully: it avoids most of the flooding, not all of it.",
    "advice_none": "There is no safer way around. Drive carefully, or leave later if you can.",
    "parking_title": "{lot} may flood",
    "parking": "Estimated flood levels are high at {lot}. {instead}",
    "park_instead": "Park at {lot} instead.",
    "no_lot": "No nearby lot is clearly safer, so allow extra time.",
    "traffic_title": "Heavy traffic on the way to {event}",
    "traffic": "Traffic is heavier than usual. Leave by {time}.",
    "closure_title": "Road work on your route to {event}",
    "closure": "{name} is {what}. Your leave-by time already allows for it.",
    "closed": "closed",
    "works": "under construction",
    "weather": "The National Weather Service has issued this for your area{severity}. Avoid low-lying and flooded roads.",
    "weather_severity": " (severity: {level})",
    "tide_title": "High tide in Biscayne Bay",
    "tide": "Estimated water levels in Biscayne Bay are at the {level} flood level. Low-lying bayfront streets "
            "(Brickell, near the Miami River) may flood even without rain.",
}

# fixed values: what a forecast summary and a model's metadata say of themselves
PREDICTION_TARGET = "recorded_flood_report"
FORECAST_AREA = "FIU–Downtown/Brickell study network"
FORECAST_TEXTS = {
    "validation_status": "experimental_report_proxy",
    "summary_kind": "length_weighted_mean_of_modeled_street_ranks",
    "note": "Relative susceptibility summary, not the probability that this area floods",
}
METADATA_TEXTS = {
    "status": "experimental",
    "selection_rule": "Median average precision over rolling quarterly validation windows; mean ROC-AUC breaks ties",
    "test_evaluation": "Full eligible street-day populations; no negative sampling in tests",
}
