"""Every registered query against its SQL on the smallest tables, and the shape of the plans."""
import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def check(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canon(v):
    if v is None or v != v:
        return "~"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    try:
        f = float(v)
        return str(int(f)) if math.isfinite(f) and f == int(f) else repr(f)
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(canon(None if v is None or str(v) in ("NaT", "<NA>") else v) for v in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf, check, name):
    got, want = entry.queries()[name](spark, sf).toPandas(), check.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["segment_risk", "j3_point_in_zone", "j4_nearest_lines", "j9_pair_twins", "j13_report_history", "w2_pct_within", "w5_sample_negatives", "a15_metrics",
                                  "f16_map_box", "j16_resolve_location", "j15_pick_lot", "a22_describe_routes", "c3_events_with_queries", "x30_trip_alerts"])
def test_plans_have_no_cross_join_and_no_python(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert not [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF") if w in text]


def test_scan_is_pruned_and_filtered(spark, sf):
    text = plan(entry.queries()["s1_read_layer"](spark, sf))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text and "GreaterThan(l_quantity,30.0)" in text


def test_entry(spark):
    assert entry.entry(spark).columns == ["edge_id", "risk_score", "score_note"]
