"""Results must not depend on what else is asked, nor change or vanish beyond some size."""
import datetime as d

import pytest
from pyspark.sql import functions as F

from highwater.operators import checks as C, graph as N, metrics as M, spatial as P, trips as R


def test_path_does_not_depend_on_other_pairs(spark):
    edges = [("a", "b", "a1"), ("a", "c", "a2"), ("b", "d", "z2"), ("c", "d", "z1"), ("x", "a", "x1")]
    df = spark.createDataFrame([(*e, "usual", 1.0) for e in edges], "u string, v string, edge_id string, kind string, cost double")
    routes = []
    for pairs in ([("a", "d")], [("a", "d"), ("x", "d")], [("a", "d"), ("a", "b"), ("a", "c"), ("a", "x")]):
        paths, _ = N.batch_paths(df, spark.createDataFrame(pairs, "source string, target string"))
        routes.append([r["edge_id"] for r in paths.where("source = 'a' and target = 'd'").orderBy("seq").collect()])
    assert routes == [["a1", "z2"]] * 3


def test_relative_score_with_many_knots(spark):
    n = 6000
    knots = spark.range(n).select(F.col("id").cast("int").alias("k"), F.pow(F.col("id") / (n - 1), 2.0).alias("p"))
    x = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.25, 0.81, 1.0, 1.5)], "p double")
    got = [r["relative"] for r in M.relative_score(x, knots).collect()]
    assert got == pytest.approx([0.0, 0.0, 0.5, 0.9, 1.0, 1.0], abs=1e-3)


def test_horizon_counts_every_gap(spark):
    days = [(i, d.date(2026, 1, 1) + d.timedelta(days=2 * i), 0.0, 0.0, 0.0, "u") for i in range(12)]
    got = {r["check"]: r["violations"] for r in C.check_horizon(spark.createDataFrame(
        days, "seq int, date date, rain_mm double, rain_lag1_mm double, rain_prior3_mm double, updated_at string")).collect()}
    assert got["not_consecutive"] == 11 and got["length"] == 1


def test_nearest_however_far(spark):
    nodes = spark.createDataFrame([("n", 0.0, 0.0), ("m", 5.0, 0.0)], "node_id string, x double, y double")
    points = spark.createDataFrame([("far", 1e12, 0.0), ("here", 1.0, 0.0), ("none", None, 0.0)], "point_id string, x double, y double")
    got = {r["point_id"]: r["node_id"] for r in P.nearest_node(points, nodes, 10.0).collect()}
    assert got == {"far": "m", "here": "n", "none": None}
    assert [r["node_id"] for r in P.nearest_node(points, nodes.limit(0), 10.0).collect()] == [None] * 3
    targets = nodes.withColumnRenamed("node_id", "target_id")
    found = {(r["point_id"], r["target_id"], r["rank"]) for r in R.nearest_k(points, targets, 2).collect()}
    assert found == {("far", "m", 1), ("far", "n", 2), ("here", "n", 1), ("here", "m", 2)}


def test_raster_column_out_of_range_raises(spark):
    cells = spark.createDataFrame([(-1, 0), (0, 0)], "cx int, cy int")
    with pytest.raises(Exception, match="raster column"):
        N.cell_components(cells).collect()
