"""Tables that look small on disk, and edge tables that are not kept whole for queries that read a few columns."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from highwater.functions.geometry import box_ring, line
from highwater.operators import spatial as P
from highwater.session import stored


def test_a_stored_table_is_not_taken_for_its_encoded_size(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    try:
        size = lambda df: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        rows = spark.range(100_000, numPartitions=2).select((F.col("id") % 3).alias("a"), F.lit(1).cast("long").alias("b"))
        kept = stored(rows)
        assert size(kept) > 1_000_000 and kept.count() == 100_000 and kept.agg(F.sum("a")).first()[0] == 99_999
        assert size(stored(rows.limit(1000))) < 200_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["a7_access_roads", "j9_pair_twins", "a25_polygon_stats"])
def test_edges_are_not_kept(spark, sf, name):
    spark.catalog.clearCache()
    assert "InMemoryRelation" not in entry.queries()[name](spark, sf)._jdf.queryExecution().withCachedData().toString()


def test_twins_meet_once(spark):
    """Parallel edges, ties, loops and an edge that comes twice."""
    rows = [("a", 1, 2, 0., 9.), ("b", 2, 1, 0., 9.), ("c", 2, 1, 0., 9.), ("d", 2, 1, .5, 9.5), ("e", 3, 3, 50., 51.), ("f", 3, 3, 50., 51.), ("g", 5, 4, 90., 95.), ("h", 4, 5, 93., 98.), ("a", 1, 2, 0., 9.), ("i", 1, None, 0., 9.)]
    e = spark.createDataFrame(rows, "edge_id string, u int, v int, x0 double, x1 double").select("edge_id", "u", "v", line("x0", F.lit(0.0), (F.col("x0") + F.col("x1")) / 2, F.lit(0.0), "x1", F.lit(0.0)).alias("geom"))
    got = sorted((r["edge_id"], r["twin_id"], r["twin_m"], r["street_id"]) for r in P.pair_twins(e).select("edge_id", "twin_id", "twin_m", "street_id").collect())
    none = lambda k: (k, None, None, k)
    assert got == [("a", "b", 0.0, "a"), ("a", "b", 0.0, "a"), ("b", "a", 0.0, "a"), none("c"), none("d"), ("e", "f", 0.0, "e"), ("f", "e", 0.0, "e"), none("g"), none("h"), none("i")]


def test_a_twin_of_unknown_distance_comes_first(spark):
    """A line with an unknown vertex has no distance to another such line; that leaves the edge without a twin, as before."""
    rows = [("a", 1, 2, None), ("b", 2, 1, None), ("c", 2, 1, 5.), ("d", 4, 5, 5.), ("e", 5, 4, 5.)]
    e = spark.createDataFrame(rows, "edge_id string, u int, v int, xm double").select("edge_id", "u", "v", line(F.lit(0.0), F.lit(0.0), "xm", F.lit(0.0), F.lit(9.0), F.lit(0.0)).alias("geom"))
    assert {r["edge_id"]: r["twin_id"] for r in P.pair_twins(e).collect()} == {"a": None, "b": None, "c": None, "d": "e", "e": "d"}


def test_polygon_stats_of_odd_rows(spark):
    rows = [("in", "s", .2, 1., 9.), ("in", "s", .4, 2., 8.), ("half", "s", .9, 5., 15.), ("two", None, .6, 3., 4.), ("two", "t", .8, 30., 40.), ("lost", None, .7, 6., 7.)]
    e = spark.createDataFrame(rows, "edge_id string, street_id string, risk_score double, a double, b double").select(
        "edge_id", "street_id", "risk_score", line("a", "a", "a", "b", "b", "b").alias("geom"))
    z = spark.createDataFrame([(1, 0., 0., 10., 10.), (2, 100., 100., 110., 110.)], "zone int, x0 double, y0 double, x1 double, y1 double").withColumn("rings", box_ring("x0", "y0", "x1", "y1"))
    got = [r.asDict() for r in P.polygon_stats(e, z, "zone").collect()]
    assert [(r["zone"], r["edges"], r["risk_min"], r["risk_max"], r["streets"]) for r in got] == [(1, 3, .2, .7, 2)] and abs(got[0]["risk_avg"] - 1.3 / 3) < 1e-12
