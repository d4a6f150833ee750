"""Readers: landed files in, typed rows out. Schemas are explicit, so nothing is inferred from the data."""
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from highwater.functions.geometry import decode_polyline, line, point
from highwater.functions.text import edge_id, from_epoch_s
from highwater.operators.serving import inside_box
from highwater.settings import BBOX, CLOSURE_EVENT_TYPES
from highwater.sources.collections import feature_texts


def read_layer(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet layer, only the columns asked for."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def _feature_schema(props: str, geometry: str) -> str:
    return f"features array<struct<type:string,properties:struct<{props}>,geometry:{geometry}>>"


def feature_rows(pages: DataFrame) -> DataFrame:
    """GeoJSON pages (``features`` of _feature_schema with coordinates as text) -> the properties, ``geom_type``, and what the
    geometry is: ``rings`` of a polygon or multi-polygon, ``lines`` of a line or multi-line, ``points`` of a point or
    multi-point. The other two are null."""
    f = pages.select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    at = lambda depth: F.from_json(text, "array<" * depth + "double" + ">" * depth)
    xy = lambda p: point(p[0], p[1])
    paths = lambda nested: F.transform(nested, lambda path: F.transform(path, xy))
    return f.select("f.properties.*", kind.alias("geom_type"),
                    F.when(kind == "Polygon", paths(at(3))).when(kind == "MultiPolygon", paths(F.flatten(at(4)))).alias("rings"),
                    F.when(kind == "LineString", paths(F.array(at(2)))).when(kind == "MultiLineString", paths(at(3))).alias("lines"),
                    F.when(kind == "Point", F.transform(F.array(at(1)), xy)).when(kind == "MultiPoint", F.transform(at(2), xy)).alias("points"))


GEOMETRY_TEXT = "struct<type:string,coordinates:string>"


def read_features(spark: SparkSession, path: str, props: str, by_line: bool = False, split_bytes: int = 16 << 20) -> DataFrame:
    """GeoJSON collections -> one row per feature, as ``feature_rows``. ``props`` is DDL, e.g. "osm_id:string,name:string".

    A large collection is read by one task per ``split_bytes``. ``by_line`` is for files of one feature per line.
    """
    item = f"type string, properties struct<{props}>, geometry {GEOMETRY_TEXT}"
    if by_line:
        raw = spark.read.schema(item).json(path)
    else:
        raw = feature_texts(spark, path, split_bytes).select(F.from_json("feature", item).alias("f")).select("f.*")
    return feature_rows(raw.select(F.array(F.struct("type", "properties", "geometry")).alias("features")))


def read_graph_edges(spark: SparkSession, path: str) -> DataFrame:
    """GraphML edges -> u, v, key, edge_id."""
    x = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, _id string").load(path)
    return x.select(F.col("_source").cast("bigint").alias("u"), F.col("_target").cast("bigint").alias("v"),
                    F.col("_id").cast("int").alias("key"), edge_id("_source", "_target", "_id").alias("edge_id"))


def read_feature_pages(spark: SparkSession, path: str, attributes: str, id_col: str, geojson: bool = False) -> DataFrame:
    """Landed pages of a paged feature service; an id seen on two pages counts once. A page that holds the service's error fails.

    ``geojson`` pages have properties and geometry (see ``feature_rows``), the others ``attributes`` alone.
    """
    item = f"properties:struct<{attributes}>,geometry:{GEOMETRY_TEXT}" if geojson else f"attributes:struct<{attributes}>"
    raw = spark.read.option("multiLine", True).schema(f"features array<struct<{item}>>, error string").json(path)
    raw = raw.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("page holds an error: "), "error")).cast("boolean")))
    rows = feature_rows(raw) if geojson else raw.select(F.explode("features").alias("f")).select("f.attributes.*")
    return rows.dropDuplicates([id_col])


def read_daily_weather(spark: SparkSession, path: str) -> DataFrame:
    """Daily weather JSON of parallel arrays -> date, rain_mm, unit, zone."""
    raw = spark.read.option("multiLine", True).schema(
        "timezone string, daily_units struct<precipitation_sum:string>, "
        "daily struct<time:array<string>,precipitation_sum:array<double>>").json(path)
    z = raw.select("timezone", "daily_units.precipitation_sum", F.explode(F.arrays_zip(
        F.col("daily.time").alias("t"), F.col("daily.precipitation_sum").alias("mm"))).alias("d"))
    return z.select(F.to_date("d.t").alias("date"), F.col("d.mm").alias("rain_mm"),
                    F.col("precipitation_sum").alias("unit"), F.col("timezone").alias("zone"))


RAIN_POINT = ("latitude double, longitude double, minutely_15_units struct<precipitation:string>, "
              "minutely_15 struct<time:array<string>,precipitation:array<double>>")


def read_rain_quarters(spark: SparkSession, path: str) -> DataFrame:
    """15-minute rain, one object or a list of points -> lat, lon, t (UTC, naive in the file), mm. Units other than mm fail."""
    raw = spark.read.option("multiLine", True).schema(RAIN_POINT).json(path)  # a top-level list gives one row per element
    unit = F.col("minutely_15_units.precipitation")
    checked = raw.where(F.when(F.coalesce(unit == "mm", F.lit(False)), F.lit(True)).otherwise(
        F.raise_error(F.lit("15-minute rain must be in mm")).cast("boolean")))
    z = checked.select("latitude", "longitude", F.explode(F.arrays_zip(
        F.col("minutely_15.time").alias("t"), F.col("minutely_15.precipitation").alias("mm"))).alias("q"))
    return z.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.try_to_timestamp("q.t").alias("t"), F.col("q.mm").alias("mm"))


def read_tide(spark: SparkSession, path: str) -> DataFrame:
    """Tide JSON -> t, v_ft, kind (predicted or observed). Blank values are skipped."""
    item = "array<struct<t:string,v:string>>"
    raw = spark.read.option("multiLine", True).schema(f"predictions {item}, data {item}").json(path)
    parts = [raw.select(F.explode(c).alias("x"), F.lit(k).alias("kind")) for c, k in (("predictions", "predicted"), ("data", "observed"))]
    v = F.expr("try_cast(x.v as double)")
    return parts[0].unionByName(parts[1]).where(F.coalesce("x.v", F.lit("")) != "").select(
        F.try_to_timestamp("x.t", F.lit("yyyy-MM-dd HH:mm")).alias("t"), v.alias("v_ft"), "kind")


def read_weather_alerts(spark: SparkSession, path: str) -> DataFrame:
    props = ",".join(f"{c}:string" for c in ("id", "event", "severity", "urgency", "onset", "ends", "expires", "headline", "areaDesc"))
    raw = spark.read.option("multiLine", True).schema(_feature_schema(props, "string")).json(path)
    p = raw.select(F.explode("features").alias("f"))
    ts = lambda c: F.try_to_timestamp(f"f.properties.{c}")
    return p.select("f.properties.id", "f.properties.event", "f.properties.severity", "f.properties.urgency",
                    ts("onset").alias("onset"), ts("ends").alias("ends"), ts("expires").alias("expires"), "f.properties.headline",
                    F.col("f.properties.areaDesc").alias("area"), F.col("f.geometry").isNotNull().alias("has_polygon"))


TRAFFIC_EVENT = ("ID bigint, EventType string, RoadwayName string, DirectionOfTravel string, Latitude double, Longitude double, "
                 "LatitudeSecondary double, LongitudeSecondary double, StartDate bigint, PlannedEndDate bigint, "
                 "IsFullClosure boolean, EncodedPolyline string, LanesAffected string, Description string, "
                 "Organization string, Severity string")


def parse_traffic_events(events: DataFrame, types=CLOSURE_EVENT_TYPES, bbox=BBOX) -> DataFrame:
    """Traffic events -> closures in the box. Geometry: encoded line, else two points, else one."""
    two = (F.coalesce(F.col("LongitudeSecondary"), F.lit(0.0)) != 0) & (F.coalesce(F.col("LatitudeSecondary"), F.lit(0.0)) != 0) & ~(
        (F.col("LongitudeSecondary") == F.col("Longitude")) & (F.col("LatitudeSecondary") == F.col("Latitude")))
    decoded = decode_polyline("EncodedPolyline")
    geom = (F.when(F.coalesce(F.col("EncodedPolyline"), F.lit("")) != "",
                   F.when(F.size(F.array_distinct(decoded)) >= 2, decoded).otherwise(F.slice(decoded, 1, 1)))
            .when(F.col("Latitude").isNotNull() & F.col("Longitude").isNotNull(),
                  F.when(two, line("Longitude", "Latitude", "LongitudeSecondary", "LatitudeSecondary")).otherwise(line("Longitude", "Latitude"))))
    full = F.coalesce("IsFullClosure", F.lit(False))
    rows = events.where(F.col("EventType").isin(types)).select(
        F.concat(F.lit("fl511:"), F.col("ID").cast("string")).alias("closure_id"), F.lit("fl511").alias("source"),
        F.when(full | (F.col("EventType") == "closures"), "closure").otherwise("roadwork").alias("kind"), full.alias("full_closure"),
        F.col("DirectionOfTravel").alias("direction"), from_epoch_s("StartDate").alias("start"), from_epoch_s("PlannedEndDate").alias("end"),
        F.col("RoadwayName").alias("name"), F.col("Description").alias("description"), F.col("LanesAffected").alias("lanes_affected"),
        F.col("Organization").alias("agency"), F.col("Severity").alias("status"), geom.alias("geom"))
    return inside_box(rows.where(F.col("geom").isNotNull()), "geom", bbox)


def read_traffic_events(spark: SparkSession, path: str, types=CLOSURE_EVENT_TYPES, bbox=BBOX) -> DataFrame:
    return parse_traffic_events(spark.read.option("multiLine", True).schema(TRAFFIC_EVENT).json(path), types, bbox)


def read_lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small JSON list or object of known fields; anything else in the file, such as ``_comment`` keys, is left out."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def read_code_map(spark: SparkSession, path: str, value: str, key: str = "code") -> DataFrame:
    """A JSON object {code: {...}} -> one row per code. ``value`` is DDL of the inner object."""
    raw = spark.read.option("wholetext", True).text(path)
    m = raw.select(F.explode(F.from_json("value", f"map<string,struct<{value}>>")).alias(key, "v"))
    return m.where(~F.col(key).startswith("_")).select(key, "v.*")


def read_cells(spark: SparkSession, path: str, nodata: float | None = None) -> DataFrame:
    """Raster cells cx, cy, z; nodata, NaN and infinities become null."""
    return clean_cells(spark.read.parquet(path).select("cx", "cy", "z"), nodata)


def clean_cells(cells: DataFrame, nodata: float | None = None) -> DataFrame:
    bad = F.isnan("z") | F.col("z").isin(float("inf"), float("-inf"))
    if nodata is not None:
        bad = bad | (F.abs(F.col("z") - nodata) <= 1e-8 + 1e-5 * abs(nodata))
    return cells.withColumn("z", F.when(~bad, F.col("z")))
