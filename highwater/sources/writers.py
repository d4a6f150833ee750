"""Writers. Every one is a distributed write; what the driver sees are counts."""
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from highwater.functions.geometry import col, round_path
from highwater.operators.checks import compare_keys
from highwater.operators.trips import upsert
from highwater.session import cut_lineage


def write_layer(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """The full population by day, in one job. Rows of a day are spread first, so no day is one task's work."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition("date", F.pmod(F.xxhash64("street_id"), F.lit(slices))).write.mode("overwrite").partitionBy("date").parquet(path)


def replace_keyed(df: DataFrame, path: str, key: str) -> dict:
    """Full refresh of a keyed set, then compare what was written with what should be."""
    df = cut_lineage(df)
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1).count()
    if repeated:
        raise ValueError(f"{key} repeats or is null; nothing written")
    df.write.mode("overwrite").parquet(path)
    r = compare_keys(df, df.sparkSession.read.parquet(path), key).first()
    if r["only_a"] or r["only_b"]:
        raise RuntimeError(f"written keys differ: {r['only_a']} missing, {r['only_b']} unexpected")
    return {"written": r["both"]}


# ------------------------------------------------------------------ versioned tables: readers follow a marker, never a folder in progress
def read_versioned(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest complete version, or None before the first."""
    v = _newest(spark, path)
    if v is None:
        return None
    manifest = _manifest(spark, path, v["version"])
    return spark.read.parquet(*(manifest.values() if manifest else [f"{path}/data/{v['version']}"]))


def _newest(spark: SparkSession, path: str):
    try:
        return spark.read.parquet(f"{path}/versions").agg(F.max(F.struct("seq", "version")).alias("m")).first()["m"]
    except AnalysisException:
        return None


def _manifest(spark: SparkSession, path: str, version: str) -> dict[int, str]:
    """bucket -> folder of a bucketed version; empty for a version written whole. As many rows as buckets."""
    folder = f"{path}/manifests/{version}"
    if not _exists(spark, folder):
        return {}
    return {r["bucket"]: r["folder"] for r in spark.read.schema("bucket int, folder string").parquet(folder).collect()}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_versioned(df: DataFrame, path: str) -> str:
    """Write a new version beside the old ones, then the marker that makes it current."""
    spark = df.sparkSession
    try:
        seq = spark.read.parquet(f"{path}/versions").agg(F.max("seq")).first()[0] + 1
    except (AnalysisException, TypeError):
        seq = 1
    version = f"v{seq:08d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path}/data/{version}")
    spark.createDataFrame([(seq, version)], "seq bigint, version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def upsert_table(changes: DataFrame, path: str, key: list[str], ts: str, buckets: int = 64, keep: int = 2) -> None:
    """Replace-or-insert into a versioned table that is cut into buckets by key hash.

    Only buckets with a change are read and written anew; a manifest lists, bucket by bucket, the folders that make up the
    version, most of them from versions before. The marker comes last, so readers see the old or the new version, and folders
    that none of the newest ``keep`` versions lists are removed. The number of buckets is the table's, fixed when it is made;
    choose it so that a bucket is what one change may cost to rewrite.
    """
    spark = changes.sparkSession
    now = _newest(spark, path)
    old = _manifest(spark, path, now["version"]) if now else {}
    if now and old:
        buckets = spark.read.parquet(f"{path}/buckets").first()["n"]
    changes = cut_lineage(changes.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")))
    touched = sorted(r["_bucket"] for r in changes.select("_bucket").distinct().collect())  # at most one number per bucket
    if not touched:
        return
    seq = now["seq"] + 1 if now else 1
    version = f"v{seq:08d}-{uuid.uuid4().hex[:8]}"
    before = [old[b] for b in touched if b in old] or ([f"{path}/data/{now['version']}"] if now and not old else [])
    base = spark.read.parquet(*before) if before else changes.drop("_bucket").limit(0)
    merged = upsert(base, changes.drop("_bucket"), key, ts).withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = f"{path}/data/{version}"
    merged.repartition("_bucket", F.pmod(F.xxhash64(*key, F.lit(1)), F.lit(slices))).write.partitionBy("_bucket").parquet(data)
    if now and not old:  # a table written whole before is cut up by its first change
        touched = [b for b in range(buckets) if _exists(spark, f"{data}/_bucket={b}")]
    if not old:
        spark.createDataFrame([(buckets,)], "n int").coalesce(1).write.mode("overwrite").parquet(f"{path}/buckets")
    folders = old | {b: f"{data}/_bucket={b}" for b in touched}
    spark.createDataFrame(sorted(folders.items()), "bucket int, folder string").coalesce(1).write.parquet(f"{path}/manifests/{version}")
    spark.createDataFrame([(seq, version)], "seq bigint, version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    _retire(spark, path, seq, keep)


def _retire(spark: SparkSession, path: str, seq: int, keep: int) -> None:
    """Remove bucket folders and manifests that none of the newest versions lists."""
    versions = spark.read.parquet(f"{path}/versions")
    live = [r["version"] for r in versions.where(F.col("seq") > seq - keep).collect()]
    used = {folder for v in live for folder in _manifest(spark, path, v).values()}
    last = [r["version"] for r in versions.where(F.col("seq") == seq - keep).collect()]
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for v in last:
        gone = [f for f in _manifest(spark, path, v).values() if f not in used] + [f"{path}/manifests/{v}"]
        for folder in gone:
            p = jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(conf).delete(p, True)


# ------------------------------------------------------------------ runs
def publish_run(scores: DataFrame, run: DataFrame, path: str) -> dict:
    """Publish a scoring run: scores first, counted, then the marker row, then runs of the scenario that were computed earlier
    are dropped. Later runs, and folders still being written, stay.

    Readers join through the marker table, so half a run is never seen; a failed run leaves no marker and publishing it
    again overwrites its own folder only.
    """
    spark = scores.sparkSession
    r = run.select("run_id", "scenario").first()
    scores = cut_lineage(scores)  # evaluated once: counted and written from the same rows
    want = scores.count()
    target = f"{path}/risk_scores/scenario={r['scenario']}/run_id={_safe(r['run_id'])}"
    scores.drop("scenario", "run_id").write.mode("overwrite").parquet(target)
    got = spark.read.parquet(target).count()
    if got != want:
        raise RuntimeError(f"{got} of {want} scores written; run not published")
    run.withColumn("folder", F.lit(target)).coalesce(1).write.mode("append").parquet(f"{path}/risk_runs")
    return {"run_id": r["run_id"], "written": got, "dropped": _drop_old_runs(spark, path, r["scenario"])}


def _safe(text: str) -> str:
    return text.replace(":", "-")


def _drop_old_runs(spark: SparkSession, path: str, scenario: str) -> int:
    """Remove the scenario's published folders whose run is older than the newest one, through the file system Spark itself uses."""
    runs = spark.read.parquet(f"{path}/risk_runs").where(F.col("scenario") == scenario)
    old = runs.join(runs.agg(F.max("computed_at").alias("_newest")), F.col("computed_at") < F.col("_newest")).select("folder").distinct()
    names = {r["folder"].rsplit("/", 1)[1] for r in old.collect()}  # one short string per published run
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parent = jvm.org.apache.hadoop.fs.Path(f"{path}/risk_scores/scenario={scenario}")
    fs = parent.getFileSystem(conf)
    dropped = 0
    for s in fs.listStatus(parent):
        if s.getPath().getName() in names:
            dropped += bool(fs.delete(s.getPath(), True))
    return dropped


def read_current_scores(spark: SparkSession, path: str, scenario: str) -> DataFrame | None:
    runs = spark.read.parquet(f"{path}/risk_runs").where(F.col("scenario") == scenario)
    r = runs.orderBy(F.desc("computed_at")).limit(1).select("folder", "run_id").first()
    return None if r is None else spark.read.parquet(r["folder"]).withColumn("run_id", F.lit(r["run_id"]))


# ------------------------------------------------------------------ GeoJSON
def to_geojson(df: DataFrame, geom: str, props: list[str], kind: str = "LineString", digits: int = 6) -> DataFrame:
    """One GeoJSON feature per row as text. ``geom``: line, rings (Polygon) or point column."""
    pair = lambda p: F.array(p["x"], p["y"])
    if kind == "Point":
        coords = F.array(F.bround(col(geom)["x"], digits), F.bround(col(geom)["y"], digits))
    elif kind == "Polygon":
        coords = F.transform(geom, lambda r: F.transform(round_path(r, digits), pair))
    else:
        coords = F.transform(round_path(geom, digits), pair)
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), coords.alias("coordinates")).alias("geometry"),
                       F.struct(*props).alias("properties"))
    return df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))
