"""Session settings and the two helpers every iterative job needs."""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StringType, StructType


def build_session(master: str | None = None, app: str = "highwater", partitions: int | None = None) -> SparkSession:
    """A session with UTC clocks and adaptive execution on. ``master`` is only for local use."""
    b = (SparkSession.builder.appName(app)
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.streaming.stateStore.providerClass",
                 "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = (b.master(master).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
             .config("spark.driver.host", "localhost"))
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def n_buckets(spark: SparkSession) -> int:
    """How many value ranges a distributed running sum is cut into."""
    return max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor can read.

    It is the cluster's to name. Only a local session that has none gets a temporary one.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can read")
            shared = tempfile.mkdtemp(prefix="highwater-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back.

    A checkpoint keeps the size estimate of the plan it replaces. Where a loop joins its state with something made from that
    state, the estimate is squared each round until planning takes longer than the work; files have their true size. Encoded
    files can be many times smaller than their rows, which would send large tables to the driver for a broadcast: a table that
    only looks small is written again as it is.
    """
    spark = df.sparkSession
    found = _kept(df)
    most = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    width = 8 + sum(_width(f.dataType) for f in df.schema.fields)
    if most > 0 and _estimate(found) <= most and found.count() * width > most:
        return _kept(found, compression="none", **{"parquet.enable.dictionary": "false"})
    return found


def _kept(df: DataFrame, **options: str) -> DataFrame:
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _estimate(df: DataFrame) -> int:
    """Bytes that joins take a table for."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _width(kind: DataType) -> int:
    """Bytes a value takes in memory; texts and lists count with a few dozen."""
    if isinstance(kind, StructType):
        return 16 + sum(_width(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return 24 + _width(kind.elementType)
    return 24 if isinstance(kind, StringType | BinaryType | MapType) else 8
