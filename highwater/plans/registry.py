"""Registered queries: a DataFrame over the test tables and, where SQL can say the same, an independent SQL text."""
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from highwater.plans.projections import Tables, with_projections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a name."""
    def add(f):
        def run(spark: SparkSession, path: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(Tables(spark, path))
        run.__name__ = name
        QUERIES[name] = run
        if sql:
            CHECKS[name] = with_projections(sql)
        return f
    return add


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Floats rounded the way the SQL texts round theirs."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in names})


def text(df: DataFrame, *cols: str) -> DataFrame:
    """Dates and times as text, so both engines print them alike."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    return df.withColumns({c: F.col(c).cast("string") if kinds[c] == "date" else F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in cols})


def ts(sql: str) -> str:
    """SQL for the same text form of a timestamp."""
    return f"strftime({sql}, '%Y-%m-%d %H:%M:%S')"


def psd(px, py, ax, ay, bx, by) -> str:
    """SQL for point-to-segment distance."""
    t = (f"coalesce(least(greatest((({px}-{ax})*({bx}-{ax})+({py}-{ay})*({by}-{ay}))/nullif(power({bx}-{ax},2)+power({by}-{ay},2),0),0),1),0)")
    return f"sqrt(power({px}-{ax}-{t}*({bx}-{ax}),2)+power({py}-{ay}-{t}*({by}-{ay}),2))"
