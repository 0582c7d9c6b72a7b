"""Session settings and lineage helpers shared by every job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sessions of one hot key are merged map-side before the shuffle.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
}


# Scratch folder of a local session that names none.
_LOCAL: dict[str, str] = {}


def build_session(app: str = "shelfspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs expect; cluster settings win over ours."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = _LOCAL.get("folder") or tempfile.mkdtemp(prefix="spark-shelfspark-")
    _LOCAL["folder"] = folder
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    The result survives lost executors, stops plans of loops from growing, and has a
    known size, so that later joins broadcast it only when it is small. Shuffle files that
    the write needed are removed when it ends, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    before = spark.conf.get(_FREED, "false")
    spark.conf.set(_FREED, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREED, before)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 200_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Broadcast a dimension whose row count is checked to be small; a larger one is left to Spark's own choice.

    Size estimates of derived tables are often far too high, and a shuffle of the fact
    table by a dimension key would put a hot store or product into one partition. The
    check reads at most ``rows`` + 1 rows of the dimension; pass narrow rows only.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
