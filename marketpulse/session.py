"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: The JVM never compiles a method of more than 8000 bytes; longer generated stages run operator by operator.
COMPILED = {"spark.sql.codegen.hugeMethodLimit": "8000"}
# Set on every session we build; a cluster's own submit-time values win for sizing
# (cores, memory, shuffle partitions), so none of those appear here.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    **COMPILED,
}

def local_session(cores: str = "*", app: str = "marketpulse", **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset (tests on one
    machine) it is a folder below the session's warehouse.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured.rstrip("/") if configured else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path in the session's own part of the shared folder.

    That part is removed when the session's JVM ends.
    """
    root = f"{shared_folder(spark)}/pulse-{spark.sparkContext.applicationId}"
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(location):
        files.mkdirs(location)
        files.deleteOnExit(location)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The frame written as a table in the shared folder and read back.

    For small results that a plan uses several times, such as an index's constituents: they
    are computed once, survive the loss of executors, and their size is known to the
    planner when it chooses join strategies.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
