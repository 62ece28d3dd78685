"""Scans of Parquet tables with explicit schemas (no inference job, pruned columns)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import GIVEN


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(GIVEN[name]).parquet(f"{folder}/{name}.parquet")


def spread_if_small(df: DataFrame, path: str) -> DataFrame:
    """Spread a small input over all cores before costly per-row work.

    A file is read by at most one task per row group, so a few small files would leave most
    cores idle. Inputs that fill every core with full splits anyway are left alone: there
    the shuffle would cost more than it gains, and nothing larger than cores x split size
    is ever moved.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if stored_bytes(spark, path) < cores * split else df


def broadcast_if_small(df: DataFrame, *paths: str) -> DataFrame:
    """Ask for a broadcast of a dimension whose files are well below Spark's own limit.

    A dimension built from joined tables has no usable size estimate, and the planner would
    broadcast the other side instead. Above a quarter of the limit (Parquet is compressed)
    no hint is given and the planner chooses.
    """
    return F.broadcast(df) if small_enough(df.sparkSession, *paths) else df


def small_enough(spark: SparkSession, *paths: str) -> bool:
    """Whether the files at the paths are below a quarter of Spark's broadcast limit."""
    limit = _bytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return sum(stored_bytes(spark, p) for p in paths) * 4 <= limit


def stored_bytes(spark: SparkSession, path: str) -> int:
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(location).getLength()


def _bytes(setting: str) -> int:
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", setting.strip().lower()).groups()
    return int(number) * units.get(unit or "b", 1)
