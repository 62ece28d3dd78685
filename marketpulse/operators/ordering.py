"""Row numbers and first rows per key that hold when one key owns a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized

def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of every key.

    Spark plans a row_number filter with a group limit *before* the shuffle, so each map
    task sends at most n rows per key and a hot key stays small.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")


def numbered_duplicates(
    df: DataFrame, keys: Sequence[str], moment: str, tie: str, name: str = "rn"
) -> DataFrame:
    """Rows of every key that occurs more than once, numbered in time order (nulls last).

    A window per key would bring all copies of a key into one task. Instead the copies are
    range-partitioned by key, time and tie, which cuts a hot key into many slices however
    its rows are spread, and written with their slice number. Rows are numbered inside
    their slice; counts per key and slice - a few rows per key - give each slice its offset.
    """
    keys = list(keys)
    order = [F.col(moment).asc_nulls_last(), F.col(tie).asc()]
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
    copies = df.join(repeated, keys, "left_semi")
    sliced = materialized(
        copies.repartitionByRange(*keys, *order).withColumn("__slice", F.spark_partition_id()), "slices"
    )
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "__slice")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, "__slice", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    return (
        sliced.join(offsets, [*keys, "__slice"])
        .withColumn(name, F.col("__before") + F.row_number().over(inside))
        .drop("__slice", "__before")
    )
