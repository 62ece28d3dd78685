"""Checks, retention, storage layout and log statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fk_violations(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent row, with how many child rows carry them.

    Child rows are counted per value before the join, so a hot value is one row in it.
    """
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(F.col(parent_column).alias(column))
    return used.join(known, column, "left_anti")


def enum_violations(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values outside the allowed list with their row counts."""
    return df.where(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))


def retain(df: DataFrame, date_column: str, as_of: str, months: int | None) -> DataFrame:
    """Rows inside a rolling window; months None keeps everything."""
    if months is None:
        return df
    return df.where(F.col(date_column) >= F.add_months(F.lit(as_of).cast("date"), -months))


def write_sharded(prices: DataFrame, shards: DataFrame, path: str, by_month: bool = False) -> None:
    """Prices as a Parquet table partitioned by shard, and by month for very large ones.

    A shard can hold most tickers. The rebalance hint lets adaptive execution cut an
    oversized shard into several writers and merge small ones; rows are sorted inside each
    file, so ticker and date filters skip row groups.
    """
    folders = ["shard_id", "month"] if by_month else ["shard_id"]
    placed = prices.join(shards.select("ticker", "shard_id"), "ticker")
    if by_month:
        placed = placed.withColumn("month", F.date_format("date", "yyyy-MM"))
    balanced = placed.hint("rebalance", *folders).sortWithinPartitions(*folders, "ticker", "date")
    balanced.write.partitionBy(*folders).parquet(path)


def shards_of(shards: DataFrame, tickers: DataFrame) -> DataFrame:
    """The distinct shards that hold any of the given tickers."""
    return shards.join(tickers.select("ticker"), "ticker", "left_semi").select("shard_id").distinct()


def read_sharded(spark: SparkSession, path: str, schema: str, shards: DataFrame) -> DataFrame:
    """Only the named shards; the semi-join prunes directories at run time."""
    table = spark.read.schema(f"{schema}, shard_id string").parquet(path)
    return table.join(shards, "shard_id", "left_semi")


def exact_percentiles(df: DataFrame, key: str, value: str, fractions: Sequence[float]) -> DataFrame:
    """Exact discrete percentiles of a whole-number column per key.

    Built from counts per value (added up map-side), then per block of 1,000 values: the
    running totals never see single rows, so a key with a third of all rows is no heavier
    than its number of distinct values.
    """
    block = F.floor(F.col(value) / 1000)
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.withColumn("__block", block)
    blocks = counts.groupBy(key, "__block").agg(F.sum("__n").alias("__block_n"))
    of_key = Window.partitionBy(key)
    blocks = blocks.withColumns(
        {
            "__below": F.coalesce(
                F.sum("__block_n").over(
                    of_key.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
            "__total": F.sum("__block_n").over(of_key),
        }
    )
    inside = Window.partitionBy(key, "__block").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.join(blocks, [key, "__block"]).withColumn(
        "__upto", F.col("__below") + F.sum("__n").over(inside)
    )
    picks = [
        F.min(F.when(F.col("__upto") >= F.ceil(F.col("__total") * F.lit(f)), F.col(value))).alias(f"p{round(f * 100)}")
        for f in fractions
    ]
    return ranked.groupBy(key).agg(*picks)


def query_log_stats(logs: DataFrame) -> DataFrame:
    """Success rate, latency and result counts per generation method."""
    method = "generation_method"
    totals = logs.groupBy(method).agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
        F.avg("processing_time_ms").alias("avg_ms"),
        F.max("processing_time_ms").alias("max_ms"),
        F.sum("result_count").alias("results"),
    )
    return totals.join(exact_percentiles(logs, method, "processing_time_ms", (0.5, 0.95)), method)
