"""Hot keys stay right and plans keep the shape that holds at size."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as contract
from marketpulse.operators import dedup, governance, hierarchy, ordering, prices, upsert
from marketpulse.plans import news
from marketpulse.sources.store import ArticleStore
from marketpulse.sources.views import Views


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows share one key, many of them the same minute or second."""
    base = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("K"), F.pmod("id", F.lit(700)))).alias("ticker"),
        F.lit("h").alias("headline"),
        F.lit("2024").alias("date_posted"),
        F.concat(F.lit("l"), "id").alias("article_link"),
        F.timestamp_seconds(F.col("id") * 37 % 100_000 - F.col("id") * 37 % 100_000 % 30).alias("created_at"),
        F.col("id").alias("arrival_seq"),
    )
    nulls = F.when(F.col("arrival_seq") % 50 > 0, F.col("created_at"))
    return base.withColumn("created_at", nulls)


@pytest.mark.parametrize("same_moment", [False, True])
def test_numbering_by_slices_equals_one_window(spark, hot, same_moment):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")  # or little data would end up in one slice
    try:
        _check_numbering(hot, same_moment)
    finally:
        spark.conf.set(setting, before)


def _check_numbering(hot, same_moment):
    if same_moment:  # all copies from one batch
        hot = hot.withColumn("created_at", F.timestamp_seconds(F.lit(0)))
    keys = ["ticker", "headline"]
    got = ordering.numbered_duplicates(hot, keys, "created_at", "arrival_seq").select("arrival_seq", "rn")
    whole = Window.partitionBy(*keys)
    want = (
        hot.withColumn("rn", F.row_number().over(whole.orderBy(F.col("created_at").asc_nulls_last(), "arrival_seq")))
        .withColumn("n", F.count(F.lit(1)).over(whole))
        .where("n > 1")
        .select("arrival_seq", "rn")
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert dedup.count_duplicates(hot).first().duplicate_rows == got.where("rn > 1").count()


def test_first_row_per_key_is_limited_before_the_shuffle(spark, small):
    text = plan(dedup.delete_duplicates(Views(spark, small).articles()))
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", text), text


def test_aggregations_merge_before_the_shuffle(spark, small):
    v = Views(spark, small)
    for df in (v.prices(), news.ticker_scores(v), governance.fk_violations(v.trades(), "ticker", v.shares(), "ticker")):
        before, after = plan(df).split("Exchange hashpartitioning", 1)
        assert "HashAggregate" in before and "partial_" in after


def test_scans_read_only_what_they_need(spark, small):
    text = plan(contract.queries()["articles_unscored"](spark, small))
    assert "l_tax" not in text
    text = plan(Views(spark, small).prices().select("ticker", "date", "close"))
    assert "ReadSchema" in text and "l_discount" not in text and "l_returnflag" not in text


def test_range_scan_filters_reach_parquet_and_prune_shards(spark, small, tmp_path):
    v = Views(spark, small)
    path = str(tmp_path / "prices")
    shards = v.shares().select("ticker", F.lower("sector").alias("shard_id"))
    governance.write_sharded(v.prices().select("ticker", "date", "close"), shards, path)
    schema = "ticker string, date date, close decimal(12,4)"
    table = spark.read.schema(f"{schema}, shard_id string").parquet(path)
    text = plan(prices.price_range(table, ["S1", "S2"], "1996-04-01", "1997-01-01").where("shard_id = 'asia'"))
    assert "In(ticker" in text and "GreaterThanOrEqual(date" in text and "PartitionFilters: [isnotnull(shard_id" in text


QUERIES = sorted(set(contract.queries()) - {"stream_ingest", "stream_daily_sentiment", "stream_weekly_sentiment"})


@pytest.mark.parametrize("name", QUERIES)
def test_no_plan_multiplies_rows(spark, small, name):
    text = plan(contract.queries()[name](spark, small))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A window over everything would be one task.
    assert "SinglePartition" not in text or "Window" not in text.split("SinglePartition")[0]


def test_exact_percentiles_equal_sorting(spark):
    df = spark.range(5001).select(F.lit("m").alias("k"), (F.col("id") * 7919 % 12_345).cast("int").alias("v"))
    values = sorted(r.v for r in df.collect())
    row = governance.exact_percentiles(df, "k", "v", (0.01, 0.5, 0.95)).first()
    n = len(values)
    assert (row.p1, row.p50, row.p95) == tuple(values[-(-n * p // 100) - 1] for p in (1, 50, 95))


def test_tree_nodes_add_up(spark):
    rows = [
        ("A", "S1", "I1", 10.0, 0.5), ("B", "S1", "I1", 30.0, -0.5), ("C", "S1", "I2", 5.0, None),
        ("D", "S2", "I3", 0.0, 0.9), ("E", None, "I3", 99.0, 0.9),
    ]
    frame = spark.createDataFrame(rows, "ticker string, sector string, industry string, mCap double, compound_sentiment double")
    got = {r.id: (r.value, r.color) for r in hierarchy.treemap(frame, "R").collect()}
    assert got["R"] == (45.0, -0.25) and got["R/S1"] == (45.0, -0.25) and got["R/S1/I2"] == (5.0, None)
    assert got["R/S2/I3/D"] == (0.0, None) and len(got) == 1 + 2 + 3 + 4


def test_upsert_is_idempotent_with_unique_keys(spark, small):
    v = Views(spark, small)
    once = upsert.upsert_articles(news.stored(v), news.batch(v), news.as_of())
    twice = upsert.upsert_articles(once, news.batch(v), news.as_of())
    assert once.count() == once.select("ticker", "headline").distinct().count()
    assert once.exceptAll(twice).isEmpty() and twice.exceptAll(once).isEmpty()


def test_upsert_reads_only_the_folders_of_its_keys(spark, small, tmp_path):
    v = Views(spark, small)
    store = ArticleStore(spark, str(tmp_path), folders=32)
    store.replace("article_data", news.stored(v).drop("arrival_seq"))
    path, folders = store._newest_articles()
    prepared = upsert.prepare_batch(news.batch(v), news.as_of())
    full = upsert.merge_articles(store.articles, prepared)
    touched = [r.b for r in prepared.select(store._bucket(folders).alias("b")).distinct().limit(3).collect()]
    part = store._in_folders(path, touched)
    assert "PartitionFilters: [isnotnull(bucket" in plan(part) or "bucket#" in plan(part).split("PartitionFilters", 1)[1][:80]
    assert 0 < part.count() < store.articles.count() == news.stored(v).count()
    own = prepared.where(store._bucket(folders).isin(touched))
    merged = upsert.merge_articles(part, own)
    assert merged.exceptAll(full.where(store._bucket(folders).isin(touched))).isEmpty()
