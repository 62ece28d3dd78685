from __future__ import annotations

from pyspark.sql import functions as F

from marketpulse.operators.ordering import top_per_key
from marketpulse.schemas import ARTICLE_KEY, SCORE_COLUMNS
from marketpulse.sources.store import ArticleStore
from marketpulse.streaming import ingest

SCHEMA = (
    "ticker string, headline string, date_posted string, source string, article_link string, "
    + ", ".join(f"{c} float" for c in SCORE_COLUMNS)
    + ", arrival_seq bigint"
)
SCORES = (0.1, 0.7, 0.2, 0.7)


def land(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def drain(spark, landing, out):
    stream = ingest.file_stream(spark, str(landing), SCHEMA)
    query = ingest.append_arrivals(stream, f"{out}/arrivals", f"{out}/checkpoint", F.to_timestamp(F.lit("2024-05-01")))
    query.awaitTermination()
    return spark.read.parquet(f"{out}/arrivals")


def test_arrivals_resolve_to_the_newest_batch_and_keep_scores(spark, tmp_path):
    none = (None,) * 4
    land(spark, tmp_path / "in", [("A", "h", "2024-01-01", "s1", "l1", *SCORES, 5), ("A", "h", "2024-01-01", "s0", "l0", *none, 3)])
    land(spark, tmp_path / "in", [("B", "h", None, "s", "l", *none, 6)])
    drain(spark, tmp_path / "in", tmp_path)
    land(spark, tmp_path / "in", [("A", "h", "2024-01-09", "s2", "l2", *SCORES, 9)])
    drain(spark, tmp_path / "in", tmp_path)
    land(spark, tmp_path / "in", [("A", "h", "2024-01-10", None, "l3", *none, 11)])
    arrivals = drain(spark, tmp_path / "in", tmp_path)
    assert arrivals.count() == 3
    row = ingest.resolve(arrivals).collect()
    assert len(row) == 1
    # Content of the last batch with its null, scores of the newest scored arrival.
    assert (row[0].date_posted, row[0].source, row[0].article_link) == ("2024-01-10", None, "l3")
    assert abs(row[0].compound_sentiment - 0.7) < 1e-6
    assert spark.read.parquet(str(tmp_path / "arrivals_rejects")).select("ticker").first().ticker == "B"
    # Nothing new: nothing changes.
    assert drain(spark, tmp_path / "in", tmp_path).count() == 3


def test_resolve_survives_a_hot_key(spark):
    none = F.lit(None).cast("float")
    arrivals = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "HOT").otherwise(F.concat(F.lit("K"), "id")).alias("ticker"),
        F.lit("h").alias("headline"),
        F.col("id").cast("string").alias("date_posted"),
        F.lit("s").alias("source"),
        F.lit("l").alias("article_link"),
        *(none.alias(c) for c in SCORE_COLUMNS),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.col("id").alias("arrival_seq"),
        (F.col("id") % 7).alias("batch_id"),
    )
    got = ingest.resolve(arrivals).select("ticker", "date_posted")
    want = top_per_key(arrivals, ARTICLE_KEY, [F.col("batch_id").desc(), F.col("arrival_seq")])
    assert got.exceptAll(want.select("ticker", "date_posted")).isEmpty() and got.count() == want.count()


def test_closed_windows_equal_the_batch_result(spark, tmp_path):
    schema = "ticker string, at timestamp, compound_sentiment double"
    days = [("A", f"2024-01-0{i} 10:00:00", 0.1 * i) for i in range(1, 6)] + [("A", "2024-01-03 11:00:00", None)]
    df = spark.createDataFrame(days, "ticker string, at string, compound_sentiment double")
    df.withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), schema)
    windows = ingest.windowed_sentiment(stream, "at")
    ingest.append_windows(windows, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(
        (str(r.start)[:10], round(r.score, 6), r.n_scored, r.n_articles)
        for r in spark.read.parquet(str(tmp_path / "out")).collect()
    )
    # The newest article is of the 5th: with a day of patience, days to the 3rd are closed.
    assert got == [("2024-01-01", 0.1, 1, 1), ("2024-01-02", 0.2, 1, 1), ("2024-01-03", 0.3, 1, 2)]


def test_repeats_across_batches_restart_and_compaction(spark, tmp_path):
    """Three micro-batches with repeats, one restart; a read after compaction touches later arrivals only."""
    store = ArticleStore(spark, str(tmp_path / "store"), folders=8)
    schema = SCHEMA + ", scraped_at timestamp"
    none = (None,) * 4

    def land_at(rows, moment):
        spark.createDataFrame(rows, SCHEMA).withColumn("scraped_at", F.to_timestamp(F.lit(moment))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = ingest.without_repeats(ingest.file_stream(spark, str(tmp_path / "in"), schema), "scraped_at").drop("scraped_at")
        ingest.append_arrivals(stream, f"{tmp_path}/arrivals", f"{tmp_path}/checkpoint", F.to_timestamp(F.lit("2024-05-01"))).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/arrivals")

    a, b = ("A", "h", "2024-01-01", "s", "l", *none, 1), ("B", "h", "2024-01-01", "s", "l", *SCORES, 2)
    land_at([a, a, b], "2024-01-01 10:00:00")
    assert run().count() == 2
    land_at([a, b], "2024-01-01 11:00:00")  # said again, after a restart
    assert run().count() == 2
    assert ingest.compact(store, f"{tmp_path}/arrivals") == 0
    assert store.articles.count() == 2
    land_at([("A", "h", "2024-01-02", "s", "moved", *none, 3), b, ("C", "h", "2024-01-01", "s", "l", *none, 4)], "2024-01-01 12:00:00")
    assert run().count() == 4
    now = ingest.current(store, f"{tmp_path}/arrivals")
    files = {f.split("/arrivals/")[1].split("/")[0] for f in now.inputFiles() if "/arrivals/" in f}
    read = ingest._arrivals_after(spark, f"{tmp_path}/arrivals", 0)
    (later,) = {r.batch_id for r in read.select("batch_id").distinct().collect()}  # batches without data have numbers too
    assert later > 0 and files
    assert "PartitionFilters: [isnotnull(batch_id" in read._jdf.queryExecution().executedPlan().toString()
    got = {r.ticker: (r.article_link, r.compound_sentiment is not None) for r in now.collect()}
    assert got == {"A": ("moved", False), "B": ("l", True), "C": ("l", False)}
    assert ingest.compact(store, f"{tmp_path}/arrivals") == later
    assert {r.ticker: r.article_link for r in store.articles.collect()} == {"A": "moved", "B": "l", "C": "l"}
    assert ingest.compact(store, f"{tmp_path}/arrivals") == later  # nothing new
    assert ingest.current(store, f"{tmp_path}/arrivals").count() == 3
