"""The store's behaviour on the small tables it is specified with."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marketpulse.operators import scoring, upsert
from marketpulse.plans import jobs
from marketpulse.schemas import ARTICLE, SCORE_COLUMNS
from marketpulse.sources.store import ArticleStore

RAW = "ticker string, headline string, date_posted string, source string, article_link string, arrival_seq bigint"
UNSCORED = [
    ("AAPL", "Apple News", "2023-01-01", "SourceA", "link1", 1),
    ("GOOG", "Google News", "2023-01-02", "SourceB", "link2", 2),
]
SCORED = [
    ("MSFT", "Microsoft News", "2023-01-03", "SourceC", "link3", 0.1, 0.7, 0.2, 0.6),
    ("AMZN", "Amazon News", "2023-01-04", "SourceD", "link4", 0.2, 0.6, 0.2, 0.4),
]
META = [
    ("AAPL", "Tech", "Electronics", 2.5e12, "Apple Inc.", 1),
    ("GOOG", "Tech", "Internet", 1.8e12, "Alphabet Inc.", 2),
]


def when(text: str):
    return F.to_timestamp(F.lit(text))


def unscored(spark, rows=UNSCORED):
    return spark.createDataFrame(rows, RAW)


def scored(spark):
    names = "ticker string, headline string, date_posted string, source string, article_link string, "
    return spark.createDataFrame(SCORED, names + ", ".join(f"{c} double" for c in SCORE_COLUMNS))


@pytest.fixture
def store(spark, tmp_path):
    return ArticleStore(spark, str(tmp_path / "store"))


@pytest.fixture
def filled(store, spark):
    store.insert_articles(unscored(spark), when("2023-02-01"))
    store.insert_articles(scored(spark), when("2023-02-01"), has_sentiment=True)
    return store


def test_new_store_is_empty(store):
    assert store.get_articles().count() == 0
    assert store.get_ticker_metadata().count() == 0


def test_insert_is_idempotent_and_unscored(store, spark):
    for _ in range(3):
        store.insert_articles(unscored(spark), when("2023-02-01"))
    rows = store.articles.collect()
    assert len(rows) == 2 and {r.ticker for r in rows} == {"AAPL", "GOOG"}
    assert all(r[c] is None for r in rows for c in SCORE_COLUMNS)


def test_reads(filled):
    assert filled.get_articles(n=1).first().ticker == "AMZN"
    oldest = filled.get_articles(n=1, latest=False, has_sentiment=False).first()
    assert oldest.ticker == "AAPL" and oldest.compound_sentiment is None
    dates = [r.date_posted for r in filled.get_articles(n=4).collect()]
    assert len(dates) == 4 and dates == sorted(dates, reverse=True)
    after = filled.get_articles(n=10, after_date="2023-01-02").collect()
    assert {r.ticker for r in after} == {"GOOG", "MSFT", "AMZN"}


def test_unscored_reinsert_keeps_scores_and_updates_content(filled, spark):
    again = [("MSFT", "Microsoft News", "2023-01-09", None, "moved", 7)]
    filled.insert_articles(unscored(spark, again), when("2023-03-01"))
    row = filled.articles.where("ticker = 'MSFT'").first()
    assert (row.date_posted, row.source, row.article_link) == ("2023-01-09", None, "moved")
    assert abs(row.compound_sentiment - 0.6) < 1e-6 and str(row.created_at).startswith("2023-03-01")
    assert filled.articles.count() == 4


def test_scored_insert_overwrites_scores_under_either_naming(filled, spark):
    named = scored(spark).withColumnsRenamed(
        dict(zip(SCORE_COLUMNS, ("Negative", "Positive", "Neutral", "compound")))
    )
    changed = named.withColumn("compound", F.lit(-0.9))
    filled.insert_articles(changed, when("2023-03-01"), has_sentiment=True)
    assert {round(r.compound_sentiment, 4) for r in filled.articles.where("ticker in ('MSFT','AMZN')").collect()} == {-0.9}


def test_first_arrival_wins_inside_a_batch(store, spark):
    rows = [("A", "h", "2023-01-05", "late", "l", 9), ("A", "h", "2023-01-01", "early", "e", 2)]
    store.insert_articles(unscored(spark, rows), when("2023-02-01"))
    assert store.articles.first().source == "early"


def test_rows_without_required_columns_are_split_out(store, spark):
    rows = [("A", "h", None, "s", "l", 1), (None, "h", "2023", "s", "l", 2), ("B", "", "2023", None, None, 3)]
    batch = unscored(spark, rows)
    _, rejects = upsert.split_rejects(batch)
    assert rejects.count() == 2
    store.insert_articles(batch, when("2023-02-01"))
    assert [r.ticker for r in store.articles.collect()] == ["B"]


def test_scored_insert_needs_score_columns(store, spark):
    with pytest.raises(ValueError, match="lacks columns"):
        store.insert_articles(unscored(spark), when("2023-02-01"), has_sentiment=True)


def test_metadata_last_arrival_wins(store, spark):
    schema = "ticker string, sector string, industry string, mCap double, companyName string, arrival_seq int"
    store.insert_ticker_metadata(spark.createDataFrame(META, schema))
    later = [("GOOG", "Tech", "Ads", 1.0, "Alphabet", 1), ("GOOG", "Tech", "Search", 2.0, "Alphabet", 2)]
    store.insert_ticker_metadata(spark.createDataFrame(later, schema))
    got = {r.ticker: (r.industry, r.mCap) for r in store.get_ticker_metadata().collect()}
    assert got == {"AAPL": ("Electronics", pytest.approx(2.5e12)), "GOOG": ("Search", 2.0)}


def test_incomplete_snapshot_is_ignored(filled, tmp_path):
    before = filled.articles.count()
    (tmp_path / "store" / "article_data" / "snapshot=00000099").mkdir()
    assert filled.articles.count() == before
    filled.insert_articles(filled.articles.withColumn("arrival_seq", F.lit(1)), when("2023-02-01"))
    assert filled.articles.count() == before


def test_index_constituents_validates_the_flag(store, spark):
    schema = "ticker string, ISIN_Code string, idx_50 boolean, idx_100 boolean"
    store.write_universe(spark.createDataFrame([("A", "x", True, True), ("B", "y", False, True)], schema))
    assert [r.ticker for r in store.get_index_constituents("idx_50").collect()] == ["A"]
    with pytest.raises(ValueError):
        store.get_index_constituents("ticker")


def test_deduplicate_keeps_the_earliest(store, spark):
    rows = [
        ("A", "h", "2023-01-01", None, "l1", None, None, None, None, "2023-01-03 00:00:00"),
        ("A", "h", "2023-01-02", None, "l2", None, None, None, None, "2023-01-01 00:00:00"),
        ("A", "h", "2023-01-03", None, "l3", None, None, None, None, "2023-01-02 00:00:00"),
    ]
    text = ARTICLE.replace("created_at timestamp", "created_at string").replace(" not null", "")
    df = spark.createDataFrame(rows, text).withColumn("created_at", F.to_timestamp("created_at"))
    store.replace("article_data", df)
    found = store.query_duplicates().orderBy("rn").collect()
    assert [(r.rn, r.article_link) for r in found] == [(2, "l3"), (3, "l1")]
    store.deduplicate()
    assert [r.article_link for r in store.articles.collect()] == ["l2"]


def test_score_backlog_job(filled):
    jobs.compute_and_update_sentiment(filled, scoring.score_with_lexicon, when("2023-04-01"), n=1)
    got = {r.ticker: r.compound_sentiment for r in filled.articles.collect()}
    assert got["GOOG"] is not None and got["AAPL"] is None
    jobs.compute_and_update_sentiment(filled, scoring.score_with_lexicon, when("2023-04-01"))
    assert filled.get_articles(has_sentiment=False).count() == 0
    snapshots = filled._snapshots("article_data")
    jobs.compute_and_update_sentiment(filled, scoring.score_with_lexicon, when("2023-04-01"))
    assert filled._snapshots("article_data") == snapshots


def test_collect_and_dashboard_jobs(store, spark):
    schema = "ticker string, ISIN_Code string, idx_50 boolean"
    store.write_universe(spark.createDataFrame([("SBIN", "x", True), ("OUT", "y", False)], schema))
    page = (
        '<div class="z4rs2b"><a href="http://n/1"><div class="sfyJob">Paper</div>'
        '<div class="Yfwt5"> Profit up </div><div class="Adak">2 hours ago</div></a></div>'
        '<div class="z4rs2b"><div class="Yfwt5">No link</div></div>'
    )
    pages = spark.createDataFrame(
        [("SBIN", "GoogleFinance", "u", page), ("OUT", "GoogleFinance", "u", page), ("SBIN", "Finology", "u", "<p>")],
        "ticker string, site string, url string, html string",
    ).withColumn("as_of", F.to_timestamp(F.lit("2024-03-31 10:11:12")))
    rejects = jobs.collect_news(store, pages, "idx_50", when("2024-03-31"))
    assert sorted(r.problem for r in rejects.collect()) == ["missing element", "no items"]
    row = store.articles.first()
    assert (row.ticker, row.headline, row.date_posted, row.article_link) == (
        "SBIN", "Profit up", "2024-03-31 08:11:12", "http://n/1",
    )
    meta = "ticker string, sector string, industry string, mCap double, companyName string, arrival_seq int"
    store.insert_ticker_metadata(spark.createDataFrame([("SBIN", "Fin", "Bank", 10.0, "Bank", 1)], meta))
    jobs.compute_and_update_sentiment(store, scoring.score_with_lexicon, when("2024-04-01"))
    tree = {r.id: (r.level, r.value, r.parent) for r in jobs.dashboard(store, "ALL").collect()}
    assert tree == {
        "ALL": (0, 10.0, ""),
        "ALL/Fin": (1, 10.0, "ALL"),
        "ALL/Fin/Bank": (2, 10.0, "ALL/Fin"),
        "ALL/Fin/Bank/SBIN": (3, 10.0, "ALL/Fin/Bank"),
    }


def test_repeated_keys_without_arrival_order_stay_unique(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "unique"))
    rows = [("T", "headline", "2024-01-01 00:00:00", "s", "l1", "t1"), ("T", "headline", "2024-01-01 00:00:00", "s", "l2", "t2"), (None, "h", "2024-01-01 00:00:00", "s", "l", "t")]
    batch = spark.createDataFrame(rows, "ticker string, headline string, date_posted string, source string, article_link string, article_text string")
    batch = batch.withColumn("date_posted", F.to_timestamp("date_posted"))
    rejects = [store.insert_articles(batch.select([c for c in batch.columns]), F.to_timestamp(F.lit("2024-01-02 00:00:00"))) for _ in range(3)]
    assert rejects == [1, 1, 1]
    assert store.articles.count() == 1


def test_an_upsert_rewrites_only_the_folders_of_its_keys(spark, tmp_path):
    store = ArticleStore(spark, str(tmp_path / "folders"), folders=64)
    rows = [(f"T{i % 50}", f"headline {i}", f"2024-01-{i % 28 + 1:02d}", "s", "l", i) for i in range(4000)]
    store.insert_articles(unscored(spark, rows), when("2024-02-01"))
    table = tmp_path / "folders" / "article_data"
    before = {p: (p.stat().st_mtime_ns, p.read_bytes()) for p in table.rglob("*.parquet")}
    assert len(before) == 64
    jobs.compute_and_update_sentiment(store, scoring.score_with_lexicon, when("2024-03-01"), n=20)
    after = {p: p.stat().st_mtime_ns for p in table.rglob("*.parquet")}
    same = [p for p in before if after.get(p) == before[p][0]]
    assert 64 - 20 <= len(same) < 64 and all(p.read_bytes() == before[p][1] for p in same)
    assert store.articles.count() == 4000 and store.articles.where("compound_sentiment is not null").count() == 20
    assert len(after) == 64  # one file a folder


def test_other_folder_count_keeps_the_rows(filled):
    before = sorted(map(tuple, filled.articles.collect()), key=str)
    filled.relayout(3)
    assert sorted(map(tuple, filled.articles.collect()), key=str) == before
    filled.insert_articles(filled.articles.withColumn("arrival_seq", F.lit(1)), when("2023-02-01"))
    assert filled.articles.count() == len(before)
    assert filled._newest_articles()[1] == 3


def test_retention(filled, tmp_path):
    assert filled.forget_articles("2023-01-03") == 2
    assert {r.ticker for r in filled.articles.collect()} == {"MSFT", "AMZN"}
    assert filled.forget_articles("2023-01-03") == 0


def test_old_snapshots_expire_after_their_readers(store, spark):
    schema = "ticker string, sector string, industry string, mCap double, companyName string, arrival_seq int"
    meta = spark.createDataFrame(META, schema)
    assert store.insert_ticker_metadata(meta) == 0
    reader = store.get_ticker_metadata()
    assert store.insert_ticker_metadata(meta.withColumn("sector", F.when(F.col("ticker") == "AAPL", F.col("sector")))) == 1
    assert store.expire_snapshots("ticker_meta", 0) == []  # replaced just now: a reader may still hold it
    assert reader.count() == 2
    assert store.expire_snapshots("ticker_meta", 1 << 50) == [1]
    assert store._snapshots("ticker_meta") == [2] and store.get_ticker_metadata().count() == 2
    assert store.expire_rejects("ticker_meta", 0) == 0 and store.expire_rejects("ticker_meta", 1 << 50) == 1


def test_news_of_one_stock(filled):
    assert [r.headline for r in filled.get_articles(ticker="MSFT").collect()] == ["Microsoft News"]
