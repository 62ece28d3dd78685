"""Queries over articles: scans, reads, upserts, duplicates, aggregation, the tree map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import compound, label_columns, weighted_mean
from ..operators import articles as A
from ..operators import dedup, scoring, upsert
from ..operators.governance import retain
from ..operators.hierarchy import dashboard_join as join_meta
from ..operators.hierarchy import index_treemap as tree_of_index
from ..operators.hierarchy import dashboard_names, treemap
from ..operators.indices import active_on
from ..schemas import MODEL_OUT, SCORE_COLUMNS
from ..sources.views import Views
from .registry import query, r6
from .sql_views import with_views

ROOT = "ALL"
SPLIT = "2024-01-16"
AS_OF = "2024-02-01 00:00:00"

STORE_SQL = """ticker, headline, date_posted, source, article_link,
  round(negative_sentiment::DOUBLE, 6) AS negative_sentiment, round(positive_sentiment::DOUBLE, 6) AS positive_sentiment,
  round(neutral_sentiment::DOUBLE, 6) AS neutral_sentiment, round(compound_sentiment::DOUBLE, 6) AS compound_sentiment,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"""


def store_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "ticker",
        "headline",
        "date_posted",
        "source",
        "article_link",
        *(r6(c) for c in SCORE_COLUMNS),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


def stored(v: Views) -> DataFrame:
    """Articles of the first half of the month, one per key."""
    early = v.articles().where(F.col("created_at") < F.to_timestamp_ntz(F.lit(f"{SPLIT} 00:00:00")))
    return dedup.delete_duplicates(early).drop("arrival_seq")


def whole(v: Views) -> DataFrame:
    """All articles, one per key."""
    return dedup.delete_duplicates(v.articles()).drop("arrival_seq")


def batch(v: Views) -> DataFrame:
    """Articles of the second half, copies included."""
    return v.articles().where(F.col("created_at") >= F.to_timestamp_ntz(F.lit(f"{SPLIT} 00:00:00")))


# --- scans and reads ------------------------------------------------------------------------
@query(with_views("meta", body='SELECT ticker, sector, industry, "mCap", "companyName" FROM meta'))
def ticker_meta_scan(v: Views) -> DataFrame:
    return v.meta()


@query(with_views("univ", body="SELECT ticker FROM univ WHERE idx_50"))
def index_constituents(v: Views) -> DataFrame:
    return A.index_constituents(v.universe(), "idx_50")


@query(with_views("art", body=f"SELECT {STORE_SQL} FROM art WHERE compound_sentiment IS NULL"))
def articles_unscored(v: Views) -> DataFrame:
    return store_rows(A.filter_articles(v.articles(), has_sentiment=False))


@query(with_views("art", body=f"SELECT {STORE_SQL} FROM art WHERE date_posted >= '2024-01-20'"))
def articles_after_date(v: Views) -> DataFrame:
    return store_rows(A.filter_articles(v.articles(), after_date="2024-01-20"))


@query(
    with_views(
        "art",
        body=f"SELECT {STORE_SQL} FROM (SELECT * FROM art "
        "ORDER BY date_posted DESC, ticker, headline, arrival_seq LIMIT 20)",
    )
)
def articles_latest_n(v: Views) -> DataFrame:
    return store_rows(A.get_articles(v.articles()))


@query(
    with_views(
        "art",
        body=f"SELECT {STORE_SQL} FROM (SELECT * FROM art "
        "ORDER BY date_posted ASC, ticker, headline, arrival_seq LIMIT 20)",
    )
)
def articles_oldest_n(v: Views) -> DataFrame:
    return store_rows(A.get_articles(v.articles(), latest=False))


@query(
    with_views(
        "art",
        body=f"""SELECT {STORE_SQL} FROM (
  SELECT * FROM art WHERE compound_sentiment IS NULL AND date_posted >= '2024-01-10'
  ORDER BY date_posted DESC, ticker, headline, arrival_seq LIMIT 200)""",
    )
)
def get_articles(v: Views) -> DataFrame:
    return store_rows(A.get_articles(v.articles(), n=200, has_sentiment=False, after_date="2024-01-10"))


@query(
    with_views(
        "art",
        body="""SELECT * FROM (
  SELECT ticker, nullif(headline, 'error {"k": 1}') AS headline, date_posted, article_link FROM art)
WHERE headline IS NOT NULL""",
    )
)
def drop_null_headline(v: Views) -> DataFrame:
    gaps = v.articles().select(
        "ticker",
        F.nullif(F.col("headline"), F.lit('error {"k": 1}')).alias("headline"),
        "date_posted",
        "article_link",
    )
    return A.drop_without_headline(gaps)


@query(with_views("art", body="SELECT count(DISTINCT ticker) AS n_tickers FROM art"))
def distinct_tickers(v: Views) -> DataFrame:
    return v.articles().agg(F.countDistinct("ticker").alias("n_tickers"))


@query(
    with_views(
        "art",
        body="""SELECT source, count(*) AS collected, count(nullif(headline, 'error {"k": 1}')) AS with_headline,
  count(*) FILTER (WHERE date_posted < '2024-01-30') AS dated_before_cutoff,
  count(compound_sentiment) AS scored, count(DISTINCT (ticker, headline)) AS distinct_articles
FROM art GROUP BY source""",
    )
)
def ingest_counts(v: Views) -> DataFrame:
    return (
        v.articles()
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("collected"),
            F.count(F.nullif(F.col("headline"), F.lit('error {"k": 1}'))).alias("with_headline"),
            F.count_if(F.col("date_posted") < "2024-01-30").alias("dated_before_cutoff"),
            F.count("compound_sentiment").alias("scored"),
            F.countDistinct(F.struct("ticker", "headline")).alias("distinct_articles"),
        )
    )


# --- upserts and duplicates -----------------------------------------------------------------
@query(
    with_views(
        "stored",
        "batch",
        body=f"""SELECT {STORE_SQL} FROM (
  SELECT coalesce(s.ticker, b.ticker) AS ticker, coalesce(s.headline, b.headline) AS headline,
         CASE WHEN b.ticker IS NULL THEN s.date_posted ELSE b.date_posted END AS date_posted,
         CASE WHEN b.ticker IS NULL THEN s.source ELSE b.source END AS source,
         CASE WHEN b.ticker IS NULL THEN s.article_link ELSE b.article_link END AS article_link,
         s.negative_sentiment, s.positive_sentiment, s.neutral_sentiment, s.compound_sentiment,
         CASE WHEN b.ticker IS NULL THEN s.created_at ELSE TIMESTAMP '{AS_OF}' END AS created_at
  FROM stored s FULL JOIN batch b ON s.ticker = b.ticker AND s.headline = b.headline)""",
    )
)
def upsert_no_sentiment(v: Views) -> DataFrame:
    return store_rows(upsert.upsert_articles(stored(v), batch(v), as_of()))


@query(
    with_views(
        "stored",
        "batch",
        body=f"""SELECT {STORE_SQL} FROM (
  SELECT ticker, headline, date_posted, source, article_link, negative_sentiment, positive_sentiment,
         neutral_sentiment, compound_sentiment, TIMESTAMP '{AS_OF}' AS created_at FROM batch
  UNION ALL
  SELECT ticker, headline, date_posted, source, article_link, negative_sentiment, positive_sentiment,
         neutral_sentiment, compound_sentiment, created_at
  FROM stored s WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.ticker = s.ticker AND b.headline = s.headline))""",
    )
)
def upsert_with_sentiment(v: Views) -> DataFrame:
    named = batch(v).withColumnsRenamed(
        {
            "negative_sentiment": "Negative",
            "positive_sentiment": "Positive",
            "neutral_sentiment": "Neutral",
            "compound_sentiment": "compound",
        }
    )
    return store_rows(upsert.upsert_articles(stored(v), named, as_of(), has_sentiment=True))


@query(
    with_views(
        "meta",
        body="""SELECT ticker, sector, industry,
  CASE WHEN c_mktsegment = 'BUILDING' THEN round("mCap" * 2, 2) ELSE "mCap" END AS "mCap",
  CASE WHEN c_mktsegment = 'BUILDING' THEN "companyName" || ' Ltd' ELSE "companyName" END AS "companyName"
FROM meta JOIN customer ON c_name = "companyName"
UNION ALL
SELECT 'S' || s_suppkey, 'NEW', 'NEW', round(s_acctbal + 1000, 2), s_name FROM supplier""",
    )
)
def upsert_ticker_meta(v: Views) -> DataFrame:
    """Two arrivals for every BUILDING company (the later one counts) and all-new tickers."""
    segment = v._table("customer").select(F.col("c_name").alias("companyName"), "c_mktsegment")
    changed = v.meta().join(segment, "companyName").where("c_mktsegment = 'BUILDING'")
    columns = ["ticker", "sector", "industry"]
    early = changed.select(*columns, (F.col("mCap") * 3).alias("mCap"), "companyName", F.lit(1).alias("arrival_seq"))
    late = changed.select(
        *columns,
        F.round(F.col("mCap") * 2, 2).alias("mCap"),
        F.concat("companyName", F.lit(" Ltd")).alias("companyName"),
        F.lit(2).alias("arrival_seq"),
    )
    new = v._table("supplier").select(
        F.concat(F.lit("S"), "s_suppkey").alias("ticker"),
        F.lit("NEW").alias("sector"),
        F.lit("NEW").alias("industry"),
        F.round(F.col("s_acctbal") + 1000, 2).alias("mCap"),
        F.col("s_name").alias("companyName"),
        F.lit(1).alias("arrival_seq"),
    )
    return upsert.upsert_ticker_meta(v.meta(), early.unionByName(late).unionByName(new))


DUPLICATES_SQL = """SELECT rn, ticker, headline, date_posted, article_link,
  strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM (SELECT *, row_number() OVER (PARTITION BY ticker, headline ORDER BY created_at, arrival_seq) AS rn FROM art)"""


@query(with_views("art", body=f"{DUPLICATES_SQL} WHERE rn > 1"))
def query_duplicates(v: Views) -> DataFrame:
    text = F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")
    return dedup.query_duplicates(v.articles()).withColumn("created_at", text)


@query(
    with_views(
        "art",
        body="""SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows, count(*) FILTER (WHERE n > 1) AS duplicated_keys
FROM (SELECT count(*) AS n FROM art GROUP BY ticker, headline)""",
    )
)
def duplicate_count(v: Views) -> DataFrame:
    return dedup.count_duplicates(v.articles())


@query(
    with_views(
        "art",
        body=f"""SELECT {STORE_SQL} FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker, headline ORDER BY created_at, arrival_seq) AS rn FROM art)
WHERE rn = 1""",
    )
)
def delete_duplicates(v: Views) -> DataFrame:
    return store_rows(dedup.delete_duplicates(v.articles()))


@query(
    with_views(
        "art",
        "qlog",
        body="""SELECT 'articles' AS kind, article_link AS id FROM art WHERE created_at >= TIMESTAMP '2024-01-10'
UNION ALL SELECT 'logs', log_id FROM qlog WHERE timestamp >= TIMESTAMP '2024-01-15'""",
    )
)
def retention_window(v: Views) -> DataFrame:
    """Two years of articles and one year of logs, each seen from its own cut-off day."""
    kept = retain(v.articles(), "created_at", "2026-01-10", 24)
    logs = retain(v.query_logs(), "timestamp", "2025-01-15", 12)
    return kept.select(F.lit("articles").alias("kind"), F.col("article_link").alias("id")).unionByName(
        logs.select(F.lit("logs").alias("kind"), F.col("log_id").alias("id"))
    )


# --- scores ---------------------------------------------------------------------------------
@query(
    with_views(
        "raw_scores",
        body="""SELECT event_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE,
  round_even(CASE WHEN p > n THEN p ELSE -n END, 4))) AS compound FROM raw_scores""",
    )
)
def compound_score(v: Views) -> DataFrame:
    return v.events().select("event_id", compound(v.probability(37), v.probability(53)).alias("compound"))


@query(
    with_views(
        "raw_scores",
        body="""SELECT event_id, p::FLOAT::DOUBLE AS "Positive", n::FLOAT::DOUBLE AS "Negative",
  (1 - p - n)::FLOAT::DOUBLE AS "Neutral",
  round_even(CASE WHEN p::FLOAT > n::FLOAT THEN p::FLOAT ELSE -n::FLOAT END::DOUBLE, 4) AS compound FROM raw_scores""",
    )
)
def label_pivot(v: Views) -> DataFrame:
    """Model output lists without their zero labels, back to one column per label."""
    p, n = v.probability(37), v.probability(53)
    entries = F.array(
        *(
            F.struct(F.lit(label).alias("label"), value.cast("float").alias("score"))
            for label, value in (("Neutral", 1 - p - n), ("Positive", p), ("Negative", n))
        )
    )
    outputs = F.filter(entries, lambda item: item["score"] != 0).cast(MODEL_OUT)
    rows = v.events().select("event_id", outputs.alias("outputs"))
    labels = rows.select("event_id", *label_columns(F.col("outputs")))
    return labels.select("event_id", *(F.col(c).cast("double").alias(c) for c in labels.columns[1:]))


def _hits(words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"(len(list_filter(words, lambda w: w IN ({listed}))) + 1)"


def lexicon_sql(source: str, keys: str, text: str) -> str:
    """The word-list scorer as SQL: words are unbroken runs of a-z in the lowered text."""
    return f"""SELECT {keys}, (pos / total)::FLOAT AS "Positive", (neg / total)::FLOAT AS "Negative",
       (neu / total)::FLOAT AS "Neutral"
FROM (SELECT {keys}, {_hits(scoring.POSITIVE_WORDS)}::DOUBLE AS pos, {_hits(scoring.NEGATIVE_WORDS)}::DOUBLE AS neg,
             {_hits(scoring.NEUTRAL_WORDS)}::DOUBLE AS neu, pos + neg + neu AS total
      FROM (SELECT {keys}, string_split_regex(lower({text}), '[^a-z]+') AS words FROM {source}))"""


SCORES_SQL = """round("Positive"::DOUBLE, 6) AS "Positive", round("Negative"::DOUBLE, 6) AS "Negative",
  round("Neutral"::DOUBLE, 6) AS "Neutral",
  round_even(CASE WHEN "Positive" > "Negative" THEN "Positive" ELSE -"Negative" END::DOUBLE, 4) AS compound"""


@query(f"SELECT doc_id, {SCORES_SQL} FROM ({lexicon_sql('documents', 'doc_id', 'text')})")
def score_articles(v: Views) -> DataFrame:
    scored = scoring.score_with_lexicon(v.documents(), "text")
    return scored.select("doc_id", r6("Positive"), r6("Negative"), r6("Neutral"), "compound")


@query(f"SELECT doc_id, {SCORES_SQL} FROM ({lexicon_sql('documents', 'doc_id', 'text')})")
def score_articles_model(v: Views) -> DataFrame:
    """The same scores through the model interface (one load per task, Arrow batches)."""
    scored = scoring.score_with_model(v.documents(), scoring.lexicon_scorer, "text")
    return scored.select("doc_id", r6("Positive"), r6("Negative"), r6("Neutral"), "compound")


@query(
    with_views(
        "art",
        body=f"""SELECT ticker, headline, {SCORES_SQL.replace(' AS "Positive"', ' AS "Positive_lexicon"')
        .replace(' AS "Negative"', ' AS "Negative_lexicon"').replace(' AS "Neutral"', ' AS "Neutral_lexicon"')
        .replace(' AS compound', ' AS compound_lexicon')},
  round("Positive"::DOUBLE, 6) AS "Positive_model", round("Negative"::DOUBLE, 6) AS "Negative_model",
  round("Neutral"::DOUBLE, 6) AS "Neutral_model",
  round_even(CASE WHEN "Positive" > "Negative" THEN "Positive" ELSE -"Negative" END::DOUBLE, 4) AS compound_model
FROM ({lexicon_sql('(SELECT DISTINCT ticker, headline FROM art)', 'ticker, headline', 'headline')})""",
    )
)
def model_comparison(v: Views) -> DataFrame:
    unique = dedup.delete_duplicates(v.articles()).select("ticker", "headline")
    both = scoring.compare_scorers(
        scoring.score_with_lexicon(unique),
        scoring.score_with_model(unique, scoring.lexicon_scorer),
        ("_lexicon", "_model"),
    )
    return both.select(
        "ticker", "headline", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in both.columns[2:])
    )


@query(
    with_views(
        "whole",
        body=f"""SELECT {STORE_SQL} FROM (
  SELECT s.ticker, s.headline, s.date_posted, s.source, s.article_link, x."Negative" AS negative_sentiment,
         x."Positive" AS positive_sentiment, x."Neutral" AS neutral_sentiment,
         round_even(CASE WHEN x."Positive" > x."Negative" THEN x."Positive" ELSE -x."Negative" END::DOUBLE, 4)
           AS compound_sentiment, s.created_at
  FROM whole s JOIN ({lexicon_sql("(SELECT * FROM whole WHERE source <> 'view')", 'ticker, headline', 'headline')}) x
    ON s.ticker = x.ticker AND s.headline = x.headline)""",
    )
)
def attach_scores(v: Views) -> DataFrame:
    articles = whole(v)
    scores = scoring.score_with_lexicon(articles.where("source <> 'view'").select("ticker", "headline"))
    return store_rows(upsert.attach_scores(articles, scores))


@query(
    with_views(
        "whole",
        body=f""", todo AS (
  SELECT * FROM whole WHERE compound_sentiment IS NULL ORDER BY date_posted DESC, ticker, headline LIMIT 200),
done AS ({lexicon_sql('todo', 'ticker, headline', 'headline')})
SELECT {STORE_SQL} FROM (
  SELECT s.ticker, s.headline, s.date_posted, s.source, s.article_link,
         coalesce(d."Negative", s.negative_sentiment) AS negative_sentiment,
         coalesce(d."Positive", s.positive_sentiment) AS positive_sentiment,
         coalesce(d."Neutral", s.neutral_sentiment) AS neutral_sentiment,
         coalesce(round_even(CASE WHEN d."Positive" > d."Negative" THEN d."Positive" ELSE -d."Negative" END::DOUBLE, 4)::FLOAT,
                  s.compound_sentiment) AS compound_sentiment,
         CASE WHEN d.ticker IS NULL THEN s.created_at ELSE TIMESTAMP '{AS_OF}' END AS created_at
  FROM whole s LEFT JOIN done d ON s.ticker = d.ticker AND s.headline = d.headline)""",
    )
)
def score_backlog(v: Views) -> DataFrame:
    return store_rows(scoring.score_backlog(whole(v), scoring.score_with_lexicon, as_of(), n=200))


# --- aggregation and the tree map ---------------------------------------------------------------
MEANS_SQL = """avg(negative_sentiment) AS negative_sentiment, avg(positive_sentiment) AS positive_sentiment,
  avg(neutral_sentiment) AS neutral_sentiment, avg(compound_sentiment) AS compound_sentiment"""
MEANS6_SQL = """round(negative_sentiment, 6) AS negative_sentiment, round(positive_sentiment, 6) AS positive_sentiment,
  round(neutral_sentiment, 6) AS neutral_sentiment, round(compound_sentiment, 6) AS compound_sentiment"""


@query(
    with_views(
        "art", body=f"SELECT ticker, {MEANS6_SQL} FROM (SELECT ticker, {MEANS_SQL} FROM art GROUP BY ticker)"
    )
)
def ticker_scores(v: Views) -> DataFrame:
    return A.ticker_scores(v.articles()).select("ticker", *(r6(c) for c in SCORE_COLUMNS))


@query(
    with_views(
        "art",
        "meta",
        body=f"""SELECT m.ticker, sector, industry, "mCap" AS "Market Cap (Billion Rs)", "companyName",
  round(neutral_sentiment, 6) AS "Neutral", round(positive_sentiment, 6) AS "Positive",
  round(negative_sentiment, 6) AS "Negative", round(compound_sentiment, 6) AS "Sentiment Score"
FROM meta m JOIN (SELECT ticker, {MEANS_SQL} FROM art GROUP BY ticker) s ON m.ticker = s.ticker""",
    )
)
def dashboard_join(v: Views) -> DataFrame:
    scores = A.ticker_scores(v.articles()).select("ticker", *(r6(c) for c in SCORE_COLUMNS))
    return dashboard_names(join_meta(v.meta(), scores))


def _treemap_sql(source: str) -> str:
    return f"""SELECT
  concat_ws('/', '{ROOT}', CASE WHEN lvl >= 1 THEN sector END, CASE WHEN lvl >= 2 THEN industry END,
            CASE WHEN lvl >= 3 THEN ticker END) AS id,
  CASE WHEN lvl = 0 THEN '' ELSE concat_ws('/', '{ROOT}', CASE WHEN lvl >= 2 THEN sector END,
            CASE WHEN lvl >= 3 THEN industry END) END AS parent,
  CASE lvl WHEN 0 THEN '{ROOT}' WHEN 1 THEN sector WHEN 2 THEN industry ELSE ticker END AS label,
  lvl::INT AS level, round(value, 4) AS value, round(color, 6) AS color
FROM (SELECT sector, industry, m.ticker AS ticker, 3 - grouping(sector) - grouping(industry) - grouping(m.ticker) AS lvl,
             sum("mCap") AS value,
             sum("mCap" * s.score) / nullif(sum("mCap") FILTER (WHERE s.score IS NOT NULL), 0) AS color
      FROM meta m JOIN (SELECT ticker, avg(compound_sentiment) AS score FROM {source} GROUP BY ticker) s
        ON m.ticker = s.ticker
      GROUP BY ROLLUP (sector, industry, m.ticker))"""


def tree_rows(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"value": F.round("value", 4), "color": F.round("color", 6)})


@query(with_views("art", "meta", body=_treemap_sql("art")))
def sentiment_treemap(v: Views) -> DataFrame:
    """The dashboard over all articles."""
    return tree_rows(treemap(join_meta(v.meta(), A.ticker_scores(v.articles())), ROOT))


@query(
    with_views(
        "art",
        "meta",
        body=", newest AS (SELECT * FROM art ORDER BY date_posted DESC, ticker, headline, arrival_seq LIMIT 20)\n"
        + _treemap_sql("newest"),
    )
)
def sentiment_treemap_latest20(v: Views) -> DataFrame:
    """The dashboard as coded: the default read of the 20 latest articles."""
    newest = A.get_articles(v.articles())
    return tree_rows(treemap(join_meta(v.meta(), A.ticker_scores(newest)), ROOT))


NEWS_TICKER = "T7"


@query(
    with_views(
        "art",
        body=f"""SELECT ticker, headline, date_posted, source, article_link, round(compound_sentiment::DOUBLE, 6) AS compound_sentiment
FROM art WHERE ticker = '{NEWS_TICKER}'""",
    )
)
def ticker_news(v: Views) -> DataFrame:
    """All news of one stock."""
    news = A.get_articles(v.articles(), n=None, ticker=NEWS_TICKER)
    return news.select("ticker", "headline", "date_posted", "source", "article_link", F.round(F.col("compound_sentiment").cast("double"), 6).alias("compound_sentiment"))


TREE_DAY = "2024-01-20"


@query(
    with_views(
        "art",
        "meta",
        "news_members",
        body=f""", inside AS (
  SELECT ticker FROM news_members WHERE index_name = 'idx_50' AND effective_date <= DATE '{TREE_DAY}'
    AND (end_date IS NULL OR end_date > DATE '{TREE_DAY}')),
scored AS (
  SELECT ticker, avg(negative_sentiment::DOUBLE) AS neg, avg(neutral_sentiment::DOUBLE) AS neu, avg(positive_sentiment::DOUBLE) AS pos,
         avg(compound_sentiment::DOUBLE) AS score
  FROM art a WHERE a.date_posted[1:10]::DATE BETWEEN DATE '{TREE_DAY}' - 6 AND DATE '{TREE_DAY}'
    AND EXISTS (SELECT 1 FROM news_members m WHERE m.ticker = a.ticker AND m.index_name = 'idx_50'
                AND m.effective_date <= a.date_posted[1:10]::DATE AND coalesce(m.end_date > a.date_posted[1:10]::DATE, true))
  GROUP BY ticker),
leaves AS (
  SELECT sector, industry, m.ticker AS ticker, "mCap" AS cap, "companyName" AS company, neg, neu, pos, score
  FROM meta m LEFT JOIN scored s ON s.ticker = m.ticker WHERE m.ticker IN (SELECT ticker FROM inside)),
nodes AS (
  SELECT 'idx_50/' || sector || '/' || industry || '/' || ticker AS id, 'idx_50/' || sector || '/' || industry AS parent, ticker AS label, 3 AS level,
         cap AS value, score AS color, company, neg, neu, pos, score FROM leaves
  UNION ALL SELECT 'idx_50/' || sector || '/' || industry, 'idx_50/' || sector, industry, 2, sum(cap),
         sum(cap * score) / sum(CASE WHEN score IS NOT NULL THEN cap END), NULL, NULL, NULL, NULL, NULL FROM leaves GROUP BY sector, industry
  UNION ALL SELECT 'idx_50/' || sector, 'idx_50', sector, 1, sum(cap),
         sum(cap * score) / sum(CASE WHEN score IS NOT NULL THEN cap END), NULL, NULL, NULL, NULL, NULL FROM leaves GROUP BY sector
  UNION ALL SELECT 'idx_50', '', 'idx_50', 0, sum(cap), sum(cap * score) / sum(CASE WHEN score IS NOT NULL THEN cap END),
         NULL, NULL, NULL, NULL, NULL FROM leaves)
SELECT id, parent, label, level::INT AS level, round(value, 4) AS value, round(color, 6) AS color, company AS "companyName",
  round(neg, 6) AS "Negative", round(neu, 6) AS "Neutral", round(pos, 6) AS "Positive", round(score, 6) AS "Sentiment Score" FROM nodes""",
    )
)
def index_treemap(v: Views) -> DataFrame:
    """The sentiment tree of one index over seven days, with the columns of its leaves."""
    nodes = tree_rows(tree_of_index(v.meta(), v.articles(), v.news_members(), "idx_50", TREE_DAY))
    return nodes.withColumns({c: F.round(F.col(c), 6) for c in ("Negative", "Neutral", "Positive", "Sentiment Score")})


DAILY_SQL = """SELECT ticker, date_posted[1:10]::DATE AS date, avg(compound_sentiment) AS score,
  count(compound_sentiment) AS n_scored, count(*) AS n_articles FROM art GROUP BY 1, 2"""


@query(with_views("art", body=f"SELECT ticker, date, round(score, 6) AS score, n_scored, n_articles FROM ({DAILY_SQL})"))
def daily_ticker_sentiment(v: Views) -> DataFrame:
    return A.daily_ticker_sentiment(v.articles()).withColumn("score", F.round("score", 6))


@query(
    with_views(
        "art",
        body="""SELECT ticker, round(avg(compound_sentiment), 6) AS score, count(*) AS n_articles
FROM art WHERE date_posted[1:10]::DATE > DATE '2024-01-23' AND date_posted[1:10]::DATE <= DATE '2024-01-30' GROUP BY ticker""",
    )
)
def sentiment_by_period(v: Views) -> DataFrame:
    dated = v.articles().withColumn("date", F.substring("date_posted", 1, 10).try_cast("date"))
    week = A.since(dated, "date", "2024-01-30", "7D")
    return week.groupBy("ticker").agg(
        F.round(F.avg("compound_sentiment"), 6).alias("score"), F.count(F.lit(1)).alias("n_articles")
    )


@query(
    with_views(
        "art",
        "meta",
        "news_members",
        body=f"""SELECT index_name, d.date,
  round(sum("mCap" * score) / nullif(sum("mCap") FILTER (WHERE score IS NOT NULL), 0), 6) AS score,
  count(*) AS n_tickers, sum(n_articles)::BIGINT AS n_articles
FROM ({DAILY_SQL}) d JOIN news_members k ON d.ticker = k.ticker AND d.date >= k.effective_date
     AND (k.end_date IS NULL OR d.date < k.end_date) JOIN meta m ON m.ticker = d.ticker
WHERE d.date BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY 1, 2""",
    )
)
def index_sentiment(v: Views) -> DataFrame:
    """Cap-weighted daily sentiment of an index's members of the day."""
    days = A.daily_ticker_sentiment(v.articles()).where("date BETWEEN DATE'2024-01-05' AND DATE'2024-01-25'")
    members = active_on(days, v.news_members()).join(v.meta().select("ticker", "mCap"), "ticker")
    return members.groupBy("index_name", "date").agg(
        F.round(weighted_mean(F.col("score"), F.col("mCap")), 6).alias("score"),
        F.count(F.lit(1)).alias("n_tickers"),
        F.sum("n_articles").alias("n_articles"),
    )
