"""Reads over the article, metadata and universe tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import SCORE_COLUMNS


def filter_articles(
    articles: DataFrame, has_sentiment: bool = True, after_date: str | None = None, ticker: str | None = None
) -> DataFrame:
    """``has_sentiment=False`` keeps unscored rows only; True applies no filter.

    ``date_posted`` is text and compares as text. ``ticker`` keeps the news of one stock.
    """
    if ticker is not None:
        articles = articles.where(F.col("ticker") == F.lit(ticker))
    if not has_sentiment:
        articles = articles.where(F.col("compound_sentiment").isNull())
    if after_date is not None:
        articles = articles.where(F.col("date_posted") >= F.lit(after_date))
    return articles


def get_articles(
    articles: DataFrame,
    n: int | None = 20,
    latest: bool = True,
    has_sentiment: bool = True,
    after_date: str | None = None,
    ticker: str | None = None,
) -> DataFrame:
    """The n latest or oldest articles (all of them for n=None), of one stock if a ticker is given.

    Equal dates are ordered by ticker, headline and arrival, so the cut is repeatable.
    """
    kept = filter_articles(articles, has_sentiment, after_date, ticker)
    if n is None:
        return kept
    posted = F.col("date_posted")
    ties = [c for c in ("ticker", "headline", "arrival_seq") if c in articles.columns]
    return kept.orderBy(posted.desc() if latest else posted.asc(), *ties).limit(n)


def index_constituents(universe: DataFrame, index: str) -> DataFrame:
    """Tickers whose membership flag is set; the flag must be a boolean column."""
    flags = [f.name for f in universe.schema.fields if f.dataType.simpleString() == "boolean"]
    if index not in flags:
        raise ValueError(f"unknown index {index!r}; known: {flags}")
    return universe.where(F.col(index)).select("ticker")


def drop_without_headline(articles: DataFrame) -> DataFrame:
    """Drop null headlines; an empty headline stays."""
    return articles.na.drop(subset=["headline"])


def ticker_scores(articles: DataFrame) -> DataFrame:
    """Mean of each score per ticker. Null scores are skipped, null tickers dropped."""
    means = [F.avg(c).alias(c) for c in SCORE_COLUMNS]
    return articles.where(F.col("ticker").isNotNull()).groupBy("ticker").agg(*means)


def daily_ticker_sentiment(articles: DataFrame, *carry: str) -> DataFrame:
    """Mean compound score and article counts per ticker and posting day.

    Articles without a readable date have no day and are left out.
    """
    day = F.substring("date_posted", 1, 10).try_cast("date")
    return (
        articles.withColumn("date", day)
        .where(F.col("date").isNotNull() & F.col("ticker").isNotNull())
        .groupBy("ticker", "date", *carry)
        .agg(
            F.avg("compound_sentiment").alias("score"),
            F.count("compound_sentiment").alias("n_scored"),
            F.count(F.lit(1)).alias("n_articles"),
        )
    )


def since(df: DataFrame, date_column: str, as_of: str, period: str) -> DataFrame:
    """Rows of the period that ends at as_of: as_of - period < date <= as_of."""
    end = F.lit(as_of).cast("date")
    start = F.add_months(end, -_months(period)) if _months(period) else F.date_sub(end, _days(period))
    return df.where((F.col(date_column) > start) & (F.col(date_column) <= end))


# Named periods (fixed values): days, or months where the period is calendar-based.
PERIOD_DAYS = {"1D": 1, "7D": 7, "30D": 30}
PERIOD_MONTHS = {"1M": 1, "3M": 3, "6M": 6, "1Y": 12, "2Y": 24, "3Y": 36}


def _days(period: str) -> int:
    return PERIOD_DAYS[period]


def _months(period: str) -> int:
    if period not in PERIOD_DAYS and period not in PERIOD_MONTHS:
        raise ValueError(f"unknown period {period!r}")
    return PERIOD_MONTHS.get(period, 0)
