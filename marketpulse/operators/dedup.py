"""Find and remove repeated (ticker, headline) rows; the earliest created_at is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ARTICLE_KEY
from .ordering import numbered_duplicates, top_per_key


def query_duplicates(articles: DataFrame, tie: str = "arrival_seq") -> DataFrame:
    """Every row but the first of its key, with its row number."""
    numbered = numbered_duplicates(articles, ARTICLE_KEY, "created_at", tie)
    return numbered.where("rn > 1").select(
        "rn", "ticker", "headline", "date_posted", "article_link", "created_at"
    )


def count_duplicates(articles: DataFrame) -> DataFrame:
    """How many rows query_duplicates reports, from counts per key alone."""
    per_key = articles.groupBy(*ARTICLE_KEY).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicated_keys"),
    )


def delete_duplicates(articles: DataFrame, tie: str = "arrival_seq") -> DataFrame:
    """The earliest row of every key."""
    return top_per_key(articles, ARTICLE_KEY, [F.col("created_at").asc_nulls_last(), F.col(tie)])
