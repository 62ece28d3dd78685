"""Landed files: CSV lists, JSON responses, and the JSON shapes they carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LISTING_JSON, ORDER_BOOK_JSON, QUOTE_JSON


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header. Malformed lines fail the read instead of becoming nulls."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line."""
    return spark.read.schema(schema).json(path)


def order_book_ffmc(body: Column) -> Column:
    """Nested value of a trade-info response; null where any level is absent."""
    return F.from_json(body, ORDER_BOOK_JSON)["marketDeptOrderBook"]["tradeInfo"]["ffmc"]


def listing_items(df: DataFrame, body: str) -> DataFrame:
    """One row per entry of a response's ``data`` list; no list, no rows."""
    keep = [c for c in df.columns if c != body]
    parsed = df.withColumn("__item", F.explode(F.from_json(F.col(body), LISTING_JSON)["data"]))
    return parsed.select(*keep, "__item.*")


def ticker_metadata(quotes: DataFrame) -> DataFrame:
    """(ticker, sector, industry, mCap in billions, companyName) from quote responses.

    A response that lacks any of the fields yields no row.
    """
    q = F.from_json(F.col("quote"), QUOTE_JSON)
    fields = quotes.select("ticker", q.alias("q")).select(
        "ticker",
        F.col("q.industryInfo.macro").alias("sector"),
        F.col("q.industryInfo.industry").alias("industry"),
        F.col("q.priceInfo.previousClose").alias("__close"),
        F.col("q.securityInfo.issuedSize").alias("__shares"),
        F.col("q.info.companyName").alias("companyName"),
    )
    complete = fields.na.drop()
    mcap = F.round(F.col("__close") * F.col("__shares") / F.lit(1e9), 2)
    return complete.select("ticker", "sector", "industry", mcap.alias("mCap"), "companyName")
