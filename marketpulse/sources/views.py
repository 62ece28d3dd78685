"""The given tables, read as the package's own tables.

Every view is a lazy projection or aggregation of a whole given table; ``plans.sql_views``
spells the same definitions for the oracle.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import store_text
from ..functions.scores import compound
from ..operators.indices import free_float_mcap
from ..operators.prices import daily_bars
from ..session import materialized
from .tables import broadcast_if_small, spread_if_small, table

SCORE_MODULUS = 3001
SCORE_DIVISOR = 9973.0  # a prime: four-place rounding never meets a tie
TRADE_SEQ_FACTOR = 1 << 20


class Views:
    """Views over one folder of given tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._closes: DataFrame | None = None

    def _table(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _spread(self, name: str) -> DataFrame:
        return spread_if_small(self._table(name), self._path(name))

    # --- news ---------------------------------------------------------------------------
    def events(self) -> DataFrame:
        return self._table("events")

    def pages(self) -> DataFrame:
        return self._table("pages")

    def documents(self) -> DataFrame:
        return self._spread("documents")

    @staticmethod
    def probability(factor: int) -> Column:
        return F.pmod(F.col("event_id") * factor, F.lit(SCORE_MODULUS)) / F.lit(SCORE_DIVISOR)

    def articles(self) -> DataFrame:
        """One article per event, with copies of a (ticker, headline) where events repeat."""
        p, n = self.probability(37), self.probability(53)
        scored = F.col("event_type") != "error"

        def score(value: Column) -> Column:
            return F.when(scored, value.cast("float"))

        return self.events().select(
            F.concat(F.lit("T"), "user_id").alias("ticker"),
            F.concat_ws(" ", "event_type", "props").alias("headline"),
            store_text(F.col("ts")).alias("date_posted"),
            F.col("event_type").alias("source"),
            F.concat(F.lit("ev/"), "event_id").alias("article_link"),
            score(n).alias("negative_sentiment"),
            score(p).alias("positive_sentiment"),
            score(1 - p - n).alias("neutral_sentiment"),
            score(compound(p, n)).alias("compound_sentiment"),
            F.col("ts").alias("created_at"),
            F.col("event_id").alias("arrival_seq"),
        )

    def meta(self) -> DataFrame:
        customer, nation, region = (self._table(t) for t in ("customer", "nation", "region"))
        return (
            customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("T"), "c_custkey").alias("ticker"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("industry"),
                F.round(F.col("c_acctbal") + 1000, 2).alias("mCap"),
                F.col("c_name").alias("companyName"),
            )
        )

    def universe(self) -> DataFrame:
        tenth = F.pmod("c_custkey", F.lit(10))
        return self._table("customer").select(
            F.concat(F.lit("T"), "c_custkey").alias("ticker"),
            F.concat(F.lit("IN"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("ISIN_Code"),
            (tenth == 0).alias("idx_50"),
            (tenth < 2).alias("idx_100"),
            (tenth < 4).alias("idx_200"),
            F.lit(True).alias("idx_500"),
        )

    def news_members(self) -> DataFrame:
        """Membership intervals of the idx_50 tickers; every third one has ended."""
        key = F.col("c_custkey")
        return self._table("customer").where(F.pmod(key, F.lit(10)) == 0).select(
            F.lit("idx_50").alias("index_name"),
            F.concat(F.lit("T"), key).alias("ticker"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(key, F.lit(7)).cast("int")).alias("effective_date"),
            F.when(F.pmod(key, F.lit(3)) == 0, F.lit("2024-01-21").cast("date")).alias("end_date"),
        )

    # --- market -------------------------------------------------------------------------
    def trades(self, only: DataFrame | None = None) -> DataFrame:
        """One trade per line item: price in whole 1/10000 (cut), amount in whole cents.

        ``only`` keeps the tickers of a list, before anything is aggregated or shuffled.
        """
        return _with_ticker(self._keyed_trades(only))

    def _keyed_trades(self, only: DataFrame | None, tickers: Sequence[str] | None = None, between: tuple[str, str] | None = None) -> DataFrame:
        """Trades under the number of their ticker, which groups cheaper than its text.

        ``tickers`` and ``between`` (first and last day) become conditions on the stored columns, which
        the scan can check against its row groups; on the derived ticker and day it couldn't.
        """
        cents = whole_cents("l_extendedprice")
        seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * TRADE_SEQ_FACTOR + F.pmod(
            "l_partkey", F.lit(TRADE_SEQ_FACTOR)
        )
        stored = self._table("lineitem")
        if tickers is not None:
            stored = stored.where(F.col("l_suppkey").isin([int(t[1:]) for t in tickers if re.fullmatch(r"S(0|[1-9]\d{0,17})", t)]))
        if between is not None:
            first, last = (dt.datetime.fromisoformat(day) for day in between)
            stored = stored.where((F.col("l_shipdate") >= F.lit(first).cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit(last + dt.timedelta(days=1)).cast("timestamp_ntz")))
        rows = stored.select(
            F.col("l_suppkey").alias("ticker"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.floor(cents * 100 / F.col("l_quantity")).alias("price"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            cents.alias("amount"),
            seq.alias("seq"),
        )
        if only is None:
            return rows
        numbers = only.select(F.substring("ticker", 2, 20).cast("bigint").alias("ticker"))
        return rows.join(numbers, "ticker", "left_semi")

    def prices(self, only: DataFrame | None = None, tickers: Sequence[str] | None = None, between: tuple[str, str] | None = None) -> DataFrame:
        """Daily bars. Whole numbers are aggregated; decimals are made per day, not per trade."""
        bars = _with_ticker(daily_bars(self._keyed_trades(only, tickers, between)))
        exact = {c: (F.col(c) / F.lit(10000.0)).cast("decimal(12,4)") for c in ("open", "high", "low", "close")}
        return bars.withColumns({**exact, "turnover": (F.col("turnover") / F.lit(100.0)).cast("decimal(20,2)")})

    def write_closes(self) -> None:
        """Write the closes, for a query that reads them several times: trades are then aggregated once."""
        self._closes = materialized(self.closes(), "closes")

    def closes(self, only: DataFrame | None = None) -> DataFrame:
        """Close and volume per ticker and day."""
        if self._closes is None:
            return self.prices(only).select("ticker", "date", "close", "volume")
        return self._closes if only is None else self._closes.join(only, "ticker", "left_semi")

    def series_prices(self) -> DataFrame:
        """Five dense daily series from the events, shaped as index history."""
        price = (F.col("value") + 1.0).cast("decimal(12,4)")
        trades = self.events().select(
            F.col("event_type").alias("ticker"),
            F.col("ts").cast("date").alias("date"),
            price.alias("price"),
            F.lit(1).cast("bigint").alias("quantity"),
            price.cast("decimal(14,2)").alias("amount"),
            F.col("event_id").alias("seq"),
        )
        return daily_bars(trades)

    def shares(self) -> DataFrame:
        supplier, nation, region = (self._table(t) for t in ("supplier", "nation", "region"))
        key = F.col("s_suppkey")
        return (
            supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                F.concat(F.lit("S"), key).alias("ticker"),
                (F.pmod(key, F.lit(97)) * 100 + 1000).alias("total_shares"),
                (F.pmod(key, F.lit(80)) + 20).alias("ff_pct"),
                F.col("r_name").alias("sector"),
                F.col("n_name").alias("industry"),
                F.col("s_acctbal").alias("acctbal"),
            )
        )

    def market_data(self, only: DataFrame | None = None) -> DataFrame:
        """Daily close with market cap and free-float market cap per ticker."""
        close = F.col("close")
        mcap = (F.col("total_shares").cast("decimal(15,0)") * close).cast("decimal(30,4)")
        return (
            self.closes(only)
            .join(broadcast_if_small(self.shares(), self._path("supplier")), "ticker")
            .select(
                "ticker",
                "date",
                "sector",
                "close",
                "volume",
                mcap.alias("market_cap"),
                free_float_mcap(F.col("total_shares"), F.col("ff_pct"), close).alias("ffmc"),
            )
        )

    def fundamentals(self) -> DataFrame:
        """Revenue, EPS and book value per share by ticker and quarter."""
        cents = whole_cents("l_extendedprice")
        kept = F.floor((1 - F.col("l_discount")) * 100 + 0.5)
        revenue = self._table("lineitem").groupBy(
            F.concat(F.lit("S"), "l_suppkey").alias("ticker"),
            quarter_end(F.col("l_shipdate")).alias("quarter"),
        ).agg((F.sum(cents * kept) / F.lit(10000.0)).alias("revenue"))
        return revenue.join(broadcast_if_small(self.shares(), self._path("supplier")), "ticker").select(
            "ticker",
            "quarter",
            "sector",
            "industry",
            "revenue",
            (F.col("revenue") / F.col("total_shares")).alias("eps"),
            ((F.col("acctbal") + 500) / F.col("total_shares") * 100).alias("book_value_per_share"),
        )

    def actions(self) -> DataFrame:
        """A split, bonus or dividend per supplier, and a later split for every fifth."""
        key = F.col("s_suppkey")
        kind = F.pmod(key, F.lit(3))
        suppliers = self._table("supplier")
        ticker = F.concat(F.lit("S"), key).alias("ticker")
        first = suppliers.select(
            ticker,
            F.date_add(F.lit("1998-01-01").cast("date"), F.pmod(key, F.lit(365)).cast("int")).alias("action_date"),
            F.when(kind == 0, "split").when(kind == 1, "bonus").otherwise("dividend").alias("action_type"),
            F.when(kind == 0, 1).when(kind == 1, 2).alias("ratio_numerator"),
            F.when(kind == 0, 2).when(kind == 1, 3).alias("ratio_denominator"),
            F.when(kind == 2, F.pmod(key, F.lit(9)) + 1).cast("decimal(10,4)").alias("amount"),
        )
        second = suppliers.where(F.pmod(key, F.lit(5)) == 0).select(
            ticker,
            F.date_add(F.lit("1999-06-01").cast("date"), F.pmod(key, F.lit(100)).cast("int")).alias("action_date"),
            F.lit("split").alias("action_type"),
            F.lit(1).alias("ratio_numerator"),
            F.lit(2).alias("ratio_denominator"),
            F.lit(None).cast("decimal(10,4)").alias("amount"),
        )
        return first.unionByName(second)

    def order_book(self) -> DataFrame:
        """Open buy (F) and sell (O) orders; orders of status P are not in the book."""
        price = F.round(F.col("o_totalprice") / 1000).cast("bigint")
        return (
            self._table("orders")
            .where(F.col("o_orderstatus").isin("F", "O"))
            .select(
                F.concat(F.lit("B"), F.pmod("o_custkey", F.lit(50))).alias("ticker"),
                F.when(F.col("o_orderstatus") == "F", "bid").otherwise("ask").alias("side"),
                F.when(F.col("o_orderstatus") == "F", price).otherwise(price + 500).alias("price"),
                (F.pmod("o_orderkey", F.lit(9)) + 1).alias("qty"),
            )
        )

    def query_logs(self) -> DataFrame:
        return self.events().select(
            F.concat(F.lit("log-"), "event_id").alias("log_id"),
            F.col("event_type").alias("generation_method"),
            F.get_json_object("props", "$.k").cast("int").alias("result_count"),
            F.round(F.col("value") * 100).cast("int").alias("processing_time_ms"),
            (F.col("value") < 200).alias("success"),
            F.col("ts").alias("timestamp"),
            F.concat(F.lit("IDX"), "user_id").alias("index_id"),
        )


def _with_ticker(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ticker", F.concat(F.lit("S"), "ticker"))


def whole_cents(column: str) -> Column:
    """A non-negative money amount as whole cents."""
    return F.floor(F.col(column) * 100 + 0.5)


def quarter_end(moment: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(moment.cast("date"), "quarter"), 2))
