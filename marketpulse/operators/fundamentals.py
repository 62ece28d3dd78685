"""Quarterly fundamentals: as-of values, growth, screens and valuation ratios.

A quarter is named by its last day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prices import with_rolling_volatility


def asof(
    rows: DataFrame,
    known: DataFrame,
    values: Sequence[str],
    known_date: str,
    date: str = "date",
    key: str = "ticker",
) -> DataFrame:
    """Each row with the latest ``known`` values of its key dated on or before its date.

    Both sides are merged into one series per key and values carried forward, so nothing is
    joined by range. ``rows`` is daily per key, which bounds the window group.
    """
    packed = F.struct(F.col(known_date).alias("asof_date"), *values)
    facts = known.select(key, F.col(known_date).alias(date), packed.alias("__known"))
    merged = rows.withColumn("__row", F.lit(True)).unionByName(facts, allowMissingColumns=True)
    # On equal dates the facts come first.
    order = Window.partitionBy(key).orderBy(date, F.col("__row").asc_nulls_first())
    carried = F.last("__known", ignorenulls=True).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return merged.withColumn("__known", carried).where("__row").select(*rows.columns, "__known.*")


def growth_yoy(fundamentals: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Change against the same quarter a year earlier, found by date and not by row."""
    before = fundamentals.select(
        "ticker",
        F.last_day(F.add_months("quarter", 12)).alias("quarter"),
        *(F.col(m).alias(f"__{m}") for m in measures),
    )
    growth = {f"{m}_growth_yoy": F.try_divide(F.col(m), F.col(f"__{m}")) - 1 for m in measures}
    return (
        fundamentals.join(before, ["ticker", "quarter"], "left")
        .withColumns(growth)
        .drop(*(f"__{m}" for m in measures))
    )


def screen_growth(rows: DataFrame, measure: str, n: int, where: str | None = None) -> DataFrame:
    """The n fastest growers that satisfy an attribute condition."""
    kept = rows.where(where) if where else rows
    return kept.where(F.col(measure).isNotNull()).orderBy(F.col(measure).desc(), "ticker").limit(n)


def screen_eps_streak(fundamentals: DataFrame, quarters: int = 4, as_of: str | None = None) -> DataFrame:
    """Tickers whose last ``quarters`` quarters (up to ``as_of``, if given) are consecutive, each
    EPS above the one before, and whose latest EPS is positive."""
    if as_of is not None:
        fundamentals = fundamentals.where(F.col("quarter") <= F.lit(as_of).cast("date"))
    series = Window.partitionBy("ticker").orderBy("quarter")
    latest = Window.partitionBy("ticker").orderBy(F.col("quarter").desc())
    rises = (F.col("eps") > F.lag("eps").over(series)) & (
        F.lag("quarter").over(series) == F.last_day(F.add_months("quarter", -3))
    )
    recent = fundamentals.withColumns(
        {"__rises": F.coalesce(rises, F.lit(False)), "__age": F.row_number().over(latest)}
    ).where(F.col("__age") <= quarters)
    verdict = recent.groupBy("ticker").agg(
        F.count_if((F.col("__age") < quarters) & F.col("__rises")).alias("__rising"),
        F.count(F.lit(1)).alias("__n"),
        F.max_by("eps", "quarter").alias("latest_eps"),
        F.max("quarter").alias("latest_quarter"),
    )
    return verdict.where(
        (F.col("__rising") == quarters - 1) & (F.col("__n") == quarters) & (F.col("latest_eps") > 0)
    ).select("ticker", "latest_quarter", "latest_eps")


def trailing_dividends(prices: DataFrame, dividends: DataFrame) -> DataFrame:
    """Prices with the dividends per share paid in the year up to each day."""
    paid = dividends.select("ticker", F.col("action_date").alias("date"), "amount")
    merged = prices.withColumn("__row", F.lit(True)).unionByName(paid, allowMissingColumns=True)
    year = F.expr(
        "sum(amount) OVER (PARTITION BY ticker ORDER BY date "
        "RANGE BETWEEN INTERVAL 1 YEAR PRECEDING AND CURRENT ROW)"
    )
    return (
        merged.withColumn("dividends_1y", F.coalesce(year, F.lit(0).cast("decimal(20,4)")))
        .where("__row")
        .drop("__row", "amount")
    )


def with_facts_and_dividends(
    prices: DataFrame, known: DataFrame, values: Sequence[str], known_date: str, dividends: DataFrame
) -> DataFrame:
    """``asof`` and ``trailing_dividends`` in one merged series, which is shuffled and sorted by day once."""
    packed = F.struct(F.col(known_date).alias("asof_date"), *values)
    facts = known.select("ticker", F.col(known_date).alias("date"), packed.alias("__known"))
    paid = dividends.select("ticker", F.col("action_date").alias("date"), "amount")
    merged = prices.withColumn("__row", F.lit(True)).unionByName(facts, allowMissingColumns=True).unionByName(paid, allowMissingColumns=True)
    # On equal dates the facts come first.
    order = Window.partitionBy("ticker").orderBy("date", F.col("__row").asc_nulls_first())
    carried = F.last("__known", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    year = F.expr(
        "sum(amount) OVER (PARTITION BY ticker ORDER BY date "
        "RANGE BETWEEN INTERVAL 1 YEAR PRECEDING AND CURRENT ROW)"
    )
    return (
        merged.withColumn("__known", carried)
        .withColumn("dividends_1y", F.coalesce(year, F.lit(0).cast("decimal(20,4)")))
        .where("__row")
        .select(*prices.columns, "dividends_1y", "__known.*")
    )


def valuation_ratios(rows: DataFrame) -> DataFrame:
    """P/E, P/B and dividend yield; null where the denominator is not positive."""

    def ratio(over, under):
        return F.when(under > 0, over / under)

    close = F.col("close").cast("double")
    return rows.withColumns(
        {
            "pe_ratio": ratio(close, F.col("eps")),
            "pb_ratio": ratio(close, F.col("book_value_per_share")),
            "dividend_yield": ratio(F.col("dividends_1y").cast("double"), close),
        }
    )


def computed_metrics(
    prices: DataFrame, fundamentals: DataFrame, dividends: DataFrame, betas: DataFrame
) -> DataFrame:
    """The stored metrics per ticker and day: ratios, growth, beta and 30-day volatility."""
    grown = growth_yoy(fundamentals, ["revenue", "eps"])
    facts = ["eps", "book_value_per_share", "revenue_growth_yoy", "eps_growth_yoy"]
    known = valuation_ratios(with_facts_and_dividends(prices, grown, facts, "quarter", dividends))
    close = F.col("close").cast("double")
    change = F.try_divide(close, F.lag(close).over(Window.partitionBy("ticker").orderBy("date"))) - 1
    risky = with_rolling_volatility(known.withColumn("__ret", change), "__ret")
    return risky.join(betas.select("ticker", "beta"), "ticker", "left").select(
        "ticker",
        "date",
        "pe_ratio",
        "pb_ratio",
        "dividend_yield",
        "revenue_growth_yoy",
        "eps_growth_yoy",
        "beta",
        F.col("volatility").alias("volatility_30d"),
    )
