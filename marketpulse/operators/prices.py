"""Daily price series: shaping, adjustment, returns, volatility, drawdown.

Windows here partition by ticker over *daily* rows. One ticker has at most one row per
calendar day, so a window group is bounded by the length of the calendar (about 12,500
trading days in 50 years) however many trades the ticker has; trades are reduced to days
by a partial aggregation before any shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OHLCV_COLUMNS = ("date", "symbol", "open", "high", "low", "close", "volume", "turnover", "vwap")
INDEX_HISTORY_COLUMNS = ("date", "index_name", "open", "high", "low", "close")


def project_by_name(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Select raw columns under their shaped names: {shaped name: raw name}."""
    return df.select(*(F.col(raw).alias(shaped) for shaped, raw in names.items()))


def daily_bars(trades: DataFrame) -> DataFrame:
    """Open, high, low, close, volume and turnover per ticker and day.

    ``trades`` has ticker, date, price decimal(12,4), quantity, amount and ``seq``, the
    order of trades within a day.
    """
    return trades.groupBy("ticker", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("amount").alias("turnover"),
    )


def price_range(prices: DataFrame, tickers: list[str], start: str, end: str) -> DataFrame:
    """ticker IN (...) AND date BETWEEN start AND end; both reach the Parquet scan."""
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    return prices.where(F.col("ticker").isin(tickers) & F.col("date").between(first, last))


def action_factor(ratio_old: str = "ratio_numerator", ratio_new: str = "ratio_denominator"):
    """Adjustment factor old shares / new shares of a split or bonus; 1 for other actions."""
    return F.when(
        F.col("action_type").isin("split", "bonus"),
        F.col(ratio_old).cast("double") / F.col(ratio_new),
    ).otherwise(F.lit(1.0))


def adjusted_close(prices: DataFrame, actions: DataFrame) -> DataFrame:
    """Closes before a split or bonus times its factor, for every later action.

    Actions are merged into the series and the factors multiplied by one reverse window,
    so a row is never repeated per action. An action on a day leaves that day's close as is.
    """
    factors = actions.select("ticker", F.col("action_date").alias("date"), action_factor().alias("__f"))
    merged = prices.withColumns({"__f": F.lit(1.0), "__price": F.lit(True)}).unionByName(
        factors, allowMissingColumns=True
    )
    # Latest first; the frame stops before rows of the same day.
    later = Window.partitionBy("ticker").orderBy(F.datediff(F.col("date"), F.lit("1970-01-01")).desc())
    product = F.product("__f").over(later.rangeBetween(Window.unboundedPreceding, -1))
    return (
        merged.withColumn("factor", F.coalesce(product, F.lit(1.0)))
        .where("__price")
        .withColumn("adjusted_close", F.col("close").cast("double") * F.col("factor"))
        .drop("__f", "__price")
    )


def returns(series: DataFrame, value: str = "close", key: str = "ticker") -> DataFrame:
    """returns_1d against the previous row; 1w/1m/1y against the latest row at least that
    far back."""
    now = F.col(value).cast("double")
    rows = Window.partitionBy(key).orderBy("date")
    out = {"returns_1d": F.try_divide(now, F.lag(now).over(rows)) - 1}
    for name, span in (("1w", "INTERVAL 7 DAYS"), ("1m", "INTERVAL 1 MONTH"), ("1y", "INTERVAL 1 YEAR")):
        base = F.expr(
            f"last_value(cast({value} AS double)) OVER (PARTITION BY {key} ORDER BY date "
            f"RANGE BETWEEN UNBOUNDED PRECEDING AND {span} PRECEDING)"
        )
        out[f"returns_{name}"] = F.try_divide(now, base) - 1
    return series.withColumns(out)


def daily_returns(series: DataFrame, value: str = "close", key: str = "ticker") -> DataFrame:
    """(key, date, ret) without each key's first row."""
    now = F.col(value).cast("double")
    rows = Window.partitionBy(key).orderBy("date")
    change = F.try_divide(now, F.lag(now).over(rows)) - 1
    return series.select(key, "date", change.alias("ret")).where(F.col("ret").isNotNull())


def with_rolling_volatility(returns: DataFrame, ret: str = "ret", rows: int = 30, key: str = "ticker") -> DataFrame:
    """Sample deviation of the last ``rows`` daily returns; null until that many exist."""
    last = Window.partitionBy(key).orderBy("date").rowsBetween(-(rows - 1), 0)
    deviation = F.stddev_samp(ret).over(last)
    return returns.withColumn("volatility", F.when(F.count(ret).over(last) == rows, deviation))


def rolling_volatility(series: DataFrame, rows: int = 30, value: str = "close", key: str = "ticker") -> DataFrame:
    return with_rolling_volatility(daily_returns(series, value, key), "ret", rows, key)


def max_drawdown(series: DataFrame, value: str = "close", key: str = "ticker") -> DataFrame:
    """drawdown from the running peak, and the worst drawdown so far."""
    now = F.col(value).cast("double")
    so_far = Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    down = series.withColumn("drawdown", now / F.max(now).over(so_far) - 1)
    return down.withColumn("max_drawdown", F.min("drawdown").over(so_far))
