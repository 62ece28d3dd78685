"""Risk against a benchmark, and the covariance matrix of returns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRADING_DAYS = 252
TILE = 256


def market_returns(returns: DataFrame) -> DataFrame:
    """Equal-weighted market: the mean return of a day. One row per calendar day."""
    return returns.groupBy("date").agg(F.avg("ret").alias("market_ret"))


def with_benchmark(returns: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Returns joined to a benchmark on date."""
    return returns.join(benchmark, "date")


def beta(paired: DataFrame, key: str = "ticker") -> DataFrame:
    """Cov(r, m) / Var(m) per series, with sample statistics over common days."""
    return paired.groupBy(key).agg(
        F.try_divide(F.covar_samp("ret", "market_ret"), F.var_samp("market_ret")).alias("beta"),
        F.count(F.lit(1)).alias("n_days"),
    )


def portfolio_beta(weighted: DataFrame, betas: DataFrame, index: str = "index_name") -> DataFrame:
    """Weighted sum of the constituents' betas."""
    return (
        weighted.join(betas, "ticker")
        .groupBy(index)
        .agg(F.sum(F.col("weight") * F.col("beta")).alias("portfolio_beta"), F.count(F.lit(1)).alias("n"))
    )


def tracking_error(paired: DataFrame, key: str = "index_name") -> DataFrame:
    """Annualised sample deviation of the daily return differences."""
    difference = F.col("ret") - F.col("market_ret")
    return paired.groupBy(key).agg(
        (F.stddev_samp(difference) * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("tracking_error"),
        F.count(F.lit(1)).alias("n_days"),
    )


def benchmark_stats(paired: DataFrame, *by: str) -> DataFrame:
    """Compounded returns, excess return and volatilities of a series and its benchmark."""

    def compounded(column: str):
        return F.exp(F.sum(F.ln(1 + F.col(column)))) - 1

    return paired.groupBy(*by).agg(
        compounded("ret").alias("total_return"),
        compounded("market_ret").alias("benchmark_return"),
        (compounded("ret") - compounded("market_ret")).alias("excess_return"),
        F.stddev_samp("ret").alias("volatility"),
        F.stddev_samp("market_ret").alias("benchmark_volatility"),
        F.count(F.lit(1)).alias("n_days"),
    )


def return_covariance(returns: DataFrame, tile: int = TILE) -> DataFrame:
    """Sample covariance of every pair of series over the days both have a return.

    Blocked matrix product. Series are split into tiles of about ``tile`` names; rows go to
    the tile pairs they belong to, per month of days, and each group adds up its products
    with dense matrices of at most 2 x tile names by 31 days. Pairs of days never meet in a
    join, and only sums leave a task. One tile - any index of up to a few hundred names -
    sends every row exactly once.
    """
    names = returns.select("ticker").distinct()
    # A tile is a hash range; the count of names only sets how many there are.
    n_tiles = max(1, -(-names.count() // tile))
    tiled = returns.select(
        "ticker",
        "date",
        "ret",
        F.trunc("date", "month").alias("month"),
        F.pmod(F.xxhash64("ticker"), F.lit(n_tiles)).cast("int").alias("tile"),
    )
    other = F.explode(F.sequence(F.lit(0), F.lit(n_tiles - 1))).alias("other")
    routed = tiled.select("*", other).withColumns(
        {"tile_a": F.least("tile", "other"), "tile_b": F.greatest("tile", "other")}
    )
    sums = routed.groupBy("tile_a", "tile_b", "month").applyInPandas(
        _products, "a string, b string, n bigint, sa double, sb double, sab double"
    )
    total = sums.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")))
    covariance = (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1)
    return total.where("n > 1").select("a", "b", F.col("n").alias("n_days"), covariance.alias("covariance"))


def _products(block: pd.DataFrame) -> pd.DataFrame:
    """Sums over one month for the name pairs (a <= b) that belong to this tile pair."""
    grid = block.pivot(index="date", columns="ticker", values="ret").sort_index(axis=1)
    values = grid.to_numpy(dtype=float)
    present = ~np.isnan(values)
    filled, mask = np.where(present, values, 0.0), present.astype(float)
    counts = mask.T @ mask
    firsts = filled.T @ mask
    both = filled.T @ filled
    names = grid.columns.to_numpy()
    tiles = block.drop_duplicates("ticker").set_index("ticker")["tile"].reindex(names).to_numpy()
    row, col = np.triu_indices(len(names))
    low, high = int(block["tile_a"].iloc[0]), int(block["tile_b"].iloc[0])
    pair_low = np.minimum(tiles[row], tiles[col])
    pair_high = np.maximum(tiles[row], tiles[col])
    keep = (pair_low == low) & (pair_high == high) & (counts[row, col] > 0)
    row, col = row[keep], col[keep]
    return pd.DataFrame(
        {
            "a": names[row],
            "b": names[col],
            "n": counts[row, col].astype("int64"),
            "sa": firsts[row, col],
            "sb": firsts[col, row],
            "sab": both[row, col],
        }
    )
