"""Market-cap weighted sentiment over root / sector / industry / ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import weighted_mean
from .articles import since, ticker_scores

# Store column -> dashboard column (fixed values).
DASHBOARD_NAMES = {
    "mCap": "Market Cap (Billion Rs)",
    "compound_sentiment": "Sentiment Score",
    "neutral_sentiment": "Neutral",
    "positive_sentiment": "Positive",
    "negative_sentiment": "Negative",
}
PATH = ("sector", "industry", "ticker")
LEAF_COLUMNS = ("companyName", "negative_sentiment", "neutral_sentiment", "positive_sentiment", "compound_sentiment")


def dashboard_join(meta: DataFrame, scores: DataFrame) -> DataFrame:
    """Metadata with per-ticker scores; both sides hold one row per ticker.

    No broadcast is forced: the ticker list grows with the market, and the planner already
    broadcasts whichever side it measures to be small.
    """
    return meta.join(scores, "ticker", "inner")


def dashboard_names(frame: DataFrame) -> DataFrame:
    return frame.withColumnsRenamed(DASHBOARD_NAMES)


def treemap(frame: DataFrame, root: str, leaf_columns: bool = False) -> DataFrame:
    """All nodes of the tree: id, parent, label, level, value and colour.

    ``frame`` has one row per ticker. A node's value is the sum of its market caps, its
    colour the cap-weighted mean score of the tickers that have one. With ``leaf_columns``
    come the dashboard's columns of a ticker (LEAF_COLUMNS), null on the nodes above.
    """
    own = [F.when(F.grouping_id() == 0, F.max(c)).alias(DASHBOARD_NAMES.get(c, c)) for c in LEAF_COLUMNS] if leaf_columns else []
    complete = frame.where(" and ".join(f"{c} is not null" for c in PATH))
    nodes = (
        complete.rollup(*PATH)
        .agg(
            F.grouping_id().alias("gid"),
            F.sum("mCap").alias("value"),
            weighted_mean(F.col("compound_sentiment"), F.col("mCap")).alias("color"),
            *own,
        )
    )
    # grouping_id: 0 ticker, 1 industry, 3 sector, 7 root
    level = F.when(F.col("gid") == 7, 0).when(F.col("gid") == 3, 1).when(F.col("gid") == 1, 2).otherwise(3)
    parts = F.array(F.lit(root), *PATH)
    return nodes.withColumn("level", level).select(
        F.array_join(F.slice(parts, 1, F.col("level") + 1), "/").alias("id"),
        F.array_join(F.slice(parts, 1, F.col("level")), "/").alias("parent"),
        F.element_at(parts, F.col("level") + 1).alias("label"),
        "level",
        "value",
        "color",
        *(DASHBOARD_NAMES.get(c, c) for c in LEAF_COLUMNS if leaf_columns),
    )


def index_treemap(meta: DataFrame, articles: DataFrame, members: DataFrame, index: str, as_of: str, period: str = "7D") -> DataFrame:
    """The sentiment tree of one index over the news of a period that ends at ``as_of``, with leaf columns.

    ``members`` has membership intervals (index_name, ticker, effective_date, end_date); a ticker's
    news counts on the days on which it was in the index, once however many intervals hold the day.
    Tickers in the index on the last day without news keep their market cap and have no score.
    """
    end = F.lit(as_of).cast("date")
    within = members.where(F.col("index_name") == index)
    today = within.where((F.col("effective_date") <= end) & (F.col("end_date").isNull() | (F.col("end_date") > end))).select("ticker").distinct()
    dated = articles.withColumn("date", F.substring("date_posted", 1, 10).try_cast("date"))
    recent = since(dated, "date", as_of, period)
    valid = F.expr("r.ticker = m.ticker AND r.date >= m.effective_date AND (m.end_date IS NULL OR r.date < m.end_date)")
    counted = recent.alias("r").join(within.alias("m"), valid, "left_semi")
    frame = meta.join(today, "ticker", "left_semi").join(ticker_scores(counted), "ticker", "left")
    return treemap(frame, index, leaf_columns=True)
