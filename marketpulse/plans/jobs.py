"""The three jobs of the daily run, on a store."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import extract, scoring
from ..operators.hierarchy import dashboard_join, treemap
from ..session import materialized
from ..sources.sites import TICKER_SITES, SiteRule
from ..sources.store import ArticleStore


def collect_news(
    store: ArticleStore, pages: DataFrame, index: str, as_of: Column, rules: Sequence[SiteRule] = TICKER_SITES
) -> DataFrame:
    """Landed pages of an index's tickers -> articles, upserted without scores.

    ``pages`` has ticker, site, url, html and as_of. Returns the unusable items. Arrival
    order inside a batch is site visiting order, then the item's position on its page.
    """
    wanted = pages.join(store.get_index_constituents(index), "ticker", "left_semi")
    # written once: a filter on the stored problem, and no second parse for the rejects
    items = materialized(extract.extract_articles(wanted, rules), "items")
    visit = F.array_position(F.array(*(F.lit(r.name) for r in rules)), F.col("site"))
    found = A.drop_without_headline(extract.usable(items)).withColumn(
        "arrival_seq", visit * F.lit(1 << 32) + F.col("item_pos")
    )
    store.insert_articles(found, as_of, written=True)
    return extract.rejected(items)


def compute_and_update_sentiment(
    store: ArticleStore, score: Callable[[DataFrame], DataFrame], as_of: Column, n: int | None = 200
) -> None:
    """Score the latest n unscored articles and upsert the scores; nothing to do is a no-op."""
    if store.get_articles(n=1, has_sentiment=False).isEmpty():
        return
    store.insert_articles(scoring.scored_backlog(store.articles, score, n), as_of, has_sentiment=True)


def dashboard(store: ArticleStore, root: str, n: int | None = 20) -> DataFrame:
    """The sentiment tree over the n latest articles (None: all)."""
    scores = A.ticker_scores(store.get_articles(n=n))
    return treemap(dashboard_join(store.get_ticker_metadata(), scores), root)
