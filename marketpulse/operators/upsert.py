"""Set-based upserts. Plain Parquet has no MERGE, so each returns the next snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import (
    ARTICLE_CONTENT,
    ARTICLE_KEY,
    ARTICLE_REQUIRED,
    SCORE_COLUMNS,
    SCORER_TO_STORE,
)
from .ordering import top_per_key

META_REQUIRED = ("ticker", "sector", "industry", "companyName")


def split_rejects(batch: DataFrame, required: Sequence[str] = ARTICLE_REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(rows that have every required column, rows that lack one)."""
    complete = F.lit(True)
    for name in required:
        complete = complete & F.col(name).isNotNull()
    return batch.where(complete), batch.where(~complete)


def upsert(
    store: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    replaced: Sequence[str],
) -> DataFrame:
    """Merge of a keyed store with a batch that has one row per key.

    ``replaced`` columns take the batch's value, nulls included, wherever the batch has the
    key; all other columns keep the stored value. Both sides are unique per key, so no join
    here can skew.
    """
    keys = list(keys)
    incoming = batch.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in replaced), F.lit(True).alias("__hit"))
    return _merged(store.join(incoming, keys, "full_outer"), store, keys, replaced)


def _merged(joined: DataFrame, store: DataFrame, keys: Sequence[str], replaced: Sequence[str]) -> DataFrame:
    columns = []
    for field in store.schema.fields:
        column = F.col(field.name)
        if field.name in replaced:
            new = F.col(f"__new_{field.name}").cast(field.dataType)
            column = F.when(F.col("__hit"), new).otherwise(column).alias(field.name)
        columns.append(column)
    return joined.select(*columns)


def _store_names(batch: DataFrame) -> DataFrame:
    return batch.withColumnsRenamed({k: v for k, v in SCORER_TO_STORE.items() if k in batch.columns})


def prepare_batch(batch: DataFrame, as_of: Column, has_sentiment: bool = False) -> DataFrame:
    """One complete row per key, under the store's names.

    The row with the lowest ``arrival_seq`` wins; where there is none or it ties, the first by
    the content columns, so a key is never there twice. Rows that miss a required column are left
    out (see ``split_rejects``).
    """
    batch = _store_names(batch)
    columns = [*ARTICLE_CONTENT, *(SCORE_COLUMNS if has_sentiment else ())]
    missing = [c for c in columns if c not in batch.columns]
    if missing:
        raise ValueError(f"batch lacks columns {missing}")
    valid, _ = split_rejects(batch)
    first = [F.col(c) for c in ("arrival_seq", *columns) if c in batch.columns]
    valid = top_per_key(valid, ARTICLE_KEY, first)
    return valid.select(*ARTICLE_KEY, *columns, as_of.alias("created_at"))


def merge_articles(store: DataFrame, prepared: DataFrame) -> DataFrame:
    """Next article snapshot from a prepared batch: it wins over the store.

    Without scores in the batch the stored scores survive; with scores they are overwritten.
    """
    replaced = [c for c in prepared.columns if c not in ARTICLE_KEY]
    return upsert(store, prepared, ARTICLE_KEY, replaced)


def upsert_articles(store: DataFrame, batch: DataFrame, as_of: Column, has_sentiment: bool = False) -> DataFrame:
    """Next article snapshot from a raw batch."""
    return merge_articles(store, prepare_batch(batch, as_of, has_sentiment))


def upsert_ticker_meta(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Next metadata snapshot: whole rows replaced, the last arrival per ticker wins."""
    valid, _ = split_rejects(batch, META_REQUIRED)
    latest = top_per_key(valid, ["ticker"], [F.col("arrival_seq").desc()])
    return upsert(store, latest, ["ticker"], ["sector", "industry", "mCap", "companyName"])


def attach_scores(articles: DataFrame, scores: DataFrame) -> DataFrame:
    """Articles that have scores, with those scores and their own created_at."""
    kept = articles.drop(*SCORE_COLUMNS)
    return kept.join(_store_names(scores).select(*ARTICLE_KEY, *SCORE_COLUMNS), list(ARTICLE_KEY), "inner")
