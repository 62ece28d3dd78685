"""Incremental ingestion and daily sentiment with Structured Streaming.

Arrivals are appended, never merged in place: a micro-batch costs what it brings, not the
size of the store. Repeats of an arrival within the watermark are dropped by the stream's state.
A compaction folds the batches since the last one into the article store, whose folders of
other keys it doesn't touch; the current state is then the store and the batches after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordering import top_per_key
from ..operators.upsert import split_rejects
from ..schemas import ARTICLE, ARTICLE_CONTENT, ARTICLE_KEY, SCORE_COLUMNS
from ..sources.store import ArticleStore

WATERMARK = "1 day"


def file_stream(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """Parquet files of a landing folder, each read once."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def without_repeats(articles: DataFrame, moment: str, watermark: str = WATERMARK) -> DataFrame:
    """The stream without rows that say the same about an article as one within the watermark before.

    Scrapes land the same items again and again; an item whose content or scores changed is no
    repeat. State holds a row's values until the watermark on ``moment``, the scrape time, passes it;
    rows later than the watermark are dropped.
    """
    same = [*ARTICLE_KEY, *(c for c in (*ARTICLE_CONTENT, *SCORE_COLUMNS) if c in articles.columns)]
    return articles.withWatermark(moment, watermark).dropDuplicatesWithinWatermark(same)


def append_arrivals(articles: DataFrame, path: str, checkpoint: str, as_of: Column) -> StreamingQuery:
    """Write each micro-batch, one row per key, below its own batch_id.

    A batch that is run again after a failure replaces its own folder, so a retry leaves no
    copies. Rows without a required column go to ``<path>_rejects``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        valid, rejects = split_rejects(batch)
        first = top_per_key(valid, ARTICLE_KEY, [F.col("arrival_seq")])
        first.withColumn("created_at", as_of).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        rejects.write.mode("overwrite").parquet(f"{path}_rejects/batch_id={batch_id}")

    return (
        articles.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def resolve(arrivals: DataFrame) -> DataFrame:
    """The current article per key from all arrivals.

    The newest batch wins, and inside it the lowest arrival_seq. Scores come from the newest
    arrival that has any, so an unscored re-arrival keeps them. One aggregation with
    map-side merging: a key that arrived very often stays small.
    """
    order = F.struct(F.col("batch_id"), (-F.col("arrival_seq")).alias("first"))
    scored = F.col("compound_sentiment").isNotNull()
    state = arrivals.groupBy(*ARTICLE_KEY).agg(
        F.max_by(F.struct(*ARTICLE_CONTENT, "created_at"), order).alias("content"),
        F.max_by(F.struct(*SCORE_COLUMNS), F.when(scored, order)).alias("scores"),
    )
    return state.select(*ARTICLE_KEY, "content.*", "scores.*")


def windowed_sentiment(
    articles: DataFrame, moment: str, length: str = "1 day", slide: str | None = None, watermark: str = WATERMARK
) -> DataFrame:
    """Mean score and counts per ticker and window; a window is emitted once it is closed.

    State is bounded by the windows the watermark still holds open.
    """
    span = F.window(moment, length, slide) if slide else F.window(moment, length)
    return (
        articles.withWatermark(moment, watermark)
        .groupBy(span.alias("span"), "ticker")
        .agg(
            F.avg("compound_sentiment").alias("score"),
            F.count("compound_sentiment").alias("n_scored"),
            F.count(F.lit(1)).alias("n_articles"),
        )
        .select("ticker", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "score", "n_scored", "n_articles")
    )


def append_windows(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Closed windows to Parquet, exactly once."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


# --- compaction ---------------------------------------------------------------------------------------
def _arrivals_after(spark: SparkSession, path: str, mark: int) -> DataFrame:
    """Arrivals of batches after `mark`; folders of earlier batches aren't read."""
    schema = f"{ARTICLE}, arrival_seq bigint, batch_id bigint".replace(" not null", "")
    return spark.read.schema(schema).parquet(path).where(F.col("batch_id") > mark)


def _marks(store: ArticleStore, path: str) -> tuple[str, list[int]]:
    """Where the marks of a stream's compactions are, and the numbers of the last batches they folded."""
    folder = f"{path}_folded"
    location, fs = store._path(folder)
    names = [s.getPath().getName() for s in fs.listStatus(location)] if fs.exists(location) else []
    return folder, sorted(int(n.removeprefix("upto=")) for n in names if n.startswith("upto="))


def compact(store: ArticleStore, path: str) -> int:
    """Fold the arrivals since the last compaction into the store; returns the last batch folded, or -1.

    Unscored arrivals keep stored scores, scored ones overwrite them. The mark is set after the
    store is written; a compaction that is cut off before is repeated, which changes nothing.
    """
    folder, marks = _marks(store, path)
    mark = marks[-1] if marks else -1
    fresh = _arrivals_after(store.spark, path, mark)
    newest = fresh.agg(F.max("batch_id")).first()[0]
    if newest is None:
        return mark
    state = resolve(fresh.where(F.col("batch_id") <= newest))
    scored = F.col("compound_sentiment").isNotNull()
    store.insert_articles(state.where(~scored), F.col("created_at"))
    store.insert_articles(state.where(scored), F.col("created_at"), has_sentiment=True)
    location, fs = store._path(f"{folder}/upto={newest}")
    fs.mkdirs(location)
    return newest


def current(store: ArticleStore, path: str) -> DataFrame:
    """The current article per key: the store, and the arrivals that no compaction has folded yet."""
    _, marks = _marks(store, path)
    fresh = resolve(_arrivals_after(store.spark, path, marks[-1] if marks else -1))
    incoming = fresh.select(*ARTICLE_KEY, F.struct(*[c for c in fresh.columns if c not in ARTICLE_KEY]).alias("__new"))
    both = store.articles.join(incoming, list(ARTICLE_KEY), "full_outer")
    hit, rescored = F.col("__new").isNotNull(), F.col("__new.compound_sentiment").isNotNull()
    columns = []
    for name in store.articles.columns:
        if name not in ARTICLE_KEY:
            takes = rescored if name in SCORE_COLUMNS else hit
            columns.append(F.when(takes, F.col(f"__new.{name}")).otherwise(F.col(name)).alias(name))
    return both.select(*ARTICLE_KEY, *columns)
