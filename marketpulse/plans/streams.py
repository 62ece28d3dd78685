"""Streaming queries, run to the end of the landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import GIVEN
from ..session import scratch_path
from ..sources.views import Views
from ..streaming import ingest
from .news import STORE_SQL, as_of, store_rows
from .registry import query
from .sql_views import with_views


class StreamViews(Views):
    """The same views, with the events table read as a file stream."""

    def events(self) -> DataFrame:
        return ingest.file_stream(self.spark, self.folder, GIVEN["events"], "events.parquet")


def _streamed(v: Views) -> DataFrame:
    return StreamViews(v.spark, v.folder).articles()


@query(
    with_views(
        "art",
        body=f"""SELECT {STORE_SQL} FROM (
  SELECT * REPLACE (TIMESTAMP '2024-02-01' AS created_at),
         row_number() OVER (PARTITION BY ticker, headline ORDER BY arrival_seq) AS r FROM art) WHERE r = 1""",
    )
)
def stream_ingest(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "arrivals")
    ingest.append_arrivals(_streamed(v), path, f"{path}_checkpoint", as_of()).awaitTermination()
    return store_rows(ingest.resolve(v.spark.read.parquet(path)))


def _windows(v: Views, length: str, slide: str | None) -> DataFrame:
    # Watermarks need an instant; the created_at of the views has no zone.
    moved = _streamed(v).withColumn("posted_at", F.col("created_at").cast("timestamp"))
    windows = ingest.windowed_sentiment(moved, "posted_at", length, slide)
    path = scratch_path(v.spark, "windows")
    ingest.append_windows(windows, path, f"{path}_checkpoint").awaitTermination()
    schema = "ticker string, start timestamp, end timestamp, score double, n_scored bigint, n_articles bigint"
    out = v.spark.read.schema(schema).parquet(path)
    return out.select(
        "ticker", F.to_date("start").alias("start"), F.round("score", 6).alias("score"), "n_scored", "n_articles"
    )


def _windows_sql(days: int) -> str:
    return with_views(
        "art",
        body=f"""SELECT ticker, start, round(avg(compound_sentiment), 6) AS score,
  count(compound_sentiment) AS n_scored, count(*) AS n_articles
FROM (SELECT *, unnest(list_transform(range({days}), lambda i: created_at::DATE - i::INT)) AS start FROM art)
WHERE start + {days} <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY
GROUP BY ticker, start""",
    )


@query(_windows_sql(1))
def stream_daily_sentiment(v: Views) -> DataFrame:
    """Days that the one-day watermark has closed."""
    return _windows(v, "1 day", None)


@query(_windows_sql(7))
def stream_weekly_sentiment(v: Views) -> DataFrame:
    """Seven-day windows, one starting every day."""
    return _windows(v, "7 days", "1 day")
