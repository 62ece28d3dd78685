"""The article and metadata store: Parquet snapshots below one folder.

    <base>/<table>/snapshot=00000001/...
    <base>/article_data/snapshot=00000001/folders=256/bucket=17/...

Metadata and universe are small: a write builds the next snapshot from the newest complete one
(Spark marks completeness with _SUCCESS). Articles are dealt to folders by a hash of their key;
an upsert reads and overwrites the folders of its batch's keys and no others. The merged rows
are written to the shared folder first, so nothing is read where it is replaced, and an upsert
that is cut off can be run again: each folder is either old or new, and a second run of the same
batch changes nothing. One writer at a time. Old snapshots stay until `expire_snapshots` removes
those that were replaced longer ago than any reader runs.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import articles as reads
from ..operators import dedup, upsert
from ..schemas import ARTICLE, ARTICLE_KEY, TICKER_META
from ..session import materialized

UNIVERSE = "indices_constituents"


ARTICLES = "article_data"
#: Folders of a new article table. A folder is the least an upsert rewrites, and one task writes it.
FOLDERS = 256


class ArticleStore:
    def __init__(self, spark: SparkSession, base: str, folders: int = FOLDERS):
        self.spark, self.base, self.folders = spark, base.rstrip("/"), folders

    def _path(self, path: str):
        """(Hadoop path, its file system)."""
        location = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return location, location.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # --- snapshots ----------------------------------------------------------------------
    def _snapshots(self, table: str) -> list[int]:
        """Numbers of the complete snapshots, through Hadoop's file system API."""
        folder, fs = self._path(f"{self.base}/{table}")
        if not fs.exists(folder):
            return []
        numbers = []
        for status in fs.listStatus(folder):
            match = re.fullmatch(r"snapshot=(\d+)", status.getPath().getName())
            if match and fs.exists(self._path(f"{status.getPath()}/_SUCCESS")[0]):
                numbers.append(int(match.group(1)))
        return sorted(numbers)

    def _snapshot_path(self, table: str, number: int) -> str:
        return f"{self.base}/{table}/snapshot={number:08d}"

    def read(self, table: str, schema: str) -> DataFrame:
        """The newest snapshot, or an empty table before the first write."""
        numbers = self._snapshots(table)
        if not numbers:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._snapshot_path(table, numbers[-1]))

    def replace(self, table: str, df: DataFrame) -> None:
        """The next snapshot of a whole table."""
        numbers = self._snapshots(table)
        path = self._snapshot_path(table, numbers[-1] + 1 if numbers else 1)
        if table == ARTICLES:
            self._write_folders(df, path, self.folders, "static")
        else:
            df.write.mode("overwrite").parquet(path)

    def expire_snapshots(self, table: str, replaced_before: int) -> list[int]:
        """Remove snapshots that were replaced before this time (milliseconds since 1970); returns their numbers.

        A reader holds the snapshot that was the newest when it began, so a time further back than
        the longest read is safe. The newest snapshot always stays.
        """
        numbers = self._snapshots(table)
        gone = []
        for number, after in zip(numbers, numbers[1:]):
            done, fs = self._path(f"{self._snapshot_path(table, after)}/_SUCCESS")
            if fs.getFileStatus(done).getModificationTime() < replaced_before:
                fs.delete(self._path(self._snapshot_path(table, number))[0], True)
                gone.append(number)
        return gone

    def expire_rejects(self, table: str, written_before: int) -> int:
        """Remove batches of rejected rows written before this time (milliseconds since 1970); returns how many."""
        folder, fs = self._path(f"{self.base}/rejects/{table}")
        old = [s.getPath() for s in fs.listStatus(folder) if s.getModificationTime() < written_before] if fs.exists(folder) else []
        for path in old:
            fs.delete(path, True)
        return len(old)

    # --- folders of articles ----------------------------------------------------------------
    @staticmethod
    def _bucket(folders: int) -> Column:
        return F.pmod(F.xxhash64(*ARTICLE_KEY), F.lit(folders)).cast("int")

    def _write_folders(self, df: DataFrame, path: str, folders: int, replaced: str = "dynamic") -> None:
        """Overwrite the folders that the rows fall into ("dynamic") or the whole table, one task a folder."""
        dealt = df.withColumns({"folders": F.lit(folders), "bucket": self._bucket(folders)})
        dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", replaced).partitionBy("folders", "bucket").parquet(path)

    def _newest_articles(self) -> tuple[str, int]:
        """Path and folder count of the newest article table, made empty where there is none."""
        if not self._snapshots(ARTICLES):
            self.replace(ARTICLES, self.spark.createDataFrame([], ARTICLE))
        path = self._snapshot_path(ARTICLES, self._snapshots(ARTICLES)[-1])
        location, fs = self._path(path)
        known = [re.fullmatch(r"folders=(\d+)", s.getPath().getName()) for s in fs.listStatus(location)]
        return path, next((int(m.group(1)) for m in known if m), self.folders)

    def _holds_rows(self, path: str) -> bool:
        """Whether a table of articles has any folder."""
        location, fs = self._path(path)
        return any(s.getPath().getName().startswith("folders=") for s in fs.listStatus(location))

    def _in_folders(self, path: str, buckets: Sequence[int]) -> DataFrame:
        """The articles of some folders; the others aren't listed for tasks or read."""
        stored = self.spark.read.schema(f"{ARTICLE}, folders int, bucket int").parquet(path)
        return stored.where(F.col("bucket").isin(list(buckets))).drop("folders", "bucket")

    def relayout(self, folders: int) -> None:
        """Deal the articles to another number of folders, as their number grows."""
        self.folders = folders
        self.replace(ARTICLES, self.articles)

    # --- tables ---------------------------------------------------------------------------
    @property
    def articles(self) -> DataFrame:
        return self.read(ARTICLES, ARTICLE).drop("folders", "bucket")

    def get_ticker_metadata(self) -> DataFrame:
        return self.read("ticker_meta", TICKER_META)

    def insert_articles(self, batch: DataFrame, as_of: Column, has_sentiment: bool = False, written: bool = False) -> int:
        """Upsert a batch; its rows without a required column are kept aside and counted.

        The batch is written first, so extraction and scoring run once, unless it is ``written``,
        a cheap projection of a stored table. Rejected rows go to a
        folder of their own below ``rejects/article_data``; their number is returned.
        """
        landed = batch if written else materialized(batch, "landed")
        rejects = self._set_aside(ARTICLES, upsert.split_rejects(landed)[1])
        prepared = materialized(upsert.prepare_batch(landed, as_of, has_sentiment), "batch")
        path, folders = self._newest_articles()
        touched = [r.bucket for r in prepared.select(self._bucket(folders).alias("bucket")).distinct().collect()]  # at most one per folder
        if touched and self._holds_rows(path):
            merged = upsert.merge_articles(self._in_folders(path, touched), prepared)
            self._write_folders(materialized(merged, "merged"), path, folders)
        elif touched:  # nothing is read, so nothing needs to be kept apart from what is replaced
            self._write_folders(upsert.merge_articles(self.spark.createDataFrame([], ARTICLE), prepared), path, folders)
        return rejects

    def forget_articles(self, before: str) -> int:
        """Remove articles posted before a date (text, as stored); returns how many. Folders without such rows stay as they are."""
        path, folders = self._newest_articles()
        old = self.articles.where(F.col("date_posted") < before).groupBy(self._bucket(folders).alias("bucket")).count()
        counts = dict(map(tuple, old.collect()))  # at most one per folder
        if counts:
            kept = materialized(self._in_folders(path, list(counts)).where(F.col("date_posted") >= before), "kept")
            self._write_folders(kept, path, folders)
            left = {r.bucket for r in kept.select(self._bucket(folders).alias("bucket")).distinct().collect()}
            for bucket in counts.keys() - left:
                location, fs = self._path(f"{path}/folders={folders}/bucket={bucket}")
                fs.delete(location, True)
        return sum(counts.values())

    def _set_aside(self, table: str, rejected: DataFrame) -> int:
        rejects = rejected.count()
        if rejects:
            rejected.write.parquet(f"{self.base}/rejects/{table}/{uuid.uuid4().hex}")
        return rejects

    def insert_ticker_metadata(self, batch: DataFrame) -> int:
        """Upsert whole metadata rows; incomplete ones are kept aside, their number is returned."""
        landed = materialized(batch, "landed")
        rejects = self._set_aside("ticker_meta", upsert.split_rejects(landed, upsert.META_REQUIRED)[1])
        self.replace("ticker_meta", upsert.upsert_ticker_meta(self.get_ticker_metadata(), landed))
        return rejects

    def get_articles(
        self,
        n: int | None = 20,
        latest: bool = True,
        has_sentiment: bool = True,
        after_date: str | None = None,
        ticker: str | None = None,
    ) -> DataFrame:
        return reads.get_articles(self.articles, n, latest, has_sentiment, after_date, ticker)

    def write_universe(self, universe: DataFrame) -> None:
        self.replace(UNIVERSE, universe)

    def get_index_constituents(self, index: str) -> DataFrame:
        numbers = self._snapshots(UNIVERSE)
        if not numbers:
            raise ValueError("no universe has been written")
        universe = self.spark.read.parquet(self._snapshot_path(UNIVERSE, numbers[-1]))
        return reads.index_constituents(universe, index)

    def query_duplicates(self) -> DataFrame:
        return dedup.query_duplicates(self.articles, tie="article_link")

    def deduplicate(self) -> None:
        self.replace(ARTICLES, dedup.delete_duplicates(self.articles, tie="article_link"))
