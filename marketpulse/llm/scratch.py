"""Intermediate tables in the shared folder that go as soon as nothing reads them."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from ..session import materialized, scratch_path


class Scratch:
    """Tables by name. A table may be removed once what was made from it is written: a written table needs no lineage."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark
        self._paths: dict[str, list[str]] = defaultdict(list)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self._spark, name)
        self._paths[name].append(path)
        return materialized(df, name, path)

    def remove(self, *names: str) -> None:
        for name in names:
            self._delete(self._paths.pop(name, []))

    def keep_last(self, name: str) -> None:
        """Remove all tables of this name but the one written last."""
        self._delete(self._paths[name][:-1])
        del self._paths[name][:-1]

    def _delete(self, paths: list[str]) -> None:
        context = self._spark.sparkContext
        for path in paths:
            location = context._jvm.org.apache.hadoop.fs.Path(path)
            location.getFileSystem(context._jsc.hadoopConfiguration()).delete(location, True)
