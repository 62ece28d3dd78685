"""Exact order statistics of a column without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialized

_BINS = 1024


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest non-null value (1 is the largest); None where there are fewer or k < 1.

    Counts per bin of the range that holds the value come to the driver (at most 1,024 rows);
    the range shrinks to one bin until a single value is left.
    """
    value = F.col(column).cast("double")
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if not 1 <= k <= n:
        return None
    above = 0
    inside = df.where(value.isNotNull())
    while low < high:
        width = (high - low) / _BINS
        slot = F.floor((value - F.lit(low)) / F.lit(width)) if width > 0 else (value >= F.lit(high)).cast("long")
        rows = inside.where(value.between(low, high)).groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        for _, n, low_in, high_in in sorted(map(tuple, rows.collect()), reverse=True):
            if above + n >= k:
                low, high = low_in, high_in
                break
            above += n
    return low


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in (0, 1) that depends on the keys and the seed only."""
    return (F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 50)).cast("double") + 0.5) / float(1 << 50)


def distinct_sample(df: DataFrame, label: str, value: str, n: int) -> list:
    """At most `n` rows for each value of `label`, the first by a hash of the string `value`; equal strings count once.

    Of the rows of a string the one whose hash is smallest stands for it. `label` must have
    few values. A task keeps `n` rows of a label before anything is collected.
    """
    whole = F.struct(F.xxhash64(*df.columns).alias("__row"), *[F.col(c) for c in df.columns if c not in (label, value)])
    distinct = materialized(df.groupBy(label, value).agg(F.min(whole).alias("__one")), "distinct")
    rows = []
    for r in distinct.select(label).distinct().orderBy(label).collect():
        first = distinct.where(F.col(label) == F.lit(r[0])).orderBy(F.xxhash64(value), value).limit(n)
        rows += first.select(label, value, "__one.*").drop("__row").collect()
    return rows
