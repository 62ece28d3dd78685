"""Rows that can be among given keys, told before any shuffle.

The keys set bits of a bitmap of at most WORDS numbers of 64 bits, which goes to all tasks. A
row whose bit isn't set has none of the keys; the others are joined as usual, so a bit that is
set by another key costs a shuffled row and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20


def flagged(rows: DataFrame, key: Sequence[Column | str], keys: DataFrame, among: Sequence[Column | str]) -> DataFrame:
    """`rows` and `may`: false only where `key` is none of the keys `among` of `keys`, a written table."""
    h = F.xxhash64(*among)
    set_bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))
    bitmap = keys.groupBy(_word(h).alias("screen_word")).agg(set_bits.alias("screen_bits"))
    h = F.xxhash64(*key)
    bit = F.call_function("shiftright", F.coalesce("screen_bits", F.lit(0)), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    joined = rows.join(F.broadcast(bitmap), _word(h) == F.col("screen_word"), "left")  # at most WORDS rows
    return joined.withColumn("may", bit == 1).drop("screen_word", "screen_bits")


def screened(rows: DataFrame, key: Sequence[Column | str], keys: DataFrame, among: Sequence[Column | str]) -> DataFrame:
    """The rows that may be among the keys."""
    return flagged(rows, key, keys, among).where("may").drop("may")


def _word(h: Column) -> Column:
    return F.pmod(F.shiftright(h, 6), F.lit(WORDS)).cast("int")
