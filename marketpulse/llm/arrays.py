"""Array expressions on the words of a text, all of them built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words: 0x20 and 0x09 to 0x0D.
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` evaluated once, however often the body uses it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def starts(count: Column) -> Column:
    """0, 1, ... count - 1; at least 0 alone."""
    return F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)))
