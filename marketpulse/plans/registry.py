"""Named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.views import Views

Build = Callable[[Views], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(oracle: str | None = None) -> Callable[[Build], Build]:
    """Register a function under its own name."""

    def register(build: Build) -> Build:
        name = build.__name__
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, oracle)
        return build

    return register


def r6(column: str | Column) -> Column:
    """A double rounded to 6 places: sums differ in their last bits between engines."""
    name = F.col(column) if isinstance(column, str) else column
    out = F.round(name.cast("double"), 6)
    return out.alias(column) if isinstance(column, str) else out
