"""Named queries with their SQL: one decorator keeps the two side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return add


def r6(x: Column | str) -> Column:
    """Doubles to six places: sums run in another order in another engine."""
    return F.round(F.col(x).cast("double") if isinstance(x, str) else x.cast("double"), 6)


def r9(value: Column | str) -> Column:
    """What rankings are ordered by: equal sums in any order of their parts, and no tie that isn't one."""
    return F.round(F.col(value) if isinstance(value, str) else value, 9)
