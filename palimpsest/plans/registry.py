"""Query name -> (frame, SQL). A query is a function of a World; its oracle is SQL over the same entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.plans.projection import SQL, World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, world: bool = True):  # noqa: ANN201
    """Register a function of a World under a name; `sql` follows the entities' common table expressions if world is set."""

    def add(build: Callable[[World], DataFrame]) -> Callable[[World], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(World(spark, folder))
        if sql:
            ORACLES[name] = SQL + sql if world else sql
        return build

    return add
