"""Registering a query together with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausegrid.plans.corpora import Corpora
from clausegrid.registry.shared_sql import with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(corpora) -> DataFrame``; ``sql`` may use the shared derived tables."""

    def add(fn: Callable[[Corpora], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Corpora(spark, folder))
        if sql is not None:
            ORACLE[name] = with_tables(sql)
        return fn

    return add
