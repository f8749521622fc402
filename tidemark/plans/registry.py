"""Queries by name, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


class Tables:
    """The tables of a folder as attributes; `seen` holds what a query has found out about them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.seen = spark, folder, {}

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        """Register a function of Tables under a name."""
        def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            self.queries[name] = lambda spark, folder: f(Tables(spark, folder))
            if sql:
                self.sql[name] = sql
            return f

        return add
