"""How queries are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """oracle: the same query in DuckDB's SQL."""

        def register(f: Query) -> Query:
            key = name or f.__name__
            self.queries[key] = f
            if oracle:
                self.oracles[key] = oracle
            return f

        return register
