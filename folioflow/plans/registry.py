"""Named queries, each with the SQL that states it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}
        self.rows: dict[str, str] = {}

    def query(self, rows: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function's name; rows: the inventory rows it covers."""

        def add(f: Query) -> Query:
            name = f.__name__
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name], self.rows[name] = f, rows
            if sql:
                self.oracles[name] = sql
            return f

        return add

    def include(self, other: Registry) -> None:
        for name, f in other.queries.items():
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name], self.rows[name] = f, other.rows[name]
        self.oracles |= other.oracles
