"""Registered queries: name to callable, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers the decorated query under its own name; a name can be taken once."""

        def register(f: Query) -> Query:
            if f.__name__ in self.queries:
                raise ValueError(f"{f.__name__} is registered already")
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql.strip()
            return f

        return register
