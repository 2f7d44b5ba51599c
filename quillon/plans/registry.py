"""A list of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.all: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(q: Query) -> Query:
            self.all[name] = q
            if sql:
                self.sql[name] = sql
            return q

        return keep

    def queries(self) -> dict[str, Query]:
        return dict(self.all)

    def oracle_sql(self) -> dict[str, str]:
        return dict(self.sql)
