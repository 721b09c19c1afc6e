"""Where the runnable queries are collected, each beside the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from eventloom.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where one exists, its SQL; ``$NAME`` in the SQL stands for a shared CTE."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = expand(sql)
        return fn

    return add


def expand(sql: str) -> str:
    from eventloom.plans.tables import CTES

    for _ in range(3):
        for key, text in sorted(CTES.items(), key=lambda kv: -len(kv[0])):
            sql = sql.replace(f"${key}", text)
    return sql.strip()
