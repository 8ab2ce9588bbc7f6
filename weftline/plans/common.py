"""How queries over the driver's tables are written down."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Plans:
    """Queries by name, with the SQL that checks each (None where SQL can't express it)."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None) -> None:
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def plan(self, name: str, sql: str | None) -> Callable[[Query], Query]:
        def put(query: Query) -> Query:
            self.add(name, query, sql)
            return query

        return put


def six(c: Column) -> Column:
    return F.round(c, 6) + 0.0  # no negative zero
