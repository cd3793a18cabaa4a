"""How query modules name their queries and read tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Queries:
    """Collects queries under their names, each with the SQL that DuckDB runs on the same tables, if there is any."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql:
                self.sql[name] = sql
            return f

        return register
