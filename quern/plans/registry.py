"""Queries by name, each with the SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Collects functions of a table reader; a query's name is its function's."""

    def __init__(self):
        self.all: dict[str, tuple[Callable, str | None]] = {}

    def query(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            def run(spark: SparkSession, d: str) -> DataFrame:
                return f(lambda name: spark.read.parquet(f"{d}/{name}.parquet"))

            self.all[f.__name__] = (run, sql)
            return f

        return keep

    def queries(self) -> dict[str, Callable]:
        return {k: v for k, (v, _) in self.all.items()}

    def oracle_sql(self) -> dict[str, str]:
        return {k: s for k, (_, s) in self.all.items() if s}
