"""A catalogue of queries: each a callable over (spark, folder) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folium.session import short_methods, table

Query = Callable[[SparkSession, str], DataFrame]


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None, *names: str):
        """Registers a function over DataFrames of the named tables under its own name."""

        def wrap(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                short_methods(spark)
                return f(*[table(spark, sf_dir, n) for n in names])

            self.queries[f.__name__] = run
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return wrap
