"""Pairs of a DataFrame query and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    """Queries over the driver tables, each with its SQL where SQL can express it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a query under its function name, without trailing underscore."""

        def keep(query: Query) -> Query:
            name = query.__name__.rstrip("_")
            self.queries[name] = query
            if sql is not None:
                self.sql[name] = sql
            return query

        return keep


CATALOG = Catalog()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4, only: Sequence[str] | None = None) -> DataFrame:
    """Round floating columns, so that summation order does not show."""
    names = [n for n, kind in df.dtypes if kind == "double" and (only is None or n in only)]
    return df.withColumns({n: F.round(F.col(f"`{n}`"), digits) for n in names}) if names else df

