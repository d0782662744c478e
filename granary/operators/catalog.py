"""How a module registers its queries: a build function, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Catalog(dict[str, Query]):
    def query(self, sql: str | None = None) -> Callable:
        """Registers the decorated function under its own name."""

        def register(build: Callable[[SparkSession, str], DataFrame]):
            self[build.__name__] = Query(build, sql)
            return build

        return register


class Tables:
    """The parquet tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")
