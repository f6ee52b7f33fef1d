"""Where query modules register: a Spark function and, where SQL can say the same, its oracle."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import load_table


class Tables:
    """Lazy access to the parquet tables of one folder: ``t.orders`` is a DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return load_table(self.spark, f"{self.folder}/{name}.parquet")


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query function ``f(t: Tables) -> DataFrame`` under a name, with its oracle SQL if there is one."""

    def add(f):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def with_ctes(*parts: tuple[str, str], body: str, stored: Collection[str] = ()) -> str:
    """``WITH a AS (...), b AS (...) body``; parts named in ``stored`` are computed once (they are read several times)."""
    return "WITH " + ", ".join(f"{n} AS {'MATERIALIZED ' if n in stored else ''}({s})" for n, s in parts) + " " + body
