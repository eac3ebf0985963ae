"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function as the query of its name, with its SQL."""

    def add(f: Query) -> Query:
        @wraps(f)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = shipped
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Tables:
    """The tables of a directory by name: ``t.documents``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self._spark, self._dir, name)


from . import checks, conversations, documents, events, extensions, files, prompting, runs, seams, traces, vectors  # noqa: E402, F401  they register their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["validation_findings"](spark, sf_dir)
