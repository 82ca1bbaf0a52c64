"""Queries by name, each with the SQL that tells the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Checks of the analysis plane on scripts or constants of the library itself: they read no given table, so only tests run them.
CORPUS_QUERIES: dict[str, Query] = {}
CORPUS_ORACLES: dict[str, str] = {}


def _adder(queries: dict[str, Query], oracles: dict[str, str], sql: str | None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if function.__name__ in QUERIES or function.__name__ in CORPUS_QUERIES:
            raise ValueError(f"{function.__name__} is registered twice")
        queries[function.__name__] = function
        if sql is not None:
            oracles[function.__name__] = sql
        return function

    return add


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its name."""
    return _adder(QUERIES, ORACLES, sql)


def corpus_query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a check on the library's own scripts, for the tests alone."""
    return _adder(CORPUS_QUERIES, CORPUS_ORACLES, sql)
