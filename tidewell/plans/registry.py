"""The registry of queries: each is a function of a Corpus, with the SQL of its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans.corpus import Corpus, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The viewer and the moment that the registered queries use.
VIEWER = "src3"
NOW = "2024-01-20 12:00:00"


def query(sql: str | None = None, **tables: str):
    """Registers a function of a Corpus under its own name; sql may name derived tables, and tables adds more of them."""

    def register(fn: Callable[[Corpus], DataFrame]):
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_tables(sql, **tables)
        return fn

    return register
