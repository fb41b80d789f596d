"""The queries that the library offers, by name, and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plinth.sources import listings as source

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir); ``sql`` may use the views ``listings`` and ``raw_listings``."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = source.with_views(sql)
        return f

    return register
