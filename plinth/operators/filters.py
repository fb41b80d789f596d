"""Predicates built from optional arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the choice in a list that means no restriction.
ALL = "Tümü"


def filter_dynamic(df: DataFrame, equal: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, skip=()) -> DataFrame:
    """The conjunction of the predicates whose values say something: falsy values and ``ALL`` restrict nothing, nor do columns in ``skip``."""
    parts: list[Column] = []
    for values, test in ((equal, Column.__eq__), (at_least, Column.__ge__), (at_most, Column.__le__)):
        parts += [test(F.col(c), F.lit(v)) for c, v in (values or {}).items() if v and v != ALL and c not in skip]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df


def filter_not_value(df: DataFrame, required: str, first: str, second: str, value) -> DataFrame:
    """Rows whose ``required`` isn't null and whose coalesced pair isn't ``value``; a null pair stays."""
    return df.where(F.col(required).isNotNull() & ~F.coalesce(first, second).eqNullSafe(value))


def observed(df: DataFrame, observation, name: str = "rows") -> DataFrame:
    """Counts rows as they pass, in whatever job reads ``df``."""
    return df.observe(observation, F.count(F.lit(1)).alias(name))
