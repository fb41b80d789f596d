"""Registered queries: operators bound to tables, with the SQL they are checked against."""

from plinth.plans import cleaning, dashboard, drift_queries, imputation, ingest, modelling, profiling, statistics  # noqa: F401
from plinth.plans.registry import ORACLES, QUERIES  # noqa: F401
