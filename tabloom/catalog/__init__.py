"""Operators bound to the driver's tables, each with an independent SQL check."""

from __future__ import annotations

import importlib
import textwrap
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = (
    "claims", "relational", "joins", "aggregates", "windows", "scalars", "sources", "eligibility",
    "providers", "geo", "conversion", "activity", "profiling", "modelling", "scoring", "texts",


)


def query(key: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``key`` with its optional SQL check."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate key {key}")
        QUERIES[key] = lambda spark, root: fn(Tables(spark, root))
        if sql:
            SQL[key] = textwrap.dedent(sql).strip()
        return fn

    return register


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"tabloom.catalog.{module}")
