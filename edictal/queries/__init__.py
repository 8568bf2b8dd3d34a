"""Check queries: every operator run over whole tables.  Each takes (spark, folder of the tables)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "lifecycle", "text", "extract", "classify", "windows", "calendar", "match", "aggregate", "cdc", "catalogue", "follow",
    "jobs", "sources", "stream",
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out.update(import_module(f"edictal.queries.{name}").QUERIES)
    return out
