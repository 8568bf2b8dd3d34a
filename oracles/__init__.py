"""Independent DuckDB SQL for the check queries."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "lifecycle", "text", "extract", "classify", "windows", "calendar", "match", "aggregate", "cdc", "catalogue", "follow",
    "jobs", "sources", "stream",
)


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out.update(import_module(f"oracles.{name}").SQL)
    return out
