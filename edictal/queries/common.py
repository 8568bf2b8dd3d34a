"""Small helpers of the check queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edictal.session import once
from edictal.sources import bind, tables

Query = Callable[[SparkSession, str], DataFrame]


def view(spark: SparkSession, path: str, name: str) -> DataFrame:
    if name in bind.VIEWS:
        return bind.view(spark, path, name)
    return tables.load(spark, path, name)


def scalar(source: str, key: str, **columns) -> Query:
    """A projection of a whole view: its key and the given expressions."""

    def run(spark: SparkSession, path: str) -> DataFrame:
        return view(spark, path, source).select(key, *[c.alias(n) for n, c in _flat(columns)])

    return run


def staged(source: str, key: str, stage: Callable[[], dict], **columns) -> Query:
    """Like ``scalar`` with normal forms projected first, so the rules read ready columns."""

    def run(spark: SparkSession, path: str) -> DataFrame:
        df = view(spark, path, source).withColumns(stage())
        return df.select(key, *[c.alias(n) for n, c in _flat(columns)])

    return run


def read_once(source: str, key: str, text: str, stage: Callable[[], dict] = dict, **columns) -> Query:
    """Like ``staged`` for rules that read one text and nothing else: they run once for every distinct text."""

    def run(spark: SparkSession, path: str) -> DataFrame:
        groups = [g for g in (stage(), {n: c for n, c in _flat(columns)}) if g]
        return once(view(spark, path, source).select(key, text), [text], *groups).select(key, *columns)

    return run


def _flat(columns: dict) -> list[tuple[str, Column]]:
    """Expressions come as functions, because a column cannot be built before there is a session."""
    return [(n, c()) for n, c in columns.items()]


def text_of(array: Column) -> Column:
    """Arrays leave the check queries as text."""
    return F.array_join(array, ",")


def day(c: Column | str) -> Column:
    """Dates leave the check queries as ISO text."""
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def fields(struct: Column, *names: str, dates: tuple[str, ...] = ()) -> dict[str, Column]:
    return {n: (day(struct[n]) if n in dates else struct[n]) for n in names}
