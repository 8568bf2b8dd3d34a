"""Sinks: versioned snapshots, append-only facts, review reports."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, folder: str, version: str) -> str:
    """The next version of a snapshot in a folder of its own; a version is never written over."""
    target = os.path.join(folder, f"version={version}")
    df.write.mode("errorifexists").parquet(target)
    return target


def append_facts(df: DataFrame, folder: str, day: str = "published") -> None:
    """Append facts, partitioned by month so that a scan of a window prunes whole folders."""
    df.withColumn("month", F.date_format(day, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(folder)


def read_window(spark: SparkSession, folder: str, schema, first, last, day: str = "published") -> DataFrame:
    """Facts of a date window; the month filter prunes partitions before any file is opened."""
    months = (F.col("month") >= F.date_format(F.lit(first), "yyyy-MM")) & (F.col("month") <= F.date_format(F.lit(last), "yyyy-MM"))
    return spark.read.schema(schema).parquet(folder).filter(months & F.col(day).between(first, last))


def write_report(df: DataFrame, folder: str) -> None:
    """Review report as UTF-8 CSV with semicolons and a header."""
    df.write.mode("errorifexists").csv(folder, sep=";", header=True, encoding="UTF-8")
