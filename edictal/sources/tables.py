"""Table scans, reference dimensions and seeds."""

from __future__ import annotations

import os
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictal.functions.text import name_keys
from edictal.schemas import MUNICIPALITIES, TABLES


# Session setting of the bench and the tests, whose fact tables are one row group and so one task; unset on a cluster.
DEAL = "edictal.deal"
# Tables that hold texts or facts; the others are dimensions.
FACTS = ("lineitem", "orders", "events", "documents", "pages", "conversations")


def load(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table by its declared schema; columns and filters are pruned by the scan."""
    df = spark.read.schema(TABLES[name]).parquet(os.path.join(path, f"{name}.parquet"))
    parts = spark.conf.get(DEAL, None)
    return df.repartition(int(parts)) if parts and name in FACTS else df


def seed(dim: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The dimension with the rows whose key it lacks."""
    return dim.unionByName(absent(rows.dropDuplicates(keys), dim, keys))


def absent(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key ``stored`` lacks; null key parts are equal to each other, so what was stored once stays stored."""
    theirs = stored.select(*[F.col(k).alias(f"_stored_{i}") for i, k in enumerate(keys)])
    equal = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_stored_{i}")) for i, k in enumerate(keys)])
    return rows.join(theirs, equal, "left_anti")


# Provinces by the first two digits of the municipality code, smallest valid catalogue.
PROVINCES = {"03": "Alicante", "12": "Castellón", "46": "Valencia"}
SMALLEST_CATALOGUE = 500


def load_municipalities(spark: SparkSession, path: str, smallest: int = SMALLEST_CATALOGUE) -> DataFrame:
    """S3: municipality catalogue with its alias keys; a file with too few rows is rejected."""
    raw = spark.read.csv(path, sep=";", header=True, schema=MUNICIPALITIES, encoding="UTF-8")
    code = F.lpad(F.trim("codigo_ine"), 5, "0")
    province = F.create_map(*[F.lit(x) for pair in PROVINCES.items() for x in pair])[F.left(code, F.lit(2))]
    towns = raw.select(
        code.alias("ine"), province.alias("province"), F.trim("nombre").alias("name"), F.trim("nombre_val").alias("name_val"),
    ).filter((F.length("name") > 0) & (F.length("name_val") > 0) & F.col("province").isNotNull())
    if towns.limit(smallest).count() < smallest:
        raise ValueError("the municipality catalogue received is not valid")
    return towns.withColumn("aliases", F.array_union(name_keys("name"), name_keys("name_val")))
