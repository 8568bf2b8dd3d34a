"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import uuid

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Runtime settings of the session the jobs run in.  Long rule chains compile to methods beyond the 8000
# bytecodes HotSpot will compile; past that limit Spark splits them into smaller ones instead.
RUNTIME = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
    # Keyed state of streams outgrows the heap; stateful processors need this store.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A single-node session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("edictal")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    if "SPARK_CHECKPOINT_DIR" in os.environ:
        builder = builder.config("spark.checkpoint.dir", os.environ["SPARK_CHECKPOINT_DIR"])
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("edictal.deal", str(partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder


# Spark removes the shuffle files of an execution as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a result that several later steps read to the shared folder, and go on from the table.

    The lineage ends there, so a lost executor repeats nothing before it, and readers still prune columns
    and push filters into the scan, which a checkpointed plan cannot.  Nothing reads the shuffle files of the writing again; they go
    with it instead of when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    folder = os.path.join(checkpoint_dir(spark), f"stage-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        (writer.option("compression", codec) if codec else writer).parquet(folder)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


# Distinct texts that are sent to every executor, in bytes; more of them are left to Spark, which moves the rows.
TEXT_BYTES = 16 << 20


def once(df: DataFrame, names: list[str], *rules: dict[str, Column]) -> DataFrame:
    """``df`` with the columns that ``rules`` make of the texts ``names``, each group of rules from the columns of those before it.

    Rules run once for every distinct text, however many rows have it.  What they say is written, so that its size is known: where the
    texts are few they are sent to the rows, whatever Spark's own limit is, as rows that are moved by their text take it along.
    """
    texts = df.select(*names).distinct()
    for group in rules:
        texts = texts.withColumns(group)
    keys = [f"_text_{i}" for i in range(len(names))]
    made = stage(texts.select(*[F.col(n).alias(k) for n, k in zip(names, keys, strict=True)], *[c for group in rules for c in group]))
    equal = reduce(and_, [F.col(n).eqNullSafe(F.col(k)) for n, k in zip(names, keys, strict=True)])
    held = made.agg(F.sum(sum((F.coalesce(F.octet_length(k), F.lit(0)) for k in keys), F.lit(100)))).first()[0] or 0
    return df.join(F.broadcast(made) if held <= TEXT_BYTES else made, equal, "left").drop(*keys)
