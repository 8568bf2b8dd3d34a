"""Micro-batch reading of the periodic cycle.

The cycle re-reads overlapping windows, so every stage is at-least-once in and exactly-once out: keys
deduplicate within a watermark, state is kept per key, and sinks are written per batch under the batch id.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from edictal.schemas import TABLES


def read_stream(spark: SparkSession, path: str, name: str = "events", files_per_batch: int = 1000) -> DataFrame:
    """A table as a file stream; event times become zoned timestamps, which watermarks need.

    A table stored as a folder is streamed from that folder; one stored as a single file is found by its name.
    """
    table = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, f"{name}.parquet"))
    files = table.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(table):
        raise FileNotFoundError(f"no table {name} in {path}")
    reader = spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", files_per_batch)
    if files.getFileStatus(table).isDirectory():
        raw = reader.parquet(table.toString())
    else:
        raw = reader.option("pathGlobFilter", f"{name}.parquet").parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def dedup_stream(stream: DataFrame, keys: list[str], delay: str = "30 days") -> DataFrame:
    """Overlapping re-reads give one row per natural key; state older than the delay is dropped."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def split_late(batch: DataFrame, bound, at: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows in time, and rows older than the read window, which a history run must pick up."""
    late = F.coalesce(F.col(at) < bound, F.lit(False))
    return batch.filter(~late), batch.filter(late)


def committed_watermark(spark: SparkSession, checkpoint: str, batch_id: int) -> Column:
    """The watermark a query committed with a batch, or null before the first."""
    if batch_id < 0:
        return F.lit(None).cast("timestamp")
    # The layout of a query's commit log, a version line and one of JSON.
    log = spark.read.text(f"{checkpoint}/commits/{batch_id}").filter(F.col("value").startswith("{"))
    found = log.select(F.get_json_object("value", "$.nextBatchWatermarkMs").cast("long").alias("ms")).head()
    return F.timestamp_millis(F.lit(found.ms if found and found.ms else None).cast("long"))


def closed_days(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts of days that are over; an open day is not final and is not emitted."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))


def _start(stream: DataFrame, step, checkpoint: str):
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(stream: DataFrame, folder: str, checkpoint: str, at: str = "ts", delay: str = "30 days"):
    """A stream dealt into rows in time (``out``) and rows older than its watermark (``late``), which a history run must pick up.

    The bound of a batch is the watermark that Spark committed with the batch before it, so a batch that runs again, also after a
    restart, is dealt alike.  The first batch has no bound.  Rows without a time are in time.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        bound = committed_watermark(batch.sparkSession, checkpoint, batch_id - 1)
        on_time, late = split_late(batch, bound, at)
        on_time.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{folder}/late/batch={batch_id}")

    return _start(stream.withWatermark(at, delay), step, checkpoint)


def seen_owner(owner: str, item: str) -> StatefulProcessor:
    """The processor of ``track_seen``; classes made in a function travel to workers that do not have this package."""

    class SeenOwner(StatefulProcessor):
        """What is known of an owner: the version it was read under and the day up to which it was read."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getValueState("known", "version INT, reviewed_until DATE")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            before = self.known.get()
            version, until = before if before is not None else (None, None)
            newest, days = version, [] if until is None else [until]
            for part in rows:
                newest = max([v for v in (newest, int(part["version"].max())) if v is not None])
                days += part["day"].dropna().tolist()
                items = part[part["mark"] == "item"]
                if len(items):
                    # An owner not known, or known under an earlier version, only sets its baseline.
                    news = (items["version"] == version).to_numpy(bool) if version is not None else [False] * len(items)
                    yield pd.DataFrame({owner: key[0], item: items[item].to_numpy(), "news": news, "version": items["version"].to_numpy(), "since": until})
            self.known.update((newest, max(days) if days else None))

        def close(self) -> None:
            pass

    return SeenOwner()


def track_seen(stream: DataFrame, folder: str, checkpoint: str, owner: str = "pool_id", item: str = "signature", read_on: str | None = None, version: int = 1):
    """T4: every item of an owner once; items first seen in the batch in which their owner is are its silent
    baseline, later ones are news.  ``since`` is the day up to which the owner had been read before (``read_on``: the day of a row).

    Items that were seen are the state of Spark's own deduplication, dealt by owner and item, so an owner with a third of all rows
    is spread.  What is left, new items and days, reaches the owner's own state: its version and reviewed-until day, which never expire.
    Started with a higher ``version``, items are read anew, and the first batch of an owner under it is a silent baseline again.
    A batch that runs again replaces its own folder; no earlier output is read.
    """
    kinds = dict(stream.dtypes)
    day = F.col(read_on).cast("date") if read_on else F.lit(None).cast("date")
    none = F.lit(None)
    marks = F.array(
        F.struct(F.lit("item").alias("mark"), F.col(item).alias(item), none.cast("date").alias("day")),
        F.struct(F.lit("day").alias("mark"), none.cast(kinds[item]).alias(item), day.alias("day")),
    )
    marked = stream.select(owner, F.explode(marks).alias("_m")).select(owner, "_m.*", F.lit(version).alias("version")).filter((F.col("mark") == "item") | F.col("day").isNotNull())
    fresh = marked.dropDuplicates([owner, "mark", item, "day", "version"])
    told = fresh.groupBy(owner).transformWithStateInPandas(
        seen_owner(owner, item), outputStructType=f"`{owner}` {kinds[owner]}, `{item}` {kinds[item]}, news BOOLEAN, version INT, since DATE", outputMode="Append", timeMode="None"
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return _start(told, step, checkpoint)


def last_reading() -> StatefulProcessor:
    """The processor of ``debounce_stream``."""

    class LastReading(StatefulProcessor):
        """Compares every reading of a pool with the one before it; keeps the last."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "read_at TIMESTAMP, reading_id BIGINT, off BOOLEAN")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat([p[["read_at", "reading_id", "off"]] for p in rows], ignore_index=True).assign(new=True)
            before = self.last.get()
            if before is not None:
                batch = pd.concat([pd.DataFrame([[*before, False]], columns=batch.columns), batch], ignore_index=True)
            batch = batch.sort_values(["read_at", "reading_id"], kind="stable")
            off = batch["off"].to_numpy(bool)
            closing = batch["new"].to_numpy(bool) & off & np.concatenate([[False], off[:-1]])
            newest = batch.iloc[-1]
            self.last.update((newest["read_at"].to_pydatetime(), int(newest["reading_id"]), bool(newest["off"])))
            yield batch.loc[closing, ["read_at", "reading_id"]].assign(pool_id=key[0])[["pool_id", "read_at", "reading_id"]]

        def close(self) -> None:
            pass

    return LastReading()


def debounce_stream(stream: DataFrame, folder: str, checkpoint: str):
    """T5: readings at which a pool closes: it and the one before are both inactive, across batches.

    ``stream``: pool_id, read_at, reading_id, off.  The last reading of every pool is its keyed state, which never expires.  Readings of
    a batch come in any order and are sorted by time; of a pool, only those of one batch are held, in three narrow columns, and the
    files a batch takes bound them.
    """
    readings = stream.select("pool_id", F.col("read_at").cast("timestamp").alias("read_at"), F.col("reading_id").cast("long").alias("reading_id"), F.coalesce("off", F.lit(False)).alias("off"))
    closing = readings.groupBy("pool_id").transformWithStateInPandas(
        last_reading(), outputStructType=f"pool_id {dict(readings.dtypes)['pool_id']}, read_at TIMESTAMP, reading_id BIGINT", outputMode="Append", timeMode="None"
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return _start(closing, step, checkpoint)


def news_from_batches(stream: DataFrame, folder: str, keys: list[str], checkpoint: str):
    """News events of every micro-batch: the keys no earlier batch published, by Spark's own deduplication."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return _start(stream.dropDuplicates(keys), step, checkpoint)


def backfill(stream: DataFrame, folder: str, checkpoint: str, notify: bool = False):
    """Everything available, then stop; rows are marked so that nobody is notified of history."""
    marked = stream.withColumn("notify", F.lit(notify))
    return (
        marked.writeStream.format("parquet").outputMode("append").option("path", folder)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def run_to_table(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Drive a query over all that is available into a Parquet folder and wait for it."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", folder).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
