from __future__ import annotations

from pyspark.sql import functions as F

from edictal.functions.classify import pool_operating
from edictal.functions.text import fold
from edictal.queries.common import day, view
from edictal.queries.sources import scratch
from edictal.sources.bind import PHASES, pick
from edictal.streaming import stream as S


def drive(spark, stream, schema):
    """Run a stream over all that is available and read what it wrote."""
    folder = scratch(spark)
    S.run_to_table(stream, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(schema).parquet(f"{folder}/out")


def dedup_stream(spark, path):
    """Every event read twice comes out once."""
    stream = S.read_stream(spark, path)
    twice = stream.unionByName(stream).select("event_id", "user_id", "event_type", "ts")
    out = drive(spark, S.dedup_stream(twice, ["event_id"]), "event_id BIGINT, user_id BIGINT, event_type STRING, ts TIMESTAMP")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_n"))


def split_late(spark, path):
    e = view(spark, path, "events").select("event_id", "ts")
    on_time, late = S.split_late(e, F.lit("2024-01-05").cast("timestamp_ntz"))
    both = on_time.withColumn("part", F.lit("ON_TIME")).unionByName(late.withColumn("part", F.lit("LATE")))
    return both.select("event_id", "part")


def closed_days(spark, path):
    """Days with a later day behind them are final."""
    out = drive(spark, S.closed_days(S.read_stream(spark, path)), "window STRUCT<start: TIMESTAMP, end: TIMESTAMP>, event_type STRING, n BIGINT")
    return out.select(day(F.to_date("window.start")).alias("day"), "event_type", "n")


def k():
    return F.get_json_object("props", "$.k").cast("int")


def track_seen(spark, path):
    """T4: each signature of a pool once, however often it is read; one batch is all baseline."""
    folder = scratch(spark)
    stream = S.read_stream(spark, path).select(F.col("user_id").alias("pool_id"), F.concat_ws("_", "event_type", k() % 20).alias("signature"))
    S.track_seen(stream, folder, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("pool_id BIGINT, signature STRING, news BOOLEAN").parquet(f"{folder}/out/batch=*")


def debounce_stream(spark, path):
    """T5: every reading at which a pool is inactive for the second time in a row."""
    folder = scratch(spark)
    off = F.coalesce(~pool_operating(fold(pick(PHASES, k() % len(PHASES)))), F.lit(False))
    stream = S.read_stream(spark, path).select(F.col("user_id").alias("pool_id"), F.col("ts").alias("read_at"), F.col("event_id").alias("reading_id"), off.alias("off"))
    S.debounce_stream(stream, folder, f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("pool_id BIGINT, reading_id BIGINT").parquet(f"{folder}/out/batch=*")


def news_from_batches(spark, path):
    """Keys published once over all batches."""
    folder = scratch(spark)
    stream = S.read_stream(spark, path).select("user_id", "event_type")
    S.news_from_batches(stream, f"{folder}/news", ["user_id", "event_type"], f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("user_id BIGINT, event_type STRING").parquet(f"{folder}/news/batch=*")


def backfill(spark, path):
    """History read in one go and marked silent."""
    folder = scratch(spark)
    stream = S.read_stream(spark, path).select("event_id", "event_type")
    S.backfill(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("event_id BIGINT, event_type STRING, notify BOOLEAN").parquet(f"{folder}/out").groupBy("event_type", "notify").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (dedup_stream, split_late, closed_days, track_seen, debounce_stream, news_from_batches, backfill)}
