from __future__ import annotations

import datetime as dt
import random

import pytest

from edictal.operators.windows import previous
from edictal.streaming import stream as S


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def write(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_seen_items_over_two_batches(spark, tmp_path):
    schema, folder = "pool_id long, signature string", str(tmp_path / "in")
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    write(spark, [(1, "a"), (1, "a"), (1, "b")], schema, folder)
    S.track_seen(source(spark, folder, schema), out, check).awaitTermination()
    write(spark, [(1, "b"), (1, "c"), (2, "x")], schema, folder)
    S.track_seen(source(spark, folder, schema), out, check).awaitTermination()
    rows = spark.read.schema(schema + ", news boolean").parquet(out + "/out/batch=*").collect()
    assert sorted((r.pool_id, r.signature, r.news) for r in rows) == [(1, "a", False), (1, "b", False), (1, "c", True), (2, "x", False)]


def test_debounce_over_batches_equals_one_pass(spark, tmp_path):
    schema, folder = "pool_id long, read_at timestamp, reading_id long, off boolean", str(tmp_path / "in")
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    rows = [(i % 3, dt.datetime(2026, 1, 1) + dt.timedelta(hours=7 * i), i, (i * i) % 5 < 3) for i in range(60)]
    for part in (rows[:20], rows[20:25], rows[25:]):
        write(spark, random.Random(3).sample(part, len(part)), schema, folder)
        S.debounce_stream(source(spark, folder, schema), out, check).awaitTermination()
    got = {r.reading_id for r in spark.read.schema("reading_id long").parquet(out + "/out/batch=*").collect()}
    whole = previous(spark.createDataFrame(rows, schema), "pool_id", "read_at", "reading_id", "off", "b")
    assert got == {r.reading_id for r in whole.collect() if r.off and r.b}


def test_seen_over_batches_and_a_new_version(spark, tmp_path):
    """Three batches of one version, then a higher one: its first batch of an owner is silent, whatever was seen before."""
    schema, folder = "pool_id long, signature string, read_on date", str(tmp_path / "in")
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    day = lambda k: dt.date(2026, 1, k)
    batches = [
        (1, [(1, "a", day(1)), (1, "a", day(1)), (2, "x", day(1)), (3, None, None)]),
        (1, [(1, "a", day(4)), (2, "x", day(2)), (2, "y", day(2)), (3, "z", day(9))]),
        (1, [(1, "b", day(3)), (1, "c", day(6)), (2, "z", day(5))]),
        (2, [(1, "b", day(7)), (1, "n", day(7))]),
        (2, [(1, "m", day(8)), (1, "b", day(8)), (2, "x", day(8))]),
    ]
    for version, rows in batches:
        write(spark, rows, schema, folder)
        S.track_seen(source(spark, folder, schema), out, check, read_on="read_on", version=version).awaitTermination()
    rows = spark.read.schema("pool_id long, signature string, news boolean, version int, since date").parquet(out + "/out/batch=*").collect()
    assert sorted((r.version, r.pool_id, r.signature or "", r.news, r.since) for r in rows) == [
        (1, 1, "a", False, None), (1, 1, "b", True, day(4)), (1, 1, "c", True, day(4)), (1, 2, "x", False, None), (1, 2, "y", True, day(1)), (1, 2, "z", True, day(2)),
        (1, 3, "", False, None), (1, 3, "z", True, None), (2, 1, "b", False, day(6)), (2, 1, "m", True, day(7)), (2, 1, "n", False, day(6)), (2, 2, "x", False, day(5)),
    ]


def test_late_rows_have_a_table_of_their_own(spark, tmp_path):
    """The bound is the newest time of the batches before, less the delay; a restart between batches does not forget it."""
    schema, folder = "id long, ts timestamp", str(tmp_path / "in")
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    at = lambda k: dt.datetime(2026, 1, k)
    for rows in ([(1, at(20)), (2, at(1))], [(3, at(9)), (4, at(10)), (5, at(11)), (6, at(30)), (7, None)], [(8, at(19)), (9, at(21))]):
        write(spark, rows, schema, folder)
        S.late_rows(source(spark, folder, schema), out, check, delay="10 days").awaitTermination()
    ids = lambda part: sorted(r.id for r in spark.read.schema(schema).parquet(f"{out}/{part}/batch=*").collect())
    assert (ids("out"), ids("late")) == ([1, 2, 4, 5, 6, 7, 9], [3, 8])


def test_news_once_over_batches(spark, tmp_path):
    schema, folder = "k long", str(tmp_path / "in")
    out, check = str(tmp_path / "o"), str(tmp_path / "c")
    for part in ([1, 2], [2, 3], [1, 4], [4, 5], [5, 1]):
        write(spark, [(k,) for k in part], schema, folder)
        S.news_from_batches(source(spark, folder, schema), out, ["k"], check).awaitTermination()
    got = [r.k for r in spark.read.schema(schema).parquet(out + "/batch=*").collect()]
    assert sorted(got) == [1, 2, 3, 4, 5]


def test_tables_are_streamed_as_files_and_as_folders(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.count()
    folder, single = tmp_path / "folder", tmp_path / "single"
    events.repartition(3).write.parquet(str(folder / "events.parquet"))
    events.coalesce(1).write.parquet(str(tmp_path / "parts"))
    single.mkdir()
    next((tmp_path / "parts").glob("part-*.parquet")).rename(single / "events.parquet")
    for k, path in enumerate((folder, single)):
        S.run_to_table(S.read_stream(spark, str(path), files_per_batch=1), str(tmp_path / f"o{k}"), str(tmp_path / f"c{k}"))
        assert spark.read.parquet(str(tmp_path / f"o{k}")).count() == rows
    with pytest.raises(FileNotFoundError):
        S.read_stream(spark, str(tmp_path / "none"))


def test_reread_rows_come_out_once(spark, tmp_path):
    schema, folder = "id long, ts timestamp", str(tmp_path / "in")
    write(spark, [(1, dt.datetime(2026, 1, 1)), (2, dt.datetime(2026, 1, 2))], schema, folder)
    stream = source(spark, folder, schema)
    S.run_to_table(S.dedup_stream(stream.unionByName(stream), ["id"]), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.schema(schema).parquet(str(tmp_path / "o")).count() == 2
