from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edictal.operators import cdc as U
from edictal.operators.windows import page
from edictal.operators import windows as W
from edictal.sources import sinks, tables


def test_null_never_erases_and_fill_only_fills(spark):
    old = spark.createDataFrame([(1, "a", None), (2, " ", 5)], "id int, name string, n int")
    new = spark.createDataFrame([(1, None, 7), (2, "b", 9), (3, "c", None)], "id int, name string, n int")
    kept = {r.id: (r.name, r.n) for r in U.upsert_keep(old, new, "id", ["name", "n"]).collect()}
    assert kept == {1: ("a", 7), 2: ("b", 9), 3: ("c", None)}
    filled = {r.id: (r.name, r.n, r.filled) for r in U.fill_empty(old, new, "id", ["name", "n"]).collect()}
    assert filled == {1: ("a", 7, True), 2: ("b", 5, True)}


def test_append_twice_adds_nothing(spark):
    batch = spark.createDataFrame([("k", 1), ("k", 2), ("j", 3)], "key string, v int")
    empty = batch.limit(0)
    first = U.append_new(empty, batch, ["key"], [F.col("v")])
    assert sorted((r.key, r.v) for r in first.collect()) == [("j", 3), ("k", 1)]
    assert U.append_new(first, batch, ["key"], [F.col("v")]).count() == 0


def test_layout_noise_is_no_news(spark):
    state = spark.createDataFrame([(1, "h1", "s", "p"), (2, "h1", "s", "p")], "pool_id int, content_hash string, stage string, phase string")
    now = spark.createDataFrame([(1, "h2", "s", "p"), (2, "h2", "t", "p"), (3, "h", "s", "p")], "pool_id int, content_hash string, stage string, phase string")
    got = {r.pool_id: (r.action, r.changed) for r in U.fingerprint_plan(state, now, fields=("stage", "phase")).collect()}
    assert got == {1: ("NOISE", None), 2: ("CHANGE", "stage"), 3: ("BASELINE", None)}


def test_merge_keeps_first_order_and_later_nulls(spark):
    row = "p int, doc string, pos int, t string"
    old, new = spark.createDataFrame([(1, "a", 0, "x"), (1, "b", 1, "y")], row), spark.createDataFrame([(1, "a", 0, None), (1, "c", 1, "z")], row)
    got = [(r.doc, r.t) for r in U.merge_by_key(old, new, "p", "doc", ["t"]).orderBy("seen").collect()]
    assert got == [("a", None), ("b", "y"), ("c", "z")]


def test_two_readings_close_a_pool(spark):
    at = lambda k: dt.datetime(2026, 1, k)
    rows = [(1, 1, at(1), "Bolsa cerrada"), (2, 1, at(2), "Bolsa cerrada"), (3, 2, at(1), "Bolsa en funcionamiento"), (4, 2, at(2), "cerrada"), (5, 3, at(1), "cerrada"), (6, 4, at(1), "cerrada"), (7, 4, at(2), None)]
    df = spark.createDataFrame(rows, "reading_id int, pool_id int, read_at timestamp, phase string")
    assert {r.pool_id: r.close for r in W.debounce(df).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_previous_equals_a_plain_lag(spark):
    from pyspark.sql import Window

    df = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5).alias("k"),
        F.expr("timestampadd(MINUTE, cast(id * 37 % 9000 as int), timestamp'2026-01-01')").alias("at"), F.when(F.col("id") % 4 != 0, F.col("id") % 7).alias("v"),
    )
    want = df.withColumn("p", F.lag("v").over(Window.partitionBy("k").orderBy("at", "id")))
    got = W.previous(df, "k", "at", "id", "v", "p")
    assert sorted(got.select("id", "p").collect()) == sorted(want.select("id", "p").collect())


def test_map_patch(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS old, map('a', '9', 'c', '3') AS new")
    assert df.select(U.patch("old", F.col("new"), drop=("b",)).alias("m")).first().m == {"a": "9", "c": "3"}


def test_followed_processes_are_not_deleted(spark):
    c = spark.createDataFrame([(1,), (2,)], "process_id int")
    subs = spark.createDataFrame([(1, True), (2, False)], "process_id int, active boolean")
    assert {r.process_id: r.action for r in U.guarded_delete(c, subs).collect()} == {1: "BLOCKED", 2: "DELETE"}


def test_small_catalogue_is_rejected(spark, tmp_path):
    rows = spark.createDataFrame([("3001", "Alfa", "Alfà"), ("99001", "Fuera", "Fora")], "codigo_ine string, nombre string, nombre_val string")
    sinks.write_report(rows, str(tmp_path / "towns"))
    with pytest.raises(ValueError):
        tables.load_municipalities(spark, str(tmp_path / "towns"))
    got = tables.load_municipalities(spark, str(tmp_path / "towns"), smallest=1).collect()
    assert [(r.ine, r.province, r.aliases) for r in got] == [("03001", "Alicante", ["alfa"])]
    with pytest.raises(Exception):
        sinks.write_report(rows, str(tmp_path / "towns"))


def test_a_missing_key_part_is_stored_once(spark):
    """What was inserted with a null in its key is found again on a second run."""
    keys = ["ref", "url"]
    batch = spark.createDataFrame([("a", None, 1), ("a", None, 2), (None, "u", 3), (None, None, 4)], "ref string, url string, n int")
    first = U.insert_absent(batch.limit(0), batch, keys, [F.col("n")])
    assert sorted(r.n for r in first.collect()) == [1, 3, 4]
    for stored in (first, first.select(*keys)):
        assert U.insert_absent(stored, batch, keys, [F.col("n")]).count() == 0
    assert U.unseen(batch, first, keys).count() == U.snapshot_diff(first, batch, keys).count() == 0
    assert {r.delta for r in U.baseline_delta(first, batch.filter("n = 3"), keys).collect()} == {"REMOVE"}


def test_pages_are_not_clamped():
    with pytest.raises(ValueError, match="1 to 200"):
        page(1000)


def test_stage_news_meet_pools_once_per_ad_and_stage(spark):
    """However often an ad repeats a stage, each pool meets it once, by its oldest date; told stages and empty ones stay out."""
    from tests.plans import joined_rows

    ads = [(1, "1/24", "Bases", dt.date(2024, 1, 1 + i % 28)) for i in range(300)] + [(1, "1/24", "Bases", None), (1, "1/24", "Examen", None), (1, "1/24", "", None), (2, None, "Examen", dt.date(2024, 3, 1))]
    ads = spark.createDataFrame(ads, "ad_id long, number string, stage string, published date")
    edges = spark.createDataFrame([(1, p) for p in range(200)] + [(1, None), (2, 7)], "ad_id long, pool_id long")
    told = spark.createDataFrame([(5, 1, " EXAMEN ")], "pool_id long, ad_id long, stage string")
    out = U.fan_out_stage(ads, edges, told)
    rows = out.collect()
    assert len(rows) == len({r.ref for r in rows}) == 200 + 199 + 1
    assert {r.published for r in rows if "Bases" in r.title} == {dt.date(2024, 1, 1)}
    assert [(r.pool_id, r.title) for r in rows if r.ad_id == 2] == [(7, "ADC 2: Examen")]
    # 301 rows of one stage met 200 pools each before.
    assert joined_rows(out) <= 1000
