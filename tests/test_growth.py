"""What keeps the cost of a row small: texts are read once, and rows that agree in what is read of them are read together."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edictal.functions import extract as X


@pytest.fixture
def written(monkeypatch):
    """Columns and number of rows of every table that is staged."""
    from edictal import session

    seen, real = [], session.stage
    monkeypatch.setattr(session, "stage", lambda df: seen.append((df.columns, df.count())) or real(df))
    return seen


def test_a_date_searches_its_text_once(spark):
    for date in (X.numeric_date, X.worded_date, X.closing_date):
        assert repr(date("body")).count("body") == 1
    rows = [("a", "el 31/02/2026, no el 01/03/2026"), ("b", "de 5 de marzo de 1999"), ("c", "1999-2-3 y 04/05/2006"), ("d", "nada"), ("e", None), ("f", "17 d'abril de 2026")]
    df = spark.createDataFrame(rows, "k string, body string").select("k", X.any_date("body").alias("d"), X.any_date("body", X.numeric_date("body"), F.lit(None).cast("date")).alias("e"))
    d = dt.date
    assert {r.k: (r.d, r.e) for r in df.collect()} == {
        "a": (None, None), "b": (d(1999, 3, 5), None), "c": (d(1999, 2, 3), d(1999, 2, 3)), "d": (None, None), "e": (None, None), "f": (d(2026, 4, 17), None),
    }


def test_news_are_cleaned_once_a_text(spark, written):
    from edictal.operators import windows as W

    rows = [(i, "PUBLICACION", "BOP", None, (" Bases  Descargar información x", "BASES", None)[i % 3], "u", dt.date(2024, 1, 1), f"n{i}") for i in range(60)]
    news = spark.createDataFrame(rows, "process_id long, news_kind string, kind string, field string, summary string, url string, detected date, news_id string")
    out = W.dedup_news(news)
    assert out.columns == news.columns and out.count() == 60 and [n for c, n in written if "_text" in c] == [3]


def test_title_rules_run_once_a_title(spark, written):
    from edictal.queries.text import QUERIES

    path = "/root/testdata/sf0.001"
    for name in ("identity_tokens", "repair_mojibake"):
        written.clear()
        n = QUERIES[name](spark, path).count()
        titles = spark.read.parquet(f"{path}/lineitem.parquet").count()
        assert n == titles and len(written) == 1 and written[0][1] < titles


def test_segments_move_no_titles(spark):
    from edictal.session import tune
    from edictal.sources.feeds import segment_records

    rows = [("p", "Anuncio primero del ayuntamiento Núm. registro: 2024/1 Anuncio segundo del ayuntamiento Núm. registro 2024/1 fin"), ("q", "nada"), ("r", None)]
    out = segment_records(tune(spark).createDataFrame(rows, "page string, text string"), "page", "text")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.collect()] == [("p", "2024/1", "Anuncio primero del ayuntamiento")]


def test_a_class_searches_its_text_once(spark):
    from edictal.functions.classify import mentions_town

    assert repr(X.class_from_table("body")).count("body") == 1
    rows = [("vacantes c c1 administrativa 3 c c1 auxiliar 2 fin", "C1", 5, "TABLA"), ("subgrupo: a2", "A2", None, "TEXTO"),
            ("escala de administracion general, subescala de tecnica, clase medio", "A1", None, "SUBESCALA"),
            ("administracion general, subescala auxiliar", "C2", None, "SUBESCALA"), ("subgrupo c1 subgrupo a1", None, None, None), (None, None, None, None)]
    got = spark.createDataFrame(rows[:], "n string, s string, p int, o string").select("s", "p", "o", X.class_from_table("n").alias("c")).collect()
    assert all((r.c.subgroup, r.c.places, r.c.origin) == (r.s, r.p, r.o) for r in got if r.o or not r.s)
    t = spark.createDataFrame([("en l'alcora, castellon", "ayuntamiento de x/l'alcora"), ("nada", "ayuntamiento de x")], "t string, a string")
    assert [r[0] for r in t.select(mentions_town("t", "a")).collect()] == [True, False]


def test_a_text_of_a_process_is_read_once(spark, monkeypatch):
    from edictal.plans import jobs as J

    read, real = [], J.code_block
    monkeypatch.setattr(J, "code_block", lambda df, *a: read.append(df.count()) or real(df, *a))
    text = "TEMARIO\n" + "Tema 1. La Constitución española de 1978 y los derechos fundamentales\n" * 3 + "fin"
    rows = [(1, "x", f"n{i}", "BASES", "bases", "u", dt.date(2024, 1, i + 1), text) for i in range(9)] + [(1, "x", "z", "BASES", "bases", "u", dt.date(2025, 1, 1), text + "\ufffd")]
    docs = spark.createDataFrame(rows, "process_id long, name string, notice_id string, kind string, title string, url string, published date, text string")
    assert [r.notice_id for r in J.syllabus(docs).collect()] == ["n8"] and read == [1]
    assert [r.notice_id for r in J.syllabus(docs, 2).collect()] == ["n8"]


def test_entities_are_asked_once(spark, monkeypatch):
    from edictal.operators import match as M

    asked, real = [], M.unique_match_any
    monkeypatch.setattr(M, "unique_match_any", lambda p, *a: asked.append(p.count()) or real(p, *a))
    day = dt.date(2024, 1, 1)
    events = spark.createDataFrame([(i, "Ayuntamiento de A/B" if i % 2 else None, "P", day) for i in range(20)], "document_id long, entity string, province string, cited date")
    known = spark.createDataFrame([(5, "Ayuntamiento de B", "p", day)] * 3, "process_id long, agency_name string, province string, resolved date")
    out = M.match_document_event(events, known).collect()
    assert asked == [2] and len(out) == 20 and {(r.document_id % 2, r.match_id) for r in out} == {(1, 5), (0, None)}


def test_squeezed_blanks(spark):
    from edictal.functions.text import squeeze

    rows = [("a b c",), ("a  b",), (" \ta\t b  c ",), ("a b",), ("a \n\n b\nc",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(squeeze("c")).collect()]
    assert got == ["a b c", "a b", "a b c", "a b", "a b c", "", None]
