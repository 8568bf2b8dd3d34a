from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.operators import calendar as D
from edictal.plans import jobs as J

DAY = dt.date(2000, 6, 30)
PROCESS = (
    "process_id long, agency_id long, name string, process_type string, state string, is_opportunity boolean, scope string, shift string, places int, "
    "call_date date, opens date, closes date, deadline string, gazette_date date, source_id long, closure_origin string, detail_url string, category string"
)


def process(key, name="Administrativo", kind=R.HARD_TO_FILL_TYPE, opens=None, closes=None, opportunity=True):
    return (key, 1, name, kind, "EN_CURSO", opportunity, "SI", "LIBRE", None, DAY, opens, closes, None, None, 1, None, None, None)


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        process(1, opens=dt.date(2000, 6, 20), closes=dt.date(2000, 7, 10)), process(2, closes=dt.date(2000, 6, 1)), process(3),
        process(4, "Anuncio sobre bases para la provisión de dos plazas de administrativo", "Oposición"), process(5, "Administrativo", "Oposición"),
    ]
    frame = spark.createDataFrame
    return {
        "processes": frame(rows, PROCESS), "agencies": frame([(1, "Ayuntamiento de Xàbia", "AYUNTAMIENTO", "Alicante")], "agency_id long, agency_name string, agency_kind string, province string"),
        "notices": frame([(1, 5, 1, "BOP", "Bases", DAY, "https://bop.example/1")], "notice_id long, process_id long, source_id long, kind string, title string, published date, url string"),
        "sources": frame([(1, "BOP")], "source_id long, source_kind string"), "texts": frame([], "process_id long, call_text string, document string"),
        "events": frame([], "process_id long"), "recipients": frame([(7, True), (8, False)], "user_id long, entitled boolean"),
        "subscriptions": frame([(8, 5, dt.date(2000, 1, 1), True)], "user_id long, process_id long, since date, active boolean"), "entitled": frame([], "user_id long"),
        "changes": frame([], "change_id string, process_id long, field string, old string, new string, significant boolean, detected date"),
    }


def cycle(spark, tables, **options):
    # What is hidden before and shown after is what the cycle makes news: here nothing was visible before.
    steps = J.run_cycle(tables, D.calendar(spark, 1999, 2001), F.lit(DAY), since=F.lit(dt.date(2000, 6, 1)), **options)
    return steps, {r.process_id: r for r in steps["snapshot"].collect()}


def test_cycle_applies_groups_and_titles(spark, tables):
    steps, after = cycle(spark, tables)
    assert (after[5].grp, after[5].subgroup, after[5].class_origin) == ("C", "C1", "DEDUCIDO_DEL_NOMBRE")
    assert not after[4].name.startswith("Anuncio") and after[4].original_name.startswith("Anuncio") and after[4].places == 2
    again, twice = cycle(spark, {**tables, "processes": steps["snapshot"]})
    assert again["titles"].count() == 0 and twice[5].subgroup == "C1"
    assert {r.process_id for r in again["groups"].filter("subgroup is not null").collect()} & {5} == set()


def test_stored_groups_are_kept(spark, tables):
    stored = tables["processes"].withColumns({"grp": F.lit("A"), "subgroup": F.lit("A1")})
    _, after = cycle(spark, {**tables, "processes": stored})
    assert {r.subgroup for r in after.values()} == {"A1"}


def test_ads_are_news_while_they_can_be_answered(spark, tables, monkeypatch):
    seen = J.Q.catalogue
    calls = []

    def catalogue(p, *rest):
        calls.append(p)
        return seen(p, *rest).filter("process_id = 5") if len(calls) == 1 else seen(p, *rest)

    monkeypatch.setattr(J.Q, "catalogue", catalogue)
    steps, _ = cycle(spark, tables)
    assert {r.process_id for r in steps["events"].collect()} == {1, 4}
    assert sorted((r.process_id, r.audience) for r in steps["outbox"].collect()) == [(1, "FULL"), (4, "FULL"), (4, "GENERAL")]
    assert [(r.user_id, r.process_id, r.n_news) for r in steps["follow_ups"].collect()] == [(8, 5, 1)]
    ledger = {r.step: (r.state, r.n) for r in J.cycle_ledger(steps, F.lit(DAY)).collect()}
    assert ledger["events"] == ("OK", 2) and ledger["outbox"] == ("OK", 3) and ledger["closures"] == ("SIN_NOVEDADES", 0) and ledger["follow_ups"] == ("OK", 1)


def test_syllabus_of_the_own_call(spark):
    part = lambda code, topic: f"Convocatoria {code} administrativo\nTema 1. {topic}\nTema 2. El acto administrativo y sus recursos en la jurisdicción contenciosa\n"
    text = "ANEXO\nTEMARIO\n" + part("1/24", "La Constitución") + part("2/24", "La Unión Europea") + "BASES\nfin"
    names = {1: "Administrativo, Convocatoria 1 / 24", 2: "Administrativo, convocatoria 2/24", 3: "Administrativo, Convocatoria 9/24", 4: "Administrativo", 5: None}
    # A worse document has the block of the own call alone; the best document with any block is taken.
    rows = [(k, name, 10 * k, "BASES", "Bases", "https://bop.example/1", DAY, text) for k, name in names.items()]
    rows.append((6, "Convocatoria 2/24", 60, "BASES", "Bases", "https://bop.example/2", DAY, "sin temario"))
    rows.append((6, "Convocatoria 2/24", 61, "BOP", "Anuncio", "https://x.example/3", DAY, text))
    docs = spark.createDataFrame(rows, "process_id long, name string, notice_id long, kind string, title string, url string, published date, text string")
    out = {r.process_id: r for r in J.syllabus(docs).collect()}
    assert "La Constitución" in out[1].block and "La Unión Europea" not in out[1].block and out[1].block.startswith("TEMARIO")
    assert out[2].block.startswith("Convocatoria 2/24") or out[2].block.startswith("TEMARIO")
    assert out[2].block.endswith("contenciosa\nBASES\nfin") and "La Unión Europea" in out[2].block
    assert {out[k].block for k in (3, 4, 5)} == {text[text.index("TEMARIO"):text.index("\nBASES")]}
    assert out[6].notice_id == 61 and "La Unión Europea" in out[6].block


def test_calls_that_are_published_keep_their_process(spark):
    frame = spark.createDataFrame
    call = lambda k, doc, shift="Libre": (k, doc, "CONVOCATORIA", "Ayuntamiento de Xàbia", "Alicante", "Administrativo", None, shift, None, None, "Administrativo")
    calls = frame(
        [call("a", "D1"), call("b", "D2"), call("c", "D3"), call("d", "D4"), call("e", "D5"), call("f", "D1", "Promoción interna"), call("g", None)],
        "call_id string, document_id string, document_type string, entity string, province string, job string, places int, shift string, base_date date, cited date, text string",
    )
    processes = frame([(70, "BOELOCAL:c", 1, "x", None, None, "SI"), (71, "BOELOCAL:a", 1, "x", None, None, "SI")], "process_id long, stable_id string, agency_id long, name string, call_date date, places int, scope string")
    agencies = frame([(1, "Ayuntamiento de Xàbia", "Alicante")], "agency_id long, agency_name string, province string")
    resolutions = frame([], "process_id long, agency_name string, province string, resolved date")
    # D1 was stored for two processes and D4 for none; D5 is also absorbed, which is asked first.
    stored = frame([("D1", 9), ("D1", 8), ("D1", 8), ("D4", None), ("D5", 5), (None, 3)], "document_id string, process_id long")
    absorbed = frame([("D5",), ("D6",)], "document_id string")
    out = {r.call_id: (r.decision, r.process_id) for r in J.import_calls(calls, processes, agencies, resolutions, stored, absorbed).collect()}
    assert out == {
        "a": ("EXISTENTE_PUBLICACION", 8), "b": ("NUEVA", None), "c": ("EXISTENTE_BOE", 70), "d": ("EXISTENTE_PUBLICACION", None),
        "e": ("ABSORBIDA_BOP_REVISION", None), "f": ("EXCLUIDA_TURNO_INTERNO", None), "g": ("NUEVA", None),
    }


def test_import_reads_every_title_once(spark, monkeypatch):
    """Text rules run on distinct titles, null ones among them; every notice gets what they say of its title."""
    from edictal import session

    written, real = [], session.stage
    monkeypatch.setattr(session, "stage", lambda df: written.append((df.columns, df.count())) or real(df))
    titles = ["Nombramiento como funcionario de carrera", "Concesión de subvenciones", None]
    rows = [(f"n{i}", f"s{i % 5}", f"r{i}", 1, None, titles[i % 3], "", dt.date(2024, 1, 1)) for i in range(90)]
    n = spark.createDataFrame(rows, "notice_id string, stable_id string, ref string, source_id long, url string, title string, body string, published date")
    p = spark.createDataFrame([(1, "s0", "Oposición")], "process_id long, stable_id string, process_type string")
    out = J.import_notices(n, p, n.limit(0)).collect()
    assert len(out) == 90 and {r.action for r in out if int(r.notice_id[1:]) % 3 == 1} == {"IGNORE"}
    assert [c for columns, c in written if "_rule" in columns] == [3]
