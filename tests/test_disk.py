"""What imports move and leave on disk: notices are moved once, settled calls not at all, and what was moved is removed."""

from __future__ import annotations

import datetime as dt
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from edictal import session
from edictal.plans import jobs as J
from edictal.queries import jobs as Q
from edictal.schemas import TABLES
from edictal.sources.tables import DEAL

NOTICES = "notice_id string, stable_id string, ref string, source_id long, url string, title string, body string, published date"
BASES = "Anuncio sobre la aprobación de las bases de la convocatoria de administrativo, por oposición"


@pytest.fixture
def shuffling(spark):
    """No join is turned into a broadcast because its tables are small, and no table is dealt before it is read."""
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", DEAL: ""}
    before = {key: spark.conf.get(key) for key in held}
    for key, value in held.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """120 notices of 30 processes, ten of them twice."""
    path = str(tmp_path_factory.mktemp("tables"))
    day = dt.datetime(1998, 1, 1)
    lines = [(i % 30, 3 * i, i % 7, i // 30 + 1, float(i % 50), 10.0 + i, 0.0, 0.0, "R", "O", day + dt.timedelta(days=i - 60)) for i in range(120)]
    rows = {
        "lineitem": lines + lines[:10], "orders": [(i, i % 5, "OPF"[i % 3], 1.0, day, f"{i % 5 + 1}-X") for i in range(30)],
        "customer": [(i, f"c{i}", i % 3, 0.0, "m") for i in range(5)], "nation": [(i, f"NATION_{i}", i % 3) for i in range(3)],
        "region": [(0, "AFRICA"), (1, "EUROPE"), (2, "ASIA")],
    }
    for name, values in rows.items():
        spark.createDataFrame(values, TABLES[name]).write.parquet(f"{path}/{name}.parquet")
    return path


def moved(df) -> list[int]:
    """Rows that each shuffle of the query wrote."""
    df.collect()
    out, seen, todo = [], set(), [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName() == "ReusedExchange":
            continue
        if node.nodeName() == "Exchange" and node.id() not in seen:
            seen.add(node.id())
            out.append(node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sorted(out, reverse=True)


def shuffle_files(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_staging_removes_what_it_moved(spark):
    before = shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
    out, until = session.stage(df), time.time() + 20
    # Nothing of the writing is left, without the driver's garbage being collected.
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and out.count() == 100 and session.stage(df, "zstd").count() == 100
    assert spark.conf.get(session.CLEANUP) == "false" and len(df.collect()) == len(df.collect()) == 100


def test_few_texts_are_sent_to_the_rows(shuffling, monkeypatch):
    df = shuffling.createDataFrame([(i, ("a", None, "b")[i % 3]) for i in range(60)], "k long, t string")
    sent = session.once(df, ["t"], {"u": F.upper("t")})
    assert moved(sent) == [] and {(r.t, r.u) for r in sent.collect()} == {("a", "A"), ("b", "B"), (None, None)}
    monkeypatch.setattr(session, "TEXT_BYTES", 0)
    dealt = session.once(df, ["t"], {"u": F.upper("t")})
    assert moved(dealt)[0] == 60 and sorted(map(str, dealt.collect())) == sorted(map(str, sent.collect()))


def test_notices_are_moved_once(shuffling, tables):
    n, p = Q.bulletin(shuffling, tables)
    read = J.read_notices(n)
    first = J.import_notices(read, p, read.limit(0)).filter("publish")
    rows = moved(first)
    assert rows[0] == 130 and all(x <= 30 for x in rows[1:]) and 0 < first.count() < 120
    # Only what may be published meets what is stored, and that is moved once for being told apart and found.
    again = moved(J.import_notices(read, p, n.select("ref", "source_id", "url")).filter("publish"))
    assert sum(x == first.count() for x in again) == 1 and sum(x > 30 for x in again) <= 4


def test_what_is_stored_is_found_with_missing_parts(shuffling):
    day = dt.date(2024, 1, 1)
    row = lambda k, code, ref, source, url, d=day: (k, code, ref, source, url, BASES, "", d)
    n = shuffling.createDataFrame([
        row("a", "s", None, None, None), row("b", "s", "r", None, "u"), row("c", "s", "r", 1, None), row("d", None, "r", 1, "u"), row("e", None, None, 1, "u"),
        row("f", "t", "x", 2, "v", None), row("g", "t", "y", 2, "v"), row("h", "q", "z", 2, "v"),
    ], NOTICES)
    p = shuffling.createDataFrame([(1, "q", "Oposición"), (2, None, "Oposición"), (3, "q", "Bolsa")], "process_id long, stable_id string, process_type string")
    stored = shuffling.createDataFrame([(None, None, None), (None, None, None), ("r", 1, None), ("r", 1, "u"), ("y", 2, "w")], "ref string, source_id long, url string")
    got = {(r.notice_id, r.process_id): (r.action, r.publish) for r in J.import_notices(n, p, stored).collect()}
    assert got == {
        ("a", None): ("CREATE", False), ("b", None): ("REFRESH", True), ("c", None): ("REFRESH", False), ("d", None): ("REFRESH", False), ("e", None): ("REFRESH", True),
        ("f", None): ("CREATE", True), ("g", None): ("REFRESH", True), ("h", 1): ("REFRESH", True), ("h", 3): ("REFRESH", True),
    }


def test_second_import_publishes_nothing(spark, tables, monkeypatch):
    published, read, real, rules = [], [], J.import_notices, J.read_notices
    monkeypatch.setattr(J, "import_notices", lambda n, p, s: published.append((s.count(), real(n, p, s).filter("publish").count())) or real(n, p, s))
    monkeypatch.setattr(J, "read_notices", lambda n: read.append(1) or rules(n))
    out = Q.import_twice(spark, tables)
    assert out.columns == ["notice_id", "action"] and out.collect() == [] and len(read) == 1
    assert published[0][0] == 0 < published[0][1] == published[1][0] and published[1][1] == 0


def test_layouts_hold_the_same_notices(spark, tables):
    from edictal.sources.bind import notices

    rows = [sorted(map(str, notices(spark, tables, True, by=by).collect())) for by in ("l_orderkey", "notice_id")]
    coded = notices(spark, tables, True, by="c", c=F.concat(F.lit("x"), "l_orderkey"))
    assert len(rows[0]) == 120 and rows[0] == rows[1] == sorted(map(str, coded.drop("c").collect()))
    assert all(r.c == f"x{r.process_id}" for r in coded.collect()) and Path(tables, "lineitem.parquet").exists()


def test_settled_calls_are_not_moved(shuffling, monkeypatch):
    """Calls from elsewhere and those that correct others meet no lookup of calls; each call is decided by the first reason that holds."""
    base = dt.date(2024, 1, 1)
    kind = lambda i: ("ANULACION", "RECTIFICACION", None, "CONVOCATORIA")[i % 4]
    place = lambda i: ("Alicante", "Madrid", None)[i // 4 % 3]
    calls = shuffling.createDataFrame(
        [(f"c{i}", f"D{i}", kind(i), "Ayuntamiento de Xàbia", place(i), "Administrativo", None, "Promoción interna" if i % 16 == 2 else "Libre", base, base, "x") for i in range(240)],
        "call_id string, document_id string, document_type string, entity string, province string, job string, places int, shift string, base_date date, cited date, text string",
    )
    processes = shuffling.createDataFrame([(70, "BOELOCAL:c15", 1, "x", None, None, "SI"), (71, "BOELOCAL:c0", 2, "Administrativo", base, None, "SI")], "process_id long, stable_id string, agency_id long, name string, call_date date, places int, scope string")
    agencies = shuffling.createDataFrame([(1, "Ayuntamiento de Xàbia", "Alicante"), (2, "Ayuntamiento de Xàbia", "Madrid")], "agency_id long, agency_name string, province string")
    resolutions = shuffling.createDataFrame([(9, "Ayuntamiento de Xàbia", "Alicante", base), (9, "Ayuntamiento de Xàbia", "Madrid", base)], "process_id long, agency_name string, province string, resolved date")
    stored = shuffling.createDataFrame([("D0", 5), ("D3", 6), ("D4", 7)], "document_id string, process_id long")
    absorbed = shuffling.createDataFrame([("D14",), ("D1",), ("D5",)], "document_id string")
    out = J.import_calls(calls, processes, agencies, resolutions, stored, absorbed)
    got = {r.call_id: (r.document_id, r.decision, r.process_id, r.agency_id) for r in out.collect()}

    def expected(i: int):
        agency = {"Alicante": 1, "Madrid": 2}.get(place(i))
        if place(i) != "Alicante":
            return f"D{i}", "FUERA_ALCANCE", None, agency
        if kind(i) in ("ANULACION", "RECTIFICACION"):
            return f"D{i}", "EVENTO_DOCUMENTAL_IDENTIFICADO", 9, agency
        if i == 14:
            return f"D{i}", "ABSORBIDA_BOP_REVISION", None, agency
        if i % 16 == 2:
            return f"D{i}", "EXCLUIDA_TURNO_INTERNO", None, agency
        if i == 3:
            return f"D{i}", "EXISTENTE_PUBLICACION", 6, agency
        return f"D{i}", *(("EXISTENTE_BOE", 70) if i == 15 else ("NUEVA", None)), agency

    assert got == {f"c{i}": expected(i) for i in range(240)}
    # Forty of them are looked up under document, code and date; the small tables are joined without moving calls.
    shuffling.conf.set("spark.sql.autoBroadcastJoinThreshold", "4k")
    far = J.import_calls(calls, processes.repartition(3), agencies, resolutions, stored, absorbed)
    assert max(moved(far), default=0) <= 40


def test_halves_of_a_review_are_counted_apart(spark, tables):
    out = Q.review_cycle(spark, tables)
    counts = {(r.source, r.decision): r.n for r in out.collect()}
    assert moved(out) == [] and out.columns == ["source", "decision", "n"]
    n, p = Q.bulletin(spark, tables)
    known = Q.stable(spark, tables).withColumn("stable_id", F.coalesce("stable_id", F.concat(F.lit("D:"), "process_id")))
    actions = J.import_notices(n, known, n.limit(0)).groupBy("action").count().collect()
    assert {k[1]: v for k, v in counts.items() if k[0] == "BOP"} == {r["action"]: r["count"] for r in actions}
    assert sum(v for k, v in counts.items() if k[0] == "BOE") == sum(v for k, v in counts.items() if k[0] == "BOP") == 120
    # Two of five customers, and so 12 of 30 processes with four notices each, are not of the provinces.
    assert counts["BOE", "FUERA_ALCANCE"] == 48
