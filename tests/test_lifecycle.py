from __future__ import annotations

import datetime as dt

from edictal.operators import lifecycle as L

PROCESSES = "process_id long, state string, process_type string, closure_origin string, is_opportunity boolean"
NOTICES = "notice_id string, process_id long, title string, published date"
RESULT, ANNULLED = "Resultado final del proceso selectivo", "Anulación de la convocatoria"


def day(text):
    return text and dt.date.fromisoformat(text)


def plan(spark, processes, notices, **kw):
    p = spark.createDataFrame([r if len(r) > 4 else (*r, True) for r in processes], PROCESSES)
    n = spark.createDataFrame([(i, pid, t, day(d)) for i, pid, t, d in notices], NOTICES)
    return p, n, {r.process_id: r for r in L.reconcile(p, n, **kw).collect()}


def test_decisions(spark):
    processes = [
        (1, "EN_CURSO", "Oposición", None), (2, "EN_CURSO", "Oposición", None), (3, "FINALIZADO", "Oposición", None),
        (4, "FINALIZADO", "Oposición", "RECONCILIACION"), (5, "FINALIZADO", "Oposición", "RECONCILIACION"), (6, "EN_CURSO", "Bolsa de trabajo", None),
        (7, "EN_CURSO", "Bolsa de trabajo", None), (8, "EN_CURSO", "Oposición", None, False), (9, "FINALIZADO", "Oposición", "RECONCILIACION", False),
    ]
    notices = [
        ("a", 1, RESULT, "2026-03-01"), ("b", 2, "Lista provisional de aprobados", "2026-03-01"), ("c", 5, RESULT, None),
        ("d", 6, RESULT, "2026-03-01"), ("e", 7, RESULT, "2026-03-01"), ("f", 7, ANNULLED, "2026-01-01"),
        ("g", 8, RESULT, "2026-03-01"),
    ]
    p, n, acts = plan(spark, processes, notices)
    assert {k: (r.action, r.new_state) for k, r in acts.items()} == {
        1: ("CLOSE", "FINALIZADO"), 4: ("REOPEN", "EN_CURSO"), 7: ("CLOSE", "ANULADO"),
    }
    assert acts[1].significant and not acts[4].significant
    states = {r.process_id: (r.action, r.new_state) for r in L.closing_states(p, n).collect()}
    assert states == {k: (r.action, r.new_state) for k, r in acts.items()}
    after = L.apply_closures(p, L.reconcile(p, n))
    assert L.reconcile(after, n).count() == 0
    # A closure is stored with its evidence, which goes when it is taken back.
    stored = {r.process_id: (r.closure_rule, r.closure_notice_id, r.closure_title, r.closure_published) for r in after.collect()}
    assert stored[1] == (acts[1].rule, "a", RESULT, day("2026-03-01")) and stored[4] == stored[8] == (None,) * 4
    undone = L.apply_closures(after, L.reconcile(after, n.filter("process_id <> 1")))
    assert undone.filter("process_id = 1").select("state", "closure_origin", "closure_rule", "closure_title").first() == ("EN_CURSO", None, None, None)


def test_best_evidence_order(spark):
    notices = [
        ("a", 1, RESULT, "2026-03-01"), ("b", 1, ANNULLED, "2026-02-01"), ("c", 2, RESULT, "2026-03-01"), ("d", 2, RESULT, "2026-04-10"),
        ("e", 2, RESULT, None), ("f", 3, RESULT, None), ("g", 3, RESULT, None),
    ]
    _, _, acts = plan(spark, [(i, "EN_CURSO", "Oposición", None) for i in (1, 2, 3)], notices)
    assert {k: r.notice_id for k, r in acts.items()} == {1: "b", 2: "d", 3: "g"}


def test_history_is_silent(spark):
    _, _, acts = plan(spark, [(1, "EN_CURSO", None, None)], [("a", 1, RESULT, "2026-03-01")], history=True)
    assert not acts[1].significant


def test_order_and_partitions_do_not_matter(spark):
    notices = [(f"n{i}", i % 7, (RESULT, ANNULLED, "Designación del tribunal")[i % 3], f"2026-01-{i % 28 + 1:02d}") for i in range(200)]
    processes = [(i, "EN_CURSO", "Oposición", None) for i in range(7)]
    _, _, once = plan(spark, processes, notices)
    p = spark.createDataFrame([(*r, True) for r in processes[::-1]], PROCESSES).repartition(3)
    n = spark.createDataFrame([(i, pid, t, day(d)) for i, pid, t, d in notices[::-1]], NOTICES).repartition(5)
    assert {r.process_id: r for r in L.reconcile(p, n).collect()} == once


def test_evidence_is_combined_before_the_shuffle(spark):
    n = spark.createDataFrame([], NOTICES)
    text = L.best_evidence(n)._jdf.queryExecution().toString()
    assert "partial_max_by" in text
