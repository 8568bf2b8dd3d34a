from __future__ import annotations

from pyspark.sql import functions as F

from edictal.functions import classify as C
from edictal.functions import text as T
from edictal.operators import aggregate as A
from edictal.operators import lifecycle as L
from edictal.queries.common import day, scalar, staged, view


def actions(spark, path):
    return L.reconcile(view(spark, path, "processes"), view(spark, path, "notices"))


def closure_summary(spark, path):
    """Flagship: closing and reopening actions per agency and state."""
    acts = L.closing_states(view(spark, path, "processes"), view(spark, path, "notices"), keep=("agency_id",))
    counted = acts.groupBy("agency_id", "action", "new_state").agg(F.count("*").alias("n"))
    names = view(spark, path, "agencies").select("agency_id", "agency_name")
    return counted.join(names, "agency_id").select("agency_name", "action", "new_state", "n").orderBy("agency_name", "action", "new_state")


def reconcile(spark, path):
    return actions(spark, path).withColumn("published", day("published"))


def reconcile_history(spark, path):
    acts = L.reconcile(view(spark, path, "processes"), view(spark, path, "notices"), history=True)
    return A.counts(acts, "action", "significant")


def reconcile_twice(spark, path):
    """Idempotency: a second run over the applied snapshot finds nothing to do."""
    processes, notices = view(spark, path, "processes"), view(spark, path, "notices")
    after = L.apply_closures(processes, L.reconcile(processes, notices))
    return L.reconcile(after, notices).agg(F.count("*").alias("n"))


def apply_closures(spark, path):
    processes, notices = view(spark, path, "processes"), view(spark, path, "notices")
    after = L.apply_closures(processes, L.reconcile(processes, notices))
    return after.select("process_id", "state", "closure_origin", "closure_rule", "closure_notice_id", "closure_title", day("closure_published").alias("closure_published"))


def closure_changes(spark, path):
    return L.closure_changes(actions(spark, path))


def best_evidence(spark, path):
    best = L.best_evidence(view(spark, path, "notices")).filter(F.col("any_evidence").isNotNull())
    a, p = F.col("any_evidence"), F.col("pool_evidence")
    return best.select(
        "process_id", a["rule"].alias("rule"), a["notice_id"].alias("notice_id"), day(a["published"]).alias("published"),
        p["rule"].alias("pool_rule"), p["notice_id"].alias("pool_notice_id"),
    )


def first_terminal(spark, path):
    return L.first_terminal(view(spark, path, "processes"), view(spark, path, "notices"))


def closure_event(spark, path):
    return L.with_rule(view(spark, path, "notices")).select("notice_id", "rule", "closing_state", C.closes_pools("rule").alias("closes_pools"))


QUERIES = {
    "closure_summary": closure_summary,
    "reconcile": reconcile,
    "reconcile_history": reconcile_history,
    "reconcile_twice": reconcile_twice,
    "apply_closures": apply_closures,
    "closure_changes": closure_changes,
    "best_evidence": best_evidence,
    "first_terminal": first_terminal,
    "closure_event": closure_event,
    "state_label": staged(
        "processes", "process_id", lambda: {"k": T.title_key(F.concat(F.lit("Procés "), F.lower("state")))}, label=lambda: C.state_label("k")
    ),
    "terminal_state": scalar("processes", "process_id", terminal=lambda: C.is_terminal("state"), pool=lambda: C.is_pool_type("process_type")),
}
