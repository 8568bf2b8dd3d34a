from __future__ import annotations

from pyspark.sql import functions as F

from edictal.functions import classify as C
from edictal.functions import extract as X
from edictal.functions import text as T
from edictal.operators import aggregate as A
from edictal.operators import windows as W
from edictal.operators.lifecycle import reconcile
from edictal.queries.common import day, view

RUN_DAY = "2024-01-31"


def counts(spark, path):
    n = view(spark, path, "notices").withColumn("nt", T.fold("title"))
    classed = n.select("source_id", C.notice_class("nt").alias("kind")).join(view(spark, path, "sources"), "source_id")
    return A.counts(classed, "source_kind", "kind")


def plan_summary(spark, path):
    acts = reconcile(view(spark, path, "processes"), view(spark, path, "notices"))
    return A.plan_summary(acts, ["CLOSE", "REOPEN"])


def last_success(spark, path):
    return A.last_success(view(spark, path, "runs")).select("source", day("last_success").alias("last_success"))


def read_windows(spark, path):
    runs = view(spark, path, "runs").withColumn("until", F.date_sub("until", F.length("source") * 3))
    out = A.read_windows(runs, F.lit(RUN_DAY).cast("date"))
    return out.select("source", day("last_success").alias("last_success"), "days", "exceeded")


def last_publication(spark, path):
    p = view(spark, path, "processes").select("process_id", F.date_add("call_date", F.lit(50)).alias("stored_last"))
    return A.last_publication(p, view(spark, path, "notices")).select("process_id", day("stored_last").alias("stored_last"), day("last_published").alias("last_published"))


def monotone_max(spark, path):
    from edictal.operators.cdc import monotone_max as latest

    return view(spark, path, "processes").select("process_id", day(latest("closes", "exam_date")).alias("latest"))


def urls_by_process(spark, path):
    return A.urls_by_process(view(spark, path, "notices")).select("process_id", "url", day("first_seen").alias("first_seen"), "first_notice")


def calls(spark, path):
    """Rows of gazette documents: the notices of a process and source."""
    n = view(spark, path, "notices")
    return n.select(
        F.concat_ws("-", "process_id", F.col("source_id") % 2).alias("document_id"), F.struct("published", "notice_id").alias("pos"),
        X.places("title").alias("places"), T.clean_title("title").alias("job"), "title",
    )


def group_calls(spark, path):
    return A.group_calls(calls(spark, path), ["title"])


def call_jobs(spark, path):
    out = A.call_jobs(calls(spark, path))
    return out.select("document_id", "job", F.col("pos.notice_id").alias("first_notice"))


def outbox(spark, path):
    """Outbox rows over events; dates as they are."""
    e = view(spark, path, "events")
    return e.select(
        F.col("event_id").alias("send_id"), "user_id", F.col("event_id").alias("process_id"), F.to_date("ts").alias("created"),
        F.when(F.col("event_type").isin("view", "click", "signup"), "PENDIENTE").when(F.col("event_type") == "error", "ERROR").otherwise("ENVIADA").alias("state"),
    )


def digests(spark, path):
    box = outbox(spark, path).filter(F.col("state") == "PENDIENTE")
    items = view(spark, path, "processes").select("process_id", "name", F.concat_ws(" | ", "name", F.concat(F.lit("Plazas: "), "places"), F.concat(F.lit("Cierre: "), day("closes"))).alias("line"))
    return A.digests(box, items)


def pending_by_user(spark, path):
    return A.pending_by_user(outbox(spark, path), F.lit("2024-01-29").cast("date"))


def retryable(spark, path):
    return A.retryable(outbox(spark, path), F.lit("2024-01-29").cast("date")).select("send_id", "user_id", day("created").alias("created"))


def source_state(spark, path):
    r = view(spark, path, "runs")
    n = F.col("errors").cast("int")
    counters = F.array(F.when(n % 5 != 0, n % 2), F.when(n % 3 == 0, F.lit(0)))
    return r.select("run_id", A.source_state(F.when(n % 4 == 0, n), counters).alias("state"))


def cycle_health(spark, path):
    return A.cycle_health(view(spark, path, "runs"))


def completeness(spark, path):
    listing = view(spark, path, "notices").select(F.col("source_id").alias("query_id"), F.col("process_id").alias("item_id"), (F.col("n") * 12).alias("declared"))
    return A.completeness(listing)


def coverage(spark, path):
    b = view(spark, path, "bodies").withColumn("n", T.fold("body"))
    c = b.select("agency_id", X.class_from_table("n")["subgroup"].alias("subgroup"), (F.length("body") % 7 != 0).alias("has_document"), (F.col("process_id") % 11 == 0).alias("failed"))
    return A.coverage(c, "agency_id")


def active_totals(spark, path):
    return A.active_totals(view(spark, path, "processes").filter(~C.is_terminal("state")), "agency_id", "scope")


def presence_audit(spark, path):
    targets = view(spark, path, "processes").select(F.col("process_id").alias("item_id"))
    listing = view(spark, path, "notices").filter(F.col("kind") == "BASES").select(F.col("process_id").alias("item_id"), F.col("title").alias("item_class"))
    return A.presence_audit(targets, listing)


def card_closure(spark, path):
    r = view(spark, path, "readings")
    cards = r.groupBy("pool_id").agg(F.max_by("phase", F.struct("read_at", "reading_id")).alias("phase"), F.max("opens").alias("last_published")).withColumn(
        "phase", F.when(F.col("pool_id") % 5 == 0, "Adjudicación y nombramiento").otherwise(F.col("phase"))).withColumnRenamed("pool_id", "card_id")
    from edictal.sources.bind import TITLES, pick

    name = F.when(F.col("k") % 97 == 0, "Nombramiento").otherwise(pick(TITLES, F.col("k") % 29))
    stages = r.filter(F.col("k").isNotNull()).select(F.col("pool_id").alias("card_id"), F.col("reading_id").alias("stage_id"), F.when(F.col("k") % 4 == 0, name).otherwise("Tribunal").alias("name"), F.col("opens").alias("published"))
    return A.card_closure(cards, stages).select("card_id", "rule", "state", day("day").alias("day"))


def recent(spark, path):
    """The ten-day news horizon and the twelve-month inactivity bound at one date."""
    as_of = F.lit("2000-06-30").cast("date")
    n = view(spark, path, "notices").filter(F.col("published") <= as_of)
    return n.select("notice_id", W.recent("published", as_of, days=10).alias("news"), W.recent("published", as_of, months=12).alias("active"))


QUERIES = {f.__name__: f for f in (
    counts, plan_summary, last_success, read_windows, last_publication, monotone_max, urls_by_process, group_calls, call_jobs, digests,
    pending_by_user, retryable, source_state, cycle_health, completeness, coverage, active_totals, presence_audit, card_closure, recent,
)}
