from __future__ import annotations

from pyspark.sql import functions as F

from edictal.functions import classify as C
from edictal.functions import text as T
from edictal.operators import cdc as U
from edictal.queries.common import day, text_of, view


def key(n: int):
    return F.col("process_id") % n


def newer(spark, path):
    """The next reading of every process: the same snapshot with fields moved by rule, and unknown ids."""
    p = view(spark, path, "processes")
    return p.select(
        F.when(key(10) == 3, F.col("process_id") + 100000000).otherwise(F.col("process_id")).alias("process_id"),
        F.when(key(4) == 1, F.concat("name", F.lit(" (bis)"))).otherwise(F.col("name")).alias("name"),
        F.when(key(5) != 0, F.col("places") + key(2).cast("int")).alias("places"),
        F.when(key(3) == 0, "FINALIZADO").otherwise(F.col("state")).alias("state"),
        F.when(key(6) != 2, F.date_add("closes", 1)).alias("closes"),
    )


SNAP = ["process_id", "name", "places", "state", "closes"]


def snapshot(spark, path):
    return view(spark, path, "processes").select(*SNAP)


def news_union(spark, path):
    out = U.news_union(view(spark, path, "notices"), view(spark, path, "changes"))
    return out.withColumn("detected", day("detected"))


def recipients(spark, path):
    e = view(spark, path, "events")
    paying = e.filter(F.col("event_type") == "purchase").select("user_id")
    return U.recipients(paying, e.filter(F.col("value") > 60).select("user_id"))


def snapshot_diff(spark, path):
    after = newer(spark, path)
    return U.snapshot_diff(snapshot(spark, path), after, ["process_id"]).select("process_id", "name")


def unseen(spark, path):
    n = view(spark, path, "notices")
    found = n.select("process_id", "source_id")
    seen = n.filter(F.col("published") < F.lit("1998-01-01").cast("date")).select("process_id", "source_id")
    return U.unseen(found, seen, ["process_id", "source_id"])


def baseline_delta(spark, path):
    n = view(spark, path, "notices")
    old = n.filter(F.col("published") < F.lit("1999-01-01").cast("date")).select("process_id", "source_id")
    new = n.filter(F.col("published") >= F.lit("1997-01-01").cast("date")).select("process_id", "source_id")
    return U.baseline_delta(old, new, ["process_id", "source_id"])


def worklist(spark, path):
    known = view(spark, path, "processes").select("process_id", "name")
    return U.worklist(newer(spark, path).select("process_id", "name"), known, ["process_id"])


def insert_absent(spark, path):
    batch = newer(spark, path).unionByName(newer(spark, path).withColumn("name", F.concat(F.lit("~"), "name")))
    return U.insert_absent(snapshot(spark, path), batch, ["process_id"], [F.col("name")]).select("process_id", "name")


def append_new(spark, path):
    n = view(spark, path, "notices")
    target = n.filter(F.col("published") < F.lit("2000-01-01").cast("date")).select("ref", "source_id", "url")
    return U.append_new(target, n, ["ref", "source_id", "url"], [F.col("published"), F.col("notice_id")]).select("ref", "source_id", "url", "notice_id")


def append_twice(spark, path):
    """What a second run of a batch appends: nothing, whatever is missing in its keys."""
    n, keys = view(spark, path, "notices"), ["ref", "source_id", "url"]
    order = [F.col("published"), F.col("notice_id")]
    first = U.append_new(n.limit(0).select(*keys), n, keys, order).select(*keys)
    return U.append_new(first, n, keys, order).select(*keys, "notice_id")


def upsert_keep(spark, path):
    out = U.upsert_keep(snapshot(spark, path), newer(spark, path), "process_id", SNAP[1:])
    return out.withColumn("closes", day("closes"))


def fill_empty(spark, path):
    out = U.fill_empty(snapshot(spark, path), newer(spark, path), "process_id", ["places", "closes"])
    return out.withColumn("closes", day("closes"))


def guarded_update(spark, path):
    out = U.guarded_update(snapshot(spark, path), newer(spark, path), "process_id", ~C.is_terminal("state"), ["state", "places"])
    return out.withColumn("closes", day("closes"))


def apply_plan(spark, path):
    action = F.when(key(10) == 3, "INSERT").when(key(7) == 0, "DELETE").when(key(2) == 0, "UPDATE").otherwise("NO_CHANGE")
    plan = newer(spark, path).withColumn("action", F.when(F.col("process_id") >= 100000000, "INSERT").otherwise(action))
    return U.apply_plan(snapshot(spark, path), plan, "process_id", SNAP[1:]).withColumn("closes", day("closes"))


RENAMED = {"name": "denominacion", "places": "plazas", "state": "estado", "closes": "fecha_cierre"}


def diff_fields(mode):
    def run(spark, path):
        old = snapshot(spark, path).withColumnsRenamed(RENAMED)
        new = newer(spark, path).withColumnsRenamed(RENAMED)
        return U.diff_fields(old, new, "process_id", list(RENAMED.values()), mode, keep=("fecha_cierre",))

    return run


def silence_technical(spark, path):
    card = U.silence_technical(view(spark, path, "changes"))
    bulletin = U.silence_technical(view(spark, path, "changes"), bulletin=True)
    return card.withColumn("kind", F.lit("card")).unionByName(bulletin.withColumn("kind", F.lit("bulletin"))).select("change_id", "field", "kind", "old", "new", "significant")


def pool_state(spark, path, upto, inclusive):
    """Last reading of every pool before (or from) a day."""
    r = view(spark, path, "readings")
    r = r.filter(F.col("read_at") < F.lit(upto).cast("timestamp_ntz")) if not inclusive else r
    fields = F.struct("content_hash", "stage", "phase", (C.pool_operating(T.fold("phase"))).alias("operating"), "opens", "closes")
    return r.groupBy("pool_id").agg(F.max_by(fields, F.struct("read_at", "reading_id")).alias("s")).select("pool_id", "s.*")


def fingerprint_plan(spark, path):
    state = pool_state(spark, path, "2024-01-20", False)
    state = state.filter(F.col("content_hash") < "c")
    now = pool_state(spark, path, None, True).withColumn("content_hash", F.when(F.col("pool_id") % 3 == 0, F.sha2("stage", 256)).otherwise(F.col("content_hash")))
    return U.fingerprint_plan(state, now)


def needs_refresh(spark, path):
    return U.needs_refresh(snapshot(spark, path), newer(spark, path), "process_id", ["name", "state"], ["closes"])


def portal(spark, path):
    return view(spark, path, "processes").select(
        F.concat(F.lit("P:"), "process_id").alias("stable_id"), F.col("process_id").alias("ref"), "is_opportunity",
        F.when(key(9) != 0, F.concat(F.lit("https://dogv.example/"), "process_id")).alias("official_url"), F.when(key(8) != 0, F.col("call_date")).alias("official_date"),
        F.concat_ws("|", "name", key(4)).alias("metadata"),
    )


def stored_portal(spark, path):
    return view(spark, path, "processes").filter(F.col("state") != "EN_CURSO").select(F.concat(F.lit("P:"), "process_id").alias("stable_id"), "process_id", F.concat_ws("|", "name", key(2)).alias("metadata"))


def persistence(spark, path):
    published = view(spark, path, "notices").filter(F.col("kind") == "BASES").select(F.col("process_id").alias("ref"))
    return U.persistence_plan(portal(spark, path), stored_portal(spark, path), published, ["P:5", "P:10"])


def persistence_plan(spark, path):
    return persistence(spark, path)


def may_apply(spark, path):
    return U.may_apply(persistence(spark, path))


def ads(spark, path, old):
    r = view(spark, path, "readings")
    pools = F.when(F.col("k") % 3 == 0, F.array(F.col("k").cast("string"), F.lit("444-B")))
    base = r.select(
        F.col("reading_id").alias("ad_id"), F.col("k").alias("places"), F.col("closes"), pools.alias("pools"), F.when(F.col("k") % 3 == 0, "PDF").alias("evidence"),
        U.news_fingerprint("stage", F.when(F.col("k") % 2 == 0, F.concat(F.lit("d"), F.col("k"))), "opens").alias("fingerprint"),
    )
    if old:
        return base.filter(F.col("places") < 90).withColumn("category", F.when(F.col("places") % 5 != 0, "ADC"))
    moved = F.when(F.col("ad_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.col("pools"))
    return base.withColumn("pools", moved).withColumn("evidence", F.when(F.col("ad_id") % 4 != 0, F.col("evidence"))).withColumn("places", F.when(F.col("ad_id") % 9 == 0, F.col("places") + 1).otherwise(F.col("places"))).withColumn("closes", F.when(F.col("ad_id") % 7 != 0, F.col("closes")))


def ad_plan(spark, path):
    return U.ad_plan(ads(spark, path, False), ads(spark, path, True), ["places"], ["closes"])


def edges(spark, path, new):
    r = view(spark, path, "readings").select("pool_id", "k", "reading_id")
    e = r.groupBy(F.col("k").alias("ad_id"), F.col("pool_id").cast("string").alias("ref")).agg(F.min("reading_id").alias("m"))
    if new:
        return e.select((F.col("ad_id") + 5).alias("ad_id"), "ref", F.when(F.col("m") % 3 == 0, F.col("ref").cast("long")).alias("pool_id"), F.when(F.col("m") % 2 == 0, "NUEVA").alias("evidence"))
    return e.select("ad_id", "ref", F.when(F.col("m") % 3 == 1, F.col("ref").cast("long")).alias("pool_id"), F.when(F.col("m") % 5 != 0, "VIEJA").alias("evidence"))


def upsert_edges(spark, path):
    return U.upsert_edges(edges(spark, path, False), edges(spark, path, True))


def mark_baseline(spark, path):
    n = view(spark, path, "notices")
    cut = F.lit("1998-06-01").cast("date")
    out = U.mark_baseline(n.filter(F.col("published") >= cut).select("notice_id", "process_id"), n.filter(F.col("published") < cut), ["process_id"])
    return out.select("notice_id", "is_first")


def fan_out_stage(spark, path):
    r = view(spark, path, "readings")
    news = r.select(F.col("k").alias("ad_id"), F.when(F.col("k") % 4 != 0, F.concat("k", F.lit("/24"))).alias("number"), "stage", F.col("opens").alias("published"))
    e = edges(spark, path, False)
    told = r.filter(F.col("k") % 5 == 2).select((F.col("pool_id")).alias("pool_id"), F.col("k").alias("ad_id"), "stage")
    return U.fan_out_stage(news, e, told).withColumn("published", day("published"))


def reassign(spark, path):
    n = view(spark, path, "notices").select("notice_id", "process_id")
    n = n.dropDuplicates(["notice_id"])
    links = n.filter(F.col("process_id") % 5 == 0).select("notice_id", (F.col("process_id") + F.col("process_id") % 2).alias("process_id"))
    return U.reassign(n, links)


def bag(*pairs):
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])


def patch(spark, path):
    p = view(spark, path, "processes")
    old = bag(("origen", F.col("state")), ("url", F.coalesce("detail_url", F.lit("?"))), ("cierre", F.coalesce("closure_origin", F.lit("-"))))
    new = bag(("origen", F.when(key(2) == 0, "NUEVO").otherwise(F.col("state"))), ("extra", F.col("scope")))
    out = p.select("process_id", old.alias("b"), new.alias("n"))
    merged = out.withColumn("m", U.patch("b", F.col("n"), drop=("cierre",)))
    flat = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return merged.select("process_id", text_of(flat).alias("bag"), U.contains(F.col("b"), F.map_filter("n", lambda k, v: k == "origen")).alias("contained"))


def guarded_delete(spark, path):
    candidates = view(spark, path, "processes").filter(F.col("scope") == "NO").select("process_id")
    return U.guarded_delete(candidates, view(spark, path, "subscriptions"))


def without(spark, path):
    gone = guarded_delete(spark, path)
    return U.without(view(spark, path, "notices"), gone).select("notice_id", "process_id")


def fix_shift(spark, path):
    p = view(spark, path, "processes").withColumn("name", F.concat_ws(" ", "name", F.when(key(3) == 0, "turno libre").when(key(5) == 0, "discapacidad intelectual")))
    return U.fix_shift(p).select("process_id", "shift", "new_shift")


def rescope(spark, path):
    p = view(spark, path, "processes").withColumn("decided_by", F.when(key(6) == 0, "MANUAL"))
    return U.rescope(p).select("process_id", "scope", "new_scope")


def close_pools(spark, path):
    r = view(spark, path, "readings")
    pools = r.select("pool_id").distinct().withColumn("state", F.when(F.col("pool_id") % 4 == 0, "FINALIZADO").otherwise("EN_CURSO"))
    return U.close_pools(r, pools)


def apply_subscriptions(spark, path):
    subs = view(spark, path, "subscriptions").withColumn("process_id", F.col("process_id") % 50).groupBy("user_id", "process_id").agg(F.max("active").alias("active"), F.min("since").alias("since"))
    e = view(spark, path, "events")
    requests = e.select("user_id", (F.col("event_id") % 70).alias("process_id"), (F.col("event_type") != "error").alias("subscribe"), F.to_date("ts").alias("requested"), F.col("event_id").alias("request_id"))
    out = U.apply_subscriptions(subs, requests)
    return out.select("user_id", "process_id", "active", day("since").alias("since"), day("updated").alias("updated"))


def replace_children(spark, path):
    children = view(spark, path, "bodies").select("process_id", F.lit(1).alias("position"), "name").withColumnRenamed("name", "text")
    batch = view(spark, path, "bodies").filter(F.col("places") > 15).select("process_id", T.sentences("body").alias("items"))
    return U.replace_children(children, batch, "process_id", "items")


def review_transition(spark, path):
    p = view(spark, path, "processes").select("process_id", F.when(key(2) == 0, "BORRADOR").otherwise("PENDIENTE_REVISION").alias("review_state"), F.col("opens").alias("reviewed_at"), F.lit(None).cast("long").alias("reviewed_by"), F.when(key(3) == 0, "vieja").alias("note"))
    states = F.when(key(4) == 0, "PUBLICADA").when(key(4) == 1, "DESCARTADA").otherwise("EN_REVISION")
    req = view(spark, path, "processes").filter(F.col("places") > 10).select("process_id", states.alias("review_state"), (F.col("agency_id")).alias("reviewer"), F.col("call_date").alias("requested"), F.when(key(5) == 0, "nueva").alias("note"))
    return U.review_transition(p, req).withColumn("reviewed_at", day("reviewed_at"))


def manual_edit(spark, path):
    p = view(spark, path, "processes").withColumn("origin", F.when(key(3) == 0, "MANUAL").when(key(3) == 1, "AUTOMATICO"))
    return U.manual_edit(p, newer(spark, path), ["name", "places"])


def manual_scope(spark, path):
    p = view(spark, path, "processes").select("process_id", "scope", F.lit(None).cast("string").alias("decided_by"))
    req = view(spark, path, "processes").filter(F.col("places") > 20).select("process_id", F.when(key(3) == 0, "si").when(key(3) == 1, "NO").otherwise("QUIZA").alias("scope"))
    return U.manual_scope(p, req)


def merge_by_key(spark, path):
    n = view(spark, path, "notices").groupBy("process_id", F.col("source_id").cast("string").alias("doc")).agg(F.min("n").alias("pos"), F.max("title").alias("title"))
    old = n.filter(F.col("pos") % 3 != 0)
    new = n.filter(F.col("pos") % 2 == 0).withColumn("title", F.when(F.col("pos") % 4 == 0, F.concat(F.lit("N "), "title")))
    return U.merge_by_key(old, new, "process_id", "doc", ["title"]).select("process_id", "doc", "seen.*", "title")


QUERIES = {
    **{f.__name__: f for f in (
        news_union, recipients, snapshot_diff, unseen, baseline_delta, worklist, insert_absent, append_new, append_twice, upsert_keep, fill_empty, guarded_update,
        apply_plan, silence_technical, fingerprint_plan, needs_refresh, persistence_plan, may_apply, ad_plan, upsert_edges, mark_baseline,
        fan_out_stage, reassign, patch, guarded_delete, without, fix_shift, rescope, close_pools, apply_subscriptions, replace_children,
        review_transition, manual_edit, manual_scope, merge_by_key,
    )},
    "diff_all": diff_fields("all"), "diff_stated": diff_fields("ignore_null"), "diff_keep_dates": diff_fields("keep_dates"),
}
