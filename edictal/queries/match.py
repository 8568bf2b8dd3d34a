from __future__ import annotations

from pyspark.sql import functions as F

from edictal.functions import classify as C
from edictal.functions import text as T
from edictal.operators import match as M
from edictal.queries.common import day, view
from edictal.session import once


def owned(spark, path):
    """Processes with their agency."""
    return M.enrich(view(spark, path, "processes"), view(spark, path, "agencies"), "agency_id")


def enrich(spark, path):
    return owned(spark, path).select("process_id", "agency_name", "province")


def unique_match(spark, path):
    """Process of a customer's nation, family and call month for every notice, if only one."""
    probe = view(spark, path, "notices").select("notice_id", (F.col("source_id") % 25).alias("agency_id"), F.col("published").alias("call_date"))
    build = view(spark, path, "processes").select("agency_id", "call_date", "process_id")
    return M.unique_match(probe, build, ["agency_id", "call_date"], "process_id").select("notice_id", "n", "match_id", "status")


def resolve_source(spark, path):
    """The source named by each notice; names repeat after a cut, so some are ambiguous."""
    sources = view(spark, path, "sources").withColumn("source_name", F.concat(F.lit("Supplier "), F.substring("source_name", -2, 2)))
    refs = view(spark, path, "notices").select(
        "notice_id", F.concat(F.lit(" supplier "), F.lpad(F.col("source_id") % 100, 2, "0")).alias("source_name"), F.lit("bop").alias("source_kind")
    )
    return M.resolve_source(refs, sources).select("notice_id", "n", "match_id", "error")


def towns(spark, path):
    a = view(spark, path, "agencies")
    return a.select(
        F.lpad("agency_id", 5, "0").alias("ine"), "province",
        F.array_union(T.name_keys(F.split_part("town", F.lit("/"), F.lit(1))), T.name_keys(F.split_part("town", F.lit("/"), F.lit(2)))).alias("aliases"),
    )


def resolve_agency(spark, path):
    agencies = view(spark, path, "agencies").withColumn("town", F.split_part("town", F.lit("/"), F.lit(1)))
    spelled = F.when(F.col("process_id") % 3 == 0, "La ").otherwise("")
    refs = owned(spark, path).select(
        F.col("process_id").alias("ref_id"), "agency_kind", "province",
        F.concat(spelled, F.split_part("town", F.lit("/"), (F.col("process_id") % 2 + 1).cast("int"))).alias("town"),
    )
    return M.resolve_agency(refs, agencies, towns(spark, path)).select("ref_id", "match_id", "status")


def match_call_to_base(spark, path):
    p = view(spark, path, "processes").withColumn("family", C.family(T.fold("name"))).withColumnRenamed("call_date", "base_date")
    calls = view(spark, path, "notices").select(
        F.col("notice_id").alias("call_id"), (F.col("source_id") % 25).alias("agency_id"), F.col("published").alias("base_date"),
        C.family(T.fold("title")).alias("family"), F.when(F.col("n") % 3 != 0, F.col("n") % 31).alias("places"),
    )
    return M.match_call_to_base(calls, p.select("agency_id", "base_date", "family", "places", "process_id")).select("call_id", "match_id", "status")


def recover_calls(spark, path):
    as_of = F.lit("2001-06-30").cast("date")
    p = owned(spark, path).select(
        "process_id", "places", "province", F.col("call_date").alias("base_date"), C.family(T.fold("name")).alias("family"),
        F.concat(F.lit("Ayuntamiento de "), F.split_part("town", F.lit("/"), F.lit(1))).alias("agency_name"),
    )
    jobs = owned(spark, path).select("process_id", "province", "town", "call_date", C.family(T.fold("name")).alias("family"))
    calls = view(spark, path, "notices").join(jobs, "process_id").select(
        F.concat_ws("-", "process_id", F.col("source_id") % 3).alias("document_id"), "province", F.concat(F.lit("Ayuntamiento de "), "town", F.lit(" (X)")).alias("entity"),
        F.col("call_date").alias("base_date"), "family", F.when(F.col("n") % 5 != 0, F.col("n") % 31).alias("places"), "published",
    )
    out = M.recover_calls(p, calls, as_of, 2000)
    return out.select("process_id", "n", "status", "document_id", "call_places", "complete")


def follow_ups(spark, path):
    """Municipal follow-up notices: the town is read from the title."""
    return once(view(spark, path, "notices").select("notice_id", "title", "published"), ["title"], {"town": T.issuer_town("title")}).filter(F.col("town").isNotNull())


def match_follow_up(spark, path):
    p = owned(spark, path).select("process_id", "name", "town", "state", "call_date")
    return M.match_follow_up(follow_ups(spark, path), p).select("notice_id", "reason", "match_id")


def match_by_content(spark, path):
    p = owned(spark, path).select("process_id", F.concat_ws(" ", "name", F.concat(F.lit("plaza"), F.col("process_id") % 50)).alias("name"), F.split_part("town", F.lit("/"), F.lit(1)).alias("town"), "agency_name", "shift", "call_date")
    n = follow_ups(spark, path).withColumn("title", F.concat_ws(" ", "title", F.lit("plaza"), F.concat(F.lit("plaza"), F.length("title") % 50)))
    return M.match_by_content(n, p).select("notice_id", "reason", "match_id")


def best_notice(spark, path):
    p = owned(spark, path).select("process_id", "name", F.split_part("town", F.lit("/"), F.lit(1)).alias("town"), F.col("call_date").alias("base_date"))
    n = view(spark, path, "notices").select("notice_id", F.concat_ws(" ", "title", F.when(F.col("n") % 2 == 0, F.concat(F.lit("de NATION_"), F.col("n") % 25))).alias("title"), "published")
    return M.best_notice(p, n)


def match_document_event(spark, path):
    r = view(spark, path, "notices").filter(F.col("source_id") % 3 == 1).join(owned(spark, path).select("process_id", "town", "province"), "process_id").select(
        "process_id", F.concat(F.lit("Ayuntamiento de "), F.split_part("town", F.lit("/"), F.lit(2))).alias("agency_name"), "province", F.col("published").alias("resolved")
    )
    events = owned(spark, path).select(
        F.col("process_id").alias("document_id"), F.concat(F.lit("Ayuntamiento de "), "town").alias("entity"), F.upper("province").alias("province"), F.date_add("call_date", 60).alias("cited")
    )
    return M.match_document_event(events, r).select("document_id", "match_id", "status")


def match_two_entities(spark, path):
    """Documents that name two entities, of which one may have a process of that day and the other not."""
    r = view(spark, path, "notices").filter(F.col("source_id") % 3 == 1).join(owned(spark, path).select("process_id", "town", "province"), "process_id").select(
        "process_id", F.concat(F.lit("Ayuntamiento de "), F.split_part("town", F.lit("/"), F.lit(2))).alias("agency_name"), "province", F.col("published").alias("resolved")
    )
    one = owned(spark, path).select(F.col("process_id").alias("document_id"), F.concat(F.lit("Ayuntamiento de "), "town").alias("entity"), "province", F.date_add("call_date", 60).alias("cited"))
    two = one.withColumn("entity", F.concat("entity", F.lit(" de Abajo")))
    return M.match_document_event(one.unionByName(two), r).select("document_id", "entity", "match_id", "status")


def match_identity(spark, path):
    p = view(spark, path, "processes").select("process_id", F.concat_ws(" ", "name", F.lit("convocatoria"), F.concat("places", F.lit("/1999"))).alias("name"))
    return M.match_identity(p, view(spark, path, "notices"))


def match_signature(spark, path):
    pages = view(spark, path, "pages").select("page_id", F.concat("html", F.lit(" /pdf/"), F.col("page_id") % 9 + 1992, F.lit("_"), F.col("page_id") % 47, F.lit("_es.pdf")).alias("html"))
    records = view(spark, path, "notices").select("notice_id", F.concat_ws("_", F.year("published"), "n").alias("signature"))
    return M.match_signature(records, pages).select("notice_id", "n", "match_id", "status")


def resolve_pool_refs(spark, path):
    pools = view(spark, path, "processes").filter(F.col("name").startswith("Bolsa")).select(F.col("process_id").alias("pool_id"), F.concat_ws(" ", "name", F.concat(F.col("process_id") % 900 + 100, F.lit("-L"))).alias("title"))
    ref = F.when(F.col("n") % 4 == 0, F.concat("n", F.lit("-b"))).when(F.col("n") % 4 == 1, F.concat(F.lit("5"), "n", F.lit("/22"))).when(F.col("n") % 4 == 2, F.concat(F.col("source_id") % 900 + 100, F.lit(" L"))).otherwise(F.concat(F.col("n") * 20))
    refs = view(spark, path, "notices").select(F.col("notice_id").alias("ad_id"), ref.alias("ref"))
    return M.resolve_pool_refs(refs, pools).select("ad_id", "ref", "n", "match_id", "status")


def match_any_id(spark, path):
    existing = view(spark, path, "processes").select("process_id", F.concat(F.lit("GVA:"), "process_id").alias("stable_id"), F.when(F.col("process_id") % 2 == 0, F.col("process_id") + 7).alias("id_emp"))
    new = view(spark, path, "notices").select(F.col("notice_id").alias("new_id"), F.when(F.col("n") % 2 == 0, F.concat(F.lit("GVA:"), "process_id")).alias("stable_id"), F.when(F.col("n") % 3 == 0, F.col("process_id") + 1).alias("id_emp"))
    keys = {"S": "stable_id", "E": "id_emp"}
    return M.match_any_id(new, existing, keys, keys).select("new_id", "match_id", "status")


def keep_in(spark, path):
    subs = view(spark, path, "subscriptions").filter("active")
    return M.keep_in(view(spark, path, "processes"), subs, ["process_id"]).select("process_id", "name")


def keep_not_in(spark, path):
    sources = view(spark, path, "sources").filter(F.col("source_kind") == "BOE").select("source_id")
    gazette = M.keep_in(view(spark, path, "notices"), sources, ["source_id"])
    return M.keep_not_in(view(spark, path, "processes"), gazette, ["process_id"]).select("process_id", "name")


def with_activity(spark, path):
    out = M.with_activity(view(spark, path, "processes"), view(spark, path, "notices"), view(spark, path, "sources"))
    return out.select("process_id", day("last_notice").alias("last_notice"), day("last_gazette").alias("last_gazette"), day("first_base").alias("first_base"), "best_url")


def news_counts(spark, path):
    from edictal.operators.cdc import news_union

    news = news_union(view(spark, path, "notices"), view(spark, path, "changes"))
    out = M.news_counts(news, view(spark, path, "subscriptions"))
    return out.select("user_id", "process_id", day("since").alias("since"), "n_news", day("newest").alias("newest"))


def fan_out_events(spark, path):
    """The audiences each new opportunity is addressed to."""
    events = view(spark, path, "processes").select("process_id", C.is_private("process_type", "category").alias("private"))
    recipients = view(spark, path, "events").groupBy("user_id").agg(F.max(F.col("value") > 90).alias("entitled"))
    return M.fan_out(events, recipients)[0].select("process_id", "audience")


def fan_out_recipients(spark, path):
    events = view(spark, path, "processes").select("process_id", F.lit(False).alias("private"))
    recipients = view(spark, path, "events").groupBy("user_id").agg(F.max(F.col("value") > 90).alias("entitled"))
    return M.fan_out(events, recipients)[1].select("user_id", "audience")


def split_collisions(spark, path):
    existing = view(spark, path, "processes").select(F.concat(F.lit("DVAL:"), "process_id").alias("stable_id"), "name")
    new = view(spark, path, "notices").select("notice_id", F.concat(F.lit("DVAL:"), "process_id").alias("stable_id"), F.col("title").alias("name"))
    return M.split_collisions(new, existing).select("notice_id", "final_id")


def nearest_date(spark, path):
    docs = view(spark, path, "notices").select(F.col("notice_id").alias("document_id"), F.col("n").alias("code"), F.col("published").alias("day"))
    refs = view(spark, path, "processes").select("process_id", F.coalesce("places", F.lit(1)).alias("code"), F.col("call_date").alias("day"))
    return M.nearest_date(refs, docs).select("process_id", "status", "match_id")


def canonical_id(spark, path):
    p = view(spark, path, "processes").select("process_id", (F.col("process_id") + 219600).alias("ref"))
    return p.select("process_id", M.canonical_id("ref").alias("stable_id"))


QUERIES = {f.__name__: f for f in (
    enrich, unique_match, resolve_source, resolve_agency, match_call_to_base, recover_calls, match_follow_up, match_by_content, best_notice,
    match_document_event, match_two_entities, match_identity, match_signature, resolve_pool_refs, match_any_id, keep_in, keep_not_in, with_activity, news_counts,
    fan_out_events, fan_out_recipients, split_collisions, nearest_date, canonical_id,
)}
