from __future__ import annotations

from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions import classify as C
from edictal.functions import text as T
from edictal.operators.lifecycle import with_rule
from edictal.queries.common import staged, text_of, view


def nt():
    return {"nt": T.fold("title")}


def nn():
    return {"nn": F.lower(T.squeeze(T.unaccent("name")))}


def scope_document(spark, path):
    """Best scope over the sentences of each text that state places."""
    from edictal.functions.extract import STATES_PLACES

    s = T.unfold(view(spark, path, "bodies"), "s", T.sentences("body")).select("process_id", "s").filter(C.matches("s", STATES_PLACES))
    scoped = s.withColumn("_n", T.fold("s")).withColumn("scope", C.scope("_n", "_n"))
    rank = C.chain((F.col("scope") == "SI", 2), (F.col("scope") == "REVISION", 1), default=0)
    best = scoped.groupBy("process_id").agg(F.max(rank).alias("best"))
    return best.select("process_id", C.scope_document(F.array(C.chain((F.col("best") == 2, "SI"), (F.col("best") == 1, "REVISION"), default="NO"))).alias("scope"))


def is_employment(spark, path):
    df = with_rule(view(spark, path, "notices")).withColumn("nt", T.fold("title"))
    return df.select("notice_id", C.is_employment("nt", "rule").alias("employment"))


def mentions_town(spark, path):
    p = view(spark, path, "bodies").join(view(spark, path, "agencies").select("agency_id", "agency_name"), "agency_id")
    text = F.concat_ws(" ", "body", F.when(F.col("process_id") % 2 == 0, F.col("agency_name")))
    staged_ = p.select("process_id", T.fold(text).alias("t"), T.fold(F.regexp_replace("agency_name", r" \(Sede\)$", "")).alias("a"))
    return staged_.select("process_id", C.mentions_town("t", "a").alias("mentioned"))


def maintenance(spark, path):
    """C26 over whole pages; every seventh is turned into a maintenance page by rule."""
    html = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("<html><script>x</script><p>Aplicación fuera de servicio</p>"), "html")).otherwise(F.col("html"))
    return view(spark, path, "pages").select("page_id", C.is_maintenance(html).alias("maintenance"))


def visible_to(spark, path):
    """Rows of the restricted category only for the entitled users."""
    subs = view(spark, path, "subscriptions")
    p = view(spark, path, "processes").select("process_id", C.is_private("process_type", "category").alias("private"))
    entitled = view(spark, path, "events").filter(F.col("value") > 50).select("user_id").distinct()
    return C.visible_to(subs.join(p, "process_id"), entitled).select("user_id", "process_id", "private")


def agency_type(spark, path):
    p = view(spark, path, "processes").join(view(spark, path, "agencies").select("agency_id", "agency_name", "agency_kind"), "agency_id")
    header = F.when(F.col("agency_kind") == "DIPUTACION", F.concat(F.lit("Diputación Provincial "), "agency_name")).otherwise(F.col("agency_name"))
    return C.of_agency_type(p.withColumn("header", header), "header", "AYUNTAMIENTO").select("process_id", "header")


def corrections():
    """A correction request per process, derived from its own values."""
    k = F.col("process_id")
    return {
        "grp": F.when(k % 3 == 0, "C").when(k % 3 == 1, "Z"), "subgroup": F.when(k % 5 == 0, "c1").when(k % 5 == 1, "B9").when(k % 5 == 2, "A2"),
        "scale": F.when(k % 2 == 0, "Administración general").when(k % 7 == 1, "otra"),
        "evidence": F.when(k % 4 == 0, "ftp://x").otherwise(F.concat(F.lit("https://a.example/"), k)),
    }


QUERIES = {
    "scope": staged("processes", "process_id", nn, scope=lambda: C.scope("nn", "nn"), coded=lambda: C.scope("nn", "nn", codes=True)),
    "scope_title_first": staged("bodies", "process_id", lambda: {"n": T.fold("body"), **nn()}, scope=lambda: C.scope_title_first("nn", "n")),
    "scope_document": scope_document,
    "notice_class": staged("notices", "notice_id", nt, kind=lambda: C.notice_class("nt"), plain=lambda: C.notice_class("nt", extended=False), provincial=lambda: C.notice_class("nt", provincial=True)),
    "milestone": staged("notices", "notice_id", nt, milestone=lambda: C.milestone("nt")),
    "follow_up_type": staged("notices", "notice_id", nt, kind=lambda: C.follow_up_type("nt")),
    "is_continuity": staged("notices", "notice_id", nt, clear=lambda: C.is_continuity("nt")),
    "is_founding": staged("notices", "notice_id", lambda: {"nt": F.when(F.col("n") > 10, T.fold("title")), "nb": T.fold("title")}, founding=lambda: C.is_founding("nt", "nb")),
    "family": staged("notices", "notice_id", nt, by_title=lambda: C.family("nt", R.FAMILIES_TITLE), by_call=lambda: C.family("nt"), collision=lambda: C.family("nt", R.FAMILIES_COLLISION)),
    "document_type": staged("bodies", "process_id", dict, kind=lambda: C.document_type("name", "body")),
    "is_employment": is_employment,
    "pool_exclusion": staged("bodies", "process_id", lambda: {"n": T.fold("body"), **nn()}, reason=lambda: C.pool_exclusion("nn", "n"), specialism=lambda: C.specialism("n")),
    "call_scope": staged(
        "notices", "notice_id", lambda: {"nt": T.fold("title"), "nk": T.fold("kind")},
        **{f: (lambda f=f: C.call_scope("nt", "nk")[f]) for f in ("administrative", "reason", "codes", "shift")},
    ),
    "portal_decision": staged(
        "notices", "notice_id", lambda: {"nt": T.fold("title"), "route": F.element_at(F.array(*[F.lit(r) for r in ("PROMOCION_INTERNA", "INGRESO_LIBRE", "INTERINIDAD", "X")]), (F.col("n") % 4 + 1).cast("int")), "body": F.when(F.col("source_id") % 3 == 0, "conselleria de hacienda").when(F.col("source_id") % 3 == 1, "universitat de valencia").otherwise("otro")},
        **{f: (lambda f=f: C.portal_decision("nt", "nt", "body", "route")[f]) for f in ("included", "reason", "codes", "agency")},
    ),
    "cycle_state": staged("readings", "reading_id", lambda: {"ns": T.fold("stage")}, state=lambda: C.cycle_state("ns"), ad_state=lambda: C.ad_state("ns", F.when(F.col("k") % 2 == 0, "PLAZO_CERRADO"))),
    "actionable": staged("readings", "reading_id", dict, **{f: (lambda f=f: C.actionable("opens", "closes", F.when(F.col("k") % 5 == 0, "CERRADO").when(F.col("k") % 5 == 1, "ABIERTO"), F.lit("2024-01-20").cast("date"))[f]) for f in ("actionable", "reason")}),
    "pool_operating": staged("readings", "reading_id", lambda: {"np": T.fold("phase")}, operating=lambda: C.pool_operating("np")),
    "is_private": staged("processes", "process_id", dict, private=lambda: C.is_private("process_type", "category")),
    "visible_to": visible_to,
    "shift_compatible": staged("notices", "notice_id", lambda: {"nt": T.fold("title"), "ns": F.when(F.col("n") % 3 == 0, "libre").when(F.col("n") % 3 == 1, "libre, reserva discapacidad")}, compatible=lambda: C.shift_compatible("nt", "ns")),
    "mentions_town": mentions_town,
    "is_maintenance": maintenance,
    "validate_correction": staged("processes", "process_id", corrections, errors=lambda: text_of(C.validate_correction("grp", "subgroup", "scale", "opens", "closes", "evidence"))),
    "term_state": staged("readings", "reading_id", lambda: {"head": T.fold(F.concat_ws(" ", "phase", F.lit("Información básica"), F.lit("plazo cerrado"), "stage")), "ns": T.fold("stage")}, term=lambda: C.term_state(F.split_part("head", F.lit("informacion basica"), F.lit(1))), application=lambda: C.is_application_stage("ns")),
    "agency_type": agency_type,
    "local_decision": staged("processes", "process_id", lambda: {**nn(), "ns": T.fold("shift"), "nf": T.fold("state")}, **{f: (lambda f=f: C.local_decision("nn", "ns", "nf")[f]) for f in ("in_scope", "finished", "opportunity")}),
    "route_defaults": staged("readings", "reading_id", lambda: {"route": F.element_at(F.array(*[F.lit(r) for r in ("INGRESO_LIBRE", "INTERINIDAD", "CONTRATACION_FIJA", "OTRA")]), (F.col("k") % 4 + 1).cast("int"))}, kind=lambda: C.route_defaults("route")["kind"], shift=lambda: C.route_defaults("route")["shift"]),
}
