from __future__ import annotations

from pyspark.sql import functions as F

from edictal.functions import extract as X
from edictal.functions import text as T
from edictal.operators import calendar as D
from edictal.queries.common import day, scalar, staged, text_of, view


def body():
    return {"n": T.fold("body")}


def combine_terms(spark, path):
    """X22 over arrays that Spark derives: the terms of a process from its own dates."""
    p = view(spark, path, "processes")
    terms = F.array(
        F.struct(F.col("opens").alias("opens"), F.col("closes").alias("closes"), F.lit(None).cast("string").alias("bulletin")),
        F.struct(F.col("call_date").alias("opens"), F.date_add("call_date", 30).alias("closes"), F.when(F.col("process_id") % 2 == 0, F.col("deadline")).alias("bulletin")),
        F.struct(F.lit(None).cast("date").alias("opens"), F.col("exam_date").alias("closes"), F.lit("x").alias("bulletin")),
    )
    c = p.select("process_id", X.combine_terms(terms).alias("c"))
    return c.select("process_id", day("c.opens").alias("opens"), day("c.closes").alias("closes"), F.col("c.bulletin").alias("bulletin"))


def application_stages(spark, path):
    """X24 over arrays that Spark derives: three dated stages per process."""
    p = view(spark, path, "processes")
    name = lambda i: F.when((F.col("process_id") + i) % 3 == 0, "bases y apertura").when((F.col("process_id") + i) % 3 == 1, "ampliacion del plazo").otherwise("tribunal")
    listed = F.array(*[
        F.struct(name(i).alias("name"), (F.date_add("call_date", 40 - 10 * i) if i != 2 else F.col("opens")).alias("published"), F.lit(i).alias("stage_id"))
        for i in range(4)
    ])
    s = p.select("process_id", X.application_stages(listed).alias("s"))
    return s.select("process_id", text_of(F.transform("s", lambda x: x["stage_id"].cast("string"))).alias("stages"))


def assemble_process(spark, path):
    from edictal.plans.cards import assemble_process as assemble

    r = view(spark, path, "readings")
    cards = r.select(
        F.col("reading_id").alias("card_id"), F.col("stage"), "opens", "closes", F.concat(F.lit("Convocatoria "), "k", F.lit("/2"), F.col("k") % 10).alias("title"),
        F.when(F.col("k") % 4 == 0, F.add_months("opens", 1)).alias("term_opens"), F.when(F.col("k") % 4 == 0, F.add_months("opens", 2)).alias("term_closes"),
        F.when(F.col("k") % 8 == 0, F.col("opens")).alias("bulletin_date"),
    )
    out = assemble(cards)
    return out.select("card_id", day("opens").alias("opens"), day("closes").alias("closes"), "year", "application")


QUERIES = {
    "spelled_number": scalar("processes", "process_id", days=lambda: X.days_stated(T.fold("deadline")), word=lambda: X.spelled_number(F.regexp_extract(T.fold("deadline"), "^([a-z]+(?: [yi] [a-z]+)?) d", 1))),
    "places": scalar("notices", "notice_id", places=lambda: X.places("title")),
    "shift_places": staged(
        "notices", "notice_id", lambda: {"nt": T.fold("title")},
        open=lambda: X.shift_places("nt", F.lit("TURNO_LIBRE"))["open"], internal=lambda: X.shift_places("nt", F.lit("x"))["internal"],
        shown=lambda: X.shift_places("nt", F.lit("x"))["shown"],
    ),
    "total_places": scalar("bodies", "process_id", total=lambda: X.total_places("body"), dotted=lambda: X.dotted_int("body")),
    "declared_class": staged("bodies", "process_id", body, **{f: (lambda f=f: X.declared_class("n")[f]) for f in ("grp", "subgroup", "scale")}),
    "short_class": staged("bodies", "process_id", body, **{f: (lambda f=f: X.short_class("n")[f]) for f in ("grp", "subgroup")}),
    "class_from_table": staged("bodies", "process_id", body, **{f: (lambda f=f: X.class_from_table("n")[f]) for f in ("grp", "subgroup", "places", "origin")}),
    "class_from_subscale": staged("bodies", "process_id", body, **{f: (lambda f=f: X.class_from_subscale("n")[f]) for f in ("grp", "subgroup")}),
    "class_agree": staged("bodies", "process_id", body, subgroup=lambda: X.class_agree(F.array(X.class_from_subscale("n")["subgroup"], X.short_class("n")["subgroup"]))),
    "class_from_name": scalar("processes", "process_id", grp=lambda: X.class_from_name("name")["grp"], subgroup=lambda: X.class_from_name("name")["subgroup"]),
    "any_date": staged(
        "bodies", "process_id", lambda: {"_d": X.numeric_date("body"), "_w": X.worded_date(T.fold("body"))},
        day=lambda: day(X.any_date("body", "_d", "_w")), numeric=lambda: day("_d"), worded=lambda: day("_w"),
    ),
    "date_range": scalar("bodies", "process_id", opens=lambda: day(X.date_range("body")["opens"]), closes=lambda: day(X.date_range("body")["closes"])),
    "closing_date": staged("bodies", "process_id", body, closes=lambda: day(X.closing_date("n"))),
    "call_code": staged("bodies", "process_id", body, code=lambda: X.call_code("n")["code"], year=lambda: X.call_code("n")["year"], file=lambda: X.file_code("n")),
    "base_citation": scalar("bodies", "process_id", province=lambda: X.base_citation("body")["province"], number=lambda: X.base_citation("body")["number"], day=lambda: day(X.base_citation("body")["date"])),
    "resolution_dates": scalar("bodies", "process_id", own=lambda: day(X.resolution_dates("body")["own"]), cited=lambda: day(X.resolution_dates("body")["cited"])),
    "deadline_literal": scalar("bodies", "process_id", literal=lambda: X.deadline_literal("body")),
    "place_fragment": scalar("bodies", "process_id", **{f: (lambda f=f: X.place_fragment("body")[f]) for f in ("places", "job", "system", "shift")}),
    "pool_refs": staged("bodies", "process_id", body, refs=lambda: text_of(X.pool_refs("n"))),
    "stage_phase": scalar("bodies", "process_id", stage=lambda: X.stage_phase("body")["stage"], phase=lambda: X.stage_phase("body")["phase"]),
    "shift": staged("notices", "notice_id", lambda: {"nt": T.fold("title")}, bulletin=lambda: X.shift("nt"), card=lambda: X.shift("nt", X.SHIFT_CARD)),
    "process_type": staged("bodies", "process_id", lambda: {"n": T.fold("body"), "nn": T.fold("name")}, kind=lambda: X.process_type("n", "nn")),
    "combine_terms": combine_terms,
    "extreme_dates": scalar("bodies", "process_id", earliest=lambda: day(X.extreme_dates("body")["earliest"]), latest=lambda: day(X.extreme_dates("body")["latest"])),
    "application_stages": application_stages,
    "assemble_process": assemble_process,
    "local_date": scalar("readings", "reading_id", local_day=lambda: day(D.local_date("read_at"))),
}
