from __future__ import annotations

from pyspark.sql import functions as F

from edictal.operators import calendar as D
from edictal.queries.common import day, view
from edictal.rules import AWAITS_STATE_GAZETTE

# Years the calendar has at least; a table with other dates widens it.
YEARS = (1994, 2003)
AS_OF = "2000-06-30"


def as_of():
    return F.lit(AS_OF).cast("date")


def cal(spark, path, *uses):
    """The calendar of the years of processes and their bulletins with the terms they state, or of what is given instead."""
    return D.calendar_for(spark, uses or (
        D.term_use(view(spark, path, "processes"), ["call_date", "gazette_date"]), D.term_use(bulletins(spark, path), ["gazette_date"]),
    ), YEARS)


def calendar(spark, path):
    """D1 over the days on which notices were published: business flag, ordinal and next business day."""
    days = view(spark, path, "notices").select("published").distinct()
    joined = days.join(F.broadcast(cal(spark, path, (days, ["published"], None))), F.col("published") == F.col("day"))
    return joined.select(day("published").alias("published"), "business", "ordinal", day("next_business").alias("next_business"))


def is_business_day(spark, path):
    n = view(spark, path, "notices").select("notice_id", "published")
    out = D.is_business_day(n, cal(spark, path, (n, ["published"], None)), "published")
    return out.select("notice_id", "business")


def add_business_days(spark, path):
    n = view(spark, path, "notices").select("notice_id", "published", "n")
    return D.add_business_days(n, cal(spark, path, (n, ["published"], F.col("n"))), "published", "n").select("notice_id", day("end").alias("end"))


def deadline(spark, path):
    terms = D.own_term(view(spark, path, "processes"), bulletins(spark, path))
    out = D.deadline(terms, cal(spark, path, D.term_use(terms, ["gazette_date"])))
    return out.select("process_id", "term_days", "term_kind", day("term_opens").alias("term_opens"), day("term_closes").alias("term_closes"), "term_verified")


def verified_flag(spark, path):
    p = view(spark, path, "processes")
    flag = D.is_verified(F.col("call_date"), F.coalesce("closes", "exam_date", "call_date"), years=(1996, 1997, 2000))
    return p.select("process_id", flag.alias("verified"))


def bulletins(spark, path):
    """Aggregated bulletins of processes: their notices of the state gazette with a deadline sentence by rule."""
    from edictal.sources.bind import DEADLINES, pick

    n = view(spark, path, "notices").filter(F.col("source_id") % 3 == 1)
    literal = F.when(F.col("n") % 4 != 0, pick(DEADLINES, F.col("n") % 7))
    return n.select("process_id", "notice_id", literal.alias("deadline"), F.col("published").alias("gazette_date"))


def enrolment_rollup(spark, path):
    return D.enrolment_rollup(D.term_state(bulletins(spark, path), cal(spark, path), as_of()))


def enrolled(spark, path, with_bulletins=True):
    p = view(spark, path, "processes")
    sources = view(spark, path, "sources").select("source_id", "source_kind")
    base = p.join(sources, "source_id", "left").withColumn("origin", F.when(F.col("process_id") % 8 == 0, "BOP_ALICANTE"))
    return D.enrolment_state(base, cal(spark, path), as_of(), AWAITS_STATE_GAZETTE, bulletins(spark, path) if with_bulletins else None)


def enrolment_state(spark, path):
    return enrolled(spark, path).select("process_id", "enrolment", "open_now")


def deadline_plan(spark, path):
    terms = D.own_term(view(spark, path, "processes"), bulletins(spark, path))
    plan = D.deadline_plan(terms, cal(spark, path, D.term_use(terms, ["gazette_date"])))
    return plan.select("process_id", "action", day("term_opens").alias("term_opens"), day("term_closes").alias("term_closes"), "term_days", "term_kind")


QUERIES = {
    "calendar": calendar, "is_business_day": is_business_day, "add_business_days": add_business_days, "deadline": deadline,
    "verified_flag": verified_flag, "enrolment_rollup": enrolment_rollup, "enrolment_state": enrolment_state, "deadline_plan": deadline_plan,
}
