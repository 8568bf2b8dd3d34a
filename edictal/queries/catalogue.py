from __future__ import annotations

from pyspark.sql import functions as F

from edictal.plans import catalogue as Q
from edictal.queries.calendar import cal
from edictal.queries.common import day, view

AS_OF = "2000-06-30"


def parts(spark, path):
    return [view(spark, path, n) for n in ("processes", "agencies", "notices", "sources")]


def as_of():
    return F.lit(AS_OF).cast("date")


def catalogue(spark, path):
    return Q.catalogue(*parts(spark, path), as_of()).select("process_id", "agency_name", day("last_notice").alias("last_notice"), "best_url")


def active_view(spark, path):
    return Q.active_view(view(spark, path, "processes")).select("process_id", "name", "state")


def shown(df):
    return df.select("process_id", "name", "state", "enrolment", "open_now", "official_url")


def catalogue_list(spark, path):
    return shown(Q.catalogue_list(*parts(spark, path), cal(spark, path), as_of(), n=200))


def catalogue_private(spark, path):
    return shown(Q.catalogue_list(*parts(spark, path), cal(spark, path), as_of(), n=200, private=True))


def catalogue_open_now(spark, path):
    return shown(Q.catalogue_list(*parts(spark, path), cal(spark, path), as_of(), n=200, private=True, open_now=True))


def detail(spark, path):
    wanted = view(spark, path, "subscriptions").filter("active").select("process_id").distinct()
    return shown(Q.detail(*parts(spark, path), cal(spark, path), as_of(), wanted))


def my_subscriptions(spark, path):
    return Q.my_subscriptions(view(spark, path, "subscriptions"), *parts(spark, path)).select("user_id", "process_id", "name", "agency_name", day("since").alias("since"), "official_url")


def agencies(spark, path):
    return Q.list_agencies(view(spark, path, "agencies")).select("agency_id", "agency_name", "agency_kind")


def sources(spark, path):
    return Q.list_sources(view(spark, path, "sources"), view(spark, path, "agencies")).select("source_id", "source_name", "agency_name", "priority")


QUERIES = {f.__name__: f for f in (catalogue, active_view, catalogue_list, catalogue_private, catalogue_open_now, detail, my_subscriptions, agencies, sources)}
