from __future__ import annotations

from pyspark.sql import functions as F

from edictal.operators import cdc as U
from edictal.operators import windows as W
from edictal.queries.common import day, view


def first_by(spark, path):
    n = view(spark, path, "notices")
    return W.first_by(n, ["process_id", "ref"], [F.col("published").asc_nulls_last(), F.col("notice_id")]).select("process_id", "ref", "notice_id")


def dedup_news(spark, path):
    news = U.news_union(view(spark, path, "notices"), view(spark, path, "changes"))
    out = W.dedup_news(news)
    return out.select("news_id", "process_id", "news_kind", "kind", "field", "summary", "url", day("detected").alias("detected"))


def best_url(spark, path):
    return W.best_url(view(spark, path, "notices"))


def rank_sources(spark, path):
    return W.rank_sources(view(spark, path, "notices")).select("process_id", "notice_id", "score", "rank")


def first_non_null(spark, path):
    n = view(spark, path, "notices").withColumn("code", F.when(F.col("n") % 3 == 0, F.col("n")))
    return W.first_non_null(n, "process_id", F.struct("published", "notice_id"), ["url", "code"])


def debounce(spark, path):
    return W.debounce(view(spark, path, "readings"))


def transitions(spark, path):
    return W.transitions(view(spark, path, "readings")).select("reading_id", "pool_id", "old_stage", "stage", "summary")


def slices(spark, path):
    p = view(spark, path, "processes").select("process_id", "call_date", F.coalesce("closes", F.date_add("call_date", 40)).alias("last"))
    return W.slices(p, "call_date", "last", 7).select("process_id", day("slice_from").alias("slice_from"), day("slice_to").alias("slice_to"))


def neighbourhood(spark, path):
    return W.neighbourhood(view(spark, path, "processes"), "exam_date").select(day("day").alias("day"))


def top_catalogue(spark, path):
    return W.top_catalogue(view(spark, path, "processes"), 200).select("process_id", "name")


def review_queue(spark, path):
    p = view(spark, path, "processes").withColumn("updated", F.coalesce("exam_date", "closes"))
    return W.review_queue(p).select("process_id", "scope", day("updated").alias("updated"))


def history(spark, path):
    """K4 for the process with the most publications, which Spark finds itself."""
    n = view(spark, path, "notices")
    busiest = n.groupBy("process_id").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "process_id").limit(1).select("process_id")
    return W.history(n.join(busiest, "process_id"), F.col("process_id"), "published", "notice_id", 200).select("notice_id", "title", day("published").alias("published"))


def batch_after(spark, path):
    p = view(spark, path, "processes").withColumns({
        "grp": F.when(F.col("process_id") % 3 == 0, "A"), "subgroup": F.when(F.col("process_id") % 2 == 0, "A1"),
        "scale": F.when(F.col("process_id") % 5 != 0, "General"), "updated": F.col("closes"),
    })
    return W.batch_after(p, 100, 500, recent_first=True).select("process_id", day("updated").alias("updated"))


def pending(spark, path):
    p = view(spark, path, "processes").withColumns({"review_state": F.when(F.col("scope") == "REVISION", "PENDIENTE_REVISION").otherwise("PUBLICADA"), "updated": F.col("call_date")})
    return W.pending(p).select("process_id", day("updated").alias("updated"))


QUERIES = {
    "first_by": first_by, "dedup_news": dedup_news, "best_url": best_url, "rank_sources": rank_sources, "first_non_null": first_non_null,
    "debounce": debounce, "transitions": transitions, "slices": slices, "neighbourhood": neighbourhood, "top_catalogue": top_catalogue,
    "review_queue": review_queue, "history": history, "batch_after": batch_after, "pending": pending,
}
