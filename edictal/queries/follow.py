from __future__ import annotations

from pyspark.sql import functions as F

from edictal.functions import classify as C
from edictal.operators import match as M
from edictal.plans import catalogue as Q
from edictal.plans import follow as Fo
from edictal.queries.aggregate import outbox
from edictal.queries.catalogue import as_of, parts
from edictal.queries.common import day, view


def followed(spark, path):
    """The processes followed by anybody: one feed over the whole tables."""
    return view(spark, path, "subscriptions").filter("active").select("process_id").distinct()


def my_feed(spark, path):
    when = F.lit("1999-06-30").cast("date")
    out = Fo.my_feed(view(spark, path, "notices"), view(spark, path, "changes"), view(spark, path, "processes"), followed(spark, path), when, 200)
    return out.select("news_id", "process_id", "news_kind", "field", "summary", day("detected").alias("detected"))


def entitled(spark, path):
    return view(spark, path, "events").filter(F.col("value") > 50).select("user_id")


def new_news(spark, path):
    since = F.lit("2000-01-01").cast("date")
    out = Fo.new_news(view(spark, path, "notices"), view(spark, path, "changes"), view(spark, path, "processes"), view(spark, path, "subscriptions"), entitled(spark, path), since)
    return out.select("user_id", "process_id", "n_news", day("newest").alias("newest"))


def interesting(spark, path):
    """Substantive news counted for every subscription."""
    news = Fo.substantive(view(spark, path, "notices"), view(spark, path, "changes"))
    return M.news_counts(news, view(spark, path, "subscriptions")).select("user_id", "process_id", "n_news", day("newest").alias("newest"))


def new_opportunities(spark, path):
    processes, *rest = parts(spark, path)
    visible = Q.catalogue(processes, *rest, as_of())
    before = visible.filter(F.col("call_date") < F.lit("1999-12-01").cast("date"))
    after = visible.withColumn("process_type", F.when(F.col("process_id") % 6 == 0, "Anuncio difícil cobertura (ADC)").otherwise(F.col("process_type"))).withColumn("actionable", F.col("process_id") % 12 == 0)
    events = view(spark, path, "notices").filter(F.col("kind") == "BASES").select("process_id")
    return Fo.new_opportunities(before, after, events)


def advance_outbox(spark, path):
    box = outbox(spark, path)
    e = view(spark, path, "events")
    results = e.groupBy("user_id").agg((F.max("event_id") % 3 != 0).alias("delivered")).withColumn("error", F.when(~F.col("delivered"), "RuntimeError: x"))
    paying = e.filter(F.col("value") > 80).select("user_id")
    out = Fo.advance_outbox(box, results.filter(F.col("user_id") % 5 != 1), paying, F.lit("2024-01-29").cast("date"))
    return out.select("send_id", "user_id", "state", "error", day("sent_on").alias("sent_on"))


def mark_read(spark, path):
    s = view(spark, path, "subscriptions")
    state = s.groupBy("user_id").agg(F.min("since").alias("last_seen"))
    requests = view(spark, path, "readings").select(F.col("pool_id").alias("user_id"), F.add_months("closes", -312).alias("until"))
    return Fo.mark_read(state, requests).withColumn("last_seen", day("last_seen"))


def unread(spark, path):
    news = M.news_counts(Fo.substantive(view(spark, path, "notices"), view(spark, path, "changes")), view(spark, path, "subscriptions"))
    state = view(spark, path, "readings").filter(F.col("k") > 50).groupBy(F.col("pool_id").alias("user_id")).agg(F.add_months(F.max("opens"), -276).alias("last_seen"))
    return Fo.unread(news, state).select("user_id", day("newest").alias("newest"))


def send_summary(spark, path):
    """Q9: how many would be told, per audience, without multiplying events and recipients."""
    events = view(spark, path, "processes").select("process_id", C.is_private("process_type", "category").alias("private"))
    people = view(spark, path, "events").groupBy("user_id").agg(F.max(F.col("value") > 90).alias("entitled"))
    addressed, members = M.fan_out(events, people)
    e = addressed.groupBy("audience").agg(F.count("*").alias("events"))
    m = members.groupBy("audience").agg(F.count("*").alias("recipients"))
    both = e.join(m, "audience", "full").fillna(0)
    return both.select("audience", "events", "recipients", (F.col("events") * F.col("recipients")).alias("sends"))


QUERIES = {f.__name__: f for f in (my_feed, new_news, interesting, new_opportunities, advance_outbox, mark_read, unread, send_summary)}
