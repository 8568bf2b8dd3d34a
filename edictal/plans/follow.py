"""Followers: feeds, new news, opportunities, outbox (Q6-Q12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions.classify import is_private
from edictal.operators.cdc import news_union
from edictal.operators.match import news_counts
from edictal.operators.windows import page, dedup_news

NEWS_DAYS = 10


def substantive(notices: DataFrame, changes: DataFrame) -> DataFrame:
    """O1: publications and significant changes of relevant fields, captures of navigation left out."""
    shown = notices.filter(
        ~F.coalesce(F.lower("kind"), F.lit("")).isin(*R.NAVIGATION) & (F.coalesce(F.lower("title"), F.lit("")) != "navegación")
    )
    relevant = changes.filter(
        F.col("significant") & F.col("old").isNotNull() & F.lower(F.coalesce("field", F.lit(""))).isin(*R.RELEVANT_FIELDS)
        & ~F.lower("old").isin(*R.NAVIGATION)
    )
    return news_union(shown, relevant)


def my_feed(notices: DataFrame, changes: DataFrame, processes: DataFrame, followed: DataFrame, as_of: Column, n: int = 100) -> DataFrame:
    """Q6: the newest news of the followed processes within ten days, each shown once."""
    listed = processes.filter(F.col("is_opportunity") & (F.col("scope") == "SI")).join(followed, "process_id", "left_semi").select("process_id", "name")
    window = lambda c: F.col(c).between(F.date_sub(as_of, NEWS_DAYS), as_of)
    news = substantive(notices.filter(window("published")), changes.filter(window("detected"))).join(listed, "process_id")
    return dedup_news(news).orderBy(F.col("detected").desc_nulls_last(), F.col("news_id").desc()).limit(page(n))


def new_news(
    notices: DataFrame, changes: DataFrame, processes: DataFrame, subscriptions: DataFrame, entitled: DataFrame, since: Column
) -> DataFrame:
    """Q7: news of this cycle per follower and process, the restricted category only for the entitled."""
    news = substantive(notices.filter(F.col("published") > since), changes.filter(F.col("detected") > since))
    open_to = processes.filter(F.col("is_opportunity") & (F.col("scope") == "SI")).select(
        "process_id", is_private("process_type", "category").alias("_private")
    )
    may = entitled.select("user_id").distinct().withColumn("_may", F.lit(True))
    subs = subscriptions.join(open_to, "process_id").join(may, "user_id", "left")
    allowed = subs.filter(~F.col("_private") | F.coalesce("_may", F.lit(False))).drop("_private", "_may")
    return news_counts(news, allowed)


def new_opportunities(before: DataFrame, after: DataFrame, events: DataFrame) -> DataFrame:
    """Q8: events of newly visible opportunities, one per process ever; ads only while they can be answered.

    ``before`` and ``after``: visible processes; ``after`` with process_type and actionable.
    """
    fresh = after.join(before, "process_id", "left_anti")
    silent = (F.col("process_type") == R.HARD_TO_FILL_TYPE) & ~F.coalesce("actionable", F.lit(False))
    return fresh.filter(~F.coalesce(silent, F.lit(False))).join(events, "process_id", "left_anti").select(
        "process_id", F.lit("NUEVA_OPORTUNIDAD").alias("kind"), is_private("process_type", "category").alias("private")
    )


def advance_outbox(outbox: DataFrame, results: DataFrame, paying: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Q11: next state of every outbox row: within the horizon, unpaid rows are discarded, delivered ones
    sent, failed ones keep waiting with their error."""
    paid = paying.select("user_id").distinct().withColumn("_paid", F.lit(True))
    told = results.select("user_id", "delivered", F.col("error").alias("_error"))
    joined = outbox.join(paid, "user_id", "left").join(told, "user_id", "left")
    due = (F.col("state") == "PENDIENTE") & (F.col("created") > F.date_sub(as_of, days))
    unpaid = due & F.col("_paid").isNull()
    sent = due & F.col("_paid").isNotNull() & F.coalesce("delivered", F.lit(False))
    failed = due & F.col("_paid").isNotNull() & ~F.coalesce("delivered", F.lit(True))
    state = F.when(unpaid, "DESCARTADA").when(sent, "ENVIADA").otherwise(F.col("state"))
    error = F.when(unpaid, "Sin suscripción vigente").when(failed, F.left("_error", F.lit(2000)))
    return joined.select(*[c for c in outbox.columns if c != "state"], state.alias("state"), error.alias("error"), F.when(sent, as_of).alias("sent_on"))


def mark_read(state: DataFrame, requests: DataFrame) -> DataFrame:
    """Q12: the last news each user saw only ever moves forward."""
    asked = requests.groupBy("user_id").agg(F.max("until").alias("_until"))
    joined = state.join(asked, "user_id", "full")
    return joined.select("user_id", F.greatest("last_seen", "_until").alias("last_seen"))


def unread(news: DataFrame, state: DataFrame) -> DataFrame:
    """Q12: users with news after what they saw; news is one row per user and process."""
    newest = news.groupBy("user_id").agg(F.max("newest").alias("newest"))
    return newest.join(state, "user_id", "left").filter(F.col("last_seen").isNull() | (F.col("newest") > F.col("last_seen")))
