"""Catalogue queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions.classify import has, is_private, is_terminal
from edictal.operators.calendar import enrolment_state
from edictal.operators.match import activity
from edictal.operators.windows import page, top_catalogue


def offered(processes: DataFrame) -> DataFrame:
    """Q1, the part that needs the process alone; it runs before any join."""
    lower = F.lower(F.coalesce("name", F.lit("")))
    return processes.filter(
        F.col("is_opportunity")
        & (F.col("scope") == "SI")
        & ~F.coalesce("process_type", F.lit("")).isin(*R.EXCLUDED_TYPES)
        & (F.coalesce(F.upper("shift"), F.lit("")) != "PROMOCION_INTERNA")
        & ~is_terminal("state")
        & ~has(lower, R.EXCLUDED_TITLES)
    )


def catalogue(processes: DataFrame, agencies: DataFrame, notices: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Q1: visible opportunities with their agency and activity.

    Local processes without any activity for twelve months are hidden, not closed; one with no date at
    all stays.  Notices meet the processes as one row each.
    """
    owned = offered(processes).join(agencies.select("agency_id", "agency_name", "agency_kind", "province"), "agency_id")
    active = owned.join(activity(notices, sources), "process_id", "left")
    last = F.greatest("call_date", "opens", "closes", "last_notice")
    fresh = F.coalesce(last, as_of) >= F.add_months(as_of, -R.INACTIVE_MONTHS)
    return active.filter(~F.col("agency_kind").isin(*R.LOCAL_AGENCIES) | fresh)


# Types the narrower stored view leaves out, compared in lower case, and its states.
VIEW_TYPES = (
    "promoción interna", "promocion interna", "libre designación", "libre designacion", "concurso general de méritos",
    "concurso de méritos para la provisión", "concurso de traslados", "comisiones de servicio", "difícil cobertura",
    "anuncio difícil cobertura", "anuncio dificil cobertura", "acto único telemático", "acto unico telematico",
    "acte unic telematic", "acte únic telemàtic",
)
VIEW_STATES = (
    "finalizado", "finalitzado", "finalitzat", "cancelado", "cancel·lado", "cancel·lat", "desistido", "desistit",
    "anulado", "anul·lat",
)


def active_view(processes: DataFrame) -> DataFrame:
    """Q2: the narrower view: no title or inactivity rule, fewer spellings of the closed states."""
    return processes.filter(
        F.col("is_opportunity")
        & (F.col("scope") == "SI")
        & ~F.coalesce(F.lower("state"), F.lit("")).isin(*VIEW_STATES)
        & (F.coalesce(F.upper("shift"), F.lit("")) != "PROMOCION_INTERNA")
        & ~F.coalesce(F.lower("process_type"), F.lit("")).isin(*VIEW_TYPES)
    )


def official_url(detail: str = "detail_url") -> Column:
    return F.coalesce(F.nullif(F.trim(detail), F.lit("")), F.col("best_url"))


def enriched(visible: DataFrame, sources: DataFrame, cal: DataFrame, as_of: Column) -> DataFrame:
    """Q3: address, origin, enrolment state and present-day state of catalogue rows."""
    kinds = sources.select("source_id", "source_kind")
    df = visible.join(kinds, "source_id", "left").withColumn("gazette_date", F.coalesce("last_gazette", "gazette_date"))
    if "origin" not in df.columns:
        df = df.withColumn("origin", F.lit(None).cast("string"))
    df = df.withColumn("origin", F.when(F.col("origin").isNull() & (F.col("source_kind") == "BOP"), "BOP_VALENCIA_MUNICIPAL").otherwise(F.col("origin")))
    df = enrolment_state(df, cal, as_of, R.AWAITS_STATE_GAZETTE)
    return df.withColumn("official_url", official_url()).withColumn(
        "state", F.when(F.upper("state") == "ABIERTO", R.RUNNING).otherwise(F.col("state"))
    )


def catalogue_list(
    processes: DataFrame, agencies: DataFrame, notices: DataFrame, sources: DataFrame, cal: DataFrame, as_of: Column,
    n: int = 100, private: bool = False, open_now: bool = False,
) -> DataFrame:
    """Q3 with K1 and K2: every filter comes before the limit, so nothing open is cut off early."""
    rows = processes if private else processes.filter(~is_private("process_type", "category"))
    visible = catalogue(rows, agencies, notices, sources, as_of)
    if not open_now:
        # Only the rows that are shown are enriched.
        return enriched(top_catalogue(visible, page(n)), sources, cal, as_of)
    return top_catalogue(enriched(visible, sources, cal, as_of).filter("open_now"), page(n))


def detail(processes: DataFrame, agencies: DataFrame, notices: DataFrame, sources: DataFrame, cal: DataFrame, as_of: Column, wanted: DataFrame) -> DataFrame:
    """Q4: the wanted processes whatever their state; notices are reduced to theirs before they are read."""
    rows = processes.join(wanted, "process_id", "left_semi").filter(F.col("is_opportunity") & (F.col("scope") == "SI"))
    owned = rows.join(agencies.select("agency_id", "agency_name"), "agency_id")
    theirs = notices.join(wanted, "process_id", "left_semi")
    return enriched(owned.join(activity(theirs, sources), "process_id", "left"), sources, cal, as_of)


def my_subscriptions(subscriptions: DataFrame, processes: DataFrame, agencies: DataFrame, notices: DataFrame, sources: DataFrame, user=None) -> DataFrame:
    """Q5: followed processes with their agency and address; of one user or of all."""
    mine = subscriptions.filter("active") if user is None else subscriptions.filter(F.col("active") & (F.col("user_id") == user))
    rows = processes.filter(F.col("is_opportunity") & (F.col("scope") == "SI")).join(mine, "process_id")
    followed = mine.select("process_id").distinct()
    seen = activity(notices.join(followed, "process_id", "left_semi"), sources)
    out = rows.join(agencies.select("agency_id", "agency_name"), "agency_id").join(seen, "process_id", "left")
    return out.withColumn("official_url", official_url())


def list_agencies(agencies: DataFrame, only_active: bool = True) -> DataFrame:
    """Q13."""
    return (agencies.filter("active") if only_active else agencies).orderBy("agency_name")


def list_sources(sources: DataFrame, agencies: DataFrame, only_active: bool = True) -> DataFrame:
    """Q13."""
    rows = sources.filter("active") if only_active else sources
    return rows.join(agencies.select("agency_id", "agency_name"), "agency_id", "left").orderBy("priority", "source_name")
