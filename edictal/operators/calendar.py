"""Business-day calendar and deadlines."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edictal.functions.classify import chain, matches
from edictal.functions.extract import days_stated
from edictal.functions.text import col, fold

# Yearly holidays (month, day) and the years checked against an official calendar.
FIXED_HOLIDAYS = (
    (1, 1), (1, 6), (3, 19), (5, 1), (6, 24), (8, 15), (10, 9), (10, 12), (11, 1), (12, 8), (12, 25),
)
VERIFIED = {
    2026: (
        (1, 1), (1, 6), (3, 19), (4, 3), (4, 6), (5, 1), (6, 24), (8, 15), (10, 9), (10, 12), (12, 8), (12, 25),
    ),
}
# A calendar is broadcast, so its size is bounded: 200 years are 73,049 narrow rows.
MOST_YEARS = 200
# No year has fewer business days: 366 days less at most 106 of weekends and 13 holidays.
FEWEST_BUSINESS_DAYS = 240


def easter(year: Column) -> Column:
    """Easter Sunday of a year (Gauss's method in the Gregorian form of Meeus), integers only."""
    golden, century = year % 19, F.floor(year / 100)
    leap = century - F.floor(century / 4) - F.floor((8 * century + 13) / 25)
    epact = (leap + 19 * golden + 15) % 30
    moon = epact - F.floor(epact / 28) * (1 - F.floor(epact / 28) * F.floor(29 / (epact + 1)) * F.floor((21 - golden) / 11))
    weekday = (year + F.floor(year / 4) + moon + 2 - century + F.floor(century / 4)) % 7
    offset = moon - weekday  # days after 21 March, less seven
    return F.date_add(F.make_date(year, F.lit(3), F.lit(28)), offset.cast("int"))


def holiday(day: Column, verified: dict = VERIFIED) -> Column:
    """The official list of a verified year, the rules of any other."""
    listed = F.month(day) * 100 + F.dayofmonth(day)
    sunday = easter(F.year(day))
    by_rule = (
        listed.isin(*[m * 100 + d for m, d in FIXED_HOLIDAYS])
        | (day == F.date_sub(sunday, 2))
        | (day == F.date_add(sunday, 1))
    )
    out = F.when(F.lit(False), False)
    for year, days in verified.items():
        out = out.when(F.year(day) == year, listed.isin(*[m * 100 + d for m, d in days]))
    return out.otherwise(by_rule)


def calendar(spark: SparkSession, first: int, last: int, verified: dict = VERIFIED) -> DataFrame:
    """One row per day with its business-day ordinal and the next business day.

    ``ordinal`` counts the business days up to and including the day, so the n-th business day after a
    start is the business day whose ordinal is ``ordinal(start) + n``: an equi-join instead of a loop.
    """
    if not 0 < last - first + 1 <= MOST_YEARS:
        raise ValueError(f"a calendar spans 1 to {MOST_YEARS} years")
    start = datetime.date(first, 1, 1)
    length = (datetime.date(last, 12, 31) - start).days + 1
    days = spark.range(0, length, 1, 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("day"))
    flagged = days.withColumn("business", (F.weekday("day") < 5) & ~holiday(F.col("day"), verified))
    upto = Window.partitionBy(F.lit(0)).orderBy("day")
    after = upto.rowsBetween(0, Window.unboundedFollowing)
    return flagged.select(
        "day",
        "business",
        F.sum(F.col("business").cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, 0)).cast("int").alias("ordinal"),
        F.first(F.when(F.col("business"), F.col("day")), ignorenulls=True).over(after).alias("next_business"),
    )


def calendar_for(spark: SparkSession, uses, least: tuple[int, int], verified: dict = VERIFIED) -> DataFrame:
    """D1 over the years in use, at least those from ``least[0]`` to ``least[1]``: one aggregate finds the first and last date and the longest
    term, which may start on the last date.

    ``uses``: (table, its date columns, its longest term in days or None), one or several.
    """
    ends = None
    for df, dates, days in uses:
        all_dates = F.array(*[F.col(c).cast("date") for c in dates])
        row = df.agg(F.min(F.array_min(all_dates)).alias("a"), F.max(F.array_max(all_dates)).alias("z"), F.max(F.lit(0) if days is None else days).cast("long").alias("n"))
        ends = row if ends is None else ends.unionByName(row)
    found = ends.agg(F.year(F.min("a")).alias("a"), F.year(F.max("z")).alias("z"), F.max("n").alias("n")).first()
    first, last = least
    if found.a is not None:
        first, last = min(first, found.a), max(last, found.z + 1 + max(found.n or 0, 0) // FEWEST_BUSINESS_DAYS)
    return calendar(spark, first, last, verified)


def inside(found: Column, wanted: Column, value: Column) -> Column:
    """``value``, or an error where a wanted day was not found: past the edge of the calendar nothing is guessed."""
    return F.when(wanted & found.isNull(), F.raise_error(F.lit("a day is outside the calendar"))).otherwise(value)


def is_business_day(df: DataFrame, cal: DataFrame, day: str, out: str = "business") -> DataFrame:
    """Business-day test by a broadcast of the bounded calendar."""
    days = cal.select(F.col("day").alias("_day"), F.col("business").alias(out))
    joined = df.join(F.broadcast(days), F.col(day) == F.col("_day"), "left")
    return joined.withColumn(out, inside(F.col("_day"), F.col(day).isNotNull(), F.col(out))).drop("_day")


def add_business_days(df: DataFrame, cal: DataFrame, start: str, n: str, out: str = "end") -> DataFrame:
    """D3: the ``n``-th business day after ``start``, across years; null where ``n`` is not positive."""
    from_ = cal.select(F.col("day").alias("_from"), F.col("ordinal").alias("_at"))
    to = cal.filter("business").select(F.col("ordinal").alias("_to"), F.col("day").alias(out))
    return (
        df.join(F.broadcast(from_), F.col(start) == F.col("_from"), "left")
        .withColumn("_goal", F.when(F.col(n) > 0, F.col("_at") + F.col(n)))
        .join(F.broadcast(to), F.col("_goal") == F.col("_to"), "left")
        .withColumn(out, inside(F.col("_to"), F.col(start).isNotNull() & F.coalesce(F.col(n) > 0, F.lit(False)), F.col(out)))
        .drop("_from", "_at", "_goal", "_to")
    )


def next_business_day(df: DataFrame, cal: DataFrame, day: str, out: str) -> DataFrame:
    days = cal.select(F.col("day").alias("_day"), F.col("next_business").alias(out))
    joined = df.join(F.broadcast(days), F.col(day) == F.col("_day"), "left")
    return joined.withColumn(out, inside(F.col(out), F.col(day).isNotNull(), F.col(out))).drop("_day")


def is_verified(first: Column, last: Column, years=tuple(VERIFIED)) -> Column:
    """Every year from ``first`` to ``last`` has a verified calendar."""
    span = F.when(first <= last, F.sequence(F.year(first), F.year(last)))
    return F.forall(span, lambda y: y.isin(*years) if years else F.lit(False))


def local_date(ts: Column | str, zone: str = "Europe/Madrid") -> Column:
    """Local calendar date of a UTC instant."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), col(ts).cast("timestamp_ntz")))


NATURAL = r"\bdias?\s+naturales?\b|\bdies\s+naturals\b"


def day_kind(n: Column | str) -> Column:
    """Natural days only when stated; business days otherwise."""
    return F.when(matches(n, NATURAL), "NATURALES").otherwise("HABILES")


def with_term(df: DataFrame, literal: str = "deadline") -> DataFrame:
    """D4, first half: days and kind stated by a deadline sentence (``term_days``, ``term_kind``)."""
    folded = df.withColumn("_n", F.nullif(F.trim(fold(F.col(literal))), F.lit("")))
    days = folded.withColumn("_d", days_stated("_n"))
    return days.withColumn("term_days", F.when(F.col("_d") > 0, F.col("_d"))).withColumn(
        "term_kind", F.when(F.col("_n").isNotNull(), day_kind("_n"))
    ).drop("_n", "_d")


def term_use(df: DataFrame, dates: list[str], literal: str = "deadline"):
    """What ``calendar_for`` needs to know of a table with deadline sentences: each distinct sentence is read once."""
    all_dates = F.array(*[F.col(c).cast("date") for c in dates])
    used = df.groupBy(literal).agg(F.min(F.array_min(all_dates)).alias("_first"), F.max(F.array_max(all_dates)).alias("_last"))
    return with_term(used, literal), ["_first", "_last"], F.col("term_days")


def own_term(processes: DataFrame, bulletins: DataFrame, literal: str = "deadline", published: str = "gazette_date") -> DataFrame:
    """Processes with the sentence and date their term is computed from: their own, else those of their only aggregated bulletin.
    Several bulletins (process_id, ``literal``, ``published``) of a process decide nothing, whatever they state: it has no sentence then."""
    found = bulletins.groupBy("process_id").agg(F.count("*").alias("_n"), F.min(literal).alias("_literal"), F.min(published).alias("_published"))
    several = F.coalesce(F.col("_n") > 1, F.lit(False))
    stated = F.coalesce(F.nullif(F.col(literal), F.lit("")), F.col("_literal"))
    return processes.join(found, "process_id", "left").withColumns({
        literal: F.when(~several, stated), published: F.when(several, F.col(published)).otherwise(F.coalesce(published, "_published")),
    }).select(*processes.columns)


def deadline(df: DataFrame, cal: DataFrame, literal: str = "deadline", published: str = "gazette_date") -> DataFrame:
    """Opening and last day of a term; natural terms that end on a holiday roll forward."""
    stated = with_term(df, literal).withColumn("term_opens", F.when(F.col("term_days").isNotNull(), F.date_add(published, 1)))
    business = add_business_days(stated, cal, published, "term_days", "_business_end").withColumn(
        "_natural", F.date_add(F.col(published), F.col("term_days"))
    )
    rolled = next_business_day(business, cal, "_natural", "_natural_end")
    closes = F.when(F.col("term_kind") == "NATURALES", F.col("_natural_end")).otherwise(F.col("_business_end"))
    return (
        rolled.withColumn("term_closes", F.when(F.col("term_days").isNotNull(), closes))
        .withColumn("term_verified", is_verified(F.col(published), F.col("term_closes")))
        .drop("_business_end", "_natural", "_natural_end")
    )


def window_state(opens: Column, closes: Column, as_of: Column) -> Column:
    return F.when(as_of < opens, "PENDIENTE_APERTURA").when(as_of <= closes, "ABIERTO").otherwise("CERRADO")


def term_state(df: DataFrame, cal: DataFrame, as_of: Column, literal: str = "deadline", published: str = "gazette_date") -> DataFrame:
    """State of one published term at ``as_of`` (``term_state``): only business days are computed here,
    natural ones keep their literal."""
    stated = with_term(df, literal).withColumn(
        "_n", F.when(F.col("term_kind") == "HABILES", F.col("term_days"))
    )
    ended = add_business_days(stated, cal, published, "_n", "_end")
    state = F.when(F.col("_end").isNull(), "PLAZO_LITERAL").otherwise(
        window_state(F.date_add(published, 1), F.col("_end"), as_of)
    )
    has_term = (F.trim(F.coalesce(F.col(literal), F.lit(""))) != "") & F.col(published).isNotNull()
    return ended.withColumn("term_state", F.when(has_term, state)).drop("_n", "_end")


def enrolment_rollup(terms: DataFrame, process: str = "process_id", code: str = "term_state") -> DataFrame:
    """One code for several terms of a process, or PLAZOS_MULTIPLES; a process whose bulletins state
    no term at all is published without one.  Two extremes decide it, so no list is ever built."""
    low, high = F.min(code), F.max(code)
    return terms.groupBy(process).agg(
        F.when(low.isNull(), "BOE_PUBLICADO_SIN_PLAZO").when(low == high, low).otherwise("PLAZOS_MULTIPLES").alias("rollup"),
        F.max(F.col(code) == "ABIERTO").alias("any_open"),
        F.count(code).alias("n_terms"),
    )


def enrolment_state(
    processes: DataFrame, cal: DataFrame, as_of: Column, awaiting, bulletins: DataFrame | None = None
) -> DataFrame:
    """Enrolment state at ``as_of``: stored dates, then the aggregated bulletins, then the literal,
    then the missing milestone.  D6 is the ``open_now`` column."""
    df = processes.withColumn("_base", F.coalesce("gazette_date", "call_date"))
    df = term_state(df, cal, as_of, "deadline", "_base")
    if bulletins is not None:
        rolled = enrolment_rollup(term_state(bulletins, cal, as_of))
        df = df.join(rolled.select("process_id", "rollup", "any_open"), "process_id", "left")
    else:
        df = df.withColumn("rollup", F.lit(None).cast("string")).withColumn("any_open", F.lit(False))
    state = chain(
        (F.col("opens").isNotNull() & F.col("closes").isNotNull(), window_state(F.col("opens"), F.col("closes"), as_of)),
        (F.col("rollup").isNotNull(), F.col("rollup")),
        (F.col("term_state").isNotNull(), F.col("term_state")),
        (F.col("gazette_date").isNotNull(), "BOE_PUBLICADO_SIN_PLAZO"),
        (F.coalesce(F.upper("origin").isin(*awaiting) | (F.upper("source_kind") == "BOP"), F.lit(False)), "PENDIENTE_BOE"),
        default="NO_DETERMINADO",
    )
    stored = F.col("opens").isNotNull() & F.col("closes").isNotNull()
    return (
        df.withColumn("enrolment", state)
        .withColumn("open_now", (F.col("enrolment") == "ABIERTO") | (~stored & F.coalesce("any_open", F.lit(False))))
        .drop("_base", "term_state", "term_days", "term_kind", "rollup", "any_open")
    )


def deadline_plan(processes: DataFrame, cal: DataFrame, bulletins: DataFrame | None = None) -> DataFrame:
    """FILL empty dates, report a DISCREPANCY, leave half-filled ones; stored dates are never replaced."""
    plan = deadline(processes if bulletins is None else own_term(processes, bulletins), cal).filter(F.col("term_closes").isNotNull())
    none = F.col("opens").isNull() & F.col("closes").isNull()
    both = F.col("opens").isNotNull() & F.col("closes").isNotNull()
    same = (F.col("opens") == F.col("term_opens")) & (F.col("closes") == F.col("term_closes"))
    action = F.when(none, "FILL").when(both & ~same, "DISCREPANCY").when(~none & ~both, "PARTIAL_UNTOUCHED")
    return plan.withColumn("action", action).filter(F.col("action").isNotNull())
