"""Counts, roll-ups, ledgers and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions import text as T
from edictal.operators.lifecycle import best_evidence
from edictal.operators.windows import top_by


def counts(df: DataFrame, *by: str) -> DataFrame:
    """G1: rows per class."""
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def plan_summary(actions: DataFrame, names: list[str], by: str = "action") -> DataFrame:
    """One row with a counter per kind of action."""
    return actions.agg(F.count("*").alias("total"), *[F.count_if(F.col(by) == n).alias(n.lower()) for n in names])


# Run states that count as a success.
SUCCESS = ("OK", "SIN_NOVEDADES")


def last_success(runs: DataFrame) -> DataFrame:
    """Last day each source covered with success."""
    done = runs.filter(F.col("state").isin(*SUCCESS) & F.col("until").isNotNull())
    return done.groupBy("source").agg(F.max("until").alias("last_success"))


# Days a source re-reads at least, and at most in an ordinary run.
FLOOR_DAYS, CAP_DAYS = 7, 30


def window_days(last: Column, as_of: Column, floor: int = FLOOR_DAYS, cap: int = CAP_DAYS) -> tuple[Column, Column]:
    """Days to read back, and whether the gap since the last success exceeds the cap."""
    need = F.greatest(F.lit(floor), F.date_diff(as_of, last) + 1)
    days = F.when(last.isNull(), floor).otherwise(F.least(F.lit(cap), need)).cast("int")
    return days, last.isNotNull() & (need > cap)


def read_windows(runs: DataFrame, as_of: Column, floor: int = FLOOR_DAYS, cap: int = CAP_DAYS) -> DataFrame:
    """Read window of every source seen in the ledger."""
    sources = runs.select("source").distinct().join(last_success(runs), "source", "left")
    days, exceeded = window_days(F.col("last_success"), as_of, floor, cap)
    return sources.select("source", "last_success", days.alias("days"), exceeded.alias("exceeded"))


def last_publication(processes: DataFrame, notices: DataFrame) -> DataFrame:
    """Processes whose stored last publication is not the last one stored."""
    last = notices.filter(F.col("published").isNotNull()).groupBy("process_id").agg(F.max("published").alias("last_published"))
    return processes.join(last, "process_id").filter(~F.col("stored_last").eqNullSafe(F.col("last_published")))


def urls_by_process(notices: DataFrame) -> DataFrame:
    """Document addresses of each process, each once, with the position it was first seen at."""
    web = notices.filter(F.col("url").startswith("http") & ~F.contains("url", F.lit("boe.es")))
    return web.groupBy("process_id", "url").agg(F.min(F.struct("published", "notice_id")).alias("_f")).select(
        "process_id", "url", F.col("_f.published").alias("first_seen"), F.col("_f.notice_id").alias("first_notice")
    )


def group_calls(calls: DataFrame, first: list[str]) -> DataFrame:
    """Rows of one gazette document as one call: places summed where stated, the first row's fields."""
    at = F.col("pos")
    return calls.filter(F.trim(F.coalesce("document_id", F.lit(""))) != "").groupBy("document_id").agg(
        F.sum("places").alias("places"), F.count_distinct("job").alias("n_jobs"),
        *[F.min_by(F.struct(c), at)[c].alias(c) for c in first],
    )


def call_jobs(calls: DataFrame) -> DataFrame:
    """The distinct jobs of each document with the position they were first stated at."""
    return calls.filter(F.col("job").isNotNull()).groupBy("document_id", "job").agg(F.min("pos").alias("pos"))


# Most items listed in one digest.
DIGEST_CAP = 40


def digests(outbox: DataFrame, items: DataFrame, cap: int = DIGEST_CAP) -> DataFrame:
    """One digest per user: subject, the first ``cap`` items in order, and how many more there are.

    ``outbox``: user_id, process_id, created, send_id; ``items``: process_id, name, line.  Rows without an
    item neither count nor take a place; only the rows that will be listed meet the item's texts.
    """
    found = outbox.join(items.select("process_id"), "process_id", "left_semi")
    listed = top_by(found, ["user_id"], [F.col("created"), F.col("send_id")], cap)
    totals = found.groupBy("user_id").agg(F.count("*").alias("total"))
    lines = listed.join(items, "process_id").groupBy("user_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]), "\n").alias("body"),
        F.min_by("name", "rank").alias("first_name"),
    )
    subject = F.when(F.col("total") == 1, F.concat(F.lit("Nueva oportunidad de empleo: "), "first_name")).otherwise(
        F.concat("total", F.lit(" nuevas oportunidades de empleo"))
    )
    return totals.join(lines, "user_id").select(
        "user_id", "total", subject.alias("subject"), "body", F.greatest(F.col("total") - cap, F.lit(0)).alias("more")
    )


def retryable(outbox: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Pending rows still within the retry horizon."""
    return outbox.filter((F.col("state") == "PENDIENTE") & (F.col("created") > F.date_sub(as_of, days)))


def pending_by_user(outbox: DataFrame, as_of: Column) -> DataFrame:
    """Pending items of each user as counts and extremes; the items themselves stay rows."""
    return retryable(outbox, as_of).groupBy("user_id").agg(
        F.count("*").alias("n"), F.min("send_id").alias("first_id"), F.max("send_id").alias("last_id")
    )


def source_state(errors: Column, counters: Column) -> Column:
    """DEGRADADA with errors, SIN_NOVEDADES when every counter is zero, else OK."""
    stated = F.filter(counters, lambda x: x.isNotNull())
    idle = (F.size(stated) > 0) & ~F.exists(stated, lambda x: x != 0)
    return F.when(F.coalesce(errors > 0, F.lit(False)), "DEGRADADA").when(idle, "SIN_NOVEDADES").otherwise("OK")


def cycle_health(runs: DataFrame, tolerance: int = 0) -> DataFrame:
    """Level and messages of each cycle.  A cycle runs each source once at most a few dozen times;
    names are reduced to distinct ones before they are joined."""
    total = runs.groupBy("cycle_id").agg(F.count("*").alias("total"), F.count_if(F.col("state") == "ERROR").alias("errors"))
    bad = runs.filter(F.col("state").isin("ERROR", "DEGRADADA")).select("cycle_id", "state", "source").distinct()
    names = bad.groupBy("cycle_id").agg(
        *[F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("source")))), ", ").alias(s.lower()) for s in ("ERROR", "DEGRADADA")]
    )
    failed = F.col("errors") > tolerance
    prefix = F.when(F.col("errors") >= F.col("total"), "TODAS las fuentes fallaron").otherwise(
        F.concat("errors", F.lit(" de "), "total", F.lit(" fuentes fallaron"))
    )
    degraded = F.coalesce(F.col("degradada") != "", F.lit(False))
    level = F.when(failed, "ERROR").when(degraded, "AVISO").otherwise("OK")
    return total.join(names, "cycle_id", "left").select(
        "cycle_id", "total", "errors", level.alias("level"), failed.cast("int").alias("code"),
        F.concat_ws(
            "; ", F.when(failed, F.concat(prefix, F.lit(": "), "error")),
            F.when(degraded, F.concat(F.lit("Fuentes degradadas: "), "degradada")),
        ).alias("message"),
    )


# Rows at which a listing is known to be cut.
LISTING_CAP = 100


def completeness(listing: DataFrame) -> DataFrame:
    """Declared total against distinct rows read, per query of a listing."""
    read = listing.groupBy("query_id").agg(F.max("declared").alias("declared"), F.count_distinct("item_id").alias("read"))
    cut = (F.col("read") >= LISTING_CAP) | F.coalesce(F.col("declared") > F.col("read"), F.lit(False))
    return read.withColumn("truncated", cut)


def coverage(df: DataFrame, *by: str) -> DataFrame:
    """Classified, unclassified, without document and failed rows."""
    doc, err, cls = F.col("has_document"), F.col("failed"), F.col("subgroup").isNotNull()
    return df.groupBy(*by).agg(
        F.count("*").alias("reviewed"),
        F.count_if(doc & cls).alias("classified"),
        F.count_if(doc & ~cls & ~err).alias("unclassified"),
        F.count_if(~doc).alias("without_document"),
        F.count_if(doc & ~cls & err).alias("errors"),
    )


def active_totals(df: DataFrame, *by: str) -> DataFrame:
    """Active candidates and their places, unknown places counted as none."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.coalesce("places", F.lit(0))).alias("places"))


def presence_audit(targets: DataFrame, listing: DataFrame) -> DataFrame:
    """Is each target in the listing, how often, and why not."""
    seen = listing.groupBy("item_id").agg(F.count("*").alias("times"), F.min("item_class").alias("item_class"))
    joined = targets.join(seen, "item_id", "left").withColumn("times", F.coalesce("times", F.lit(0)))
    reason = F.when(F.col("times") == 0, "NO_LOCALIZADA").when(F.col("times") > 1, "REPETIDA").otherwise("LOCALIZADA")
    return joined.withColumn("reason", reason)


# Phases and stages by which a card proves its resolution.
RESOLVED_PHASES = ("adjudicacion y nombramiento", "nombramiento")


def card_closure(cards: DataFrame, stages: DataFrame) -> DataFrame:
    """Proof on a card that its process is resolved: phase, else an appointment stage, else the best
    evidence among its stages.  ``cards``: card_id, phase, last_published; ``stages``: card_id, stage_id,
    name, published."""
    key = F.regexp_replace(T.fold("name"), r"[^a-z0-9]+", " ")
    appointed = stages.filter(F.trim(key) == "nombramiento").groupBy("card_id").agg(
        F.min_by(F.struct("name", "published"), "stage_id").alias("_appointed")
    )
    evidence = best_evidence(stages, "card_id", "name", "published", "stage_id").select("card_id", F.col("any_evidence").alias("_e"))
    joined = cards.join(appointed, "card_id", "left").join(evidence, "card_id", "left")
    by_phase = F.coalesce(F.trim(T.fold("phase")).isin(*RESOLVED_PHASES), F.lit(False))
    a, e = F.col("_appointed"), F.col("_e")
    rule = F.when(by_phase, "FASE_ADJUDICACION_NOMBRAMIENTO").when(a.isNotNull(), "ETAPA_NOMBRAMIENTO").otherwise(e["rule"])
    return joined.select(
        "card_id", rule.alias("rule"),
        F.when(by_phase | a.isNotNull(), R.FINISHED).otherwise(e["state"]).alias("state"),
        F.when(by_phase, F.col("last_published")).when(a.isNotNull(), a["published"]).otherwise(e["published"]).alias("day"),
    )
