"""Closure evidence and reversible reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions.classify import chain, closes_pools, closure_rule, is_pool_type, is_terminal, state_of_rule
from edictal.functions.text import title_key
from edictal.session import once

# Order of closing evidence: annulment, desistance, final result.
PRIORITY = {R.ANNULLED: 0, R.DESISTED: 1, R.FINISHED: 2}


def closing_notices(notices: DataFrame, title: str = "title") -> DataFrame:
    """C5 for a whole table: the rule and state of every notice that closes a process.

    The rule is computed for an ordinary process; ``closes_pools`` tells the rules that also hold for
    a pool, so notices need not meet their process to be classified.
    """
    return with_rule(notices, title).filter(F.col("rule").isNotNull())


def with_rule(notices: DataFrame, title: str = "title") -> DataFrame:
    """Every notice with its closing rule and state, null for the others.

    Aggregations read this form: a filter on the rule would be pushed below the projection and every
    regular expression would run twice.
    """
    keyed = notices.withColumn("title_key", title_key(title))
    ruled = keyed.withColumn("rule", closure_rule("title_key")).drop("title_key")
    return ruled.withColumn("closing_state", state_of_rule("rule"))


def _rank(state: Column, day: Column, tie: Column) -> Column:
    """Sort key whose greatest value is the best evidence: priority, latest date, highest id."""
    priority = chain(*[(state == name, -p) for name, p in PRIORITY.items()])
    key = F.struct(priority.alias("p"), day.isNotNull().alias("d"), day.alias("day"), tie.alias("tie"))
    return F.when(state.isNotNull(), key)


def best_evidence(
    notices: DataFrame, process: str = "process_id", title: str = "title", day: str = "published", tie: str = "notice_id"
) -> DataFrame:
    """The best closing evidence of each process, for an ordinary process and for a pool.

    One aggregation with map-side combine: a process that owns a third of all notices contributes one
    row per task to the shuffle.
    """
    closing = once(notices, [title], {"_key": title_key(title)}, {"rule": closure_rule("_key")}).withColumn("closing_state", state_of_rule("rule"))
    evidence = F.struct(
        F.col("closing_state").alias("state"), F.col("rule"), F.col(tie).alias("notice_id"),
        F.col(title).alias("title"), F.col(day).alias("published"),
    )
    rank = _rank(F.col("closing_state"), F.col(day), F.col(tie))
    return closing.groupBy(process).agg(
        F.max_by(evidence, rank).alias("any_evidence"),
        F.max_by(evidence, F.when(closes_pools("rule"), rank)).alias("pool_evidence"),
    )


def _evidence_for(process_type: str) -> Column:
    return F.when(is_pool_type(process_type), F.col("pool_evidence")).otherwise(F.col("any_evidence"))


def _candidates(processes: DataFrame, *keep: str) -> DataFrame:
    """Opportunities that may close or reopen, with no more than what decides: open ones, and those closed here."""
    terminal = is_terminal("state")
    own = F.coalesce(F.col("closure_origin") == R.OWN_CLOSURE, F.lit(False))
    return processes.filter(F.col("is_opportunity") & (~terminal | own)).select(
        "process_id", *keep, is_pool_type("process_type").alias("is_pool"), terminal.alias("closed")
    )


def reconcile(processes: DataFrame, notices: DataFrame, history: bool = False) -> DataFrame:
    """CLOSE and REOPEN actions.

    An active process closes when its notices prove it; a closure made here reopens when its evidence
    no longer holds; closures made by others are never touched.  ``history`` marks the actions not
    significant, so a first load notifies nobody.
    """
    candidates = _candidates(processes, "state")
    evidence = best_evidence(notices)
    best = F.when(F.col("is_pool"), F.col("pool_evidence")).otherwise(F.col("any_evidence"))
    joined = candidates.join(evidence, "process_id", "left").withColumn("best", best)
    action = F.when(~F.col("closed") & F.col("best").isNotNull(), "CLOSE").when(
        F.col("closed") & F.col("best").isNull(), "REOPEN"
    )
    return (
        joined.withColumn("action", action)
        .filter(F.col("action").isNotNull())
        .select(
            "process_id",
            "action",
            F.col("state").alias("old_state"),
            F.when(F.col("action") == "CLOSE", F.col("best.state")).otherwise(R.RUNNING).alias("new_state"),
            F.col("best.rule").alias("rule"),
            F.col("best.notice_id").alias("notice_id"),
            F.col("best.title").alias("title"),
            F.col("best.published").alias("published"),
            ((F.col("action") == "CLOSE") & F.lit(not history)).alias("significant"),
        )
    )


def closing_states(processes: DataFrame, notices: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The actions of ``reconcile`` without their evidence, for counting.

    The state of the best evidence is the smallest priority among the closing notices, so two integers
    per process are all that is aggregated, hashed and shuffled.
    """
    priority = chain(*[(F.col("closing_state") == name, p) for name, p in PRIORITY.items()])
    best = with_rule(notices).groupBy("process_id").agg(
        F.min(priority).alias("_any"), F.min(F.when(closes_pools("rule"), priority)).alias("_pool")
    )
    joined = _candidates(processes, *keep).join(best, "process_id", "left").withColumn("_best", F.when(F.col("is_pool"), F.col("_pool")).otherwise(F.col("_any")))
    state = chain(*[(F.col("_best") == p, name) for name, p in PRIORITY.items()], default=R.RUNNING)
    return joined.filter(F.col("closed") == F.col("_best").isNull()).select(
        "process_id", *keep, F.when(F.col("closed"), "REOPEN").otherwise("CLOSE").alias("action"), state.alias("new_state")
    )


def apply_closures(processes: DataFrame, actions: DataFrame) -> DataFrame:
    """The snapshot after a reconciliation; the guard of U4 keeps closures made meanwhile.

    A closure is stored with its evidence (closure_rule, closure_notice_id, closure_title, closure_published), which goes when it is
    taken back; a snapshot without these columns gets them.
    """
    evidence = {"closure_rule": "rule", "closure_notice_id": "notice_id", "closure_title": "title", "closure_published": "published"}
    act = actions.select("process_id", F.col("action").alias("_action"), F.col("new_state").alias("_new_state"), *[F.col(c).alias(f"_{c}") for c in evidence.values()])
    joined = processes.join(act, "process_id", "left")
    close = (F.col("_action") == "CLOSE") & ~is_terminal("state")
    reopen = F.col("_action") == "REOPEN"
    before = lambda c: F.col(c) if c in processes.columns else F.lit(None)
    return joined.withColumns({
        "closure_origin": F.when(close, R.OWN_CLOSURE).when(reopen, None).otherwise(F.col("closure_origin")),
        "state": F.when(close | reopen, F.col("_new_state")).otherwise(F.col("state")),
        **{c: F.when(close, F.col(f"_{given}")).when(reopen, None).otherwise(before(c)) for c, given in evidence.items()},
    }).select(*processes.columns, *[c for c in evidence if c not in processes.columns])


def closure_changes(actions: DataFrame) -> DataFrame:
    """The change log rows of a reconciliation."""
    summary = F.when(F.col("action") == "CLOSE", "Proceso selectivo resuelto según publicación oficial").otherwise(
        "La evidencia de cierre guardada ya no se sostiene"
    )
    return actions.select(
        "process_id", "notice_id", F.lit("ACTUALIZACION").alias("kind"), F.lit("estado").alias("field"),
        F.col("old_state").alias("old"), F.col("new_state").alias("new"), summary.alias("summary"), "significant",
    )


def first_terminal(processes: DataFrame, notices: DataFrame) -> DataFrame:
    """Newest closing notice of each running process, whatever its kind."""
    closing = with_rule(notices)
    newest = F.when(
        F.col("rule").isNotNull(), F.struct(F.col("published").isNotNull().alias("d"), F.col("published"), F.col("notice_id"))
    )
    found = F.struct("notice_id", F.col("closing_state").alias("state"))
    best = closing.groupBy("process_id").agg(
        F.max_by(found, newest).alias("any_evidence"), F.max_by(found, F.when(closes_pools("rule"), newest)).alias("pool_evidence")
    )
    running = processes.filter(~is_terminal("state")).select("process_id", F.col("state").alias("old_state"), "process_type")
    return (
        running.join(best, "process_id").withColumn("best", _evidence_for("process_type")).filter(F.col("best").isNotNull())
        .select("process_id", "old_state", F.col("best.notice_id").alias("notice_id"), F.col("best.state").alias("new_state"))
    )
