"""Jobs composed of the operators: imports, groups, syllabus, quality, the cycle (U24, U25, Q14-Q18, N8 job).

A job returns its actions; one sink step applies them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions import classify as C
from edictal.functions import extract as X
from edictal.functions import text as T
from edictal.operators import aggregate as A
from edictal.operators import calendar as D
from edictal.operators import cdc as U
from edictal.operators import lifecycle as L
from edictal.operators import match as M
from edictal.operators import windows as W
from edictal.plans import catalogue as Q
from edictal.plans import follow as Fo
from edictal.session import once, stage
from edictal.sources.feeds import code_block, line_block

# Provinces whose notices are imported.
PROVINCES = ("Valencia", "Alicante", "Castellón")


def import_calls(
    calls: DataFrame, processes: DataFrame, agencies: DataFrame, resolutions: DataFrame, stored: DataFrame,
    absorbed: DataFrame, provinces=PROVINCES,
) -> DataFrame:
    """What to do with each call of the state gazette; the first reason that holds decides.

    ``calls``: call_id, document_id, document_type, entity, province, job, places, shift, base_date,
    cited, text; ``processes``: process_id, stable_id, agency_id, name, call_date, places, scope;
    ``resolutions``: see ``match_document_event``; ``stored``: document_id and process_id of stored notices; a call that is stored
    already keeps its process, the smallest one where a document was stored for several.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    # Four lookups read the calls: they are written once with what the text rules say of them, without the texts.  Scope is the last
    # reason, so it is read only where no earlier one that the call itself states holds.
    act = yes(F.col("document_type").isin("RECTIFICACION", "ANULACION"))
    df = calls.withColumns({"_act": act, "_near": yes(F.col("province").isin(*provinces)), "_internal": C.has(T.fold("shift"), ("promocion interna",))})
    df = df.withColumn("_nj", T.fold(F.coalesce("job", F.lit("")))).withColumn("_nt", F.when(F.col("_near") & ~F.col("_act") & ~yes(F.col("_internal")), T.fold(F.concat_ws(" ", "job", "text"))))
    scope = F.when(F.col("_nt").isNotNull(), C.scope("_nt", "_nj"))
    df = stage(df.select("call_id", "document_id", "entity", "province", "places", "base_date", F.when(F.col("_act"), F.col("cited")).alias("cited"), "_act", "_near", "_internal", C.family("_nj").alias("family"), scope.alias("_scope")), "zstd")

    # What is asked of few distinct entities and days is written, so that its size is known before the calls are dealt.
    events = M.match_document_event(df.filter("_act").select("entity", "province", "cited").distinct(), resolutions)
    cited = stage(events.select(F.struct("entity", "province", "cited").alias("_asked"), F.col("match_id").alias("_event")))

    owners = stage(M.unique_match_any(
        df.select("entity", "province").distinct().withColumns(
            {"_id": F.concat_ws("|", "entity", "province"), "_p": T.fold("province"), "_alias": T.entity_variants("entity")}
        ),
        agencies.select("agency_id", T.fold("province").alias("_p"), F.array(T.fold("agency_name")).alias("_alias")),
        ["_p"], "_alias", "_id", "agency_id",
    ).select("entity", "province", F.col("match_id").alias("agency_id")))
    df = df.join(owners, ["entity", "province"], "left")

    # Calls from elsewhere, corrections and annulments are decided by what they state and cite; the others alone are moved to be looked up.
    identified = F.col("_near") & F.col("_event").isNotNull()
    told = df.filter("NOT _near OR _act").withColumn("_asked", F.when(F.col("_act"), F.struct("entity", "province", "cited"))).join(cited, "_asked", "left").select(
        "call_id", "document_id",
        C.chain((~F.col("_near"), "FUERA_ALCANCE"), (identified, "EVENTO_DOCUMENTAL_IDENTIFICADO"), default="EVENTO_DOCUMENTAL_REVISION").alias("decision"),
        F.when(identified, F.col("_event")).alias("process_id"), "agency_id",
    )
    df = df.filter("_near AND NOT _act").drop("entity", "province", "cited", "_near", "_act")

    base = processes.filter(F.col("scope") == "SI").select(
        "agency_id", F.col("call_date").alias("base_date"), C.family(T.fold("name")).alias("family"), "places", "process_id"
    )
    df = M.match_call_to_base(df, base).withColumnsRenamed({"match_id": "_base", "status": "_overlap"}).drop("base_date", "family", "places")

    marked = stored.select("document_id", F.col("process_id").alias("_kept"), F.lit(True).alias("_stored"), F.lit(False).alias("_absorbed")).unionByName(
        absorbed.select("document_id", F.lit(False).alias("_stored"), F.lit(True).alias("_absorbed")), allowMissingColumns=True
    )
    marks = marked.groupBy("document_id").agg(F.min("_kept").alias("_kept"), F.bool_or("_stored").alias("_stored"), F.bool_or("_absorbed").alias("_absorbed"))
    df = df.join(marks, "document_id", "left")
    known = processes.select(F.col("stable_id").alias("_stable"), "process_id").groupBy("_stable").agg(F.min("process_id").alias("_known"))
    df = df.join(known, F.concat(F.lit("BOELOCAL:"), "call_id") == F.col("_stable"), "left")

    decision = C.chain(
        (yes(F.col("_absorbed")), "ABSORBIDA_BOP_REVISION"),
        (F.col("_internal"), "EXCLUIDA_TURNO_INTERNO"),
        (yes(F.col("_stored")), "EXISTENTE_PUBLICACION"),
        (F.col("_known").isNotNull(), "EXISTENTE_BOE"),
        (F.col("_overlap") == "UNIQUE", "VINCULADA_BOP"),
        (F.col("_overlap") == "AMBIGUOUS", "REVISION_SOLAPAMIENTO"),
        (F.col("_scope") != "SI", "FUERA_AMBITO_ADMINISTRATIVO"),
        default="NUEVA",
    )
    out = df.withColumn("decision", decision)
    target = F.when(F.col("decision") == "EXISTENTE_BOE", F.col("_known")).when(F.col("decision") == "VINCULADA_BOP", F.col("_base")).when(
        F.col("decision") == "EXISTENTE_PUBLICACION", F.col("_kept")
    )
    return told.unionByName(out.select("call_id", "document_id", "decision", target.alias("process_id"), "agency_id"))


# What the rules say of a notice.
RULED = ("_rule", "_base", "_employment")


def read_notices(notices: DataFrame) -> DataFrame:
    """Notices with what the text rules say of them; imports of notices that were read before read no text again."""
    ruled = once(
        notices, ["title", "body"], {"_n": T.fold("title"), "_b": T.fold("body"), "_k": T.title_key("title")}, {"_rule": C.closure_rule("_k")},
        {"_base": C.is_founding("_n", "_b"), "_employment": C.is_employment("_n", "_rule")},
    )
    return ruled.drop("_n", "_b", "_k")


def import_notices(notices: DataFrame, processes: DataFrame, stored: DataFrame) -> DataFrame:
    """Bulletin import: a founding notice creates or refreshes its process, a follow-up only links,
    follow-ups without a process are reported.

    ``notices``: notice_id, stable_id, ref, source_id, url, title, body, published; ``processes``:
    process_id, stable_id, process_type; ``stored``: ref, source_id, url.
    """
    fields = ("notice_id", "stable_id", "ref", "source_id", "url", "published")
    read = notices if set(RULED) <= set(notices.columns) else read_notices(notices.select(*fields, "title", "body"))
    ruled = read.select(*fields, *RULED)
    known = processes.select("stable_id", "process_id", C.is_pool_type("process_type").alias("_pool"))
    # A missing reference, source or address is a value like any other: what was published without it is published.  As parts of one
    # value they are equal to each other, and what is stored is moved once, to be told apart and to be found.
    triple = F.struct("ref", "source_id", "url")
    done = stored.select(triple.alias("_triple")).distinct().withColumn("_done", F.lit(True))
    # The notices of a code lie together to meet its process, and there meet the first that founds it, which a notice without a code has not.
    at = F.struct(F.col("published").alias("a"), F.col("notice_id").alias("b"))
    founds = F.col("_employment") & F.col("_base") & F.col("stable_id").isNotNull()
    placed = ruled.withColumn("_f", F.min(F.when(founds, at)).over(Window.partitionBy("stable_id"))).join(known, "stable_id", "left")
    closes = F.col("_rule").isNotNull() & (~F.coalesce("_pool", F.lit(False)) | L.closes_pools("_rule"))
    exists = F.col("process_id").isNotNull()
    later = F.col("_f.b").isNotNull() & (F.col("_f") < at)
    action = C.chain(
        (~F.col("_employment"), "IGNORE"),
        (F.col("_base") & exists, "REFRESH"),
        (F.col("_base") & (F.col("_f.b") == F.col("notice_id")), "CREATE"),
        (F.col("_base"), "REFRESH"),
        ((exists | later) & closes, "CLOSE"),
        (exists | later, "LINK"),
        default="ORPHAN",
    )
    kind = F.when(F.col("_base"), "CONVOCATORIA").otherwise("BOP").alias("kind")
    acted = placed.select("notice_id", "stable_id", "process_id", action.alias("action"), kind, triple.alias("_triple"))
    return acted.join(done, "_triple", "left").select(
        "notice_id", "stable_id", "process_id", "action", (~F.col("action").isin("IGNORE", "ORPHAN") & F.col("_done").isNull()).alias("publish"), "kind"
    )


def group_pipeline(processes: DataFrame, texts: DataFrame, declared: bool = False) -> DataFrame:
    """Q16: group and subgroup of processes that lack them, from the most to the least official source:
    declared (only when enabled), subscale, document, exact name; with the origin.

    ``processes``: process_id, name, agency_name, grp, subgroup; ``texts``: process_id, call_text, document.
    """
    empty = U.blank("grp") & U.blank("subgroup")
    rows = processes.filter(empty).join(texts, "process_id", "left")
    staged = rows.withColumns({"_c": T.fold("call_text"), "_d": T.fold("document"), "_a": T.fold("agency_name")})
    named = staged.withColumns(
        {
            "_1": X.declared_class("_d")["subgroup"] if declared else F.lit(None).cast("string"),
            "_2": X.class_from_subscale("_c")["subgroup"],
            "_3": F.when(C.mentions_town("_d", "_a"), X.class_from_table("_d")),
            "_4": X.class_from_name("name")["subgroup"],
        }
    )
    origin = C.chain(
        (F.col("_1").isNotNull(), "DECLARADO"), (F.col("_2").isNotNull(), "SUBESCALA_BOE"),
        (F.col("_3.subgroup").isNotNull(), F.concat(F.lit("DOCUMENTO_BASES_"), F.col("_3.origin"))), (F.col("_4").isNotNull(), "DEDUCIDO_DEL_NOMBRE"),
    )
    found = F.coalesce("_1", "_2", "_3.subgroup", "_4")
    return named.select(
        "process_id", F.left(found, F.lit(1)).alias("grp"), found.alias("subgroup"), origin.alias("origin"),
        F.when(F.col("_1").isNull() & F.col("_2").isNull(), F.col("_3.places")).alias("places"),
    )


def clean_titles(processes: DataFrame) -> DataFrame:
    """N8 as a job: readable names and places for processes still called by their raw edict title."""
    raw = processes.filter(F.coalesce(F.col("name").rlike(T.TITLE_START), F.lit(False)))
    plan = raw.select(
        "process_id", "name", T.clean_title("name").alias("new_name"),
        F.when(F.coalesce("places", F.lit(0)) == 0, X.places("name")).alias("new_places"),
    )
    return plan.filter(F.col("new_name").isNotNull() | F.col("new_places").isNotNull())


# The code of its call in the name of a process; lines of a syllabus state codes of this form only.
NAMED_CALL = r"(?i)\bConvocatoria\s+(\d+\s*/\s*\d+)\b"


def syllabus(documents: DataFrame, k: int | None = None) -> DataFrame:
    """Q15: the syllabus of each process: the best-ranked readable document with a block, and its topics.  In a document the block of the
    process's own call comes before the general one.

    ``documents``: process_id, name (of the process), notice_id, kind, title, url, published, text.  Unreadable documents take no
    rank; ``k`` may limit the readable ones that are looked at.
    """
    # A repair neither loses characters nor finds lost ones, so the text says as it is whether it is readable.
    usable = documents.filter(T.readable("text"))
    ranked = W.scored_sources(usable) if k is None else W.rank_sources(usable, k)
    # Documents of a process with one text have one block: the best of them stands for all, and the text is read once.
    at = F.struct("score", "published", "notice_id")
    texts = ranked.groupBy("process_id", "name", "text").agg(F.max(at).alias("_best")).withColumn("_text", T.repair_glyphs("text")).drop("text")
    keys = ["process_id", "_best"]
    coded = code_block(texts.withColumn("_call", F.regexp_replace(X.found(F.col("name"), NAMED_CALL), r"\s+", "")), [*keys, "_text"], "_text", "_call")
    blocks = line_block(coded.withColumnRenamed("block", "_own"), [*keys, "_own"], "_text").withColumn("block", F.coalesce("_own", "block"))
    best = blocks.groupBy("process_id").agg(F.max_by(F.struct("_best.notice_id", "block"), F.when(F.col("block").isNotNull(), F.col("_best"))).alias("b"))
    return best.filter(F.col("b").isNotNull()).select("process_id", F.col("b.notice_id").alias("notice_id"), F.col("b.block").alias("block"))


def topics(blocks: DataFrame) -> DataFrame:
    """Q15: the lines of a syllabus after its heading, in order."""
    numbered = F.transform(F.split(T.norm_lines("block"), "\n"), lambda x, i: F.struct(i.alias("position"), x.alias("text")))
    lines = T.unfold(blocks, "_l", numbered).select("process_id", "_l.*")
    return lines.filter(F.col("position") > 0)


def quality(processes: DataFrame, notices: DataFrame, sources: DataFrame, agencies: DataFrame, changes: DataFrame) -> DataFrame:
    """Q14: violations of the stored rules: words outside a vocabulary, orphans, repeated keys."""
    def row(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.lit(name).alias("rule"), F.count("*").alias("bad"))

    scope = processes.filter(~F.coalesce(F.col("scope").isin("SI", "NO", "REVISION"), F.lit(False)))
    kinds = sources.filter(~F.coalesce(F.col("source_kind").isin("BOP", "BOE", "DOGV"), F.lit(False)))
    repeated = notices.groupBy("source_id", "ref", "url").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    checks = [
        row("scope_vocabulary", scope), row("source_vocabulary", kinds), row("notice_key_repeated", repeated),
        row("notice_without_process", M.keep_not_in(notices, processes, ["process_id"])),
        row("notice_without_source", M.keep_not_in(notices, sources, ["source_id"])),
        row("process_without_agency", M.keep_not_in(processes, agencies, ["agency_id"])),
        row("process_without_notice", M.keep_not_in(processes, notices, ["process_id"])),
        row("change_without_process", M.keep_not_in(changes, processes, ["process_id"])),
        row("term_reversed", processes.filter(F.col("opens") > F.col("closes"))),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def with_columns_for(processes: DataFrame, *names: str) -> DataFrame:
    """The table with the named text columns, empty where it has none of its own."""
    return processes.withColumns({c: F.lit(None).cast("string") for c in names if c not in processes.columns})


def apply_groups(processes: DataFrame, groups: DataFrame) -> DataFrame:
    """The snapshot after ``group_pipeline``: only processes without group and subgroup get them, with the origin (class_origin),
    and places only where none are stored.  Of several texts of a process the most official one decides."""
    rank = C.chain((F.col("origin") == "DECLARADO", 1), (F.col("origin") == "SUBESCALA_BOE", 2), (F.col("origin").startswith("DOCUMENTO"), 3), default=4)
    found = groups.filter(F.col("subgroup").isNotNull()).groupBy("process_id").agg(
        F.min(F.struct(rank.alias("rank"), "subgroup", "grp", "origin", "places")).alias("_g")
    )
    df = with_columns_for(processes, "grp", "subgroup", "class_origin")
    go = F.col("_g").isNotNull() & U.blank("grp") & U.blank("subgroup")
    lacking = go & (F.coalesce("places", F.lit(0)) == 0)
    return df.join(found, "process_id", "left").withColumns({
        "places": F.when(lacking, F.coalesce("_g.places", "places")).otherwise(F.col("places")), "class_origin": F.when(go, F.col("_g.origin")).otherwise(F.col("class_origin")),
        "grp": F.when(go, F.col("_g.grp")).otherwise(F.col("grp")), "subgroup": F.when(go, F.col("_g.subgroup")).otherwise(F.col("subgroup")),
    }).select(*df.columns)


def apply_titles(processes: DataFrame, titles: DataFrame) -> DataFrame:
    """The snapshot after ``clean_titles``: the readable name, the raw one as original_name, and places where none are stored."""
    df = with_columns_for(processes, "original_name")
    plan = titles.select("process_id", F.col("name").alias("_raw"), "new_name", "new_places")
    # The guard of U4: a name that was changed meanwhile is kept.
    go = F.col("new_name").isNotNull() & (F.col("name") == F.col("_raw"))
    lacking = F.coalesce("places", F.lit(0)) == 0
    return df.join(plan, "process_id", "left").withColumns({
        "original_name": F.when(go, F.col("_raw")).otherwise(F.col("original_name")), "places": F.when(lacking, F.coalesce("new_places", "places")).otherwise(F.col("places")),
        "name": F.when(go, F.col("new_name")).otherwise(F.col("name")),
    }).select(*df.columns)


def run_cycle(tables: dict[str, DataFrame], cal: DataFrame, as_of: Column, history: bool = False, since: Column | None = None) -> dict[str, DataFrame]:
    """Q17: one cycle after the imports: deadlines, groups, titles, closures last, then the difference of
    what is visible and whom it concerns.  ``history`` closes without any notification.

    ``tables``: processes, agencies, notices, sources, texts, events; processes may state the term of an ad (term_state).  With
    bulletins (see ``own_term``) a term may come from the only one of a process.  With
    recipients (user_id, entitled) there are outbox rows, one per event and audience, and the members of the audiences; with
    subscriptions, entitled and changes there are follow-ups of the news after ``since``, the closures of this cycle among them.
    Returns the actions of every step, the next snapshot and the new events; the caller writes them.
    """
    processes, notices = tables["processes"], tables["notices"]
    if "subscriptions" in tables and since is None:
        raise ValueError("follow-ups need the day of the last cycle")
    visible = lambda p: Q.catalogue(p, tables["agencies"], notices, tables["sources"], as_of)
    # Every step after reads the terms and the dated processes: they are worked out once.
    deadlines = stage(D.deadline_plan(processes.filter(~C.is_terminal("state") & F.col("is_opportunity") & (F.col("scope") == "SI")), cal, tables.get("bulletins")))
    fills = deadlines.filter(F.col("action") == "FILL").select("process_id", F.col("term_opens").alias("opens"), F.col("term_closes").alias("closes"))
    dated = stage(with_columns_for(U.fill_empty(processes, fills, "process_id", ["opens", "closes"]).drop("filled"), "grp", "subgroup"))
    groups = stage(group_pipeline(dated.join(tables["agencies"].select("agency_id", "agency_name"), "agency_id", "left"), tables["texts"]))
    graded = apply_groups(dated, groups)
    titles = stage(clean_titles(graded))
    named = stage(apply_titles(graded, titles))
    closures = stage(L.reconcile(named, notices, history))
    after = stage(L.apply_closures(named, closures))
    answered = C.actionable("opens", "closes", "term_state", as_of)["actionable"]
    fresh = Fo.new_opportunities(visible(processes), visible(with_columns_for(after, "term_state")).withColumn("actionable", answered), tables["events"])
    out = {
        "deadlines": deadlines, "groups": groups, "titles": titles, "closures": closures, "snapshot": after,
        "events": fresh.limit(0) if history else fresh,
    }
    if "recipients" in tables:
        addressed, out["members"] = M.fan_out(out["events"], tables["recipients"])
        out["outbox"] = addressed.select("process_id", "kind", "audience", F.lit("PENDIENTE").alias("state"), as_of.alias("created"))
    if "subscriptions" in tables:
        fields = ("change_id", "process_id", "field", "old", "new", "significant", "detected")
        closed = L.closure_changes(closures).withColumns({"change_id": F.concat_ws("-", F.lit("CIERRE"), "process_id", as_of), "detected": as_of})
        changes = tables["changes"].select(*fields).unionByName(closed.select(*fields))
        follow_ups = Fo.new_news(notices, changes, after, tables["subscriptions"], tables["entitled"], since)
        out["follow_ups"] = follow_ups.limit(0) if history else follow_ups
    return out


def cycle_summary(steps: dict[str, DataFrame]) -> DataFrame:
    """Q17: counts per step and action, as the ledger stores them."""
    parts = [
        A.counts(steps["deadlines"], "action").withColumn("step", F.lit("deadlines")),
        A.counts(steps["groups"].withColumn("action", F.coalesce("origin", F.lit("SIN_CLASIFICAR"))), "action").withColumn("step", F.lit("groups")),
        A.counts(steps["titles"].withColumn("action", F.lit("CLEAN")), "action").withColumn("step", F.lit("titles")),
        A.counts(steps["closures"], "action").withColumn("step", F.lit("closures")),
        A.counts(steps["events"].withColumn("action", F.col("kind")), "action").withColumn("step", F.lit("events")),
    ]
    if "outbox" in steps:
        parts.append(A.counts(steps["outbox"].withColumn("action", F.col("audience")), "action").withColumn("step", F.lit("outbox")))
    if "follow_ups" in steps:
        parts.append(A.counts(steps["follow_ups"].withColumn("action", F.lit("TELL")), "action").withColumn("step", F.lit("follow_ups")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("step", "action", "n")


def cycle_ledger(steps: dict[str, DataFrame], as_of: Column) -> DataFrame:
    """Q17: a ledger row of every step of a cycle, also of those that found nothing to do."""
    names = [n for n in ("deadlines", "groups", "titles", "closures", "events", "outbox", "follow_ups") if n in steps]
    done = cycle_summary(steps).groupBy("step").agg(F.sum("n").alias("n"))
    every = done.sparkSession.createDataFrame([(n,) for n in names], "step string")
    n = F.coalesce("n", F.lit(0))
    return every.join(done, "step", "left").select("step", F.when(n > 0, "OK").otherwise("SIN_NOVEDADES").alias("state"), n.alias("n"), as_of.alias("until"))


def review_cycle(calls: DataFrame, notices: DataFrame, processes: DataFrame, agencies: DataFrame, resolutions: DataFrame, stored: DataFrame, provinces=PROVINCES) -> DataFrame:
    """Q18: extraordinary review in plan mode: bulletins first, then the state gazette, counted per decision."""
    # Either half is counted and written by itself, so that what the first one moved is gone when the second begins.
    bulletins = stage(A.counts(import_notices(notices, processes, stored).withColumn("decision", F.col("action")), "decision").withColumn("source", F.lit("BOP")))
    none = stored.select(F.lit("").alias("document_id"), F.lit(None).cast("long").alias("process_id")).limit(0)
    gazette = stage(A.counts(import_calls(calls, processes, agencies, resolutions, none, none, provinces), "decision").withColumn("source", F.lit("BOE")))
    return bulletins.unionByName(gazette).select("source", "decision", "n")
