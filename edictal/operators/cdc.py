"""Change capture, upserts and update plans.

Snapshots are never changed in place: every operator returns the next snapshot, or the actions that a
single sink step applies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions import classify as C
from edictal.functions import extract as X
from edictal.functions import text as T
from edictal.operators.windows import debounce, first_by
from edictal.session import once
from edictal.sources.tables import absent


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(T.col(c).cast("string"), F.lit(""))) == ""


def fill(c: Column | str) -> Column:
    """The value, null when it is empty."""
    return F.when(~blank(c), T.col(c))


# --- sets -------------------------------------------------------------------------------------------------

def news_union(notices: DataFrame, changes: DataFrame) -> DataFrame:
    """O1: publications and changes as one feed with aligned columns."""
    published = notices.select(
        F.col("notice_id").alias("news_id"), "process_id", F.lit("PUBLICACION").alias("news_kind"), "kind",
        F.lit(None).cast("string").alias("field"), F.col("title").alias("summary"), F.col("published").alias("detected"),
        F.lit(True).alias("significant"), "url",
    )
    changed = changes.select(
        F.col("change_id").alias("news_id"), "process_id", F.lit("CAMBIO").alias("news_kind"),
        F.lit("ACTUALIZACION").alias("kind"), "field", F.concat_ws(" -> ", "old", "new").alias("summary"), "detected",
        "significant", F.lit(None).cast("string").alias("url"),
    )
    return published.unionByName(changed)


def recipients(paying: DataFrame, exceptions: DataFrame) -> DataFrame:
    """O2: paying users and exceptions, each once."""
    return paying.unionByName(exceptions).distinct()


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """O3: rows of ``after`` whose key ``before`` lacks."""
    return absent(after, before, keys)


def unseen(found: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Found items not in the seen set, each once; the next seen set is the union of both."""
    return absent(found.dropDuplicates(keys), seen, keys)


def baseline_delta(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What to drop from and add to a stored baseline (``delta`` is REMOVE or ADD)."""
    gone = absent(old.select(*keys).distinct(), new, keys).withColumn("delta", F.lit("REMOVE"))
    added = absent(new.select(*keys).distinct(), old, keys).withColumn("delta", F.lit("ADD"))
    return gone.unionByName(added)


def worklist(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Known items, never dropped, and the newly found ones."""
    return known.unionByName(absent(found.dropDuplicates(keys), known, keys))


# --- upserts -------------------------------------------------------------------------------------------------

def insert_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows of a batch to insert: first of each key, key not stored."""
    return absent(first_by(batch, keys, order), target, keys)


def append_new(target: DataFrame, batch: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows an append-only sink adds; a second run of the same batch adds none."""
    return insert_absent(target, batch, keys, order)


def _sides(target: DataFrame, batch: DataFrame, key: str, how: str) -> DataFrame:
    """Target columns as they are, batch columns as ``new_…``, and where the key was found."""
    t = target.withColumn("_stored", F.lit(True))
    b = batch.select(key, *[F.col(c).alias(f"new_{c}") for c in batch.columns if c != key]).withColumn("_given", F.lit(True))
    return t.join(b, key, how)


def upsert_keep(target: DataFrame, batch: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Upsert in which a null never erases."""
    joined = _sides(target, batch, key, "full")
    return joined.select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in cols])


def fill_empty(target: DataFrame, batch: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Only empty fields are filled; ``filled`` tells whether anything was."""
    joined = _sides(target, batch, key, "left")
    touched = F.lit(False)
    for c in cols:
        touched = touched | (blank(c) & F.col(f"new_{c}").isNotNull())
    kept = [F.coalesce(fill(c), F.col(f"new_{c}")).alias(c) if c in cols else F.col(c) for c in target.columns]
    return joined.select(*kept, touched.alias("filled"))


def guarded_update(target: DataFrame, batch: DataFrame, key: str, guard: Column, cols: list[str]) -> DataFrame:
    """U4: update only rows for which the guard still holds."""
    joined = _sides(target, batch, key, "left")
    go = F.coalesce(F.col("_given"), F.lit(False)) & guard
    return joined.select(*[F.when(go, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in target.columns])


def apply_plan(snapshot: DataFrame, actions: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """The next snapshot version: INSERT, UPDATE and DELETE actions applied to the stored one."""
    joined = _sides(snapshot, actions, key, "full")
    write = F.col("new_action").isin("INSERT", "UPDATE")
    return joined.filter(F.coalesce(F.col("new_action") != "DELETE", F.lit(True))).select(
        key, *[F.when(F.coalesce(write, F.lit(False)), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in cols]
    )


def diff_fields(
    old: DataFrame, new: DataFrame, key: str, cols: list[str], mode: str = "all", watched=R.RELEVANT_FIELDS, keep=()
) -> DataFrame:
    """Change log rows (field, old, new, significant).

    ``all`` logs every difference; ``ignore_null`` only new values that are stated; ``keep_dates`` treats
    a null in the ``keep`` columns as the stored value.  A change of a watched field is significant when
    the old value was known.
    """
    joined = _sides(old, new, key, "inner")

    def entry(c: str) -> Column:
        before, after = F.col(c).cast("string"), F.col(f"new_{c}").cast("string")
        if mode == "keep_dates" and c in keep:
            after = F.coalesce(after, before)
        differs = ~same(before, after)
        if mode == "ignore_null":
            differs = differs & after.isNotNull()
        row = F.struct(
            F.lit(c).alias("field"), before.alias("old"), after.alias("new"),
            (before.isNotNull() & F.lit(c in watched)).alias("significant"),
        )
        return F.when(differs, row)

    return T.unfold(joined, "_e", F.array(*[entry(c) for c in cols])).select(key, "_e.*")


def silence_technical(changes: DataFrame, bulletin: bool = False) -> DataFrame:
    """Changes of capture or layout lose their significance.

    Card sources: irrelevant field, navigation values, legacy state to running.  ``bulletin`` sources: an
    unknown old value, except a new publication.
    """
    field = F.lower(F.coalesce("field", F.lit("")))
    old, new = F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    technical = (
        ~field.isin(*R.RELEVANT_FIELDS)
        | F.lower(old).isin(*R.NAVIGATION)
        | F.lower(new).isin(*R.NAVIGATION)
        | ((field == "estado") & F.upper(old).isin(*R.LEGACY_STATES) & (F.upper(new) == R.RUNNING))
    )
    if bulletin:
        technical = F.col("old").isNull() & (F.coalesce("field", F.lit("")) != "publicacion")
    return changes.withColumn("significant", F.col("significant") & ~technical)


# Fields whose change is news for the follower of a pool.
POOL_FIELDS = ("stage", "phase", "operating", "opens", "closes")


def fingerprint_plan(state: DataFrame, readings: DataFrame, key: str = "pool_id", fields=POOL_FIELDS) -> DataFrame:
    """BASELINE, NO_CHANGE, NOISE or CHANGE of each reading against the stored state.

    A changed hash alone is noise; only relevant fields are news.  ``changed`` lists them.
    """
    joined = _sides(state, readings, key, "right")
    differ = [F.when(~same(F.col(f), F.col(f"new_{f}")), F.lit(f)) for f in fields]
    changed = F.array_compact(F.array(*differ))
    first = F.col("content_hash").isNull()
    action = (
        F.when(first, "BASELINE").when(F.col("content_hash") == F.col("new_content_hash"), "NO_CHANGE")
        .when(F.size(changed) == 0, "NOISE").otherwise("CHANGE")
    )
    return joined.withColumn("action", action).select(
        key, "action", F.when(F.col("action") == "CHANGE", F.array_join(changed, ",")).alias("changed"),
        F.col("content_hash").alias("old_hash"), F.col("new_content_hash").alias("new_hash"),
    )


def needs_refresh(old: DataFrame, new: DataFrame, key: str, cols: list[str], dates: list[str]) -> DataFrame:
    """U8: does any field the source may refresh differ?  A date that is not stated is no change."""
    joined = _sides(old, new, key, "inner")
    stale = F.lit(False)
    for c in cols:
        stale = stale | ~same(F.col(c), F.col(f"new_{c}"))
    for c in dates:
        stale = stale | (F.col(f"new_{c}").isNotNull() & ~same(F.col(c), F.col(f"new_{c}")))
    return joined.select(key, stale.alias("refresh"))


def persistence_plan(new: DataFrame, existing: DataFrame, published: DataFrame, legacy: list[str]) -> DataFrame:
    """INSERT, LINK_METADATA, NO_CHANGE, REVIEW or BLOCK for every portal record.

    ``new``: stable_id, ref, is_opportunity, official_url, official_date, metadata; ``existing``:
    stable_id, process_id, metadata; ``published``: refs already stored.
    """
    stored = existing.select("stable_id", "process_id", F.col("metadata").alias("old_metadata"))
    done = published.select("ref").distinct().withColumn("_published", F.lit(True))
    joined = new.join(stored, "stable_id", "left").join(done, "ref", "left")
    valid = F.col("official_date").isNotNull() & F.coalesce(F.col("official_url").startswith("https://"), F.lit(False))
    publish = F.col("_published").isNull()
    known = F.col("process_id").isNotNull()
    refreshed = ~same(F.col("old_metadata"), F.col("metadata"))
    action = C.chain(
        (~F.col("is_opportunity"), "REVIEW"),
        (~valid, "BLOCK"),
        (known & (refreshed | publish), "LINK_METADATA"),
        (known, "NO_CHANGE"),
        (F.col("stable_id").isin(*legacy) if legacy else F.lit(False), "BLOCK"),
        default="INSERT",
    )
    return joined.withColumn("action", action).select(
        "stable_id", "ref", "process_id", "action",
        (F.col("action").isin("INSERT", "LINK_METADATA") & (publish | (F.col("action") == "INSERT"))).alias("publish"),
        ((F.col("action") == "LINK_METADATA") & refreshed).alias("update_metadata"),
    )


def may_apply(plan: DataFrame) -> DataFrame:
    """One row: a plan with any BLOCK is refused as a whole."""
    return plan.agg(F.count_if(F.col("action") == "BLOCK").alias("blocked")).withColumn("apply", F.col("blocked") == 0)


def news_fingerprint(stage: Column | str, document: Column | str, published: Column | str) -> Column:
    """What identifies the visible stage of an ad; the date only without a document."""
    document = F.coalesce(T.col(document), F.lit(""))
    day = F.when(document == "", F.coalesce(T.col(published).cast("string"), F.lit(""))).otherwise("")
    return F.concat_ws("|", day, T.stage_key(stage), document)


def ad_plan(ads: DataFrame, existing: DataFrame, cols: list[str], dates: list[str]) -> DataFrame:
    """NEW, UPDATE or NO_CHANGE of each ad; relations proved earlier are carried forward.

    Both sides: ad_id, ``cols``, ``dates``, pools (array), evidence, fingerprint; ``existing`` also category.
    """
    joined = _sides(existing, ads, "ad_id", "right")
    none_now = F.coalesce(F.size("new_pools") <= 0, F.lit(True))
    joined = joined.withColumn("eff_pools", F.when(none_now, F.coalesce("pools", F.array().cast("array<string>"))).otherwise(F.col("new_pools")))
    joined = joined.withColumn(
        "eff_evidence", F.when(none_now & F.coalesce(F.size("pools") > 0, F.lit(False)), F.col("evidence")).otherwise(F.col("new_evidence"))
    )
    differs = ~same(F.col("pools"), F.col("eff_pools")) | ~same(F.col("evidence"), F.col("eff_evidence"))
    for c in [*cols, "fingerprint"]:
        differs = differs | ~same(F.col(c), F.col(f"new_{c}"))
    for c in dates:
        differs = differs | (F.col(f"new_{c}").isNotNull() & ~same(F.col(c), F.col(f"new_{c}")))
    known = F.coalesce(F.col("_stored"), F.lit(False))
    return joined.select(
        "ad_id",
        F.when(~known, "NEW").when(differs, "UPDATE").otherwise("NO_CHANGE").alias("action"),
        (known & ~F.coalesce(F.col("category") == "ADC", F.lit(False))).alias("baseline"),
        F.array_join("eff_pools", ",").alias("pools"),
        F.col("eff_evidence").alias("evidence"),
    )


def upsert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Ad to pool edges; an earlier resolution or evidence survives a later null."""
    joined = edges.alias("e").join(new.alias("n"), ["ad_id", "ref"], "full")
    return joined.select(
        "ad_id", "ref", F.coalesce("n.pool_id", "e.pool_id").alias("pool_id"), F.coalesce("n.evidence", "e.evidence").alias("evidence")
    )


def mark_baseline(new: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The first sight of a key is a baseline and never news."""
    seen = state.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return new.join(seen, keys, "left").withColumn("is_first", F.col("_seen").isNull()).drop("_seen")


def fan_out_stage(ads: DataFrame, edges: DataFrame, published: DataFrame) -> DataFrame:
    """Stage news of an ad for each related pool, once per pool and normalised stage.

    ``ads``: ad_id, number, stage, published; ``published``: pool_id, ad_id, stage of earlier news.
    """
    key = {"_key": T.stage_key("stage")}
    told = once(published.select("pool_id", "ad_id", "stage").distinct(), ["stage"], key).select("pool_id", "ad_id", "_key")
    related = edges.filter(F.col("pool_id").isNotNull()).select("ad_id", "pool_id").distinct()
    # The oldest news of an ad and stage is the same for every pool, so it is found before the pools are met.
    fresh = once(ads.select("ad_id", "number", "stage", "published").distinct(), ["stage"], key).filter(F.col("_key") != "")
    oldest = fresh.groupBy("ad_id", "_key").agg(
        F.min(F.struct(F.col("published").isNull().alias("none"), "published", "stage", "number")).alias("_n")
    ).select("ad_id", "_key", "_n.published", "_n.stage", "_n.number")
    title = F.concat(F.lit("ADC "), F.coalesce("number", F.col("ad_id").cast("string")), F.lit(": "), F.coalesce(T.clean_stage("stage"), F.lit("novedad relacionada")))
    ref = F.concat(F.lit("ADC:"), "ad_id", F.lit(":"), T.content_hash("_key", 16), F.lit(":B"))
    news = oldest.withColumns({"title": title, "_ref": ref}).join(related, "ad_id").join(told, ["pool_id", "ad_id", "_key"], "left_anti")
    return news.select("pool_id", "ad_id", F.concat("_ref", "pool_id").alias("ref"), "title", "published")


def reassign(notices: DataFrame, links: DataFrame) -> DataFrame:
    """Stored notices move to the process they were identified with; ``moved`` marks them."""
    to = links.select("notice_id", F.col("process_id").alias("_to"))
    joined = notices.join(to, "notice_id", "left")
    moved = F.col("_to").isNotNull() & ~same(F.col("_to"), F.col("process_id"))
    return joined.withColumn("moved", moved).withColumn("process_id", F.coalesce("_to", "process_id")).drop("_to")


def patch(bag: Column | str, changes: Column, drop: tuple[str, ...] = ()) -> Column:
    """Shallow merge of a string map, the patch wins, and keys to drop."""
    old = F.coalesce(T.col(bag), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(changes, k)), changes)
    return F.map_filter(merged, lambda k, v: ~k.isin(*drop)) if drop else merged


def contains(bag: Column, part: Column) -> Column:
    """Every entry of ``part`` is in the map with the same value."""
    return F.size(F.map_filter(part, lambda k, v: ~F.try_element_at(bag, k).eqNullSafe(v))) == 0


def guarded_delete(candidates: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """U16: DELETE or BLOCKED; a process somebody follows is never deleted."""
    followed = subscriptions.filter("active").groupBy("process_id").agg(F.count("*").alias("followers"))
    joined = candidates.join(followed, "process_id", "left").withColumn("followers", F.coalesce("followers", F.lit(0)))
    return joined.withColumn("action", F.when(F.col("followers") > 0, "BLOCKED").otherwise("DELETE"))


def without(df: DataFrame, deletions: DataFrame, key: str = "process_id") -> DataFrame:
    """U16: a table, or a child table, without the deleted processes."""
    return df.join(deletions.filter(F.col("action") == "DELETE").select(key), key, "left_anti")


def fix_shift(processes: DataFrame) -> DataFrame:
    """Corrections of the shift where the name states another one."""
    target = processes.withColumn("_n", T.fold("name")).withColumn("new_shift", X.shift("_n", X.SHIFT_CORRECTION)).drop("_n")
    return target.filter(F.col("new_shift").isNotNull() & ~same(F.col("shift"), F.col("new_shift")))


def rescope(processes: DataFrame) -> DataFrame:
    """Scope of undecided processes, and of accepted ones that now classify as foreign.

    ``decided_by`` MANUAL is never overwritten.
    """
    named = processes.withColumn("_n", F.lower(T.squeeze(T.unaccent("name")))).withColumn("_auto", C.scope("_n", "_n")).drop("_n")
    promote = (F.col("scope") == "REVISION") & (F.col("_auto") != "REVISION")
    retire = (F.col("scope") == "SI") & (F.col("_auto") == "NO")
    change = (promote | retire) & ~F.coalesce(F.col("decided_by") == "MANUAL", F.lit(False))
    return named.withColumn("new_scope", F.when(change, F.col("_auto")).otherwise(F.col("scope"))).drop("_auto")


def close_pools(readings: DataFrame, pools: DataFrame) -> DataFrame:
    """Pools to close by phase, with the change row; terminal ones stay as they are."""
    closing = debounce(readings).filter("close")
    open_ = pools.filter(~C.is_terminal("state")).select("pool_id", F.col("state").alias("old_state"))
    return open_.join(closing, "pool_id").select(
        "pool_id", "old_state", F.lit(R.FINISHED).alias("new_state"),
        F.concat(F.lit("Bolsa fuera de funcionamiento: "), "phase").alias("summary"),
    )


def apply_subscriptions(subs: DataFrame, requests: DataFrame) -> DataFrame:
    """A batch of subscribe and cancel requests, the last of each user and process.

    A cancelled subscription stays as an inactive row and is reactivated by the next request.
    """
    keys = ["user_id", "process_id"]
    last = requests.groupBy(*keys).agg(F.max_by("subscribe", F.struct("requested", "request_id")).alias("_sub"), F.max("requested").alias("_at"))
    joined = subs.join(last, keys, "full")
    new = F.col("active").isNull()
    kept = joined.filter(~(new & ~F.col("_sub")))
    return kept.select(
        *keys, F.coalesce("_sub", "active").alias("active"), F.coalesce("since", "_at").alias("since"),
        F.when(F.col("_sub").isNotNull() & (F.col("_sub") | F.col("active")), F.col("_at")).otherwise(F.col("since")).alias("updated"),
    )


def replace_children(children: DataFrame, batch: DataFrame, parent: str, items: str) -> DataFrame:
    """All children of the parents in the batch are replaced, numbered from one in list order."""
    rest = children.join(batch.select(parent), parent, "left_anti")
    fresh = batch.select(parent, F.posexplode(items).alias("pos", "text")).select(parent, (F.col("pos") + 1).alias("position"), "text")
    return rest.select(parent, "position", "text").unionByName(fresh)


def review_transition(processes: DataFrame, requests: DataFrame) -> DataFrame:
    """Review state; the reviewer is stamped only by a decision, a missing note keeps the old one."""
    asked = requests.select("process_id", F.col("review_state").alias("_to"), "reviewer", "requested", F.col("note").alias("_note"))
    joined = processes.join(asked, "process_id", "left")
    decided = F.coalesce(F.col("_to").isin("PUBLICADA", "DESCARTADA"), F.lit(False))
    return (
        joined.withColumn("review_state", F.coalesce("_to", "review_state"))
        .withColumn("reviewed_at", F.when(decided, F.col("requested")).otherwise(F.col("reviewed_at")))
        .withColumn("reviewed_by", F.when(decided, F.col("reviewer")).otherwise(F.col("reviewed_by")))
        .withColumn("note", F.coalesce("_note", "note"))
        .drop("_to", "reviewer", "requested", "_note")
    )


def manual_edit(processes: DataFrame, requests: DataFrame, cols: list[str]) -> DataFrame:
    """INSERT of new manual processes and full UPDATE of manual ones; others are REJECTED."""
    joined = _sides(processes.select("process_id", "origin"), requests, "process_id", "right")
    manual = F.upper(F.coalesce("origin", F.lit(""))) == "MANUAL"
    action = F.when(F.col("_stored").isNull(), "INSERT").when(manual, "UPDATE").otherwise("REJECTED")
    return joined.select("process_id", action.alias("action"), *[F.col(f"new_{c}").alias(c) for c in cols])


def manual_scope(processes: DataFrame, requests: DataFrame) -> DataFrame:
    """A person's decision on the scope; words outside the vocabulary change nothing."""
    asked = requests.filter(F.upper("scope").isin("SI", "NO", "REVISION")).select("process_id", F.upper("scope").alias("_to"))
    joined = processes.join(asked, "process_id", "left")
    return joined.withColumn("decided_by", F.when(F.col("_to").isNotNull(), "MANUAL").otherwise(F.col("decided_by"))).withColumn(
        "scope", F.coalesce("_to", "scope")
    ).drop("_to")


def monotone_max(old: Column | str, new: Column | str) -> Column:
    """The later of two values, either may be missing."""
    return F.greatest(T.col(old), T.col(new))


def merge_by_key(old: DataFrame, new: DataFrame, parent: str, key: str, cols: list[str]) -> DataFrame:
    """Two ordered lists of records merged by key: first-seen order, the later record wins whole,
    its nulls included.  Both sides have ``parent``, ``key``, ``pos`` and ``cols``, one row per record."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1))).filter(~blank(key))
    at = F.struct("_side", "pos")
    merged = both.groupBy(parent, key).agg(F.min(at).alias("_first"), F.max_by(F.struct(*cols), at).alias("_last"))
    return merged.select(parent, key, F.struct(F.col("_first._side").alias("side"), F.col("_first.pos").alias("pos")).alias("seen"), "_last.*")
