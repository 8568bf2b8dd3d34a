"""Entity resolution (J1-J23): linked only when unique, otherwise none or ambiguous.

No operator here emits all pairs of a block.  "Exactly one candidate" needs only the smallest and the
largest identifier of a block, so candidates are reduced per key before they meet the rows to match;
a block that holds a third of all rows is one row by then.  Where rows can reach a candidate by several
keys, both sides list their keys and the extremes of the keys are combined.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions import classify as C
from edictal.functions import extract as X
from edictal.functions import text as T
from edictal.operators.windows import top_by
from edictal.session import stage


def status(low: Column, high: Column) -> Column:
    return F.when(low.isNull(), "NONE").when(low == high, "UNIQUE").otherwise("AMBIGUOUS")


def _settle(df: DataFrame) -> DataFrame:
    out = df.withColumn("status", status(F.col("_low"), F.col("_high")))
    return out.withColumn("match_id", F.when(F.col("status") == "UNIQUE", F.col("_low"))).drop("_low", "_high")


def enrich(fact: DataFrame, dim: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Attributes of a dimension; Spark broadcasts it when its size allows, AQE decides."""
    return fact.join(dim, key, how)


def unique_match(probe: DataFrame, build: DataFrame, keys: list[str], build_id: str) -> DataFrame:
    """Candidates that share all ``keys``: ``n``, ``match_id`` when there is exactly one, ``status``."""
    blocks = build.groupBy(*keys).agg(
        F.min(build_id).alias("_low"), F.max(build_id).alias("_high"), F.count("*").alias("n")
    )
    return _settle(probe.join(blocks, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))))


def unique_match_any(probe: DataFrame, build: DataFrame, keys: list[str], alias: str, probe_id: str, build_id: str) -> DataFrame:
    """J2 where both sides carry an array ``alias`` of alternative keys, all of them tried."""
    blocks = (
        T.unfold(build, "_alias", alias).select(*keys, "_alias", build_id)
        .groupBy(*keys, "_alias").agg(F.min(build_id).alias("_l"), F.max(build_id).alias("_h"))
    )
    exploded = T.unfold(probe, "_alias", alias).select(probe_id, *keys, "_alias")
    hits = exploded.join(blocks, [*keys, "_alias"]).groupBy(probe_id).agg(F.min("_l").alias("_low"), F.max("_h").alias("_high"))
    return _settle(probe.join(hits, probe_id, "left"))


def resolve_source(refs: DataFrame, sources: DataFrame, by_agency: bool = False) -> DataFrame:
    """Source by functional identity among the active ones; anything but one is an error row."""
    extra = ["agency_id"] if by_agency else []

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("_name", F.lower(F.trim("source_name"))).withColumn("_kind", F.upper("source_kind"))

    build = keyed(sources.filter("active")).select("_name", "_kind", *extra, "source_id")
    found = unique_match(keyed(refs), build, ["_name", "_kind", *extra], "source_id").drop("_name", "_kind")
    return found.withColumn("error", F.when(F.col("n") == 0, "no encontrada").when(F.col("n") > 1, "ambigua"))


def identity(c: Column | str) -> Column:
    return T.fold(T.squeeze(c))


def resolve_agency(refs: DataFrame, agencies: DataFrame, towns: DataFrame, ref_id: str = "ref_id") -> DataFrame:
    """Agency by kind, province and town; for town halls two spellings of one official municipality
    are the same.  ``towns`` has ine, province and the array ``aliases``."""
    alias = towns.select("province", F.explode("aliases").alias("_key"), "ine").distinct()

    def keyed(df: DataFrame, key: str) -> DataFrame:
        base = df.select(key, F.upper("agency_kind").alias("_kind"), identity("province").alias("_province"), "province", "town")
        direct = base.select(key, "_kind", "_province", F.concat(F.lit("T:"), identity("town")).alias("_alias"))
        spelled = T.unfold(base.filter(F.col("_kind") == "AYUNTAMIENTO"), "_key", T.name_keys("town"))
        official = spelled.join(alias, ["province", "_key"]).select(
            key, "_kind", "_province", F.concat(F.lit("I:"), "ine").alias("_alias")
        )
        return direct.unionByName(official).filter(F.col("_alias").isNotNull()).distinct()

    blocks = keyed(agencies.filter("active"), "agency_id").groupBy("_kind", "_province", "_alias").agg(
        F.min("agency_id").alias("_l"), F.max("agency_id").alias("_h")
    )
    hits = keyed(refs, ref_id).join(blocks, ["_kind", "_province", "_alias"]).groupBy(ref_id).agg(
        F.min("_l").alias("_low"), F.max("_h").alias("_high")
    )
    return _settle(refs.join(hits, ref_id, "left"))


def match_call_to_base(calls: DataFrame, processes: DataFrame) -> DataFrame:
    """Founding notice of a call: same agency, base date and family, equal places or either unknown.

    A block of agency, date and family is one row by the time a call meets it: the extremes of all its processes, of those that state no
    places, and of those of every number of places.  So a call is moved once and has no second row for its alternatives.
    """
    keys = ["agency_id", "base_date", "family"]
    pair = F.struct(F.min("process_id").alias("l"), F.max("process_id").alias("h"))
    numbers = processes.filter(F.col("family").isNotNull()).groupBy(*keys, "places").agg(pair.alias("_x"))
    blocks = numbers.groupBy(*keys).agg(
        F.min("_x.l").alias("_all_l"), F.max("_x.h").alias("_all_h"), F.max(F.when(F.col("places").isNull(), F.col("_x"))).alias("_none"),
        F.map_from_entries(F.collect_list(F.when(F.col("places").isNotNull(), F.struct(F.col("places").cast("string").alias("key"), F.col("_x").alias("value"))))).alias("_by"),
    )
    own, none, unknown = F.try_element_at("_by", F.col("places").cast("string")), F.col("_none"), F.col("places").isNull()
    joined = calls.join(blocks, keys, "left").withColumns({
        "_low": F.when(unknown, F.col("_all_l")).otherwise(F.least(own["l"], none["l"])),
        "_high": F.when(unknown, F.col("_all_h")).otherwise(F.greatest(own["h"], none["h"])),
    })
    return _settle(joined).select(*calls.columns, "status", "match_id")


def recover_calls(processes: DataFrame, calls: DataFrame, as_of: Column, max_days: int = 180) -> DataFrame:
    """Gazette documents that announce the processes which lack one: NONE, UNIQUE or AGGREGATE.

    Calls are summed per document and then per key, so each process meets at most one row per entity form.
    The oldest admissible document depends on the base date only, which is part of the key.
    """
    since = F.greatest(F.col("base_date"), F.date_sub(as_of, max_days - 1))
    keys = ["province", "base_date", "_entity", "family"]
    # Calls of a document are summed under the entity as it is written, and few sums take its forms.
    written = calls.filter(F.col("family").isNotNull() & F.col("published").between(since, as_of)).groupBy(
        "province", "base_date", "entity", "family", "document_id"
    ).agg(F.sum("places").alias("places"))
    forms = T.unfold(written.select("entity").distinct(), "_entity", T.entity_variants("entity"))
    documents = written.join(stage(forms), "entity").groupBy(*keys, "document_id").agg(F.sum("places").alias("places"))
    blocks = documents.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("document_id").alias("document_id"),
        F.sum(F.coalesce("places", F.lit(0))).alias("call_places"), F.min("places").alias("_one"),
    )
    probe = processes.withColumn("_entity", T.fold("agency_name"))
    joined = probe.join(blocks, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    differs = F.coalesce(F.col("_one") != F.col("places"), F.lit(False))
    state = F.when(F.col("n") == 0, "NONE").when((F.col("n") > 1) | differs, "AGGREGATE").otherwise("UNIQUE")
    return joined.withColumn("status", state).withColumn(
        "complete", (F.col("n") == 1) & F.coalesce((F.col("places") > 0) & (F.col("_one") == F.col("places")), F.lit(False))
    ).withColumn("document_id", F.when(F.col("status") == "UNIQUE", F.col("document_id"))).drop("_entity", "_one")


def match_follow_up(notices: DataFrame, processes: DataFrame) -> DataFrame:
    """Running process a follow-up notice belongs to, with the reason.

    ``notices``: notice_id, title, town, published; ``processes``: process_id, name, town (``a/b``),
    state, call_date.  Same town and family, called no later than the notice; by file code when the
    notice states one, else only if it is the one candidate.  Of each key the two earliest calls are
    enough to know whether none, one or several precede a date.
    """
    probe = notices.withColumn("_n", T.fold("title")).withColumn("_family", C.family("_n", R.FAMILIES_TITLE)).withColumn(
        "_code", X.file_code("_n")
    ).withColumn("_clear", C.is_continuity("_n")).withColumn("_town", F.trim(T.fold("town"))).drop("_n")
    running = processes.filter((F.col("state") == R.RUNNING) & F.col("call_date").isNotNull()).withColumn("_n", T.fold("name")).select(
        "process_id", "call_date", C.family("_n", R.FAMILIES_TITLE).alias("_family"), X.file_code("_n").alias("_code"), "town"
    )
    build = T.unfold(running, "_town", T.alias_set("town")).filter(F.col("_family").isNotNull())
    order = [F.col("call_date"), F.col("process_id")]

    def earliest(keys: list[str], rows: DataFrame, name: str) -> DataFrame:
        two = top_by(rows, keys, order, 2)
        return two.groupBy(*keys).agg(
            F.min("call_date").alias(f"{name}_1"),
            F.max(F.when(F.col("rank") == 2, F.col("call_date"))).alias(f"{name}_2"),
            F.min_by("process_id", "rank").alias(f"{name}_id"),
        )

    by_name = earliest(["_town", "_family"], build, "any")
    by_code = earliest(["_town", "_family", "_code"], build.filter(F.col("_code").isNotNull()), "code")
    joined = probe.join(by_name, ["_town", "_family"], "left").join(by_code, ["_town", "_family", "_code"], "left")

    def seen(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_1") <= F.col("published"), F.lit(False)).cast("int") + F.coalesce(
            F.col(f"{name}_2") <= F.col("published"), F.lit(False)
        ).cast("int")

    any_, code = seen("any"), seen("code")
    coded = F.col("_code").isNotNull()
    reason = C.chain(
        (F.col("_family").isNull(), "SIN_FAMILIA"),
        (~F.col("_clear"), "NO_ES_CONTINUIDAD_SELECTIVA"),
        (any_ == 0, "SIN_COINCIDENCIA"),
        (coded & (code == 1), "CODIGO_EXACTO"),
        (coded & (code > 1), "CODIGO_AMBIGUO"),
        (coded, "CODIGO_SIN_COINCIDENCIA"),
        (any_ == 1, "UNICO_HITO_SELECTIVO"),
        default="AMBIGUO_SIN_CODIGO",
    )
    out = joined.withColumn("reason", reason)
    linked = F.when(F.col("reason") == "CODIGO_EXACTO", F.col("code_id")).when(
        F.col("reason") == "UNICO_HITO_SELECTIVO", F.col("any_id")
    )
    return out.withColumn("match_id", linked).select(*notices.columns, "reason", "match_id")


def _word_set(n: str, stop, alias=None) -> Column:
    return F.array_sort(T.tokens(n, 4, stop, alias))


# Postings of a block's word that one task is meant to hold; a word with more is dealt over several.
POSTINGS = 4096


def best_overlap(asked: DataFrame, offered: DataFrame, block: list[str], extra: bool) -> DataFrame:
    """For every word set asked of a block, the offered sets that share most words with it, by a prefix-filtered inverted index.

    ``asked``: the block and _words, distinct; ``offered``: the block, _set, and the extremes _l and _h of the rows that have the set.
    Of sets that share equally many, with ``extra`` those with the fewest other words are better.  The result has the block, _words,
    _score (common, extra; common is 1 at least) and the extremes _l and _h of the best; no row where nothing is shared.

    Words of a set are taken rarest first, by their count in the block.  A set that shares c of s words has one of the first s - c + 1: so
    the rarest word alone finds all sets that share all, and what it finds bounds how many words more have to be looked up.  A set of one
    word needs no pairs, only the head of the word's list.  Without ``extra``, a word that all sets of a block have tells none of
    them apart and is left out: who shares nothing else ties with all.
    """
    postings = offered.withColumn("_w", F.explode("_set"))
    score = lambda common, size: F.struct(common.alias("common"), (common - size if extra else F.lit(0)).alias("extra"))
    heads = postings.groupBy(*block, "_w", score(F.lit(1), F.size("_set")).alias("_score")).agg(F.count("*").alias("_n"), F.min("_l").alias("_l"), F.max("_h").alias("_h"))
    words = heads.groupBy(*block, "_w").agg(F.sum("_n").alias("_df"), F.max(F.struct("_score", "_l", "_h")).alias("_head"))
    if not extra:
        words = words.join(offered.groupBy(*block).agg(F.count("*").alias("_sets")), block).filter(F.col("_df") < F.col("_sets")).drop("_sets")
    words = stage(words)
    parts = lambda df: F.greatest(F.ceil(F.col(df) / POSTINGS), F.lit(1)).cast("int")
    hot = words.filter(F.col("_df") > POSTINGS).select(*block, "_w", parts("_df").alias("_parts"))
    dealt = postings.join(hot, [*block, "_w"], "left").withColumn("_part", F.pmod(F.xxhash64("_set"), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")

    known = F.sort_array(F.collect_list(F.struct("_df", "_w", "_head")))
    seen = stage(asked.withColumn("_w", F.explode("_words")).join(words, [*block, "_w"]).groupBy(*block, "_words").agg(known.alias("_seen")))
    key = [*block, "_words"]
    one = seen.filter(F.size("_seen") == 1).select(*key, F.col("_seen")[0]["_head"].alias("_b"))

    def found(probe: DataFrame) -> DataFrame:
        """The best of what shares one of ``_looked`` words."""
        looked = probe.withColumn("_x", F.explode("_looked")).select(*key, "_x._w", parts("_x._df").alias("_parts")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        common = F.size(F.array_intersect("_words", "_set"))
        pairs = looked.join(dealt, [*block, "_w", "_part"]).withColumn("_score", score(common, F.size("_set")))
        level = pairs.groupBy(*key, "_score").agg(F.min("_l").alias("_l"), F.max("_h").alias("_h"))
        return level.groupBy(*key).agg(F.max(F.struct("_score", "_l", "_h")).alias("_b"))

    several = seen.filter(F.size("_seen") > 1)
    first = stage(found(several.withColumn("_looked", F.slice("_seen", 1, 1))))
    # With c shared so far, another c can hide behind the rarest word only in the s - c after it.
    more = F.size("_seen") - F.coalesce(F.col("_b._score.common"), F.lit(1))
    rest = several.join(first, key, "left").withColumn("_looked", F.slice("_seen", F.lit(2), more)).filter(F.size("_looked") > 0)
    second = found(rest.select(*key, "_looked"))
    return best_of(one.unionByName(first).unionByName(second), key)


def best_of(found: DataFrame, key: list[str]) -> DataFrame:
    """Of several findings (_b: score, extremes) of a key the best, with the extremes of all that are as good."""
    level = found.select(*key, "_b.*").groupBy(*key, "_score").agg(F.min("_l").alias("_l"), F.max("_h").alias("_h"))
    return level.groupBy(*key).agg(F.max(F.struct("_score", "_l", "_h")).alias("_b")).select(*key, "_b.*")


def gazette_candidates(processes: DataFrame, province: str, origin: str = "BOELOCAL:") -> DataFrame:
    """Processes a follow-up notice of a province may belong to: opportunities of administrative scope that came from the state
    gazette, as their stable id says.

    ``processes``: stable_id, is_opportunity, scope, province.
    """
    return processes.filter(F.col("stable_id").startswith(origin) & F.col("is_opportunity") & (F.col("scope") == "SI") & (F.coalesce("province", F.lit("")) == province))


def match_by_content(notices: DataFrame, processes: DataFrame) -> DataFrame:
    """Gazette process of the same town by shift, else the only one, else the best word overlap.

    ``notices``: notice_id, title, town; ``processes``: process_id, name, town, agency_name, shift (``gazette_candidates`` of them).  Rows
    with the same town, shift and words are interchangeable, so words are compared once per distinct set, in ``best_overlap``.
    """
    # What is decided depends on title and town alone, so each pair is decided once and the notices meet the decision.
    n = notices.select("title", "town").distinct().withColumn("_n", T.fold("title")).withColumn("_town", F.trim(T.fold("town")))
    need = F.when(C.has("_n", C.RESERVE), "RESERVE").when(
        C.matches("_n", r"\b(?:turno|torn)\s+(?:libre|lliure)\b"), "OPEN"
    ).otherwise("ANY")
    probe = stage(n.withColumn("_need", need).withColumn("_words", _word_set("_n", R.STOPWORDS_FOLLOW_UP)).drop("_n"))

    p = processes.withColumn("_s", T.fold(F.coalesce("shift", F.lit("")))).withColumn("_p", T.fold("name"))
    gives = F.when(C.has("_s", C.RESERVE), "RESERVE").when(C.has("_s", ("libre", "lliure")), "OPEN").otherwise("OTHER")
    bare = F.replace(F.replace(T.fold("agency_name"), F.lit("ayuntamiento de "), F.lit("")), F.lit("ajuntament de "), F.lit(""))
    forms = F.array_distinct(F.array_compact(F.array(F.trim(T.fold("town")), F.trim(bare))))
    # Which needs a candidate answers: any, and its own shift.
    offers = stage(
        T.unfold(p.select(forms.alias("_forms"), gives.alias("_gives"), _word_set("_p", R.STOPWORDS_FOLLOW_UP).alias("_set"), "process_id"), "_town", "_forms")
        .withColumn("_need", F.explode(F.array(F.lit("ANY"), F.col("_gives"))))
        .groupBy("_town", "_need", "_set").agg(F.min("process_id").alias("_l"), F.max("process_id").alias("_h"))
    )
    pool = stage(offers.groupBy("_town", "_need").agg(F.min("_l").alias("_low"), F.max("_h").alias("_high")))
    any_pool = pool.filter(F.col("_need") == "ANY").select("_town", F.lit(True).alias("_known"))

    # Words decide only where several candidates are left.
    open_ = pool.filter(F.col("_low") != F.col("_high")).select("_town", "_need")
    asked = probe.select("_town", "_need", "_words").distinct().join(open_, ["_town", "_need"])
    best = best_overlap(asked, offers.join(open_, ["_town", "_need"]), ["_town", "_need"], extra=False)
    joined = (
        probe.join(any_pool, "_town", "left").join(pool, ["_town", "_need"], "left").join(best, ["_town", "_need", "_words"], "left")
    )
    stated = F.col("_need") != "ANY"
    one = F.col("_low") == F.col("_high")
    reason = C.chain(
        (F.col("_known").isNull(), "SIN_PROCESO_MUNICIPIO"),
        (stated & F.col("_low").isNull(), "TURNO_INCOMPATIBLE"),
        (stated & one, "MUNICIPIO_TURNO"),
        (one, "MUNICIPIO_UNICO"),
        (F.coalesce(F.col("_l") == F.col("_h"), F.lit(False)), "MUNICIPIO_DENOMINACION"),
        default="AMBIGUO",
    )
    out = joined.withColumn("reason", reason)
    linked = F.when(F.col("reason").isin("MUNICIPIO_TURNO", "MUNICIPIO_UNICO"), F.col("_low")).when(
        F.col("reason") == "MUNICIPIO_DENOMINACION", F.col("_l")
    )
    decided = stage(out.select(F.col("title").alias("_title"), F.col("town").alias("_town"), "reason", linked.alias("match_id")))
    same = F.col("title").eqNullSafe(F.col("_title")) & F.col("town").eqNullSafe(F.col("_town"))
    return notices.join(decided, same, "left").select(*notices.columns, "reason", "match_id")


# Kinds of body that do not tell one entity from another.
ENTITY_WORDS = ("ayuntamiento", "ajuntament", "mancomunidad", "mancomunitat")


def best_notice(processes: DataFrame, notices: DataFrame) -> DataFrame:
    """The founding notice of a process among those of its base date, or none on a tie.

    ``processes``: process_id, name, town, base_date; ``notices``: notice_id, title, published.  A notice
    belongs to the entity if its issuer is the town or its title has all the words of the town.  New calls
    are preferred; then the more common and the fewer extra words.

    A notice is listed under keys: its issuer, and every town whose words it has, found by the one that the fewest towns have.  Whether
    a process has none, one or several is told by the extremes of its two keys and its day, which never meet its name; only where several
    are left are names compared, in ``best_overlap``.
    """
    entity = F.trim(T.fold("town"))
    p = (
        processes.filter(F.col("base_date").isNotNull() & F.col("town").isNotNull())
        .select(
            "process_id", F.col("base_date").alias("_day"), entity.alias("_entity"), F.coalesce(_word_set(T.fold("name"), R.STOPWORDS_BASES, R.TOKEN_ALIAS), F.array().cast("array<string>")).alias("_words"),
        )
    )
    p = stage(p)
    towns = p.select("_entity").distinct().withColumn("_ewords", F.array_sort(T.tokens("_entity", 3, ENTITY_WORDS, R.TOKEN_ALIAS)))
    worded = towns.withColumn("_key", F.concat(F.lit("W "), F.concat_ws(" ", "_ewords"))).filter(F.size("_ewords") > 0)
    keys = stage(towns.select("_entity", F.concat(F.lit("I "), "_entity").alias("_key")).unionByName(worded.select("_entity", "_key")))
    # Counted over the towns, not over the facts.
    spread = worded.select("_key", "_ewords").distinct().withColumn("_w", F.explode("_ewords"))
    rarest = spread.join(spread.groupBy("_w").agg(F.count("*").alias("_towns")), "_w").groupBy("_key", "_ewords").agg(F.min(F.struct("_towns", "_w")).alias("_r"))
    # Written, so that its size is known before the notices are dealt: few towns are broadcast, many are not.
    probes = stage(rarest.select(F.concat(F.lit("W "), "_r._w").alias("_probe"), "_key", "_ewords").unionByName(
        towns.select(F.concat(F.lit("I "), "_entity").alias("_probe"), F.concat(F.lit("I "), "_entity").alias("_key"), F.array().cast("array<string>").alias("_ewords"))
    ))
    # Words are cut once; rules that read whole titles run only on days that are asked for and on notices that are listed.
    asked_for = notices.select("notice_id", "title", F.col("published").alias("_day")).join(stage(p.select("_day").distinct()), "_day", "left_semi")
    words = asked_for.select("title").distinct().withColumn("_n", T.fold("title"))
    words = words.withColumn("_raw", F.regexp_extract_all("_n", F.lit("[a-z0-9]{3,}"), F.lit(0)))
    n = words.select("title", "_n", "_raw", F.concat(F.lit("I "), T.issuer_town("title")).alias("_town"), T.canonical("_raw", (), R.TOKEN_ALIAS).alias("_twords"))
    listed = F.array_compact(F.array_append(F.transform("_twords", lambda w: F.concat(F.lit("W "), w)), F.col("_town")))
    held = T.unfold(n, "_probe", listed).join(probes, "_probe").filter(F.size(F.array_except("_ewords", "_twords")) == 0).select("title", "_key", "_n", "_raw")
    longer = F.filter("_raw", lambda w: F.length(w) >= 4)
    # Titles are listed, not notices: each notice meets the few keys of its title.
    judged = held.select("title", "_key", (C.notice_class("_n") == "NUEVA_CONVOCATORIA").alias("_new"), F.array_sort(T.canonical(longer, R.STOPWORDS_BASES, R.TOKEN_ALIAS)).alias("_set"))
    offered = stage(asked_for.join(stage(judged), "title").groupBy("_day", "_key", "_new", "_set").agg(F.min("notice_id").alias("_l"), F.max("notice_id").alias("_h")))

    limits = offered.groupBy("_day", "_key", "_new").agg(F.min("_l").alias("_l"), F.max("_h").alias("_h"))
    where = p.select("_day", "_entity").distinct().join(keys, "_entity")
    kinds = where.join(limits, ["_day", "_key"]).groupBy("_day", "_entity", "_new").agg(F.min("_l").alias("_low"), F.max("_h").alias("_high"))
    chosen = stage(kinds.groupBy("_day", "_entity").agg(F.max(F.struct("_new", "_low", "_high")).alias("_c")).select("_day", "_entity", "_c.*"))

    block = ["_day", "_key", "_new"]
    several = chosen.filter(F.col("_low") != F.col("_high")).select("_day", "_entity", "_new")
    asked = stage(p.select("_day", "_entity", "_words").distinct().join(several, ["_day", "_entity"]).join(keys, "_entity"))
    compared = offered.join(several.join(keys, "_entity").select(*block).distinct(), block)
    best = best_overlap(asked.select(*block, "_words").distinct(), compared, block, extra=True)
    found = asked.join(best, [*block, "_words"]).select("_day", "_entity", "_words", F.struct("_score", "_l", "_h").alias("_b"))
    best = best_of(found, ["_day", "_entity", "_words"])

    out = p.join(chosen, ["_day", "_entity"], "left").join(best, ["_day", "_entity", "_words"], "left")
    match = F.when(F.col("_low") == F.col("_high"), F.col("_low")).when(F.col("_l") == F.col("_h"), F.col("_l"))
    return out.select("process_id", F.when(F.col("_low").isNull(), "NONE").when(match.isNull(), "AMBIGUOUS").otherwise("UNIQUE").alias("status"), match.alias("match_id"))


def match_document_event(events: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Process a correction or annulment refers to, by the resolution it cites.

    ``events``: document_id, entity, province, cited; ``resolutions``: process_id, agency_name, province,
    resolved — one row per gazette notice of a process.  Entities of one document are decided apart: one that has a
    process says nothing of another.
    """
    # Of the resolutions of an agency and day only the extremes count; they are found before any name is folded.
    ends = F.array_distinct(F.array(F.min("process_id"), F.max("process_id"))).alias("_ids")
    known = T.unfold(resolutions.filter(F.col("resolved").isNotNull()).groupBy("resolved", "province", "agency_name").agg(ends), "process_id", "_ids")
    build = known.select(F.col("resolved").alias("_day"), T.fold("province").alias("_province"), F.array(T.fold("agency_name")).alias("_alias"), "process_id")
    # The document plays no part in the lookup, so its entity, province and date are asked once.
    asked = ["entity", "province", "cited"]
    probe = events.select(*asked).distinct().withColumn("_day", F.col("cited")).withColumn("_province", T.fold("province")).withColumn(
        "_alias", T.entity_variants("entity")
    )
    found = unique_match_any(probe.withColumn("_probe", F.struct("entity", "province", "cited")), build, ["_day", "_province"], "_alias", "_probe", "process_id")
    # Written, so that its size is known before the events are dealt.
    found = stage(found.select(*[F.col(c).alias(f"_{c}") for c in asked], "status", "match_id"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in asked])
    return events.join(found, same, "left").select(*events.columns, "status", "match_id")


def _kind(tokens: str, kinds: tuple[str, ...]) -> Column:
    return F.filter(F.col(tokens), lambda t: F.split_part(t, F.lit(":"), F.lit(1)).isin(*kinds))


# Identifiers of a kind in one name that are counted by inclusion and exclusion: so many make 2 ** n - 1 terms.
TERMS = 2
SPECIFIC, CODES = ("CONVOCATORIA", "ORDEN", "BOLSA"), ("CODIGO",)


def _subsets(tokens: Column) -> Column:
    """One token, or two in their order, of a sorted array."""
    pairs = F.flatten(F.transform(tokens, lambda x, i: F.transform(F.slice(tokens, i + 2, F.size(tokens)), lambda y: F.array(x, y))))
    return F.concat(F.transform(tokens, lambda x: F.array(x)), pairs)


def _terms(specific: Column, codes: Column) -> Column:
    """Every combination of tokens as one key with the sign it is counted with."""
    sign = lambda s: F.when(F.size(s) == 2, -1).otherwise(1)
    term = lambda k, c: F.struct(F.concat(F.array_join(k, " "), F.lit(" / "), F.array_join(c, " ")).alias("key"), (sign(k) * sign(c)).alias("sign"))
    return F.flatten(F.transform(specific, lambda k: F.transform(codes, lambda c: term(k, c))))


def match_identity(processes: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of each process by shared identity: a specific token, and a body code when the
    process has any; the result is one row per process with the number of documents and the first and last of them.

    Documents are counted by every combination of a token or two and of none, one or two codes; the documents of a process are then a
    signed sum over its own combinations (inclusion and exclusion), so a token that a third of all documents state meets a
    process as one row.  Only a name with more than ``TERMS`` tokens of a kind is compared with the documents' token sets.
    """
    none = F.array(F.array().cast("array<string>"))
    p = processes.withColumn("_t", T.identity_tokens("name"))
    # Filters stand behind the written tables: pushed below, they would read every name once more.
    asked = stage(p.select("_t").distinct()).withColumns({"_s": _kind("_t", SPECIFIC), "_codes": _kind("_t", CODES)}).filter(F.size("_s") > 0)
    wanted = stage(asked.select(F.explode("_t").alias("_k")).distinct())
    # Distinct token sets of the documents, then without the tokens that no process states.
    d = documents.withColumn("_dt", T.identity_tokens("title")).groupBy("_dt").agg(
        F.count("*").alias("n"), F.min("notice_id").alias("first_id"), F.max("notice_id").alias("last_id")
    )
    kept = T.unfold(d, "_k", "_dt").join(wanted, "_k").groupBy("_dt").agg(F.sort_array(F.collect_set("_k")).alias("_d"), F.first("n").alias("n"), F.first("first_id").alias("first_id"), F.first("last_id").alias("last_id"))
    totals = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))
    sets = stage(totals(kept, "_d")).withColumns({"_ds": _kind("_d", SPECIFIC), "_dc": _kind("_d", CODES)}).filter(F.size("_ds") > 0)

    few = (F.size("_s") <= TERMS) & (F.size("_codes") <= TERMS)
    listed = T.unfold(sets, "_x", _terms(_subsets(F.col("_ds")), F.concat(none, _subsets(F.col("_dc")))))
    counted = totals(listed.withColumn("key", F.col("_x.key")), "key")
    signed = T.unfold(asked.filter(few), "_x", _terms(_subsets(F.col("_s")), F.when(F.size("_codes") == 0, none).otherwise(_subsets(F.col("_codes")))))
    by_terms = totals(signed.select("_t", "_x.*").join(counted, "key").withColumn("n", F.col("n") * F.col("sign")), "_t")

    many = T.unfold(asked.filter(~few), "_k", "_s").join(T.unfold(sets, "_k", "_ds"), "_k").filter((F.size("_codes") == 0) | F.arrays_overlap("_codes", "_dc"))
    by_sets = totals(many.select("_t", "_d", "n", "first_id", "last_id").distinct(), "_t")

    return p.select("process_id", "_t").join(by_terms.unionByName(by_sets), "_t", "left").select(
        "process_id", F.coalesce("n", F.lit(0)).alias("n"), "first_id", "last_id"
    )


def match_signature(records: DataFrame, pages: DataFrame, unread: Column | None = None) -> DataFrame:
    """The page whose source contains the signature of a record, if it is the only one and every
    page could be read.  Pages list the signatures they contain, each with its leading parts, because
    containment is a substring test; the records meet one row per signature."""
    digits = F.transform(
        F.regexp_extract_all(F.col("html"), F.lit(r"\d{4}_\d+"), F.lit(0)),
        lambda s: F.transform(F.sequence(F.lit(6), F.length(s)), lambda k: F.left(s, k)),
    )
    listed = T.unfold(pages, "signature", F.array_distinct(F.flatten(digits))).select("page_id", "signature")
    found = unique_match(records, listed, ["signature"], "page_id")
    return found if unread is None else found.withColumn("match_id", F.when(~unread, F.col("match_id")))


POOL_IN_TITLE = r"(?i)(?<![0-9])(\d{2,4}-[BL])(?![0-9])"
YEAR_POOL_IN_TITLE = r"(?i)(?<![0-9A-Za-z])B-(\d{2,4}/\d{2,4})(?![0-9])"


def resolve_pool_refs(refs: DataFrame, pools: DataFrame) -> DataFrame:
    """Pool a reference names: ``NNN``, ``NNN-B`` or ``NNN/YY``, only if one title states it.

    ``refs``: ad_id, ref; ``pools``: pool_id, title.  Titles are read once into the references they state.
    """
    full = F.transform(F.regexp_extract_all("title", F.lit(POOL_IN_TITLE), F.lit(1)), F.upper)
    numbers = F.transform(full, lambda r: F.split_part(r, F.lit("-"), F.lit(1)))
    years = F.regexp_extract_all("title", F.lit(YEAR_POOL_IN_TITLE), F.lit(1))
    stated = T.unfold(pools, "_key", F.array_distinct(F.flatten(F.array(full, numbers, years)))).select("pool_id", "_key")
    ref = F.trim(F.replace(F.upper("ref"), F.lit(" "), F.lit("")))
    key = F.when(F.contains(ref, F.lit("/")), ref).when(
        ref.rlike(r"^\d{2,4}(?:-?[BL])?$"), F.regexp_replace(ref, r"^(\d+)-?([BL])$", "$1-$2")
    )
    return unique_match(refs.withColumn("_key", key), stated, ["_key"], "pool_id").drop("_key")


def match_any_id(new: DataFrame, existing: DataFrame, new_keys: dict[str, str], existing_keys: dict[str, str]) -> DataFrame:
    """Stored record that shares any identifier; more than one is a conflict.

    The dicts map an identifier space to the column that holds it on each side.
    """
    def keys(columns: dict[str, str]) -> Column:
        listed = [F.when(F.col(c).isNotNull(), F.concat(F.lit(space + ":"), F.col(c).cast("string"))) for space, c in columns.items()]
        return F.array_distinct(F.array_compact(F.array(*listed)))

    probe = new.withColumn("_alias", keys(new_keys)).withColumn("_one", F.lit(1))
    build = existing.withColumn("_alias", keys(existing_keys)).withColumn("_one", F.lit(1))
    found = unique_match_any(probe, build, ["_one"], "_alias", "new_id", "process_id").drop("_alias", "_one")
    return found.withColumn("status", F.when(F.col("status") == "AMBIGUOUS", "CONFLICT").otherwise(F.col("status")))


def keep_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Semi join."""
    return df.join(other, keys, "left_semi")


def keep_not_in(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Anti join."""
    return df.join(other, keys, "left_anti")


def activity(notices: DataFrame, sources: DataFrame) -> DataFrame:
    """What the correlated subqueries of the catalogue ask, in one aggregation per process."""
    from edictal.operators.windows import best_url_agg

    kinds = sources.select("source_id", "source_kind")
    joined = notices.join(kinds, "source_id", "left")
    founding = (F.col("source_kind") == "BOP") & F.upper("kind").isin("BASES", "CONVOCATORIA", "BOP") & F.contains(F.lower("title"), F.lit("bases"))
    return joined.groupBy("process_id").agg(
        F.max("published").alias("last_notice"),
        F.max(F.when(F.col("source_kind") == "BOE", F.col("published"))).alias("last_gazette"),
        F.min(F.when(founding, F.col("published"))).alias("first_base"),
        best_url_agg().alias("best_url"),
    )


def with_activity(processes: DataFrame, notices: DataFrame, sources: DataFrame) -> DataFrame:
    """Processes with their activity; the notices are reduced before the join."""
    return processes.join(activity(notices, sources), "process_id", "left")


def news_counts(news: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """News of each followed process newer than the subscription.

    A follower needs to know that there is news, how much and how recent, so news is counted per process
    and day first; a subscription then meets one row whose array has no more entries than days.
    """
    daily = news.groupBy("process_id", "detected").agg(F.count("*").alias("n"))
    days = daily.groupBy("process_id").agg(F.collect_list(F.struct("detected", "n")).alias("_days"))
    newer = F.filter("_days", lambda d: d["detected"] > F.col("since"))
    joined = subscriptions.filter("active").join(days, "process_id").withColumn("_new", newer).filter(F.size("_new") > 0)
    return joined.select(
        "user_id", "process_id", "since",
        F.aggregate("_new", F.lit(0).cast("long"), lambda a, d: a + d["n"]).alias("n_news"),
        F.array_max(F.transform("_new", lambda d: d["detected"])).alias("newest"),
    )


def fan_out(events: DataFrame, recipients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Who is told of which event, without multiplying the two.

    Recipients differ only in whether they may see the restricted category, so an event is addressed to
    one or both audiences and a recipient belongs to one; together they say exactly what the product of
    events and recipients would.
    """
    addressed = events.withColumn(
        "audience", F.explode(F.when(F.col("private"), F.array(F.lit("FULL"))).otherwise(F.array(F.lit("FULL"), F.lit("GENERAL"))))
    )
    members = recipients.withColumn("audience", F.when(F.col("entitled"), "FULL").otherwise("GENERAL"))
    return addressed, members


def split_collisions(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Same code but another known family: the identifier gets the hash of the family as a suffix."""
    rules = R.FAMILIES_COLLISION
    known = existing.withColumn("_n", T.fold("name")).select("stable_id", C.family("_n", rules).alias("_old"))
    fresh = new.withColumn("_n", T.fold("name")).withColumn("_new", C.family("_n", rules)).drop("_n")
    clash = F.col("_old") != F.col("_new")
    suffix = F.concat_ws(":", "stable_id", T.content_hash("_new", 8))
    return fresh.join(known, "stable_id", "left").withColumn(
        "final_id", F.when(F.coalesce(clash, F.lit(False)), suffix).otherwise(F.col("stable_id"))
    ).drop("_old", "_new")


def nearest_date(refs: DataFrame, documents: DataFrame, days: int = 5) -> DataFrame:
    """Document with the code on the date or the nearest within ``days``, earlier before later; more
    than one on that date is not unique.  Documents are reduced per code and date, then offered to the
    neighbouring dates, so a reference looks up one row."""
    dated = documents.groupBy("code", "day").agg(F.count("*").alias("n"), F.min("document_id").alias("document_id"))
    offset = F.explode(F.sequence(F.lit(-days), F.lit(days)))
    offered = dated.withColumn("_o", offset).withColumn("_target", F.date_sub("day", F.col("_o")))
    best = offered.groupBy("code", "_target").agg(
        F.min_by(F.struct("n", "document_id", "day"), F.struct(F.abs("_o"), "_o")).alias("_b")
    )
    joined = refs.join(best.withColumnRenamed("_target", "day"), ["code", "day"], "left")
    b = F.col("_b")
    state = F.when(b.isNull(), "NONE").when(b["n"] > 1, "NOT_UNIQUE").when(b["day"] == F.col("day"), "EXACT").otherwise("NEAR")
    return joined.withColumn("status", state).withColumn("match_id", F.when(b["n"] == 1, b["document_id"])).drop("_b")


# References of the state portal that are stored under an older identifier.
LEGACY_IDS = {219621: "GVA:110135", 219862: "GVA:110206", 220197: "GVA:110235", 220291: "GVA:110202"}


def canonical_id(ref: Column | str, legacy: dict = LEGACY_IDS, prefix: str = "GVAESTATAL") -> Column:
    """Stored identifier of a portal reference."""
    ref = T.col(ref)
    old = F.try_element_at(F.create_map(*[F.lit(x) for pair in legacy.items() for x in pair]), ref.cast("int"))
    return F.coalesce(old, F.concat(F.lit(prefix + ":"), ref.cast("string")))
