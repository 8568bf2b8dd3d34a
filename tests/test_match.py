from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from edictal.functions import text as T
from edictal.operators import match as M


def test_unique_or_nothing(spark):
    build = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "k string, id int")
    probe = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    got = {r.k: (r.n, r.match_id, r.status) for r in M.unique_match(probe, build, ["k"], "id").collect()}
    assert got == {"a": (1, 1, "UNIQUE"), "b": (2, None, "AMBIGUOUS"), "c": (0, None, "NONE"), None: (0, None, "NONE")}


def test_several_keys_to_one_candidate_stay_unique(spark):
    build = spark.createDataFrame([(1, ["x", "y"]), (2, ["z"])], "id int, alias array<string>")
    probe = spark.createDataFrame([(10, ["x", "y"]), (11, ["y", "z"]), (12, ["w"])], "pid int, alias array<string>")
    one = lambda df: df.withColumn("one", F.lit(1))
    got = {r.pid: (r.match_id, r.status) for r in M.unique_match_any(one(probe), one(build).withColumnRenamed("id", "bid"), ["one"], "alias", "pid", "bid").collect()}
    assert got == {10: (1, "UNIQUE"), 11: (None, "AMBIGUOUS"), 12: (None, "NONE")}


def test_a_hot_block_is_one_row_before_the_join(spark):
    build = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    probe = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("p"))
    out = M.unique_match(probe, build, ["k"], "id")
    got = {r.status: r["count"] for r in out.groupBy("status").count().collect()}
    assert got == {"AMBIGUOUS": 6667, "UNIQUE": 13333}


def test_call_places_equal_or_unknown(spark):
    day = dt.date(2026, 1, 1)
    p = spark.createDataFrame([(1, 7, day, "F", 3), (2, 7, day, "F", 5), (3, 8, day, "F", None)], "process_id int, agency_id int, base_date date, family string, places int")
    calls = spark.createDataFrame(
        [("a", 7, day, "F", 3), ("b", 7, day, "F", None), ("c", 7, day, "F", 9), ("d", 8, day, "F", 4), ("e", 8, day, None, 4)],
        "call_id string, agency_id int, base_date date, family string, places int",
    )
    got = {r.call_id: (r.match_id, r.status) for r in M.match_call_to_base(calls, p).collect()}
    assert got == {"a": (1, "UNIQUE"), "b": (None, "AMBIGUOUS"), "c": (None, "NONE"), "d": (3, "UNIQUE"), "e": (None, "NONE")}


def test_follow_up_against_brute_force(spark):
    random.seed(5)
    towns, jobs = ("Alfa", "Beta/Betta"), ("administrativo", "auxiliar administrativo", "expediente 12/2024 administrativo")
    base = dt.date(2024, 1, 1)
    processes = [(i, random.choice(jobs), random.choice(towns), random.choice(("EN_CURSO", "FINALIZADO")), base + dt.timedelta(days=random.randrange(90))) for i in range(14)]
    notices = [
        (f"n{i}", f"Relación definitiva de admitidos {random.choice(jobs)}", random.choice(("alfa", "beta", "betta", "gamma")), base + dt.timedelta(days=random.randrange(100)))
        for i in range(60)
    ]
    p = spark.createDataFrame(processes, "process_id int, name string, town string, state string, call_date date")
    n = spark.createDataFrame(notices, "notice_id string, title string, town string, published date")
    got = {r.notice_id: (r.reason, r.match_id) for r in M.match_follow_up(n, p).collect()}
    for nid, title, town, day in notices:
        family = "aux" if "auxiliar" in title else "adm"
        same = [x for x in processes if x[3] == "EN_CURSO" and town in x[2].lower().split("/") and ("aux" if "auxiliar" in x[1] else "adm") == family and x[4] <= day]
        coded = [x for x in same if "12/2024" in x[1]]
        if not same:
            want = ("SIN_COINCIDENCIA", None)
        elif "12/2024" in title:
            want = ("CODIGO_EXACTO", coded[0][0]) if len(coded) == 1 else (("CODIGO_AMBIGUO" if coded else "CODIGO_SIN_COINCIDENCIA"), None)
        else:
            want = ("UNICO_HITO_SELECTIVO", same[0][0]) if len(same) == 1 else ("AMBIGUO_SIN_CODIGO", None)
        assert got[nid] == want


def test_pool_references(spark):
    pools = spark.createDataFrame([(1, "Bolsa 444-B C1-01"), (2, "Bolsa 444-L"), (3, "Bolsa específica (B-500/22)"), (4, "Bolsa 1444-B")], "pool_id int, title string")
    refs = spark.createDataFrame([(9, r) for r in ("444", "444B", "444-l", "500/22", "501/22", "1444", "x")], "ad_id int, ref string")
    got = {r.ref: r.match_id for r in M.resolve_pool_refs(refs, pools).collect()}
    assert got == {"444": None, "444B": 1, "444-l": 2, "500/22": 3, "501/22": None, "1444": 4, "x": None}


def test_signature_is_contained_in_one_page(spark):
    pages = spark.createDataFrame([(1, "x /pdf/2026_123_es.pdf"), (2, "y 2026_99"), (3, "z 2026_99")], "page_id int, html string")
    records = spark.createDataFrame([("2026_123",), ("2026_12",), ("2026_99",), ("2025_1",)], "signature string")
    got = {r.signature: r.status for r in M.match_signature(records, pages).collect()}
    assert got == {"2026_123": "UNIQUE", "2026_12": "UNIQUE", "2026_99": "AMBIGUOUS", "2025_1": "NONE"}


def test_nearest_date(spark):
    d = lambda k: dt.date(2026, 5, k)
    docs = spark.createDataFrame([("c", d(10), "a"), ("c", d(13), "b"), ("c", d(20), "e"), ("c", d(20), "f")], "code string, day date, document_id string")
    refs = spark.createDataFrame([("c", d(10)), ("c", d(12)), ("c", d(20)), ("c", d(28))], "code string, day date")
    got = {r.day.day: (r.status, r.match_id) for r in M.nearest_date(refs, docs).collect()}
    assert got == {10: ("EXACT", "a"), 12: ("NEAR", "b"), 20: ("NOT_UNIQUE", None), 28: ("NONE", None)}


def test_entity_variants(spark):
    df = spark.createDataFrame([("Ayuntamiento de Benicàssim/Benicasim (Castellón)",), (None,)], "t string")
    got = [sorted(r[0]) if r[0] else None for r in df.select(T.entity_variants("t")).collect()]
    assert got == [["ayuntamiento de benicasim", "ayuntamiento de benicassim", "ayuntamiento de benicassim/benicasim"], None]


def test_news_counts_without_pairs(spark):
    d = lambda k: dt.date(2026, 1, k)
    news = spark.createDataFrame([(1, d(2)), (1, d(3)), (1, d(3)), (2, d(9))], "process_id int, detected date")
    subs = spark.createDataFrame([("u", 1, True, d(2)), ("v", 1, True, d(1)), ("w", 1, False, d(1)), ("x", 2, True, d(9))], "user_id string, process_id int, active boolean, since date")
    got = {r.user_id: (r.n_news, r.newest) for r in M.news_counts(news, subs).collect()}
    assert got == {"u": (2, d(3)), "v": (3, d(3))}


def best_of_pairs(asked, offered, extra):
    """Every asked set against every offered one of its block."""
    out = {}
    for block, words in asked:
        scored = [((len(set(words) & set(s)), len(set(words) & set(s)) - len(s) if extra else 0), low, high) for b, s, low, high in offered if b == block]
        scored = [x for x in scored if x[0][0] > 0]
        if scored:
            best = max(x[0] for x in scored)
            out[block, tuple(words)] = (best, min(x[1] for x in scored if x[0] == best), max(x[2] for x in scored if x[0] == best))
    return out


def test_best_overlap_against_all_pairs(spark, monkeypatch):
    """Also where the lists of words are dealt over several parts."""
    monkeypatch.setattr(M, "POSTINGS", 3)
    rng = random.Random(8)
    letters = "abcdefghij"
    some = lambda most: sorted({rng.choice(letters) if rng.random() < 0.7 else "a" for _ in range(rng.randint(0, most))})
    asked = {(rng.choice("xyz"), tuple(some(6))) for _ in range(120)}
    sets = {(rng.choice("xy"), tuple(some(7))) for _ in range(60)}
    offered = [(b, list(s), k % 17, k % 17 + rng.randint(0, 1)) for k, (b, s) in enumerate(sorted(sets))]
    a = spark.createDataFrame([(b, list(w)) for b, w in asked], "b string, _words array<string>")
    o = spark.createDataFrame(offered, "b string, _set array<string>, _l int, _h int")
    got = {(r.b, tuple(r._words)): (tuple(r._score), r._l, r._h) for r in M.best_overlap(a, o, ["b"], extra=True).collect()}
    assert got == best_of_pairs(asked, offered, True)
    got = {(r.b, tuple(r._words)): (r._l, r._h) for r in M.best_overlap(a, o, ["b"], extra=False).collect()}
    want = {k: v[1:] for k, v in best_of_pairs(asked, offered, False).items()}
    # Who shares only words that all sets of a block have ties with all of them, and may be left out.
    for key in want.keys() - got.keys():
        mine = [o for o in offered if o[0] == key[0]]
        assert want[key] == (min(o[2] for o in mine), max(o[3] for o in mine))
        assert set(key[1]) & set.union(*(set(o[1]) for o in mine)) <= set.intersection(*(set(o[1]) for o in mine))
    assert got == {k: want[k] for k in got}


def test_best_notice_by_issuer_and_by_words(spark):
    """Notices of the town's own hall, whose titles name another town or none, beside notices that name it."""
    rng = random.Random(9)
    day = lambda k: dt.date(2026, 3, 1 + k)
    towns, jobs = ("Alfa", "Beta del Mar", "Gamma"), ("administrativo", "auxiliar administrativo", "técnico de gestión", "ingeniero industrial")
    processes = [(i, rng.choice((*jobs, None)), rng.choice((*towns, "Delta", None)), rng.choice((day(0), day(1), None))) for i in range(60)]
    heads = ("Bases de la convocatoria", "Aprobación de las bases de la convocatoria", "Resultado final")
    notices = []
    for i in range(40):
        issuer = f"Anuncio del Ayuntamiento de {rng.choice(towns)} sobre " if rng.random() < 0.5 else ""
        named = f" en {rng.choice(towns)}" if rng.random() < 0.6 else ""
        notices.append((f"n{i:02}", f"{issuer}{rng.choice(heads)} de una plaza de {rng.choice(jobs)}{named}.", day(rng.randint(0, 2))))
    p = spark.createDataFrame(processes, "process_id int, name string, town string, base_date date")
    n = spark.createDataFrame(notices, "notice_id string, title string, published date")
    told = n.withColumn("_n", T.fold("title")).select(
        "notice_id", "published", T.issuer_town("title").alias("town"), (M.C.notice_class("_n") == "NUEVA_CONVOCATORIA").alias("new"),
        T.tokens("_n", 3, (), M.R.TOKEN_ALIAS).alias("t"), M._word_set("_n", M.R.STOPWORDS_BASES, M.R.TOKEN_ALIAS).alias("w"),
    ).collect()
    asked = p.withColumn("e", F.trim(T.fold("town"))).select(
        "process_id", "base_date", "e", T.tokens("e", 3, M.ENTITY_WORDS, M.R.TOKEN_ALIAS).alias("t"), M._word_set(T.fold("name"), M.R.STOPWORDS_BASES, M.R.TOKEN_ALIAS).alias("w")
    ).collect()
    got = {r.process_id: (r.status, r.match_id) for r in M.best_notice(p, n).collect()}
    want = {}
    for a in asked:
        if a.base_date is None or a.e is None:
            continue
        mine = [x for x in told if x.published == a.base_date and (x.town == a.e or (a.t and set(a.t) <= set(x.t)))]
        mine = [x for x in mine if x.new] or mine
        score = lambda x: (len(set(a.w or ()) & set(x.w)), -len(set(x.w) - set(a.w or ())))  # noqa: E731, B023
        best = [x for x in mine if score(x) == max(map(score, mine))]
        if not mine:
            want[a.process_id] = ("NONE", None)
        elif len(mine) == 1:
            want[a.process_id] = ("UNIQUE", mine[0].notice_id)
        else:
            want[a.process_id] = ("UNIQUE", best[0].notice_id) if len(best) == 1 and score(best[0])[0] > 0 else ("AMBIGUOUS", None)
    assert got == want and len({s for s, _ in want.values()}) == 3


def test_identity_against_all_pairs(spark):
    """Names with up to five identifiers of a kind, of which those with more than two go by sets."""
    rng = random.Random(10)

    def title(most):
        parts = [f"convocatoria {k}/2024" for k in range(1, 6)] + ["orden 3/2024", "bolsa 444B"]
        codes = ["A1-01", "A2-02", "B1-03", "C1-01-02", "C2-05"]
        return " ".join(rng.sample(parts, rng.randint(0, most)) + rng.sample(codes, rng.randint(0, most)))

    processes, documents = [(i, title(rng.choice((1, 2, 2, 4)))) for i in range(80)], [(f"n{i:03}", title(5)) for i in range(150)]
    p, d = spark.createDataFrame(processes, "process_id int, name string"), spark.createDataFrame(documents, "notice_id string, title string")
    tokens = lambda df, key, c: {r[0]: set(r[1]) for r in df.select(key, T.identity_tokens(c)).collect()}
    mine, theirs = tokens(p, "process_id", "name"), tokens(d, "notice_id", "title")
    kind = lambda t, codes: {x for x in t if x.startswith("CODIGO") == codes}
    want = {}
    for i, t in mine.items():
        hits = sorted(k for k, u in theirs.items() if kind(t, False) & u and (not kind(t, True) or kind(t, True) & u))
        want[i] = (len(hits), hits[0] if hits else None, hits[-1] if hits else None)
    got = {r.process_id: (r.n, r.first_id, r.last_id) for r in M.match_identity(p, d).collect()}
    assert got == want and any(len(kind(t, False)) > 2 or len(kind(t, True)) > 2 for t in mine.values())


def test_gazette_candidates(spark):
    rows = [("BOELOCAL:1", True, "SI", "Valencia"), ("DOGV:2", True, "SI", "Valencia"), ("BOELOCAL:3", False, "SI", "Valencia"), ("BOELOCAL:4", True, "NO", "Valencia"), ("BOELOCAL:5", True, "SI", None), ("BOELOCAL:6", True, None, "Valencia"), (None, True, "SI", "Valencia")]
    df = spark.createDataFrame(rows, "stable_id string, is_opportunity boolean, scope string, province string")
    assert [r.stable_id for r in M.gazette_candidates(df, "Valencia").collect()] == ["BOELOCAL:1"]


def test_a_call_meets_its_block_once(spark):
    """Alternatives of a call (its own places, none stated) are extremes of one row, not rows of their own."""
    from tests.plans import joined_rows

    day = dt.date(2024, 5, 2)
    calls = spark.createDataFrame([(f"c{i}", 1, day, "ADM", 3) for i in range(100)] + [("u", 1, day, "ADM", None), ("x", 1, day, None, 3)], "call_id string, agency_id int, base_date date, family string, places int")
    p = spark.createDataFrame([(10, 1, day, "ADM", 3), (10, 1, day, "ADM", None), (11, 1, day, "ADM", 4)], "process_id int, agency_id int, base_date date, family string, places int")
    out = M.match_call_to_base(calls, p)
    got = {r.call_id: (r.match_id, r.status) for r in out.collect()}
    assert got["c0"] == (10, "UNIQUE") and got["u"] == (None, "AMBIGUOUS") and got["x"] == (None, "NONE")
    assert joined_rows(out) <= 102
