from __future__ import annotations

from edictal import rules as R
from edictal.functions import classify as C
from edictal.functions import extract as X
from oracles.lifecycle import EVENTS
from oracles.text import html, sub
from oracles.views import case, fold, hit, key, lst, q, sql, squeeze

NT = f", f AS (SELECT *, {fold('title')} AS nt FROM notices)"
NN = f", g AS (SELECT *, lower({squeeze('strip_accents(name)')}) AS nn FROM processes)"


def has(x: str, words) -> str:
    return "coalesce(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ", false)"


def any_(x: str, patterns) -> str:
    return hit(x, "|".join(f"(?:{p})" for p in patterns))


def scope(text: str, job: str, codes: bool = False) -> str:
    rules = []
    if codes:
        found = f"regexp_extract_all({text}, {q(R.BODY_CODE)})"
        rules.append((f"len({found}) > 0", f"CASE WHEN list_has_any({found}, {lst(R.GENERAL_CODES)}) THEN 'SI' ELSE 'NO' END"))
    return case(*rules, (any_(text, R.OUT_OF_SCOPE), "'NO'"), (any_(job, R.OUT_OF_SCOPE_JOB), "'NO'"), (any_(text, R.IN_SCOPE), "'SI'"), default="'REVISION'")


def notice_class(n: str, extended=True, provincial=False) -> str:
    late = f"({has(n, R.PROVINCIAL_NEW)} AND NOT {has(n, R.PROVINCIAL_BLOCK)})" if provincial else "false"
    rules = [(has(n, R.INTERNAL_EXTENDED), "'EXCLUIDO_INTERNO'")] if extended else []
    rules += [
        (has(n, R.INTERNAL), "'EXCLUIDO_INTERNO'"),
        (f"{has(n, R.INTERNAL_PROMOTION)} AND NOT {has(n, R.OPEN_SHIFT)}", "'EXCLUIDO_INTERNO'"),
        (f"{has(n, R.NOISE)} AND NOT {has(n, R.NOISE_UNLESS)}", "'RUIDO'"),
        (has(n, R.TEMPORARY_POOL), "'BOLSA_TEMPORAL'"),
        (has(n, R.HARD_TO_FILL), "'ANUNCIO_DIFICIL_COBERTURA'"),
        (late, "'NUEVA_CONVOCATORIA'"),
        (has(n, R.FOLLOW_UP), "'SEGUIMIENTO'"),
        (has(n, R.NEW_CALL), "'NUEVA_CONVOCATORIA'"),
    ]
    return case(*rules, default="'SEGUIMIENTO'")


MILESTONE = case(*[(has("nt", w), q(m)) for m, w in R.MILESTONES], (hit("nt", R.CORRECTION), "'CORRECCION'"), default=q(R.OTHER_MILESTONE))
FOLLOW = case(*[(hit("nt", f"(?s){p}"), q(m)) for m, p in R.OFFICIAL_FOLLOW_UP], default=q(R.OTHER_OFFICIAL))
CLEAR = f"{has('nt', R.CONTINUITY)} AND NOT {has('nt', R.FOREIGN)}"


def family(n: str, rules) -> str:
    text = f"regexp_replace({n}, {q(R.TYPO[0])}, {q(R.TYPO[1])}, 'g')" if rules is R.FAMILIES_CALL else n
    return case(*[(hit(text, f"(?s){p}"), q(m)) for m, p in rules])


def special(n: str) -> str:
    return case(*[(hit(n, p), q(m)) for p, m in R.SPECIALISMS])


FOUNDING = f"NOT {has('t', R.LATER_ACT)} AND ({has('t', R.FOUNDING)} OR (trim(coalesce(t, '')) = '' AND {has('b', R.FOUNDING)}))"
_DOC = r"\b(?:deja|dejar)\s+sin\s+efecto\b|\banula(?:r|da|do|ción)?(?:[^\w\x{C0}-\x{17F}]|$)"
_EXCL = case(
    *[(f"contains({'nn' if where == 'title' else 'n'}, {q(w)})", q(w)) for w, where in R.POOL_EXCLUSIONS],
    (hit("nn", R.INTERNAL_WORD), "'promocion interna'"),
    (f"{hit('nn', R.EMPLOYEES_ONLY)} AND NOT contains(nn, 'libre')", "'no turno libre'"),
)
_CODES = f"list_sort(list_distinct(regexp_extract_all(nt, {q(C.CALL_CODE)}, 1)))"
_STATED = "list_sort(list_distinct(regexp_extract_all(nt, '\\b([a-c]\\d-\\d{2}(?:-[a-z0-9]+)*)\\b', 1)))"
_SHIFTOK = case(
    (has("nt", C.RESERVE), has("ns", C.RESERVE)),
    (hit("nt", r"\b(?:turno|torn)\s+(?:libre|lliure)\b"), f"{has('ns', ('libre', 'lliure'))} AND NOT {has('ns', C.RESERVE)}"),
)
_NAVE = "regexp_replace(regexp_replace({}, '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')"

SQL = {
    "scope": sql("processes", f"{NN} SELECT process_id, {scope('nn', 'nn')} AS scope, {scope('nn', 'nn', True)} AS coded FROM g"),
    "scope_title_first": sql("bodies", f"""
        , g AS (SELECT process_id, {fold('body')} AS n, lower({squeeze('strip_accents(name)')}) AS nn FROM bodies)
        SELECT process_id, CASE WHEN {scope('nn', 'nn')} <> 'REVISION' THEN {scope('nn', 'nn')} ELSE {scope('n', 'n')} END AS scope FROM g"""),
    "scope_document": sql("bodies", f"""
        , s AS (SELECT process_id, {fold("unnest(string_split_regex(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)))")} AS n FROM bodies)
        , c AS (SELECT process_id, {scope('n', 'n')} AS s FROM s WHERE {hit('n', X.STATES_PLACES)})
        SELECT process_id, CASE WHEN bool_or(s = 'SI') THEN 'SI' WHEN bool_or(s = 'REVISION') THEN 'REVISION' ELSE 'NO' END AS scope FROM c GROUP BY 1"""),
    "notice_class": sql("notices", f"{NT} SELECT notice_id, {notice_class('nt')} AS kind, {notice_class('nt', False)} AS plain, {notice_class('nt', provincial=True)} AS provincial FROM f"),
    "milestone": sql("notices", f"{NT} SELECT notice_id, {MILESTONE} AS milestone FROM f"),
    "follow_up_type": sql("notices", f"{NT} SELECT notice_id, {FOLLOW} AS kind FROM f"),
    "is_continuity": sql("notices", f"{NT} SELECT notice_id, {CLEAR} AS clear FROM f"),
    "is_founding": sql("notices", f", f AS (SELECT notice_id, CASE WHEN n > 10 THEN {fold('title')} END AS t, {fold('title')} AS b FROM notices) SELECT notice_id, {FOUNDING} AS founding FROM f"),
    "family": sql("notices", f"{NT} SELECT notice_id, {family('nt', R.FAMILIES_TITLE)} AS by_title, {family('nt', R.FAMILIES_CALL)} AS by_call, {family('nt', R.FAMILIES_COLLISION)} AS collision FROM f"),
    "document_type": sql("bodies", f"""
        , b AS (SELECT process_id, lower(concat_ws(' ', name, body)) AS b FROM bodies)
        SELECT process_id, {case((hit('b', _DOC), "'ANULACION'"), (hit('b', R.DOCUMENT_RECTIFIES), "'RECTIFICACION'"), default="'CONVOCATORIA'")} AS kind FROM b"""),
    "is_employment": sql("notices", f"""{EVENTS}
        , f AS (SELECT notice_id, rule, {fold('title')} AS nt FROM events)
        SELECT notice_id, NOT {has('nt', R.NOT_EMPLOYMENT)} AND ({has('nt', R.TERMINAL_WORDS)} OR rule IS NOT NULL OR {has('nt', R.EMPLOYMENT)}) AS employment FROM f"""),
    "pool_exclusion": sql("bodies", f"""
        , g AS (SELECT process_id, {fold('body')} AS n, lower({squeeze('strip_accents(name)')}) AS nn FROM bodies)
        SELECT process_id, {_EXCL} AS reason, {special('n')} AS specialism FROM g"""),
    "call_scope": sql("notices", f"""{NT}
        , c AS (SELECT notice_id, nt, {_CODES} AS codes, contains(nt, 'promocion interna') AS internal,
                       regexp_matches(nt, '\\bturno\\b') AND NOT contains(nt, 'turno libre') AS other, {special('nt')} AS s0 FROM f)
        , d AS (SELECT *, CASE WHEN NOT (len(codes) > 0 AND coalesce(s0 IN ({', '.join(q(t) for t in C.TOLERATED)}), false) AND contains(nt, 'cuerpo superior de administracion')) THEN s0 END AS s FROM c)
        , r AS (SELECT *, {case(('internal', "'promocion_interna'"), ('other', "'turno_no_libre'"),
                ("len(codes) > 0 AND len(list_filter(codes, lambda x: regexp_full_match(x, '(?:a1|a2|c1|c2)-01(?:-[a-z0-9]+)*'))) = 0", "'cuerpo_no_administrativo_general'"),
                ('s IS NOT NULL', 's'), (f"len(codes) > 0 OR {any_('nt', C.PORTAL_PROFILES)}", 'NULL'), default="'sin_perfil_administrativo'")} AS reason FROM d)
        SELECT notice_id, reason IS NULL AS administrative, reason, upper(array_to_string(codes, ',')) AS codes,
               CASE WHEN internal THEN 'PROMOCION_INTERNA' WHEN other THEN 'OTRO' ELSE 'TURNO_LIBRE' END AS shift FROM r"""),
    "portal_decision": sql("notices", f"""{NT}
        , c AS (SELECT notice_id, nt, {_STATED} AS stated, list_extract(['PROMOCION_INTERNA', 'INGRESO_LIBRE', 'INTERINIDAD', 'X'], n % 4 + 1) AS route,
                       CASE source_id % 3 WHEN 0 THEN 'SI' WHEN 1 THEN 'NO' ELSE 'REVISION' END AS agency FROM f)
        , d AS (SELECT *, list_filter(stated, lambda x: x IN ('a1-01', 'a2-01', 'c1-01', 'c2-01')) AS codes FROM c)
        , e AS (SELECT *, CASE WHEN len(stated) > 0 THEN len(codes) > 0 ELSE {any_('nt', C.PORTAL_PROFILES)} END AS general FROM d)
        , r AS (SELECT *, {case(("general AND agency = 'SI' AND route IN ('INGRESO_LIBRE', 'INTERINIDAD', 'CONTRATACION_FIJA')", "'incluida'"), ("route = 'PROMOCION_INTERNA'", "'promocion_interna'"),
                ('NOT general', "'fuera_ambito_administrativo'"), ("agency = 'NO'", "'organismo_excluido'"), ("agency = 'REVISION'", "'organismo_revision'"), default="'via_no_incluida'")} AS reason FROM e)
        SELECT notice_id, reason = 'incluida' AS included, reason, upper(array_to_string(codes, ',')) AS codes, agency FROM r"""),
    "cycle_state": sql("readings", f"""
        , s AS (SELECT reading_id, k, {fold('stage')} AS ns FROM readings)
        SELECT reading_id, CASE WHEN {has('ns', R.TERMINAL_STAGES)} OR (regexp_matches(ns, '^(?:nombramiento|nomenament)') AND NOT contains(ns, 'tribunal')) THEN 'FINALIZADO' ELSE 'EN_CURSO' END AS state,
               CASE WHEN regexp_matches(ns, 'anulacion|anul·lacio|anullacio') THEN 'ANULADO' WHEN regexp_matches(ns, 'adjudicacio') OR k % 2 = 0 THEN 'FINALIZADO' ELSE 'EN_CURSO' END AS ad_state FROM s"""),
    "actionable": sql("readings", """
        , s AS (SELECT *, CASE k % 5 WHEN 0 THEN 'CERRADO' WHEN 1 THEN 'ABIERTO' END AS term, DATE '2024-01-20' AS d FROM readings)
        , r AS (SELECT reading_id, CASE WHEN term = 'CERRADO' OR closes < d THEN 'PLAZO_CERRADO' WHEN opens > d THEN 'PLAZO_PENDIENTE'
                WHEN term = 'ABIERTO' OR (opens <= d AND closes >= d) THEN 'PLAZO_ABIERTO' WHEN opens IS NULL AND closes >= d THEN 'PLAZO_ABIERTO' ELSE 'PLAZO_NO_ACREDITADO' END AS reason FROM s)
        SELECT reading_id, reason = 'PLAZO_ABIERTO' AS actionable, reason FROM r"""),
    "pool_operating": sql("readings", f"SELECT reading_id, CASE WHEN trim(phase) <> '' THEN regexp_matches(left(trim({fold('phase')}), 80), 'en funcionamient|en funcionament') END AS operating FROM readings"),
    "is_private": sql("processes", "SELECT process_id, lower(trim(process_type)) = 'bolsa de trabajo' OR coalesce(upper(trim(category)) IN ('BOLSA', 'ADC'), false) AS private FROM processes"),
    "visible_to": sql("subscriptions processes", """
        , p AS (SELECT process_id, lower(trim(process_type)) = 'bolsa de trabajo' OR coalesce(upper(trim(category)) IN ('BOLSA', 'ADC'), false) AS private FROM processes)
        SELECT user_id, process_id, private FROM subscriptions JOIN p USING (process_id) WHERE NOT private OR user_id IN (SELECT user_id FROM events WHERE value > 50)"""),
    "shift_compatible": sql("notices", f"""
        , f AS (SELECT notice_id, {fold('title')} AS nt, CASE n % 3 WHEN 0 THEN 'libre' WHEN 1 THEN 'libre, reserva discapacidad' END AS ns FROM notices)
        SELECT notice_id, {_SHIFTOK} AS compatible FROM f"""),
    "mentions_town": sql("bodies agencies", f"""
        , j AS (SELECT process_id, {_NAVE.format(fold("concat_ws(' ', body, CASE WHEN process_id % 2 = 0 THEN agency_name END)"))} AS t,
                       regexp_replace(trim({fold("regexp_replace(agency_name, ' \\(Sede\\)$', '')")}), '^ayuntamiento\\s+(?:de |del |d'')?', '') AS a FROM bodies JOIN agencies USING (agency_id))
        SELECT process_id, len(list_filter(string_split(a, '/'), lambda x: trim({_NAVE.format('x')}) <> '' AND contains(t, trim({_NAVE.format('x')})))) > 0 AS mentioned FROM j"""),
    "is_maintenance": f"""
        WITH p AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN concat('<html><script>x</script><p>Aplicación fuera de servicio</p>', html) ELSE html END AS html FROM pages)
        SELECT page_id, {hit('html', r'(?i)fuera\s+de\s+servicio|fora\s+de\s+servei')} AND {hit(html(), C.OUT_OF_SERVICE)} AS maintenance FROM p""",
    "validate_correction": sql("processes", """
        , r AS (SELECT process_id, opens, closes, CASE process_id % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'Z' END AS g, CASE process_id % 5 WHEN 0 THEN 'C1' WHEN 1 THEN 'B9' WHEN 2 THEN 'A2' END AS s,
                       CASE WHEN process_id % 2 = 0 THEN 'administración general' WHEN process_id % 7 = 1 THEN 'otra' END AS sc, process_id % 4 <> 0 AS web FROM processes)
        SELECT process_id, concat_ws(',', CASE WHEN NOT web THEN 'EVIDENCE' END, CASE WHEN g = 'Z' THEN 'GROUP' END, CASE WHEN s = 'B9' THEN 'SUBGROUP' END,
               CASE WHEN left(s, 1) <> g THEN 'INCOHERENT' END, CASE WHEN sc = 'otra' THEN 'SCALE' END, CASE WHEN (opens IS NULL) <> (closes IS NULL) THEN 'ONE_DATE' END,
               CASE WHEN opens > closes THEN 'DATE_ORDER' END) AS errors FROM r"""),
    "term_state": sql("readings", f"""SELECT reading_id, CASE WHEN contains({fold('phase')}, 'plazo abierto') THEN 'ABIERTO' END AS term,
        {has(fold('stage'), R.APPLICATION_STAGES)} AS application FROM readings"""),
    "agency_type": sql("processes agencies", """
        , h AS (SELECT process_id, CASE WHEN agency_kind = 'DIPUTACION' THEN concat('Diputación Provincial ', agency_name) ELSE agency_name END AS header, agency_kind FROM processes JOIN agencies USING (agency_id))
        SELECT process_id, header FROM h WHERE agency_kind <> 'DIPUTACION'"""),
    "local_decision": sql("processes", f"""{NN}
        , d AS (SELECT process_id, NOT {any_('nn', C.CITY_RULES['out'])} AND {any_('nn', C.CITY_RULES['in'])} AS in_scope, {has(fold('state'), C.CITY_RULES['final'])} AS finished, {has(fold('shift'), C.CITY_RULES['shifts'])} AS out FROM g)
        SELECT process_id, in_scope, finished, in_scope AND NOT out AND NOT finished AS opportunity FROM d"""),
    "route_defaults": sql("readings", """SELECT reading_id, CASE k % 4 WHEN 0 THEN 'Oposición' WHEN 1 THEN 'Bolsa de trabajo' WHEN 2 THEN 'Contratación laboral indefinida' END AS kind,
        CASE WHEN k % 4 < 3 THEN 'TURNO_LIBRE' END AS shift FROM readings"""),
}
