from __future__ import annotations

from edictal.operators.calendar import FIXED_HOLIDAYS
from edictal.sources.bind import DEADLINES
from oracles.extract import _DIGITS, _WORD, num, spelled
from oracles.views import fold, got, hit, pick, sql

AS_OF = "DATE '2000-06-30'"
# Easter Sundays of the years in the tables, from published almanacs.
EASTER = {
    1994: "04-03", 1995: "04-16", 1996: "04-07", 1997: "03-30", 1998: "04-12", 1999: "04-04", 2000: "04-23", 2001: "04-15", 2002: "03-31", 2003: "04-20",
}
_EASTERS = ", ".join(f"DATE '{y}-{d}'" for y, d in EASTER.items())
CAL = f"""
, d AS (SELECT CAST(unnest(range(DATE '1994-01-01', DATE '2004-01-01', INTERVAL 1 DAY)) AS DATE) AS day)
, b AS (SELECT day, isodow(day) < 6 AND month(day) * 100 + day(day) NOT IN ({', '.join(str(m * 100 + n) for m, n in FIXED_HOLIDAYS)})
               AND day + 2 NOT IN ({_EASTERS}) AND day - 1 NOT IN ({_EASTERS}) AS business FROM d)
, cal AS (SELECT day, business, CAST(sum(CAST(business AS INT)) OVER (ORDER BY day) AS INT) AS ordinal,
                 min(CASE WHEN business THEN day END) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_business FROM b)
, work AS (SELECT ordinal, day FROM cal WHERE business)
"""
NATURAL = r"\bdias?\s+naturales?\b|\bdies\s+naturals\b"


def stated(rel: str, lit: str = "deadline") -> str:
    return f"""(SELECT * EXCLUDE (d0, w0), CASE WHEN d0 IS NOT NULL THEN {num('d0')} ELSE {spelled('w0')} END AS days, CASE WHEN nn IS NOT NULL THEN CASE WHEN {hit('nn', NATURAL)} THEN 'NATURALES' ELSE 'HABILES' END END AS kind
        FROM (SELECT *, {got('nn', _DIGITS)} AS d0, {got('nn', _WORD)} AS w0 FROM (SELECT *, nullif(trim({fold(lit)}), '') AS nn FROM {rel})))"""


_LIT = f"CASE WHEN n % 4 <> 0 THEN {pick(DEADLINES, 'n % 7')} END"
TERM = f"""{CAL}
, sole AS (SELECT process_id, count(*) AS nb, arg_min(lit, notice_id) AS bd, arg_min(published, notice_id) AS bg FROM (SELECT *, {_LIT} AS lit FROM notices WHERE source_id % 3 = 1) GROUP BY 1)
, pt AS (SELECT p.* REPLACE (CASE WHEN nb IS NULL OR nb = 1 THEN CASE WHEN p.deadline <> '' THEN p.deadline ELSE bd END END AS deadline,
                CASE WHEN p.gazette_date IS NOT NULL THEN p.gazette_date WHEN nb = 1 THEN bg END AS gazette_date) FROM processes p LEFT JOIN sole USING (process_id))
, t AS {stated('pt')}
, e AS (SELECT t.*, CASE kind WHEN 'NATURALES' THEN nat.next_business ELSE w.day END AS closes_on
        FROM t LEFT JOIN cal g ON g.day = t.gazette_date LEFT JOIN work w ON w.ordinal = g.ordinal + days LEFT JOIN cal nat ON nat.day = t.gazette_date + days)
, term AS (SELECT *, CASE WHEN days IS NOT NULL THEN gazette_date + 1 END AS term_opens, CASE WHEN days IS NOT NULL AND gazette_date IS NOT NULL THEN closes_on END AS term_closes FROM e)
"""


def state(rel: str, published: str) -> str:
    return f"""(SELECT s.*, CASE WHEN trim(coalesce(deadline, '')) = '' OR {published} IS NULL THEN NULL WHEN kind = 'NATURALES' OR w.day IS NULL THEN 'PLAZO_LITERAL'
            WHEN {AS_OF} < {published} + 1 THEN 'PENDIENTE_APERTURA' WHEN {AS_OF} <= w.day THEN 'ABIERTO' ELSE 'CERRADO' END AS code
        FROM {stated(rel)} s LEFT JOIN cal g ON g.day = s.{published} LEFT JOIN work w ON w.ordinal = g.ordinal + s.days)"""


ROLL = f"""
, bul AS (SELECT process_id, {_LIT} AS deadline, published AS gazette_date FROM notices WHERE source_id % 3 = 1)
, bs AS {state('bul', 'gazette_date')}
, roll AS (SELECT process_id, CASE WHEN count(code) = 0 THEN 'BOE_PUBLICADO_SIN_PLAZO' WHEN count(DISTINCT code) = 1 THEN min(code) ELSE 'PLAZOS_MULTIPLES' END AS rollup,
                  bool_or(code = 'ABIERTO') AS any_open, count(code) AS n_terms FROM bs GROUP BY 1)
"""
ENROL = f"""{CAL}{ROLL}
, pb AS (SELECT *, coalesce(gazette_date, call_date) AS base FROM processes)
, ps AS {state('pb', 'base')}
, enrol AS (SELECT ps.process_id, opens IS NOT NULL AND closes IS NOT NULL AS stored, any_open,
        CASE WHEN opens IS NOT NULL AND closes IS NOT NULL THEN CASE WHEN {AS_OF} < opens THEN 'PENDIENTE_APERTURA' WHEN {AS_OF} <= closes THEN 'ABIERTO' ELSE 'CERRADO' END
             WHEN rollup IS NOT NULL THEN rollup WHEN code IS NOT NULL THEN code WHEN gazette_date IS NOT NULL THEN 'BOE_PUBLICADO_SIN_PLAZO'
             WHEN ps.process_id % 8 = 0 OR (ps.source_id % 3 = 0 AND ps.source_id IN (SELECT s_suppkey FROM supplier)) THEN 'PENDIENTE_BOE' ELSE 'NO_DETERMINADO' END AS enrolment
    FROM ps LEFT JOIN roll USING (process_id))
"""
SQL = {
    "calendar": sql("notices", f"{CAL} SELECT CAST(day AS VARCHAR) AS published, business, ordinal, CAST(next_business AS VARCHAR) AS next_business FROM cal WHERE day IN (SELECT published FROM notices)"),
    "is_business_day": sql("notices", f"{CAL} SELECT notice_id, business FROM notices JOIN cal ON day = published"),
    "add_business_days": sql("notices", f"{CAL} SELECT notice_id, CAST(w.day AS VARCHAR) AS \"end\" FROM notices JOIN cal ON cal.day = published JOIN work w ON w.ordinal = cal.ordinal + n"),
    "deadline": sql("processes notices", f"""{TERM} SELECT process_id, days AS term_days, kind AS term_kind, CAST(term_opens AS VARCHAR) AS term_opens, CAST(term_closes AS VARCHAR) AS term_closes,
        CASE WHEN term_closes IS NOT NULL THEN false END AS term_verified FROM term"""),
    "verified_flag": sql("processes", """
        , r AS (SELECT process_id, year(call_date) AS a, year(coalesce(closes, exam_date, call_date)) AS z FROM processes)
        SELECT process_id, len(list_filter(range(a, z + 1), lambda y: y NOT IN (1996, 1997, 2000))) = 0 AS verified FROM r"""),
    "enrolment_rollup": sql("notices", f"{CAL}{ROLL} SELECT * FROM roll"),
    "enrolment_state": sql("processes notices", f"{ENROL} SELECT process_id, enrolment, enrolment = 'ABIERTO' OR (NOT stored AND coalesce(any_open, false)) AS open_now FROM enrol"),
    "deadline_plan": sql("processes notices", f"""{TERM}
        , a AS (SELECT *, CASE WHEN opens IS NULL AND closes IS NULL THEN 'FILL' WHEN opens IS NOT NULL AND closes IS NOT NULL THEN CASE WHEN opens <> term_opens OR closes <> term_closes THEN 'DISCREPANCY' END ELSE 'PARTIAL_UNTOUCHED' END AS action
                FROM term WHERE term_closes IS NOT NULL)
        SELECT process_id, action, CAST(term_opens AS VARCHAR) AS term_opens, CAST(term_closes AS VARCHAR) AS term_closes, days AS term_days, kind AS term_kind FROM a WHERE action IS NOT NULL"""),
}
