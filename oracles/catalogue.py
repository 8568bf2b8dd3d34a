from __future__ import annotations

from edictal import rules as R
from edictal.plans.catalogue import VIEW_STATES, VIEW_TYPES
from oracles.calendar import CAL, state
from oracles.classify import has
from oracles.lifecycle import TERMINAL
from oracles.views import q, sql
from oracles.windows import RANK


def inlist(words) -> str:
    return "(" + ", ".join(q(w) for w in words) + ")"


PRIVATE = f"(lower(trim(process_type)) IN {inlist(R.PRIVATE_TYPES)} OR coalesce(upper(trim(category)) IN ('BOLSA', 'ADC'), false))"
OFFERED = f"""is_opportunity AND scope = 'SI' AND process_type NOT IN {inlist(R.EXCLUDED_TYPES)} AND upper(shift) <> 'PROMOCION_INTERNA' AND NOT {TERMINAL} AND NOT {has('lower(name)', R.EXCLUDED_TITLES)}"""
ACT = f"""
, act AS (SELECT process_id, max(published) AS last_notice, max(published) FILTER (WHERE source_kind = 'BOE') AS last_gazette FROM notices LEFT JOIN sources USING (source_id) GROUP BY 1)
, urls AS (SELECT process_id, url AS best_url FROM notices WHERE trim(coalesce(url, '')) <> '' QUALIFY row_number() OVER (PARTITION BY process_id ORDER BY {RANK}, published NULLS LAST, notice_id) = 1)
, joined AS (SELECT p.*, g.agency_name, g.agency_kind, last_notice, last_gazette, best_url FROM processes p JOIN agencies g USING (agency_id) LEFT JOIN act USING (process_id) LEFT JOIN urls USING (process_id))
, visible AS (SELECT * FROM joined WHERE {OFFERED} AND (agency_kind NOT IN ('AYUNTAMIENTO', 'DIPUTACION')
        OR coalesce(greatest(call_date, opens, closes, last_notice), DATE '2000-06-30') >= DATE '1999-06-30'))
"""


def enriched(rel: str) -> str:
    return f"""{CAL}
, gz AS (SELECT r.* REPLACE (coalesce(last_gazette, gazette_date) AS gazette_date), s.source_kind, coalesce(last_gazette, gazette_date, call_date) AS base FROM {rel} r LEFT JOIN sources s USING (source_id))
, st AS {state('gz', 'base')}
, en AS (SELECT *, CASE WHEN opens IS NOT NULL AND closes IS NOT NULL THEN CASE WHEN DATE '2000-06-30' < opens THEN 'PENDIENTE_APERTURA' WHEN DATE '2000-06-30' <= closes THEN 'ABIERTO' ELSE 'CERRADO' END
        WHEN code IS NOT NULL THEN code WHEN gazette_date IS NOT NULL THEN 'BOE_PUBLICADO_SIN_PLAZO' WHEN source_kind = 'BOP' THEN 'PENDIENTE_BOE' ELSE 'NO_DETERMINADO' END AS enrolment FROM st)
, shown AS (SELECT *, enrolment = 'ABIERTO' AS open_now, coalesce(nullif(trim(detail_url), ''), best_url) AS official_url FROM en)
"""


_COLS = "process_id, name, state, enrolment, open_now, official_url"
_TOP = "ORDER BY coalesce(exam_date, call_date, opens) DESC NULLS LAST, process_id DESC LIMIT 200"
ALL = "processes agencies notices sources"

SQL = {
    "catalogue": sql(ALL, f"{ACT} SELECT process_id, agency_name, CAST(last_notice AS VARCHAR) AS last_notice, best_url FROM visible"),
    "active_view": sql("processes", f"SELECT process_id, name, state FROM processes WHERE is_opportunity AND scope = 'SI' AND lower(state) NOT IN {inlist(VIEW_STATES)} AND upper(shift) <> 'PROMOCION_INTERNA' AND lower(process_type) NOT IN {inlist(VIEW_TYPES)}"),
    "catalogue_list": sql(ALL, f"{ACT}, pub AS (SELECT * FROM visible WHERE NOT {PRIVATE}){enriched('pub')} SELECT {_COLS} FROM shown {_TOP}"),
    "catalogue_private": sql(ALL, f"{ACT}{enriched('visible')} SELECT {_COLS} FROM shown {_TOP}"),
    "catalogue_open_now": sql(ALL, f"{ACT}{enriched('visible')} SELECT {_COLS} FROM shown WHERE open_now {_TOP}"),
    "detail": sql(ALL + " subscriptions", f"{ACT}, w AS (SELECT * FROM joined WHERE is_opportunity AND scope = 'SI' AND process_id IN (SELECT process_id FROM subscriptions WHERE active)){enriched('w')} SELECT {_COLS} FROM shown"),
    "my_subscriptions": sql(ALL + " subscriptions", f"{ACT} SELECT user_id, process_id, name, agency_name, CAST(since AS VARCHAR) AS since, coalesce(nullif(trim(detail_url), ''), best_url) AS official_url FROM subscriptions JOIN joined USING (process_id) WHERE subscriptions.active AND is_opportunity AND scope = 'SI'"),
    "agencies": sql("agencies", "SELECT agency_id, agency_name, agency_kind FROM agencies WHERE active"),
    "sources": sql("sources agencies", "SELECT source_id, source_name, agency_name, priority FROM sources LEFT JOIN (SELECT agency_id, agency_name FROM agencies) USING (agency_id) WHERE active"),
}
