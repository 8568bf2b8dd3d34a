from __future__ import annotations

from edictal.sources.bind import TITLES
from oracles.classify import NT, notice_class
from oracles.extract import SQL as EXTRACT
from oracles.lifecycle import ACTIONS, RULE, STATE, TERMINAL, _ORDER
from oracles.text import SQL as TEXT
from oracles.views import key, pick, sql

OUTBOX = """, outbox AS (SELECT event_id AS send_id, user_id, event_id AS process_id, CAST(ts AS DATE) AS created,
    CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'PENDIENTE' WHEN event_type = 'error' THEN 'ERROR' ELSE 'ENVIADA' END AS state FROM events)"""




_PLACES, _JOBS, _CLASS = EXTRACT["places"], TEXT["clean_title"], EXTRACT["class_from_table"]
CALLS = f"""
, pl AS (SELECT DISTINCT * FROM ({_PLACES})), jb AS (SELECT DISTINCT * FROM ({_JOBS}))
, calls AS (SELECT concat_ws('-', process_id, source_id % 2) AS document_id, published, notice_id, places, job, title FROM notices JOIN pl USING (notice_id) JOIN jb USING (notice_id))
"""
SQL = {
    "counts": sql("notices sources", f"{NT} SELECT source_kind, {notice_class('nt')} AS kind, count(*) AS n FROM f JOIN sources USING (source_id) GROUP BY 1, 2"),
    "plan_summary": sql("processes notices", f"{ACTIONS} SELECT count(*) AS total, count(*) FILTER (WHERE action = 'CLOSE') AS close, count(*) FILTER (WHERE action = 'REOPEN') AS reopen FROM actions"),
    "last_success": sql("runs", "SELECT source, CAST(max(until) AS VARCHAR) AS last_success FROM runs WHERE state IN ('OK', 'SIN_NOVEDADES') AND until IS NOT NULL GROUP BY 1"),
    "read_windows": sql("runs", """
        , l AS (SELECT source, max(CASE WHEN state IN ('OK', 'SIN_NOVEDADES') THEN until - CAST(length(source) * 3 AS INT) END) AS d FROM runs GROUP BY 1)
        SELECT source, CAST(d AS VARCHAR) AS last_success, CAST(CASE WHEN d IS NULL THEN 7 ELSE least(30, greatest(7, date_diff('day', d, DATE '2024-01-31') + 1)) END AS INT) AS days,
               d IS NOT NULL AND date_diff('day', d, DATE '2024-01-31') + 1 > 30 AS exceeded FROM l"""),
    "last_publication": sql("processes notices", """
        , m AS (SELECT process_id, max(published) AS d FROM notices GROUP BY 1)
        SELECT process_id, CAST(call_date + 50 AS VARCHAR) AS stored_last, CAST(d AS VARCHAR) AS last_published FROM processes JOIN m USING (process_id) WHERE d IS DISTINCT FROM call_date + 50"""),
    "monotone_max": sql("processes", "SELECT process_id, CAST(greatest(closes, exam_date) AS VARCHAR) AS latest FROM processes"),
    "urls_by_process": sql("notices", """
        , r AS (SELECT *, row_number() OVER (PARTITION BY process_id, url ORDER BY published, notice_id) AS r FROM notices WHERE url LIKE 'http%' AND url NOT LIKE '%boe.es%')
        SELECT process_id, url, CAST(published AS VARCHAR) AS first_seen, notice_id AS first_notice FROM r WHERE r = 1"""),
    "group_calls": sql("notices", f"""{CALLS}
        SELECT document_id, CAST(sum(places) AS BIGINT) AS places, count(DISTINCT job) AS n_jobs, first(title ORDER BY published, notice_id) AS title FROM calls GROUP BY 1"""),
    "call_jobs": sql("notices", f"""{CALLS}
        SELECT document_id, job, first(notice_id ORDER BY published, notice_id) AS first_notice FROM calls WHERE job IS NOT NULL GROUP BY 1, 2"""),
    "digests": sql("processes", f"""{OUTBOX}
        , r AS (SELECT o.user_id, row_number() OVER (PARTITION BY o.user_id ORDER BY created, send_id) AS k, name,
                       concat_ws(' | ', name, 'Plazas: ' || places, 'Cierre: ' || CAST(closes AS VARCHAR)) AS line FROM outbox o JOIN processes USING (process_id) WHERE o.state = 'PENDIENTE')
        SELECT user_id, count(*) AS total, CASE WHEN count(*) = 1 THEN concat('Nueva oportunidad de empleo: ', min(name)) ELSE concat(count(*), ' nuevas oportunidades de empleo') END AS subject,
               string_agg(line, chr(10) ORDER BY k) FILTER (WHERE k <= 40) AS body, greatest(count(*) - 40, 0) AS more FROM r GROUP BY 1"""),
    "pending_by_user": f"""WITH{OUTBOX[1:]}
        SELECT user_id, count(*) AS n, min(send_id) AS first_id, max(send_id) AS last_id FROM outbox WHERE state = 'PENDIENTE' AND created > DATE '2024-01-26' GROUP BY 1""",
    "retryable": f"WITH{OUTBOX[1:]} SELECT send_id, user_id, CAST(created AS VARCHAR) AS created FROM outbox WHERE state = 'PENDIENTE' AND created > DATE '2024-01-26'",
    "source_state": sql("runs", """
        , c AS (SELECT run_id, CASE WHEN errors % 4 = 0 THEN errors END AS e, list_filter([CASE WHEN errors % 5 <> 0 THEN errors % 2 END, CASE WHEN errors % 3 = 0 THEN 0 END], lambda x: x IS NOT NULL) AS l FROM runs)
        SELECT run_id, CASE WHEN e > 0 THEN 'DEGRADADA' WHEN len(l) > 0 AND len(list_filter(l, lambda x: x <> 0)) = 0 THEN 'SIN_NOVEDADES' ELSE 'OK' END AS state FROM c"""),
    "cycle_health": sql("runs", """
        , c AS (SELECT cycle_id, count(*) AS total, count(*) FILTER (WHERE state = 'ERROR') AS errors,
                       string_agg(DISTINCT source, ', ' ORDER BY source) FILTER (WHERE state = 'ERROR') AS e, string_agg(DISTINCT source, ', ' ORDER BY source) FILTER (WHERE state = 'DEGRADADA') AS d FROM runs GROUP BY 1)
        SELECT cycle_id, total, errors, CASE WHEN errors > 0 THEN 'ERROR' WHEN d IS NOT NULL THEN 'AVISO' ELSE 'OK' END AS level, CAST(errors > 0 AS INT) AS code,
               concat_ws('; ', CASE WHEN errors >= total THEN 'TODAS las fuentes fallaron: ' || e WHEN errors > 0 THEN concat(errors, ' de ', total, ' fuentes fallaron: ', e) END, 'Fuentes degradadas: ' || d) AS message FROM c"""),
    "completeness": sql("notices", """
        SELECT source_id AS query_id, CAST(max(n * 12) AS INT) AS declared, count(DISTINCT process_id) AS read, count(DISTINCT process_id) >= 100 OR max(n * 12) > count(DISTINCT process_id) AS truncated FROM notices GROUP BY 1"""),
    "coverage": sql("bodies", f"""
        , k AS (SELECT b.agency_id, c.subgroup, length(body) % 7 <> 0 AS doc, b.process_id % 11 = 0 AS err FROM bodies b JOIN ({_CLASS}) c USING (process_id))
        SELECT agency_id, count(*) AS reviewed, count(*) FILTER (WHERE doc AND subgroup IS NOT NULL) AS classified, count(*) FILTER (WHERE doc AND subgroup IS NULL AND NOT err) AS unclassified,
               count(*) FILTER (WHERE NOT doc) AS without_document, count(*) FILTER (WHERE doc AND subgroup IS NULL AND err) AS errors FROM k GROUP BY 1"""),
    "active_totals": sql("processes", f"SELECT agency_id, scope, count(*) AS n, CAST(sum(coalesce(places, 0)) AS BIGINT) AS places FROM processes WHERE NOT {TERMINAL} GROUP BY 1, 2"),
    "presence_audit": sql("processes notices", """
        , s AS (SELECT process_id, count(*) AS times, min(title) AS item_class FROM notices WHERE kind = 'BASES' GROUP BY 1)
        SELECT p.process_id AS item_id, coalesce(times, 0) AS times, item_class, CASE WHEN times IS NULL THEN 'NO_LOCALIZADA' WHEN times > 1 THEN 'REPETIDA' ELSE 'LOCALIZADA' END AS reason FROM processes p LEFT JOIN s USING (process_id)"""),
    "card_closure": sql("readings", f"""
        , c AS (SELECT pool_id, CASE WHEN pool_id % 5 = 0 THEN 'Adjudicación y nombramiento' ELSE last(phase ORDER BY read_at, reading_id) END AS phase, max(opens) AS last_published FROM readings GROUP BY 1)
        , s AS (SELECT pool_id, reading_id AS notice_id, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 97 = 0 THEN 'Nombramiento' ELSE {pick(TITLES, 'k % 29')} END ELSE 'Tribunal' END AS name, opens AS published FROM readings)
        , r AS (SELECT *, {RULE} AS rule FROM (SELECT *, {key('name')} AS k FROM s))
        , e AS (SELECT *, {STATE} AS closing_state FROM r)
        , b AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY {_ORDER}) AS r FROM e WHERE rule IS NOT NULL)
        , a AS (SELECT pool_id, arg_min(published, notice_id) AS d FROM s WHERE lower(name) = 'nombramiento' GROUP BY 1)
        SELECT c.pool_id AS card_id, CASE WHEN c.pool_id % 5 = 0 THEN 'FASE_ADJUDICACION_NOMBRAMIENTO' WHEN a.pool_id IS NOT NULL THEN 'ETAPA_NOMBRAMIENTO' ELSE rule END AS rule,
               CASE WHEN c.pool_id % 5 = 0 OR a.pool_id IS NOT NULL THEN 'FINALIZADO' ELSE closing_state END AS state,
               CAST(CASE WHEN c.pool_id % 5 = 0 THEN last_published WHEN a.pool_id IS NOT NULL THEN a.d ELSE b.published END AS VARCHAR) AS day
        FROM c LEFT JOIN a USING (pool_id) LEFT JOIN b ON b.pool_id = c.pool_id AND b.r = 1"""),
    "recent": sql("notices", "SELECT notice_id, published >= DATE '2000-06-30' - 10 AS news, published >= DATE '1999-06-30' AS active FROM notices WHERE published <= DATE '2000-06-30'"),
}
