from __future__ import annotations

from edictal import rules as R
from oracles.views import case, hit, key, q, sql

# RE2 has no look-ahead: the excluded phrases are blanked first.
_MINOR = rf"{R.FINALISATION}{R.MINOR_STEP}"
_YEAR = rf"{R.EXERCISE}{R.FISCAL_YEAR}"


def blank(x: str, pattern: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, '#', 'g')"


_PARTIAL = f"({hit(blank('k', _YEAR), R.EXERCISE)} OR {hit('k', R.PARTIAL)} OR {hit('k', R.PROVISIONAL)} OR {hit('k', R.REVOKED)})"
_RESULT = case(*[(hit("k", p), f"'RESULTADO_FINAL_{i}'") for i, p in enumerate(R.FINAL_RESULTS, 1)])
RULE = case(
    (hit("k", R.ANNULMENT), "'ANULACION_CONVOCATORIA'"),
    (hit("k", R.DESISTANCE), "'DESISTIMIENTO_CONVOCATORIA'"),
    (hit(blank("k", _MINOR), R.FINALISATION), "'FINALIZACION_PROCESO'"),
    (hit("k", R.VOID), "'PROCESO_DESIERTO'"),
    (f"NOT {hit('k', R.INTERIM)} AND {hit('k', R.APPOINTMENT)}", "'NOMBRAMIENTO_O_ADJUDICACION'"),
    (f"NOT {hit('k', R.INTERIM)} AND NOT {_PARTIAL}", _RESULT),
)
STATE = (
    "CASE rule WHEN 'ANULACION_CONVOCATORIA' THEN 'ANULADO' WHEN 'DESISTIMIENTO_CONVOCATORIA' THEN 'DESISTIDO' "
    "ELSE CASE WHEN rule IS NOT NULL THEN 'FINALIZADO' END END"
)
TERMINAL = "coalesce(lower(trim(state)) IN (" + ", ".join(q(s) for s in R.TERMINAL_STATES) + "), false)"
EVENTS = f"""
, keyed AS (SELECT *, {key("title")} AS k FROM notices)
, ruled AS (SELECT * EXCLUDE (k), {RULE} AS rule FROM keyed)
, events AS (SELECT *, {STATE} AS closing_state, NOT starts_with(rule, 'RESULTADO_FINAL') AS closes_pools FROM ruled)
"""
_ORDER = "CASE closing_state WHEN 'ANULADO' THEN 0 WHEN 'DESISTIDO' THEN 1 ELSE 2 END, published DESC NULLS LAST, notice_id DESC"
POOL = f"regexp_matches({key('process_type')}, 'bolsa|borsa')"
ACTIONS = f"""{EVENTS}
, candidates AS (
    SELECT process_id, state, {POOL} AS is_pool, {TERMINAL} AS closed FROM processes
    WHERE is_opportunity AND (NOT {TERMINAL} OR coalesce(closure_origin = 'RECONCILIACION', false)))
, best AS (
    SELECT c.process_id, e.closing_state, e.rule, e.notice_id, e.title, e.published,
           row_number() OVER (PARTITION BY c.process_id ORDER BY {_ORDER}) AS r
    FROM candidates c JOIN events e ON e.process_id = c.process_id
    WHERE e.rule IS NOT NULL AND (NOT c.is_pool OR e.closes_pools))
, actions AS (
    SELECT c.process_id, CASE WHEN c.closed THEN 'REOPEN' ELSE 'CLOSE' END AS action, c.state AS old_state,
           CASE WHEN c.closed THEN 'EN_CURSO' ELSE b.closing_state END AS new_state,
           b.rule, b.notice_id, b.title, b.published, NOT c.closed AS significant
    FROM candidates c LEFT JOIN best b ON b.process_id = c.process_id AND b.r = 1
    WHERE (NOT c.closed AND b.rule IS NOT NULL) OR (c.closed AND b.rule IS NULL))
"""

SQL = {
    "closure_summary": sql("agencies processes notices", f"""{ACTIONS}
        SELECT agency_name, action, new_state, count(*) AS n
        FROM actions JOIN (SELECT process_id, agency_id FROM processes) USING (process_id) JOIN agencies USING (agency_id)
        GROUP BY ALL"""),
    "reconcile": sql("processes notices", f"{ACTIONS} SELECT * REPLACE (CAST(published AS VARCHAR) AS published) FROM actions"),
    "reconcile_history": sql("processes notices", f"{ACTIONS} SELECT action, false AS significant, count(*) AS n FROM actions GROUP BY ALL"),
    "reconcile_twice": sql("processes", " SELECT CAST(0 AS BIGINT) AS n"),
    "apply_closures": sql("processes notices", f"""{ACTIONS}
        SELECT p.process_id, coalesce(a.new_state, p.state) AS state,
               CASE a.action WHEN 'CLOSE' THEN 'RECONCILIACION' WHEN 'REOPEN' THEN NULL ELSE p.closure_origin END AS closure_origin,
               a.rule AS closure_rule, a.notice_id AS closure_notice_id, a.title AS closure_title, CAST(a.published AS VARCHAR) AS closure_published
        FROM processes p LEFT JOIN actions a USING (process_id)"""),
    "closure_changes": sql("processes notices", f"""{ACTIONS}
        SELECT process_id, notice_id, 'ACTUALIZACION' AS kind, 'estado' AS field, old_state AS old, new_state AS new,
               CASE action WHEN 'CLOSE' THEN 'Proceso selectivo resuelto según publicación oficial'
                    ELSE 'La evidencia de cierre guardada ya no se sostiene' END AS summary, significant
        FROM actions"""),
    "best_evidence": sql("notices", f"""{EVENTS}
        , a AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY {_ORDER}) AS r FROM events WHERE rule IS NOT NULL)
        , p AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY {_ORDER}) AS r FROM events WHERE rule IS NOT NULL AND closes_pools)
        SELECT a.process_id, a.rule, a.notice_id, CAST(a.published AS VARCHAR) AS published, p.rule AS pool_rule, p.notice_id AS pool_notice_id
        FROM a LEFT JOIN p ON p.process_id = a.process_id AND p.r = 1 WHERE a.r = 1"""),
    "first_terminal": sql("processes notices", f"""{EVENTS}
        , ranked AS (
            SELECT p.process_id, p.state AS old_state, e.notice_id, e.closing_state AS new_state,
                   row_number() OVER (PARTITION BY p.process_id ORDER BY e.published DESC NULLS LAST, e.notice_id DESC) AS r
            FROM processes p JOIN events e ON e.process_id = p.process_id
            WHERE NOT {TERMINAL} AND e.rule IS NOT NULL AND (NOT {POOL} OR e.closes_pools))
        SELECT process_id, old_state, notice_id, new_state FROM ranked WHERE r = 1"""),
    "closure_event": sql("notices", f"{EVENTS} SELECT notice_id, rule, closing_state, closes_pools FROM events"),
    "state_label": sql("processes", f"""
        SELECT process_id, {case(*[(f"regexp_full_match({key("concat('Procés ', lower(state))")}, {q(f'(?:proceso |proces )?(?:{p})')})", q(s)) for s, p in R.LABELS])} AS label
        FROM processes"""),
    "terminal_state": sql("processes", f" SELECT process_id, {TERMINAL} AS terminal, {POOL} AS pool FROM processes"),
}
