from __future__ import annotations

from edictal import rules as R
from edictal.functions import extract as X
from oracles.classify import scope
from oracles.extract import shift
from oracles.lifecycle import TERMINAL
from oracles.text import CLEAN, sub
from edictal.functions import text as T
from oracles.views import fold, q, sql, squeeze
from oracles.windows import NEWS_UNION, OFF

NEW = """
, snap AS (SELECT process_id, name, places, state, closes FROM processes)
, newer AS (SELECT CASE WHEN process_id % 10 = 3 THEN process_id + 100000000 ELSE process_id END AS process_id,
        CASE WHEN process_id % 4 = 1 THEN concat(name, ' (bis)') ELSE name END AS name, CASE WHEN process_id % 5 <> 0 THEN CAST(places + process_id % 2 AS INT) END AS places,
        CASE WHEN process_id % 3 = 0 THEN 'FINALIZADO' ELSE state END AS state, CASE WHEN process_id % 6 <> 2 THEN closes + 1 END AS closes FROM processes)
"""
_KEEP = "CAST(coalesce({0}.closes, {1}.closes) AS VARCHAR) AS closes"


def diff(after_closes: str, extra: str = "") -> str:
    rows = []
    for c, name in (("name", "denominacion"), ("places", "plazas"), ("state", "estado"), ("closes", "fecha_cierre")):
        after = after_closes if c == "closes" else f"n.{c}"
        rows.append(f"""SELECT process_id, '{name}' AS field, CAST(o.{c} AS VARCHAR) AS old, CAST({after} AS VARCHAR) AS new,
            o.{c} IS NOT NULL AND {'true' if name in R.RELEVANT_FIELDS else 'false'} AS significant FROM snap o JOIN newer n USING (process_id) WHERE o.{c} IS DISTINCT FROM {after}""")
    return f"{NEW}, d AS ({' UNION ALL '.join(rows)}) SELECT * FROM d {extra}"


_SILENT = """lower(coalesce(field, '')) NOT IN ({}) OR lower(coalesce(old, '')) IN ('navegación', 'navegacion') OR lower(coalesce(new, '')) IN ('navegación', 'navegacion')
    OR (field = 'estado' AND upper(coalesce(old, '')) IN ('ABIERTO', 'PENDIENTE', 'CERRADO', 'EN_SEGUIMIENTO') AND upper(new) = 'EN_CURSO')""".format(", ".join(q(f) for f in R.RELEVANT_FIELDS))
_OPER = f"CASE WHEN trim(phase) <> '' THEN regexp_matches(left(trim({fold('phase')}), 80), 'en funcionamient|en funcionament') END"
_LAST = f"(SELECT pool_id, content_hash, stage, phase, {_OPER} AS operating, opens, closes FROM readings {{}} QUALIFY row_number() OVER (PARTITION BY pool_id ORDER BY read_at DESC, reading_id DESC) = 1)"
_STAGEKEY = f"coalesce(trim(regexp_replace({fold(CLEAN.format(sub(squeeze('stage'), T.STAGE_NOISE, '')))}, '[^a-z0-9]+', ' ', 'g')), '')"
PORTAL = """
, new AS (SELECT concat('P:', process_id) AS stable_id, process_id AS ref, is_opportunity, process_id % 9 <> 0 AND process_id % 8 <> 0 AS valid, concat_ws('|', name, process_id % 4) AS metadata FROM processes)
, old AS (SELECT concat('P:', process_id) AS stable_id, process_id, concat_ws('|', name, process_id % 2) AS metadata FROM processes WHERE state <> 'EN_CURSO')
, pub AS (SELECT DISTINCT process_id AS ref FROM notices WHERE kind = 'BASES')
, j AS (SELECT n.stable_id, n.ref, o.process_id, is_opportunity, valid, pub.ref IS NULL AS publish, o.metadata IS DISTINCT FROM n.metadata AS refreshed FROM new n LEFT JOIN old o USING (stable_id) LEFT JOIN pub ON pub.ref = n.ref)
, a AS (SELECT *, CASE WHEN NOT is_opportunity THEN 'REVIEW' WHEN NOT valid THEN 'BLOCK' WHEN process_id IS NOT NULL AND (refreshed OR publish) THEN 'LINK_METADATA' WHEN process_id IS NOT NULL THEN 'NO_CHANGE'
        WHEN stable_id IN ('P:5', 'P:10') THEN 'BLOCK' ELSE 'INSERT' END AS action FROM j)
"""
ADS = f"""
, base AS (SELECT reading_id AS ad_id, k AS places, closes, CASE WHEN k % 3 = 0 THEN concat(k, ',444-B') END AS pools, CASE WHEN k % 3 = 0 THEN 'PDF' END AS evidence,
        concat_ws('|', CASE WHEN k % 2 = 0 THEN '' ELSE CAST(opens AS VARCHAR) END, {_STAGEKEY}, CASE WHEN k % 2 = 0 THEN concat('d', k) ELSE '' END) AS fp FROM readings)
, ex AS (SELECT *, places % 5 <> 0 AS adc FROM base WHERE places < 90)
, nw AS (SELECT ad_id, CASE WHEN ad_id % 9 = 0 THEN places + 1 ELSE places END AS places, CASE WHEN ad_id % 7 <> 0 THEN closes END AS closes, CASE WHEN ad_id % 4 = 0 THEN NULL ELSE pools END AS pools,
        CASE WHEN ad_id % 4 <> 0 THEN evidence END AS evidence, fp FROM base)
, e AS (SELECT n.ad_id, x.ad_id IS NOT NULL AS known, coalesce(x.adc, false) AS adc, CASE WHEN n.pools IS NULL THEN coalesce(x.pools, '') ELSE n.pools END AS ep,
        CASE WHEN n.pools IS NULL AND x.pools IS NOT NULL THEN x.evidence ELSE n.evidence END AS ee, x.pools AS xp, x.evidence AS xe, x.places <> n.places OR x.fp <> n.fp OR (n.closes IS NOT NULL AND n.closes IS DISTINCT FROM x.closes) AS moved
    FROM nw n LEFT JOIN ex x USING (ad_id))
"""
EDGES = """
, g AS (SELECT k AS ad_id, CAST(pool_id AS VARCHAR) AS ref, min(reading_id) AS m FROM readings GROUP BY 1, 2)
, eo AS (SELECT ad_id, ref, CASE WHEN m % 3 = 1 THEN CAST(ref AS BIGINT) END AS pool_id, CASE WHEN m % 5 <> 0 THEN 'VIEJA' END AS evidence FROM g)
, en AS (SELECT ad_id + 5 AS ad_id, ref, CASE WHEN m % 3 = 0 THEN CAST(ref AS BIGINT) END AS pool_id, CASE WHEN m % 2 = 0 THEN 'NUEVA' END AS evidence FROM g)
"""
_FOLLOWED = ", f AS (SELECT process_id, count(*) AS c FROM subscriptions WHERE active GROUP BY 1)"

SQL = {
    "news_union": sql("notices changes", f"{NEWS_UNION} SELECT * REPLACE (CAST(detected AS VARCHAR) AS detected) FROM news"),
    "recipients": "SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE value > 60",
    "snapshot_diff": sql("processes", f"{NEW} SELECT process_id, name FROM newer WHERE process_id NOT IN (SELECT process_id FROM snap)"),
    "unseen": sql("notices", "SELECT process_id, source_id FROM notices EXCEPT SELECT process_id, source_id FROM notices WHERE published < DATE '1998-01-01'"),
    "baseline_delta": sql("notices", """
        , o AS (SELECT process_id, source_id FROM notices WHERE published < DATE '1999-01-01'), n AS (SELECT process_id, source_id FROM notices WHERE published >= DATE '1997-01-01')
        SELECT *, 'REMOVE' AS delta FROM (SELECT * FROM o EXCEPT SELECT * FROM n) UNION ALL SELECT *, 'ADD' FROM (SELECT * FROM n EXCEPT SELECT * FROM o)"""),
    "worklist": sql("processes", f"{NEW} SELECT process_id, name FROM snap UNION ALL SELECT process_id, name FROM newer WHERE process_id NOT IN (SELECT process_id FROM snap)"),
    "insert_absent": sql("processes", f"{NEW} SELECT process_id, name FROM newer WHERE process_id NOT IN (SELECT process_id FROM snap)"),
    "append_new": sql("notices", """
        , o AS (SELECT DISTINCT ref, source_id, url FROM notices WHERE published < DATE '2000-01-01')
        , r AS (SELECT *, row_number() OVER (PARTITION BY ref, source_id, url ORDER BY published, notice_id) AS r FROM notices)
        SELECT ref, source_id, url, notice_id FROM r WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM o WHERE o.ref IS NOT DISTINCT FROM r.ref AND o.source_id IS NOT DISTINCT FROM r.source_id AND o.url IS NOT DISTINCT FROM r.url)"""),
    "append_twice": "SELECT CAST(NULL AS VARCHAR) AS ref, CAST(NULL AS BIGINT) AS source_id, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS notice_id WHERE false",
    "upsert_keep": sql("processes", f"{NEW} SELECT coalesce(n.process_id, s.process_id) AS process_id, coalesce(n.name, s.name) AS name, coalesce(n.places, s.places) AS places, coalesce(n.state, s.state) AS state, {_KEEP.format('n', 's')} FROM snap s FULL JOIN newer n ON n.process_id = s.process_id"),
    "fill_empty": sql("processes", f"""{NEW} SELECT s.process_id, s.name, coalesce(s.places, n.places) AS places, s.state, {_KEEP.format('s', 'n')},
        (s.places IS NULL AND n.places IS NOT NULL) OR (s.closes IS NULL AND n.closes IS NOT NULL) AS filled FROM snap s LEFT JOIN newer n ON n.process_id = s.process_id"""),
    "guarded_update": sql("processes", f"""{NEW}, g AS (SELECT *, NOT {TERMINAL} AS open FROM snap)
        SELECT s.process_id, s.name, CASE WHEN open AND n.process_id IS NOT NULL THEN n.places ELSE s.places END AS places, CASE WHEN open AND n.process_id IS NOT NULL THEN n.state ELSE s.state END AS state, CAST(s.closes AS VARCHAR) AS closes
        FROM g s LEFT JOIN newer n ON n.process_id = s.process_id"""),
    "apply_plan": sql("processes", f"""{NEW}
        , p AS (SELECT *, CASE WHEN process_id >= 100000000 THEN 'INSERT' WHEN process_id % 10 = 3 THEN 'INSERT' WHEN process_id % 7 = 0 THEN 'DELETE' WHEN process_id % 2 = 0 THEN 'UPDATE' ELSE 'NO_CHANGE' END AS action FROM newer)
        SELECT s.process_id, CASE WHEN action = 'UPDATE' THEN p.name ELSE s.name END AS name, CASE WHEN action = 'UPDATE' THEN p.places ELSE s.places END AS places, CASE WHEN action = 'UPDATE' THEN p.state ELSE s.state END AS state,
               CAST(CASE WHEN action = 'UPDATE' THEN p.closes ELSE s.closes END AS VARCHAR) AS closes FROM snap s LEFT JOIN p ON p.process_id = s.process_id WHERE action IS NULL OR action <> 'DELETE'
        UNION ALL SELECT process_id, name, places, state, CAST(closes AS VARCHAR) FROM p WHERE process_id >= 100000000"""),
    "diff_all": sql("processes", diff("n.closes")),
    "diff_stated": sql("processes", diff("n.closes", "WHERE new IS NOT NULL")),
    "diff_keep_dates": sql("processes", diff("coalesce(n.closes, o.closes)")),
    "silence_technical": sql("changes", f"""
        SELECT change_id, field, 'card' AS kind, old, new, significant AND NOT ({_SILENT}) AS significant FROM changes
        UNION ALL SELECT change_id, field, 'bulletin', old, new, significant AND old IS NOT NULL FROM changes"""),
    "fingerprint_plan": sql("readings", f"""
        , s AS (SELECT * FROM {_LAST.format("WHERE read_at < TIMESTAMP '2024-01-20'")} WHERE content_hash < 'c')
        , n AS (SELECT * REPLACE (CASE WHEN pool_id % 3 = 0 THEN sha256(stage) ELSE content_hash END AS content_hash) FROM {_LAST.format('')})
        , j AS (SELECT n.pool_id, s.content_hash AS old_hash, n.content_hash AS new_hash, concat_ws(',', CASE WHEN s.stage IS DISTINCT FROM n.stage THEN 'stage' END, CASE WHEN s.phase IS DISTINCT FROM n.phase THEN 'phase' END,
                CASE WHEN s.operating IS DISTINCT FROM n.operating THEN 'operating' END, CASE WHEN s.opens IS DISTINCT FROM n.opens THEN 'opens' END, CASE WHEN s.closes IS DISTINCT FROM n.closes THEN 'closes' END) AS c FROM n LEFT JOIN s ON s.pool_id = n.pool_id)
        , a AS (SELECT *, CASE WHEN old_hash IS NULL THEN 'BASELINE' WHEN old_hash = new_hash THEN 'NO_CHANGE' WHEN c = '' THEN 'NOISE' ELSE 'CHANGE' END AS action FROM j)
        SELECT pool_id, action, CASE WHEN action = 'CHANGE' THEN c END AS changed, old_hash, new_hash FROM a"""),
    "needs_refresh": sql("processes", f"{NEW} SELECT process_id, s.name <> n.name OR s.state <> n.state OR (n.closes IS NOT NULL AND s.closes IS DISTINCT FROM n.closes) AS refresh FROM snap s JOIN newer n USING (process_id)"),
    "persistence_plan": sql("processes notices", f"{PORTAL} SELECT stable_id, ref, process_id, action, action = 'INSERT' OR (action = 'LINK_METADATA' AND publish) AS publish, action = 'LINK_METADATA' AND refreshed AS update_metadata FROM a"),
    "may_apply": sql("processes notices", f"{PORTAL} SELECT count(*) AS blocked, count(*) = 0 AS apply FROM a WHERE action = 'BLOCK'"),
    "ad_plan": sql("readings", f"""{ADS}
        SELECT ad_id, CASE WHEN NOT known THEN 'NEW' WHEN coalesce(moved, true) OR xp IS DISTINCT FROM ep OR xe IS DISTINCT FROM ee THEN 'UPDATE' ELSE 'NO_CHANGE' END AS action, known AND NOT adc AS baseline, ep AS pools, ee AS evidence FROM e"""),
    "upsert_edges": sql("readings", f"{EDGES} SELECT coalesce(n.ad_id, o.ad_id) AS ad_id, coalesce(n.ref, o.ref) AS ref, coalesce(n.pool_id, o.pool_id) AS pool_id, coalesce(n.evidence, o.evidence) AS evidence FROM eo o FULL JOIN en n ON n.ad_id = o.ad_id AND n.ref = o.ref"),
    "mark_baseline": sql("notices", "SELECT notice_id, process_id NOT IN (SELECT process_id FROM notices WHERE published < DATE '1998-06-01') AS is_first FROM notices WHERE published >= DATE '1998-06-01'"),
    "fan_out_stage": sql("readings", f"""{EDGES}
        , n AS (SELECT DISTINCT k AS ad_id, CASE WHEN k % 4 <> 0 THEN concat(k, '/24') END AS number, stage, opens AS published, {_STAGEKEY} AS sk, {CLEAN.format(sub(squeeze('stage'), T.STAGE_NOISE, ''))} AS clean FROM readings)
        , told AS (SELECT DISTINCT pool_id, k AS ad_id, {_STAGEKEY} AS sk FROM readings WHERE k % 5 = 2)
        , r AS (SELECT DISTINCT ad_id, pool_id FROM eo WHERE pool_id IS NOT NULL)
        , j AS (SELECT r.pool_id, n.*, concat('ADC:', n.ad_id, ':', left(sha256(sk), 16), ':B', r.pool_id) AS ref FROM n JOIN r USING (ad_id) WHERE sk <> '' AND NOT EXISTS (SELECT 1 FROM told t WHERE t.pool_id = r.pool_id AND t.ad_id = n.ad_id AND t.sk = n.sk))
        , k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY published NULLS LAST, stage) AS rn FROM j)
        SELECT pool_id, ad_id, ref, concat('ADC ', coalesce(number, CAST(ad_id AS VARCHAR)), ': ', coalesce(clean, 'novedad relacionada')) AS title, CAST(published AS VARCHAR) AS published FROM k WHERE rn = 1"""),
    "reassign": sql("notices", "SELECT DISTINCT notice_id, CASE WHEN process_id % 5 = 0 THEN process_id + process_id % 2 ELSE process_id END AS process_id, process_id % 10 = 5 AS moved FROM notices"),
    "patch": sql("processes", """SELECT process_id, concat('extra=', scope, ',origen=', CASE WHEN process_id % 2 = 0 THEN 'NUEVO' ELSE state END, ',url=', coalesce(detail_url, '?')) AS bag, process_id % 2 <> 0 AS contained FROM processes"""),
    "guarded_delete": sql("processes subscriptions", f"{_FOLLOWED} SELECT process_id, coalesce(c, 0) AS followers, CASE WHEN c > 0 THEN 'BLOCKED' ELSE 'DELETE' END AS action FROM processes LEFT JOIN f USING (process_id) WHERE scope = 'NO'"),
    "without": sql("processes subscriptions notices", f"{_FOLLOWED} SELECT notice_id, process_id FROM notices WHERE process_id NOT IN (SELECT process_id FROM processes WHERE scope = 'NO' AND process_id NOT IN (SELECT process_id FROM f))"),
    "fix_shift": sql("processes", f"""
        , n AS (SELECT process_id, shift, {fold("concat_ws(' ', name, CASE WHEN process_id % 3 = 0 THEN 'turno libre' WHEN process_id % 5 = 0 THEN 'discapacidad intelectual' END)")} AS n FROM processes)
        , s AS (SELECT process_id, shift, {shift(X.SHIFT_CORRECTION)} AS new_shift FROM n) SELECT * FROM s WHERE new_shift IS NOT NULL AND new_shift IS DISTINCT FROM shift"""),
    "rescope": sql("processes", f"""
        , g AS (SELECT *, lower({squeeze('strip_accents(name)')}) AS nn FROM processes), a AS (SELECT process_id, scope, {scope('nn', 'nn')} AS auto FROM g)
        SELECT process_id, scope, CASE WHEN process_id % 6 <> 0 AND ((scope = 'REVISION' AND auto <> 'REVISION') OR (scope = 'SI' AND auto = 'NO')) THEN auto ELSE scope END AS new_scope FROM a"""),
    "close_pools": sql("readings", f"""
        , r AS (SELECT *, {OFF} AS off, row_number() OVER (PARTITION BY pool_id ORDER BY read_at DESC, reading_id DESC) AS r FROM readings)
        SELECT a.pool_id, 'EN_CURSO' AS old_state, 'FINALIZADO' AS new_state, concat('Bolsa fuera de funcionamiento: ', a.phase) AS summary FROM r a JOIN r b ON b.pool_id = a.pool_id AND b.r = 2 WHERE a.r = 1 AND a.off AND b.off AND a.pool_id % 4 <> 0"""),
    "apply_subscriptions": sql("subscriptions", """
        , s AS (SELECT user_id, process_id % 50 AS process_id, bool_or(active) AS active, min(since) AS since FROM subscriptions GROUP BY 1, 2)
        , q AS (SELECT user_id, event_id % 70 AS process_id, event_type <> 'error' AS sub, CAST(ts AS DATE) AS asked FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 70 ORDER BY CAST(ts AS DATE) DESC, event_id DESC) = 1)
        SELECT coalesce(s.user_id, q.user_id) AS user_id, coalesce(s.process_id, q.process_id) AS process_id, coalesce(sub, active) AS active, CAST(coalesce(since, asked) AS VARCHAR) AS since,
               CAST(CASE WHEN sub IS NOT NULL AND (sub OR active) THEN asked ELSE since END AS VARCHAR) AS updated
        FROM s FULL JOIN q ON q.user_id = s.user_id AND q.process_id = s.process_id WHERE NOT (s.user_id IS NULL AND NOT sub)"""),
    "replace_children": sql("bodies", """
        , s AS (SELECT process_id, string_split_regex(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM bodies WHERE places > 15)
        SELECT process_id, 1 AS position, name AS text FROM bodies WHERE places IS NULL OR places <= 15
        UNION ALL SELECT process_id, CAST(unnest(range(1, len(s) + 1)) AS INT), trim(unnest(s)) FROM s"""),
    "review_transition": sql("processes", """SELECT process_id,
        CASE WHEN places > 10 THEN CASE process_id % 4 WHEN 0 THEN 'PUBLICADA' WHEN 1 THEN 'DESCARTADA' ELSE 'EN_REVISION' END ELSE CASE WHEN process_id % 2 = 0 THEN 'BORRADOR' ELSE 'PENDIENTE_REVISION' END END AS review_state,
        CAST(CASE WHEN places > 10 AND process_id % 4 < 2 THEN call_date ELSE opens END AS VARCHAR) AS reviewed_at, CASE WHEN places > 10 AND process_id % 4 < 2 THEN agency_id END AS reviewed_by,
        coalesce(CASE WHEN places > 10 AND process_id % 5 = 0 THEN 'nueva' END, CASE WHEN process_id % 3 = 0 THEN 'vieja' END) AS note FROM processes"""),
    "manual_edit": sql("processes", f"{NEW} SELECT n.process_id, CASE WHEN s.process_id IS NULL THEN 'INSERT' WHEN s.process_id % 3 = 0 THEN 'UPDATE' ELSE 'REJECTED' END AS action, n.name, n.places FROM newer n LEFT JOIN snap s ON s.process_id = n.process_id"),
    "manual_scope": sql("processes", "SELECT process_id, CASE WHEN places > 20 AND process_id % 3 = 0 THEN 'SI' WHEN places > 20 AND process_id % 3 = 1 THEN 'NO' ELSE scope END AS scope, CASE WHEN places > 20 AND process_id % 3 < 2 THEN 'MANUAL' END AS decided_by FROM processes"),
    "merge_by_key": sql("notices", """
        , n AS (SELECT process_id, CAST(source_id AS VARCHAR) AS doc, min(n) AS pos, max(title) AS title FROM notices GROUP BY 1, 2)
        , u AS (SELECT process_id, doc, 0 AS side, pos, title FROM n WHERE pos % 3 <> 0 UNION ALL SELECT process_id, doc, 1, pos, CASE WHEN pos % 4 = 0 THEN 'N ' || title END FROM n WHERE pos % 2 = 0)
        SELECT process_id, doc, min({'side': side, 'pos': pos}).side AS side, min({'side': side, 'pos': pos}).pos AS pos, list_extract(list(title ORDER BY side DESC, pos DESC), 1) AS title FROM u GROUP BY 1, 2"""),
}
