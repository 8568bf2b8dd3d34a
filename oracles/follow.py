from __future__ import annotations

from edictal import rules as R
from oracles.aggregate import OUTBOX
from oracles.catalogue import ACT, ALL, PRIVATE, inlist
from oracles.views import sql
from oracles.windows import DEDUP

SUBSTANTIVE = f"""
, news AS (
    SELECT notice_id AS news_id, process_id, 'PUBLICACION' AS news_kind, kind, NULL AS field, title AS summary, published AS detected, url FROM notices
    WHERE lower(kind) NOT IN ('navegación', 'navegacion') AND lower(title) <> 'navegación'
    UNION ALL
    SELECT change_id, process_id, 'CAMBIO', 'ACTUALIZACION', field, concat_ws(' -> ', old, new), detected, NULL FROM changes
    WHERE significant AND old IS NOT NULL AND lower(field) IN {inlist(R.RELEVANT_FIELDS)} AND lower(old) NOT IN ('navegación', 'navegacion'))
"""
_LISTED = "SELECT process_id FROM processes WHERE is_opportunity AND scope = 'SI'"

SQL = {
    "my_feed": sql("notices changes processes subscriptions", f"""{SUBSTANTIVE.replace('news AS', 'every AS')}
        , news AS (SELECT * FROM every WHERE detected BETWEEN DATE '1999-06-20' AND DATE '1999-06-30' AND process_id IN ({_LISTED}) AND process_id IN (SELECT process_id FROM subscriptions WHERE active)){DEDUP}
        SELECT news_id, process_id, news_kind, field, clean AS summary, CAST(detected AS VARCHAR) AS detected FROM (SELECT * FROM kept WHERE r = 1 ORDER BY detected DESC NULLS LAST, news_id DESC LIMIT 200)"""),
    "new_news": sql("notices changes processes subscriptions", f"""{SUBSTANTIVE}
        , p AS (SELECT process_id, {PRIVATE} AS private FROM processes WHERE is_opportunity AND scope = 'SI')
        SELECT user_id, process_id, count(*) AS n_news, CAST(max(detected) AS VARCHAR) AS newest FROM subscriptions JOIN p USING (process_id) JOIN news USING (process_id)
        WHERE active AND detected > DATE '2000-01-01' AND detected > since AND (NOT private OR user_id IN (SELECT user_id FROM events WHERE value > 50)) GROUP BY 1, 2"""),
    "interesting": sql("notices changes subscriptions", f"""{SUBSTANTIVE}
        SELECT user_id, process_id, count(*) AS n_news, CAST(max(detected) AS VARCHAR) AS newest FROM subscriptions JOIN news USING (process_id) WHERE active AND detected > since GROUP BY 1, 2"""),
    "new_opportunities": sql(ALL, f"""{ACT}
        , a AS (SELECT * REPLACE (CASE WHEN process_id % 6 = 0 THEN 'Anuncio difícil cobertura (ADC)' ELSE process_type END AS process_type) FROM visible WHERE call_date >= DATE '1999-12-01')
        SELECT process_id, 'NUEVA_OPORTUNIDAD' AS kind, {PRIVATE} AS private FROM a WHERE NOT (process_id % 6 = 0 AND process_id % 12 <> 0) AND process_id NOT IN (SELECT process_id FROM notices WHERE kind = 'BASES')"""),
    "advance_outbox": f"""WITH{OUTBOX[1:]}
        , r AS (SELECT user_id, max(event_id) % 3 <> 0 AS ok FROM events WHERE user_id % 5 <> 1 GROUP BY 1)
        , j AS (SELECT o.*, r.ok, o.user_id IN (SELECT user_id FROM events WHERE value > 80) AS paid, o.state = 'PENDIENTE' AND created > DATE '2024-01-26' AS due FROM outbox o LEFT JOIN r USING (user_id))
        SELECT send_id, user_id, CASE WHEN due AND NOT paid THEN 'DESCARTADA' WHEN due AND ok THEN 'ENVIADA' ELSE state END AS state,
               CASE WHEN due AND NOT paid THEN 'Sin suscripción vigente' WHEN due AND ok = false THEN 'RuntimeError: x' END AS error, CASE WHEN due AND paid AND ok THEN '2024-01-29' END AS sent_on FROM j""",
    "mark_read": sql("subscriptions readings", """
        , s AS (SELECT user_id, min(since) AS last_seen FROM subscriptions GROUP BY 1)
        , r AS (SELECT pool_id AS user_id, max(CAST(closes - INTERVAL 312 MONTH AS DATE)) AS u FROM readings GROUP BY 1)
        SELECT coalesce(s.user_id, r.user_id) AS user_id, CAST(greatest(last_seen, u) AS VARCHAR) AS last_seen FROM s FULL JOIN r ON r.user_id = s.user_id"""),
    "unread": sql("notices changes subscriptions readings", f"""{SUBSTANTIVE}
        , n AS (SELECT user_id, max(detected) AS newest FROM subscriptions JOIN news USING (process_id) WHERE active AND detected > since GROUP BY 1)
        , s AS (SELECT pool_id AS user_id, CAST(max(opens) - INTERVAL 276 MONTH AS DATE) AS seen FROM readings WHERE k > 50 GROUP BY 1)
        SELECT user_id, CAST(newest AS VARCHAR) AS newest FROM n LEFT JOIN s USING (user_id) WHERE seen IS NULL OR newest > seen"""),
    "send_summary": sql("processes", f"""
        , e AS (SELECT {PRIVATE} AS private FROM processes)
        , m AS (SELECT user_id, max(value) > 90 AS entitled FROM events GROUP BY 1)
        SELECT 'FULL' AS audience, (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM m WHERE entitled) AS recipients, (SELECT count(*) FROM e) * (SELECT count(*) FROM m WHERE entitled) AS sends
        UNION ALL SELECT 'GENERAL', (SELECT count(*) FROM e WHERE NOT private), (SELECT count(*) FROM m WHERE NOT entitled), (SELECT count(*) FROM e WHERE NOT private) * (SELECT count(*) FROM m WHERE NOT entitled)"""),
}
