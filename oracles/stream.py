from __future__ import annotations

from oracles.views import sql
from oracles.windows import OFF

SQL = {
    "dedup_stream": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM events GROUP BY 1",
    "split_late": "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-05' THEN 'LATE' ELSE 'ON_TIME' END AS part FROM events",
    "closed_days": """
        WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS w FROM events)
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT w FROM m) GROUP BY 1, 2""",
    "track_seen": "SELECT DISTINCT user_id AS pool_id, concat_ws('_', event_type, CAST(json_extract_string(props, '$.k') AS INT) % 20) AS signature, false AS news FROM events",
    "debounce_stream": sql("readings", f"""
        , o AS (SELECT *, {OFF} AS off FROM readings), l AS (SELECT *, lag(off) OVER (PARTITION BY pool_id ORDER BY read_at, reading_id) AS p FROM o)
        SELECT pool_id, reading_id FROM l WHERE off AND p"""),
    "news_from_batches": "SELECT DISTINCT user_id, event_type FROM events",
    "backfill": "SELECT event_type, false AS notify, count(*) AS n FROM events GROUP BY 1",
}
