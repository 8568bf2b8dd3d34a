from __future__ import annotations

from edictal.functions import text as T
from oracles.text import CLEAN, NEWS, sub
from oracles.views import fold, sql, squeeze

_CLEAN = CLEAN.format(sub(squeeze("summary"), NEWS, ""))
NEWS_UNION = """
, news AS (
    SELECT notice_id AS news_id, process_id, 'PUBLICACION' AS news_kind, kind, NULL AS field, title AS summary, published AS detected, true AS significant, url FROM notices
    UNION ALL
    SELECT change_id, process_id, 'CAMBIO', 'ACTUALIZACION', field, concat_ws(' -> ', old, new), detected, significant, NULL FROM changes)
"""
RANK = """CASE WHEN upper(trim(coalesce(kind, ''))) = 'BASES' THEN 0 WHEN upper(trim(coalesce(kind, ''))) = 'CONVOCATORIA' THEN 1 WHEN lower(kind) LIKE '%convoc%' THEN 2
    WHEN lower(title) LIKE '%convoc%' THEN 3 WHEN lower(url) LIKE '%bop.dival.es%' THEN 4 WHEN lower(url) LIKE '%boe.es%' THEN 6 ELSE 5 END"""
DEDUP = f"""
, cleaned AS (SELECT *, coalesce({_CLEAN}, summary) AS clean FROM news)
, keyed AS (SELECT *, coalesce(trim(regexp_replace({fold('clean')}, '[^a-z0-9]+', ' ', 'g')), '') AS k FROM cleaned)
, kept AS (SELECT *, row_number() OVER (PARTITION BY process_id, news_kind, coalesce(upper(kind), ''), coalesce(lower(field), ''), k, url ORDER BY detected, news_id) AS r FROM keyed)
"""
SCORE = """(CASE WHEN lower(kind) IN ('convocatoria', 'bases') THEN 100 ELSE 0 END + CASE WHEN lower(kind) LIKE '%convoc%' THEN 60 ELSE 0 END
    + CASE WHEN lower(kind) LIKE '%base%' OR lower(title) LIKE '%bases%' THEN 50 ELSE 0 END + CASE WHEN lower(title) LIKE '%convoc%' THEN 30 ELSE 0 END
    + CASE WHEN lower(url) LIKE '%boe.es%' THEN 20 ELSE 0 END + CASE WHEN lower(url) LIKE '%bop%' THEN 15 ELSE 0 END
    - CASE WHEN regexp_matches(lower(title), 'tribunal|admit|resultado|nombr') THEN 100 ELSE 0 END)"""
OFF = f"(trim(phase) <> '' AND NOT regexp_matches(left(trim({fold('phase')}), 80), 'en funcionamient|en funcionament'))"

SQL = {
    "first_by": sql("notices", """
        , r AS (SELECT *, row_number() OVER (PARTITION BY process_id, ref ORDER BY published NULLS LAST, notice_id) AS r FROM notices)
        SELECT process_id, ref, notice_id FROM r WHERE r = 1"""),
    "dedup_news": sql("notices changes", f"{NEWS_UNION}{DEDUP} SELECT news_id, process_id, news_kind, kind, field, clean AS summary, url, CAST(detected AS VARCHAR) AS detected FROM kept WHERE r = 1"),
    "best_url": sql("notices", f"""
        , r AS (SELECT process_id, url, row_number() OVER (PARTITION BY process_id ORDER BY {RANK}, published NULLS LAST, notice_id) AS r FROM notices WHERE trim(coalesce(url, '')) <> '')
        SELECT p.process_id, r.url AS best_url FROM (SELECT DISTINCT process_id FROM notices) p LEFT JOIN r ON r.process_id = p.process_id AND r.r = 1"""),
    "rank_sources": sql("notices", f"""
        , s AS (SELECT *, CAST({SCORE} AS INT) AS score FROM notices WHERE trim(coalesce(url, '')) <> '')
        , r AS (SELECT *, CAST(row_number() OVER (PARTITION BY process_id ORDER BY score DESC, published DESC NULLS LAST, notice_id DESC) AS INT) AS rank FROM s)
        SELECT process_id, notice_id, score, rank FROM r"""),
    "first_non_null": sql("notices", """
        SELECT process_id, first(url ORDER BY published, notice_id) FILTER (WHERE url IS NOT NULL) AS url, first(n ORDER BY published, notice_id) FILTER (WHERE n % 3 = 0) AS code
        FROM notices GROUP BY 1"""),
    "debounce": sql("readings", f"""
        , r AS (SELECT *, {OFF} AS off, row_number() OVER (PARTITION BY pool_id ORDER BY read_at DESC, reading_id DESC) AS r FROM readings)
        SELECT a.pool_id, a.phase, coalesce(a.off AND b.off, false) AS "close" FROM r a LEFT JOIN r b ON b.pool_id = a.pool_id AND b.r = 2 WHERE a.r = 1"""),
    "transitions": sql("readings", """
        , r AS (SELECT *, lag(stage) OVER (PARTITION BY pool_id ORDER BY read_at, reading_id) AS old_stage FROM readings)
        SELECT reading_id, pool_id, old_stage, stage, concat('Nueva etapa del proceso: ', stage) AS summary FROM r WHERE old_stage <> stage"""),
    "slices": sql("processes", """
        , p AS (SELECT process_id, call_date, coalesce(closes, call_date + 40) AS last FROM processes)
        , s AS (SELECT process_id, last, CAST(unnest(range(call_date, last + INTERVAL 1 DAY, INTERVAL 7 DAY)) AS DATE) AS f FROM p)
        SELECT process_id, CAST(f AS VARCHAR) AS slice_from, CAST(least(f + 6, last) AS VARCHAR) AS slice_to FROM s"""),
    "neighbourhood": sql("processes", "SELECT DISTINCT CAST(exam_date + o AS VARCHAR) AS day FROM processes, (SELECT CAST(unnest(range(-5, 6)) AS INT) AS o) WHERE exam_date IS NOT NULL"),
    "top_catalogue": sql("processes", "SELECT process_id, name FROM processes ORDER BY coalesce(exam_date, call_date, opens) DESC NULLS LAST, process_id DESC LIMIT 200"),
    "review_queue": sql("processes", """SELECT process_id, scope, CAST(coalesce(exam_date, closes) AS VARCHAR) AS updated FROM processes
        ORDER BY CASE scope WHEN 'REVISION' THEN 0 WHEN 'SI' THEN 1 ELSE 2 END, coalesce(exam_date, closes) DESC NULLS LAST, process_id DESC LIMIT 300"""),
    "history": sql("notices", """
        , b AS (SELECT process_id FROM notices GROUP BY 1 ORDER BY count(*) DESC, process_id LIMIT 1)
        SELECT notice_id, title, CAST(published AS VARCHAR) AS published FROM notices WHERE process_id = (SELECT process_id FROM b) ORDER BY published DESC NULLS LAST, notice_id DESC LIMIT 200"""),
    "batch_after": sql("processes", """SELECT process_id, CAST(closes AS VARCHAR) AS updated FROM processes
        WHERE process_id > 100 AND (process_id % 3 <> 0 OR process_id % 2 <> 0 OR process_id % 5 = 0) ORDER BY closes DESC NULLS LAST, process_id LIMIT 500"""),
    "pending": sql("processes", "SELECT process_id, CAST(call_date AS VARCHAR) AS updated FROM processes WHERE scope = 'REVISION' ORDER BY call_date DESC, process_id DESC LIMIT 100"),
}
