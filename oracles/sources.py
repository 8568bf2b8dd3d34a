from __future__ import annotations

from oracles.views import sql, squeeze

SQL = {
    "load": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS shipped FROM lineitem WHERE l_quantity > 40",
    "seed": sql("processes", "SELECT process_id, CASE WHEN scope = 'SI' THEN name ELSE concat('seed ', name) END AS name FROM processes"),
    "municipalities": """
        WITH c AS (SELECT p_name, concat(list_extract(['3', '12', '46', '99'], p_partkey % 4 + 1), lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS code, p_partkey % 4 AS k FROM part)
        , d AS (SELECT p_name, lpad(CASE WHEN k = 0 THEN left(code, 4) ELSE left(code, 5) END, 5, '0') AS code FROM c)
        , t AS (SELECT concat('La ', p_name) AS name, p_name, CASE left(code, 2) WHEN '03' THEN 'Alicante' WHEN '12' THEN 'Castellón' WHEN '46' THEN 'Valencia' END AS province FROM d)
        , k AS (SELECT DISTINCT name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS v FROM t)
        , a AS (SELECT name, v, concat('la', v) AS w FROM k)
        , o AS (SELECT name, w AS x FROM a UNION SELECT name, v FROM a
                UNION SELECT name, substr(v, length(p) + 1) FROM a, (SELECT unnest(['la', 'el', 'les', 'los']) AS p) WHERE starts_with(v, p) AND length(v) > length(p)
                UNION SELECT name, left(y, length(y) - length(p)) FROM (SELECT name, v AS y FROM a UNION SELECT name, w FROM a), (SELECT unnest(['la', 'el', 'les', 'los']) AS p) WHERE NOT starts_with(y, p) AND ends_with(y, p) AND length(y) > length(p))
        , l AS (SELECT name, string_agg(x, ',' ORDER BY x) AS aliases FROM o GROUP BY 1)
        SELECT province, name, count(*) AS n, aliases FROM t JOIN l USING (name) WHERE province IS NOT NULL GROUP BY 1, 2, 4""",
    "flatten_summary": sql("notices", """SELECT CAST(published AS VARCHAR) AS published, 'Ayuntamientos' AS heading, notice_id AS item_id, title, url FROM notices WHERE source_id % 3 <> 2
        UNION ALL SELECT CAST(published AS VARCHAR), 'Ayuntamientos', notice_id || '-b', title, url FROM notices WHERE source_id % 3 <> 2 AND n % 2 = 0"""),
    "feed_rows": sql("notices", f"SELECT notice_id, {squeeze('title')} AS title, url, CAST(published AS VARCHAR) AS published FROM notices WHERE n % 3 < 2 AND url IS NOT NULL"),
    "read_feed": sql("processes", "SELECT name AS title, concat('https://a.example/', process_id) AS url, CAST(call_date AS VARCHAR) AS published FROM processes"),
    "normalise_records": sql("processes", """SELECT process_id, CASE WHEN process_id % 9 <> 0 THEN concat('BOPAL:', year(call_date), ':', process_id) ELSE '' END AS ref, process_type AS agency,
        concat_ws(' ', name, category, process_type) AS text FROM processes"""),
    "snapshot_version": sql("processes", "SELECT process_id, name, state FROM processes"),
    "fact_window": sql("notices", "SELECT notice_id, CAST(published AS VARCHAR) AS published FROM notices WHERE published BETWEEN DATE '1997-06-15' AND DATE '1998-02-10'"),
    "write_report": sql("processes", "SELECT process_id, name, state FROM processes WHERE scope = 'REVISION'"),
}
