from __future__ import annotations

from edictal import rules as R
from oracles.calendar import TERM
from oracles.catalogue import ACT
from oracles.classify import FOUNDING, has, scope
from oracles.extract import SQL as EXTRACT
from oracles.lifecycle import ACTIONS, EVENTS, POOL, TERMINAL
from oracles.match import CALLF, OWNED, _HALF
from oracles.text import SQL as TEXT
from oracles.views import fold, sql
from oracles.windows import SCORE

CALLS = f"""{OWNED}
, own AS (SELECT process_id, town, province, name AS job, call_date, shift FROM owned)
, calls AS (SELECT DISTINCT notice_id AS call_id, concat_ws('-', ref, n.source_id % 5) AS document_id, CASE WHEN n.n % 11 = 0 THEN 'ANULACION' WHEN n.n % 13 = 0 THEN 'RECTIFICACION' ELSE 'CONVOCATORIA' END AS document_type,
        town, province, job, CASE WHEN n.n % 3 <> 0 THEN n.n % 31 END AS places, n.n % 17 = 0 AS internal, CASE WHEN n.n % 2 = 0 THEN call_date ELSE published END AS base_date, call_date + 45 AS cited, title AS text
    FROM notices n JOIN own USING (process_id))
, forms AS (SELECT *, unnest(list_distinct([{fold('town')}, {fold(_HALF.format(1))}, {fold(_HALF.format(2))}])) AS e FROM calls)
, res AS (SELECT DISTINCT n.process_id, published AS d, {fold(_HALF.format(1))} AS e, province FROM notices n JOIN own USING (process_id) WHERE n.source_id % 3 = 1)
, ev AS (SELECT document_id, CASE WHEN count(DISTINCT r.process_id) = 1 THEN min(r.process_id) END AS ev FROM forms f LEFT JOIN res r ON r.e = f.e AND r.province = f.province AND r.d = f.cited
        WHERE document_type <> 'CONVOCATORIA' GROUP BY 1)
, ag AS (SELECT agency_id, {fold(_HALF.format(2))} AS e, province FROM agencies)
, ow AS (SELECT town, province, CASE WHEN count(DISTINCT ag.agency_id) = 1 THEN min(ag.agency_id) END AS agency_id FROM (SELECT DISTINCT town, province, e FROM forms) f LEFT JOIN ag USING (e, province) GROUP BY 1, 2)
, base AS (SELECT process_id, agency_id, call_date AS d, places, {CALLF} AS f FROM (SELECT *, {fold('name')} AS nt FROM processes) WHERE scope = 'SI')
, cf AS (SELECT c.*, ow.agency_id, {CALLF} AS f FROM (SELECT *, {fold('job')} AS nt FROM calls) c LEFT JOIN ow USING (town, province))
, ln AS (SELECT call_id, count(DISTINCT b.process_id) AS n, min(b.process_id) AS base FROM cf LEFT JOIN base b ON b.agency_id = cf.agency_id AND b.d = cf.base_date AND b.f = cf.f AND (b.places = cf.places OR b.places IS NULL OR cf.places IS NULL) GROUP BY 1)
, kn AS (SELECT process_id AS known, min(notice_id) AS call_id FROM notices WHERE kind = 'BASES' GROUP BY 1)
"""


def decide(stored: str, absorbed: str) -> str:
    return f"""
, dc AS (SELECT cf.call_id, cf.document_id, cf.agency_id, ev.ev, ln.base, kn.known, CASE WHEN province NOT IN ('AFRICA', 'AMERICA', 'ASIA') THEN 'FUERA_ALCANCE'
        WHEN document_type <> 'CONVOCATORIA' THEN CASE WHEN ev.ev IS NOT NULL THEN 'EVENTO_DOCUMENTAL_IDENTIFICADO' ELSE 'EVENTO_DOCUMENTAL_REVISION' END
        WHEN {absorbed} THEN 'ABSORBIDA_BOP_REVISION' WHEN internal THEN 'EXCLUIDA_TURNO_INTERNO' WHEN {stored} THEN 'EXISTENTE_PUBLICACION' WHEN kn.known IS NOT NULL THEN 'EXISTENTE_BOE'
        WHEN ln.n = 1 THEN 'VINCULADA_BOP' WHEN ln.n > 1 THEN 'REVISION_SOLAPAMIENTO' WHEN {scope(fold("concat_ws(' ', job, text)"), fold('job'))} <> 'SI' THEN 'FUERA_AMBITO_ADMINISTRATIVO' ELSE 'NUEVA' END AS decision
    FROM cf LEFT JOIN ev USING (document_id) LEFT JOIN ln USING (call_id) LEFT JOIN kn USING (call_id))
"""


_DOC = "(SELECT concat_ws('-', ref, source_id % 5) FROM notices WHERE n = {})"
_EMPL = f"NOT {has('t', R.NOT_EMPLOYMENT)} AND ({has('t', R.TERMINAL_WORDS)} OR rule IS NOT NULL OR {has('t', R.EMPLOYMENT)})"


def notices_import(stored: str, known: str) -> str:
    return f"""{EVENTS}
, f AS (SELECT DISTINCT ON (notice_id) notice_id, process_id AS pid, ref, source_id, url, published, rule, closes_pools, {fold('title')} AS t, '' AS b, concat(CASE WHEN process_id % 3 = 0 THEN 'D:' ELSE 'N:' END, process_id) AS stable_id FROM events)
, g AS (SELECT *, {FOUNDING} AS base, {_EMPL} AS empl FROM f)
, first AS (SELECT stable_id, arg_min(notice_id, {{'a': published, 'b': notice_id}}) AS fid, min({{'a': published, 'b': notice_id}}) AS fk FROM g WHERE base AND empl GROUP BY 1)
, p AS (SELECT {known} AS stable_id, process_id, {POOL} AS pool FROM processes)
, done AS (SELECT DISTINCT ref, source_id, url, true AS d FROM notices WHERE {stored})
, h AS (SELECT g.*, p.process_id, p.process_id IS NOT NULL AS ex, coalesce(fk < {{'a': g.published, 'b': g.notice_id}}, false) AS later, fid, rule IS NOT NULL AND (NOT coalesce(pool, false) OR closes_pools) AS closing, coalesce(done.d, false) AS dup
    FROM g LEFT JOIN p USING (stable_id) LEFT JOIN first USING (stable_id) LEFT JOIN done ON done.ref IS NOT DISTINCT FROM g.ref AND done.source_id IS NOT DISTINCT FROM g.source_id AND done.url IS NOT DISTINCT FROM g.url)
, im AS (SELECT *, CASE WHEN NOT empl THEN 'IGNORE' WHEN base AND ex THEN 'REFRESH' WHEN base AND fid = notice_id THEN 'CREATE' WHEN base THEN 'REFRESH' WHEN (ex OR later) AND closing THEN 'CLOSE' WHEN ex OR later THEN 'LINK' ELSE 'ORPHAN' END AS action FROM h)
"""


_NAVE = "regexp_replace(regexp_replace({}, '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')"


GROUPS = f"""
, ag AS (SELECT agency_id, regexp_replace(agency_name, ' \\(Sede\\)$', '') AS an FROM agencies)
, tx AS (SELECT b.process_id, CASE WHEN b.process_id % 3 = 0 THEN body END AS call_text, CASE WHEN b.process_id % 2 = 0 THEN concat_ws(' ', body, an) ELSE body END AS document, an FROM bodies b JOIN ag USING (agency_id))
, men AS (SELECT process_id, len(list_filter(string_split(regexp_replace(trim({fold('an')}), '^ayuntamiento\\s+(?:de |del |d'')?', ''), '/'), lambda x: trim({_NAVE.format('x')}) <> '' AND contains({_NAVE.format(fold('document'))}, trim({_NAVE.format('x')})))) > 0 AS m FROM tx)
, c2 AS (SELECT process_id, subgroup AS s2 FROM ({EXTRACT['class_from_subscale']}) WHERE process_id % 3 = 0)
, c3 AS (SELECT process_id, subgroup AS s3, places AS p3, origin AS o3 FROM ({EXTRACT['class_from_table']}) JOIN men USING (process_id) WHERE m)
, c4 AS (SELECT process_id, subgroup AS s4 FROM ({EXTRACT['class_from_name']}))
"""
_SRC = "CASE WHEN s2 IS NOT NULL THEN 'SUBESCALA_BOE' WHEN s3 IS NOT NULL THEN concat('DOCUMENTO_BASES_', o3) WHEN s4 IS NOT NULL THEN 'DEDUCIDO_DEL_NOMBRE' END"
SYLL = f"""
, lb AS ({TEXT['line_block']})
, s AS (SELECT process_id, notice_id, row_number() OVER (PARTITION BY process_id ORDER BY {SCORE} DESC, published DESC NULLS LAST, notice_id DESC) AS r FROM (SELECT DISTINCT ON (notice_id) * FROM notices) WHERE trim(coalesce(url, '')) <> '')
, best AS (SELECT s.process_id, s.notice_id, replace(lb.block, 'º', 'o') AS block FROM s JOIN lb USING (process_id) WHERE r = 1 AND block IS NOT NULL)
"""
CYCLE = f"""{TERM}
, live AS (SELECT *, CASE WHEN opens IS NULL AND closes IS NULL THEN 'FILL' WHEN opens IS NOT NULL AND closes IS NOT NULL THEN CASE WHEN opens <> term_opens OR closes <> term_closes THEN 'DISCREPANCY' END ELSE 'PARTIAL_UNTOUCHED' END AS action
           FROM term WHERE term_closes IS NOT NULL AND NOT {TERMINAL} AND is_opportunity AND scope = 'SI')
, dl AS (SELECT process_id, action, term_opens, term_closes FROM live WHERE action IS NOT NULL)
"""
_AFTER = ACT.replace("FROM processes p JOIN agencies", "FROM later p JOIN agencies").replace("act AS", "act2 AS").replace("urls AS", "urls2 AS").replace("joined AS", "joined2 AS").replace("FROM joined ", "FROM joined2 ").replace("visible AS", "visible2 AS").replace("JOIN act USING", "JOIN act2 USING").replace("JOIN urls USING", "JOIN urls2 USING")
SNAP = f"""{CYCLE}{ACTIONS}
, later AS (SELECT p.* REPLACE (coalesce(a.new_state, p.state) AS state, CASE a.action WHEN 'CLOSE' THEN 'RECONCILIACION' WHEN 'REOPEN' THEN NULL ELSE p.closure_origin END AS closure_origin,
        CASE WHEN dl.action = 'FILL' THEN coalesce(p.opens, dl.term_opens) ELSE p.opens END AS opens, CASE WHEN dl.action = 'FILL' THEN coalesce(p.closes, dl.term_closes) ELSE p.closes END AS closes)
    FROM processes p LEFT JOIN actions a USING (process_id) LEFT JOIN dl USING (process_id))
"""
SQL = {
    "import_calls": sql("notices processes agencies", f"""{CALLS}{decide(f"cf.document_id IN {_DOC.format(7)}", f"cf.document_id IN {_DOC.format(9)}")}
        SELECT call_id, document_id, decision, CASE decision WHEN 'EVENTO_DOCUMENTAL_IDENTIFICADO' THEN ev WHEN 'EXISTENTE_BOE' THEN known WHEN 'VINCULADA_BOP' THEN base WHEN 'EXISTENTE_PUBLICACION' THEN kept END AS process_id, agency_id
        FROM dc LEFT JOIN (SELECT concat_ws('-', ref, source_id % 5) AS document_id, min(process_id) AS kept FROM notices WHERE n = 7 GROUP BY 1) USING (document_id)"""),
    "import_notices": sql("notices processes", f"""{notices_import("published < DATE '1998-01-01'", "concat('D:', process_id)")}
        SELECT notice_id, stable_id, process_id, action, action NOT IN ('IGNORE', 'ORPHAN') AND NOT dup AS publish, CASE WHEN base THEN 'CONVOCATORIA' ELSE 'BOP' END AS kind FROM im"""),
    "import_twice": "SELECT CAST(NULL AS VARCHAR) AS notice_id, CAST(NULL AS VARCHAR) AS action WHERE false",
    "group_pipeline": sql("processes agencies bodies", f"""{GROUPS}
        SELECT p.process_id, left(coalesce(s2, s3, s4), 1) AS grp, coalesce(s2, s3, s4) AS subgroup, {_SRC} AS origin, CASE WHEN s2 IS NULL THEN p3 END AS places
        FROM processes p LEFT JOIN c2 USING (process_id) LEFT JOIN c3 USING (process_id) LEFT JOIN c4 USING (process_id) WHERE p.process_id % 7 <> 0"""),
    "group_declared": sql("processes agencies bodies", f"""{GROUPS}, c1 AS (SELECT process_id, subgroup AS s1 FROM ({EXTRACT['declared_class']}))
        SELECT p.process_id, coalesce(s1, s2, s3, s4) AS subgroup, CASE WHEN s1 IS NOT NULL THEN 'DECLARADO' ELSE {_SRC} END AS origin
        FROM processes p LEFT JOIN c1 USING (process_id) LEFT JOIN c2 USING (process_id) LEFT JOIN c3 USING (process_id) LEFT JOIN c4 USING (process_id)"""),
    "clean_titles": sql("notices", f"""
        , j AS (SELECT DISTINCT * FROM ({TEXT['clean_title']})), k AS (SELECT DISTINCT * FROM ({EXTRACT['places']}))
        SELECT notice_id AS process_id, title AS name, job AS new_name, CASE WHEN n % 2 <> 0 OR n = 0 THEN k.places END AS new_places FROM notices JOIN j USING (notice_id) JOIN k USING (notice_id)
        WHERE regexp_matches(title, '(?i)^anuncio?\\b') AND (job IS NOT NULL OR CASE WHEN n % 2 <> 0 OR n = 0 THEN k.places END IS NOT NULL)"""),
    "syllabus": sql("notices", f"{SYLL} SELECT process_id, notice_id, block FROM best"),
    "topics": sql("notices", f"""{SYLL}
        , l AS (SELECT process_id, list_filter(list_transform(string_split(block, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\x{{A0}}]+', ' ', 'g'))), lambda x: x <> '') AS l FROM best)
        , e AS (SELECT process_id, CAST(unnest(range(len(l))) AS INT) AS position, unnest(l) AS text FROM l) SELECT * FROM e WHERE position > 0"""),
    "quality": sql("processes notices sources agencies changes", """
        , p AS (SELECT * FROM processes WHERE state <> 'EN_CURSO'), s AS (SELECT * FROM sources WHERE active), a AS (SELECT * FROM agencies WHERE active)
        SELECT 'scope_vocabulary' AS rule, count(*) AS bad FROM p WHERE scope NOT IN ('SI', 'NO', 'REVISION')
        UNION ALL SELECT 'source_vocabulary', count(*) FROM s WHERE source_kind NOT IN ('BOP', 'BOE', 'DOGV')
        UNION ALL SELECT 'notice_key_repeated', count(*) FROM (SELECT source_id, ref, url FROM notices GROUP BY ALL HAVING count(*) > 1)
        UNION ALL SELECT 'notice_without_process', count(*) FROM notices WHERE process_id NOT IN (SELECT process_id FROM p)
        UNION ALL SELECT 'notice_without_source', count(*) FROM notices WHERE source_id NOT IN (SELECT source_id FROM s)
        UNION ALL SELECT 'process_without_agency', count(*) FROM p WHERE agency_id NOT IN (SELECT agency_id FROM a)
        UNION ALL SELECT 'process_without_notice', count(*) FROM p WHERE process_id NOT IN (SELECT process_id FROM notices)
        UNION ALL SELECT 'change_without_process', count(*) FROM changes WHERE process_id NOT IN (SELECT process_id FROM p)
        UNION ALL SELECT 'term_reversed', count(*) FROM p WHERE opens > closes"""),
    "review_cycle": sql("notices processes agencies", f"""{CALLS}{decide('false', 'false')}
        {notices_import("published < DATE '1998-01-01'", "CASE WHEN process_id NOT IN (SELECT process_id FROM notices WHERE kind = 'BASES') THEN concat('D:', process_id) END")}
        SELECT 'BOP' AS source, action AS decision, count(*) AS n FROM im GROUP BY 2 UNION ALL SELECT 'BOE', decision, count(*) FROM dc GROUP BY 2"""),
    "cycle_snapshot": sql("processes notices", f"{SNAP} SELECT process_id, state, closure_origin, CAST(opens AS VARCHAR) AS opens, CAST(closes AS VARCHAR) AS closes FROM later"),
    "cycle_summary": sql("processes agencies notices sources bodies", f"""{SNAP}{GROUPS.replace(', ag AS', ', ag9 AS').replace('JOIN ag USING', 'JOIN ag9 USING')}
        , grp AS (SELECT {_SRC} AS origin FROM processes LEFT JOIN c2 USING (process_id) LEFT JOIN c3 USING (process_id) LEFT JOIN c4 USING (process_id))
        {ACT}{_AFTER}
        , fresh AS (SELECT process_id FROM visible2 WHERE process_id NOT IN (SELECT process_id FROM visible) AND process_id NOT IN (SELECT process_id FROM notices WHERE kind = 'convocatoria'))
        SELECT 'deadlines' AS step, action, count(*) AS n FROM dl GROUP BY 2 UNION ALL SELECT 'groups', coalesce(origin, 'SIN_CLASIFICAR'), count(*) FROM grp GROUP BY 2
        UNION ALL SELECT 'closures', action, count(*) FROM actions GROUP BY 2 UNION ALL SELECT 'events', 'NUEVA_OPORTUNIDAD', count(*) FROM fresh HAVING count(*) > 0"""),
}
