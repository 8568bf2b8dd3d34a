from __future__ import annotations

from edictal import rules as R
from edictal.functions import classify as C
from oracles.classify import CLEAR, family, has, hit, notice_class
from oracles.text import identity, words
from oracles.views import fold, got, q, sql
from oracles.windows import NEWS_UNION, RANK

OWNED = ", owned AS (SELECT * FROM processes JOIN agencies USING (agency_id))"
ONE = "CASE WHEN count(DISTINCT {0}) = 1 THEN min({0}) END AS match_id, CASE count(DISTINCT {0}) WHEN 0 THEN 'NONE' WHEN 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status"
CALLF = family("nt", R.FAMILIES_CALL)
_HALF = "split_part(town, '/', {})"
_TOWN = r"(?:ayuntamiento|ajuntament)\s+(?:del|de)\s+(.+?)(?:\s+sobre\b|\s+per\s+a\b|\s+para\b|[.,;:]|$)"
_ELIDED = r"(?:ayuntamiento|ajuntament)\s+d['’]\s*(.+?)(?:\s+sobre\b|\s+per\s+a\b|\s+para\b|[.,;:]|$)"
_STRICT = r"^(?:anunci|anuncio)\s+(?:(?:de|del)\s+)?(?:l['’]\s*)?(?:ayuntamiento|ajuntament)\s+(?:de|del|d['’])\s+"
FOLLOWS = f"""
, fu AS (SELECT notice_id, title, published, nt, coalesce({got('nt', _TOWN)}, {got('nt', _ELIDED)}) AS town
         FROM (SELECT *, {fold('title')} AS nt FROM notices) WHERE {hit('nt', _STRICT)})
"""


def code(n: str) -> str:
    return (
        f"upper(rtrim(coalesce({got(n, r'\b(?:expedient|expediente)\s*(?:num\.?|numero)?\s*[:.-]?\s*([a-z0-9][a-z0-9._/-]{3,})')}, "
        f"{got(n, r'\b(?:codi|codigo)\s+(?:de\s+)?convocatoria\s*[:.-]?\s*([a-z0-9][a-z0-9._/-]{3,})')}), '.,;:'))"
    )


def keys(x: str) -> str:
    k = f"regexp_replace({fold(x)}, '[^a-z0-9]', '', 'g')"
    parts = [k]
    for a in ("la", "el", "les", "los"):
        parts.append(f"CASE WHEN length({k}) > {len(a)} THEN CASE WHEN starts_with({k}, '{a}') THEN substr({k}, {len(a) + 1}) WHEN ends_with({k}, '{a}') THEN left({k}, length({k}) - {len(a)}) END END")
    return f"[{', '.join(parts)}]"


_NEED = f"CASE WHEN {has('nt', C.RESERVE)} THEN 'RESERVE' WHEN {hit('nt', r'\b(?:turno|torn)\s+(?:libre|lliure)\b')} THEN 'OPEN' ELSE 'ANY' END"
_GIVES = f"CASE WHEN {has('s', C.RESERVE)} THEN 'RESERVE' WHEN {has('s', ('libre', 'lliure'))} THEN 'OPEN' ELSE 'OTHER' END"
_SPEC = "list_filter({}, lambda x: NOT starts_with(x, 'CODIGO'))"
_CODES = "list_filter({}, lambda x: starts_with(x, 'CODIGO'))"
_POOLKEY = """CASE WHEN contains(r, '/') THEN r WHEN regexp_full_match(r, '\\d{2,4}(?:-?[BL])?') THEN regexp_replace(r, '^(\\d+)-?([BL])$', '\\1-\\2') END"""

SQL = {
    "enrich": sql("processes agencies", f"{OWNED} SELECT process_id, agency_name, province FROM owned"),
    "unique_match": sql("notices processes", """
        , b AS (SELECT agency_id, call_date, min(process_id) AS lo, count(*) AS n FROM processes GROUP BY 1, 2)
        SELECT notice_id, coalesce(b.n, 0) AS n, CASE WHEN b.n = 1 THEN lo END AS match_id, CASE WHEN b.n IS NULL THEN 'NONE' WHEN b.n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status
        FROM notices n LEFT JOIN b ON b.agency_id = n.source_id % 25 AND b.call_date = n.published"""),
    "resolve_source": sql("notices sources", """
        , s AS (SELECT source_id, right(source_name, 2) AS k FROM sources WHERE active AND source_kind = 'BOP')
        , b AS (SELECT k, min(source_id) AS lo, count(*) AS n FROM s GROUP BY 1)
        SELECT notice_id, coalesce(b.n, 0) AS n, CASE WHEN b.n = 1 THEN lo END AS match_id, CASE WHEN b.n IS NULL THEN 'no encontrada' WHEN b.n > 1 THEN 'ambigua' END AS error
        FROM notices n LEFT JOIN b ON b.k = lpad(CAST(n.source_id % 100 AS VARCHAR), 2, '0')"""),
    "resolve_agency": sql("processes agencies", f"""{OWNED}
        , a AS (SELECT agency_id, agency_kind, province, {_HALF.format(1)} AS t, {_HALF.format(2)} AS t2 FROM agencies WHERE active)
        , town AS (SELECT DISTINCT agency_id AS ine, province, unnest(list_concat({keys(_HALF.format(1))}, {keys(_HALF.format(2))})) AS k FROM agencies)
        , r AS (SELECT process_id AS ref_id, agency_kind, province, concat(CASE WHEN process_id % 3 = 0 THEN 'La ' ELSE '' END, split_part(town, '/', CAST(process_id % 2 + 1 AS INT))) AS t FROM owned)
        , u AS (SELECT DISTINCT agency_kind, province, t FROM r)
        , m AS (SELECT u.*, a.agency_id FROM u JOIN a ON a.agency_kind = u.agency_kind AND a.province = u.province AND {fold('a.t')} = {fold('u.t')}
                UNION SELECT u.agency_kind, u.province, u.t, a.agency_id FROM (SELECT *, unnest({keys('t')}) AS k FROM u WHERE agency_kind = 'AYUNTAMIENTO') u
                JOIN town w ON w.province = u.province AND w.k = u.k JOIN town x ON x.ine = w.ine AND x.province = w.province
                JOIN (SELECT *, unnest({keys('t')}) AS k FROM a WHERE agency_kind = 'AYUNTAMIENTO') a ON a.k = x.k AND a.province = u.province)
        , s AS (SELECT agency_kind, province, t, min(agency_id) AS lo, max(agency_id) AS hi FROM m GROUP BY ALL)
        SELECT ref_id, CASE WHEN lo = hi THEN lo END AS match_id, CASE WHEN lo IS NULL THEN 'NONE' WHEN lo = hi THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status
        FROM r LEFT JOIN s USING (agency_kind, province, t)"""),
    "match_call_to_base": sql("notices processes", f"""
        , p AS (SELECT process_id, agency_id, call_date AS d, places, {CALLF} AS f FROM (SELECT *, {fold('name')} AS nt FROM processes))
        , c AS (SELECT notice_id AS call_id, source_id % 25 AS agency_id, published AS d, {CALLF} AS f, CASE WHEN n % 3 <> 0 THEN n % 31 END AS places FROM (SELECT *, {fold('title')} AS nt FROM notices))
        SELECT call_id, {ONE.format('p.process_id')} FROM c LEFT JOIN p ON p.agency_id = c.agency_id AND p.d = c.d AND p.f = c.f AND (p.places = c.places OR p.places IS NULL OR c.places IS NULL) GROUP BY 1"""),
    "recover_calls": sql("notices processes agencies", f"""{OWNED}
        , p AS (SELECT process_id, places, province, call_date AS d, {CALLF} AS f, lower(strip_accents({_HALF.format(1)})) AS e FROM (SELECT *, {fold('name')} AS nt FROM owned))
        , c AS (SELECT concat_ws('-', process_id, n.source_id % 3) AS doc, o.province, o.town, o.call_date AS d, {CALLF} AS f, CASE WHEN n.n % 5 <> 0 THEN n.n % 31 END AS places, n.published
                FROM notices n JOIN (SELECT *, {fold('name')} AS nt FROM owned) o USING (process_id))
        , v AS (SELECT *, unnest(list_distinct([{fold('town')}, {fold(_HALF.format(1))}, {fold(_HALF.format(2))}])) AS e FROM c
                WHERE f IS NOT NULL AND published BETWEEN greatest(d, DATE '2001-06-30' - 1999) AND DATE '2001-06-30')
        , g AS (SELECT province, d, e, f, doc, sum(places) AS places FROM v GROUP BY ALL)
        , j AS (SELECT p.process_id, any_value(p.places) AS pp, count(g.doc) AS n, min(g.doc) AS doc, sum(coalesce(g.places, 0)) FILTER (WHERE g.doc IS NOT NULL) AS call_places, min(g.places) AS one
                FROM p LEFT JOIN g ON g.province = p.province AND g.d = p.d AND g.e = p.e AND g.f = p.f GROUP BY 1)
        , s AS (SELECT *, CASE WHEN n = 0 THEN 'NONE' WHEN n > 1 OR coalesce(one <> pp, false) THEN 'AGGREGATE' ELSE 'UNIQUE' END AS status FROM j)
        SELECT process_id, n, status, CASE WHEN status = 'UNIQUE' THEN doc END AS document_id, CAST(call_places AS BIGINT) AS call_places, n = 1 AND coalesce(pp > 0 AND one = pp, false) AS complete FROM s"""),
    "match_follow_up": sql("notices processes agencies", f"""{OWNED}{FOLLOWS}
        , p AS (SELECT process_id, call_date, {family('nt', R.FAMILIES_TITLE)} AS f, {code('nt')} AS c, unnest(string_split({fold('town')}, '/')) AS t
                FROM (SELECT *, {fold('name')} AS nt FROM owned) WHERE state = 'EN_CURSO' AND call_date IS NOT NULL)
        , n AS (SELECT *, {family('nt', R.FAMILIES_TITLE)} AS f, {code('nt')} AS c, {CLEAR} AS clear FROM fu)
        , two AS (SELECT t, f, min(call_date) AS d1, list_sort(list({{'d': call_date, 'i': process_id}}))[1:2] AS l FROM p WHERE f IS NOT NULL GROUP BY 1, 2)
        , twoc AS (SELECT t, f, c, list_sort(list({{'d': call_date, 'i': process_id}}))[1:2] AS l FROM p WHERE f IS NOT NULL AND c IS NOT NULL GROUP BY 1, 2, 3)
        , j AS (SELECT notice_id, n.f, n.c, clear, coalesce(list_filter(two.l, lambda x: x.d <= published), []) AS a, coalesce(list_filter(twoc.l, lambda x: x.d <= published), []) AS b
                FROM n LEFT JOIN two ON two.t = trim(n.town) AND two.f = n.f LEFT JOIN twoc ON twoc.t = trim(n.town) AND twoc.f = n.f AND twoc.c = n.c)
        , r AS (SELECT *, CASE WHEN f IS NULL THEN 'SIN_FAMILIA' WHEN NOT clear THEN 'NO_ES_CONTINUIDAD_SELECTIVA' WHEN len(a) = 0 THEN 'SIN_COINCIDENCIA'
                WHEN c IS NOT NULL THEN CASE len(b) WHEN 1 THEN 'CODIGO_EXACTO' WHEN 0 THEN 'CODIGO_SIN_COINCIDENCIA' ELSE 'CODIGO_AMBIGUO' END
                WHEN len(a) = 1 THEN 'UNICO_HITO_SELECTIVO' ELSE 'AMBIGUO_SIN_CODIGO' END AS reason FROM j)
        SELECT notice_id, reason, CASE reason WHEN 'CODIGO_EXACTO' THEN b[1].i WHEN 'UNICO_HITO_SELECTIVO' THEN a[1].i END AS match_id FROM r"""),
    "match_by_content": sql("notices processes agencies", f"""{OWNED}{FOLLOWS}
        , p AS (SELECT process_id, {_GIVES} AS g, {words('nm', 4, R.STOPWORDS_FOLLOW_UP, None)} AS w,
                       unnest(list_distinct([{fold(_HALF.format(1))}, trim(replace({fold('agency_name')}, 'ayuntamiento de ', ''))])) AS t
                FROM (SELECT *, {fold('shift')} AS s, concat_ws(' ', name, concat('plaza', process_id % 50)) AS nm FROM owned))
        , n AS (SELECT notice_id, trim(town) AS t, {_NEED} AS need, {words('ti', 4, R.STOPWORDS_FOLLOW_UP, None)} AS w
                FROM (SELECT notice_id, town, {fold('ti')} AS nt, ti FROM (SELECT *, concat_ws(' ', title, 'plaza', concat('plaza', length(title) % 50)) AS ti FROM fu)))
        , sets AS (SELECT t, g, w, min(process_id) AS lo, max(process_id) AS hi FROM p GROUP BY 1, 2, 3)
        , asks AS (SELECT DISTINCT t, need, w FROM n)
        , pairs AS (SELECT a.t, a.need, a.w AS aw, s.lo, s.hi, len(list_intersect(a.w, s.w)) AS score FROM asks a JOIN sets s ON s.t = a.t AND (a.need = 'ANY' OR a.need = s.g))
        , top AS (SELECT t, need, aw, max(score) AS best, min(lo) AS lo, max(hi) AS hi FROM pairs GROUP BY 1, 2, 3)
        , tie AS (SELECT t, need, aw, min(p.lo) AS blo, max(p.hi) AS bhi FROM pairs p JOIN top USING (t, need, aw) WHERE score = best AND best > 0 GROUP BY 1, 2, 3)
        , known AS (SELECT DISTINCT t FROM sets)
        , r AS (SELECT notice_id, top.lo, tie.blo, CASE WHEN known.t IS NULL THEN 'SIN_PROCESO_MUNICIPIO' WHEN n.need <> 'ANY' AND top.lo IS NULL THEN 'TURNO_INCOMPATIBLE'
                WHEN n.need <> 'ANY' AND top.lo = top.hi THEN 'MUNICIPIO_TURNO' WHEN top.lo = top.hi THEN 'MUNICIPIO_UNICO' WHEN coalesce(blo = bhi, false) THEN 'MUNICIPIO_DENOMINACION' ELSE 'AMBIGUO' END AS reason
                FROM n LEFT JOIN known ON known.t = n.t LEFT JOIN top ON top.t = n.t AND top.need = n.need AND top.aw = n.w LEFT JOIN tie ON tie.t = n.t AND tie.need = n.need AND tie.aw = n.w)
        SELECT notice_id, reason, CASE WHEN reason IN ('MUNICIPIO_TURNO', 'MUNICIPIO_UNICO') THEN lo WHEN reason = 'MUNICIPIO_DENOMINACION' THEN blo END AS match_id FROM r"""),
    "best_notice": sql("notices processes agencies", f"""{OWNED}
        , p AS (SELECT process_id, call_date AS d, {fold(_HALF.format(1))} AS e, {words(_HALF.format(1), 3, ('ayuntamiento', 'ajuntament', 'mancomunidad', 'mancomunitat'), R.TOKEN_ALIAS)} AS ew, {words('name', 4, R.STOPWORDS_BASES, R.TOKEN_ALIAS)} AS pw FROM owned)
        , n AS (SELECT notice_id, published AS d, {notice_class('nt')} = 'NUEVA_CONVOCATORIA' AS new, {words('ti', 3, (), R.TOKEN_ALIAS)} AS tw, {words('ti', 4, R.STOPWORDS_BASES, R.TOKEN_ALIAS)} AS nw,
                       CASE WHEN {hit('nt', _STRICT)} THEN coalesce({got('nt', _TOWN)}, {got('nt', _ELIDED)}) END AS town
                FROM (SELECT notice_id, published, ti, {fold('ti')} AS nt FROM (SELECT *, concat_ws(' ', title, CASE WHEN n % 2 = 0 THEN concat('de NATION_', n % 25) END) AS ti FROM notices)))
        , c AS (SELECT process_id, notice_id, new, len(list_intersect(pw, nw)) AS common, -len(list_filter(nw, lambda x: NOT list_contains(pw, x))) AS extra
                FROM p JOIN n ON n.d = p.d AND (n.town = p.e OR (len(ew) > 0 AND list_has_all(tw, ew))))
        , f AS (SELECT * FROM c QUALIFY new = max(new) OVER (PARTITION BY process_id))
        , s AS (SELECT process_id, count(*) AS n, min(notice_id) AS sole, max({{'a': common, 'b': extra}}) AS best FROM f GROUP BY 1)
        , t AS (SELECT f.process_id, count(*) AS ties, min(notice_id) AS id FROM f JOIN s USING (process_id) WHERE common = best.a AND extra = best.b GROUP BY 1)
        , r AS (SELECT p.process_id, s.n, CASE WHEN s.n = 1 THEN sole WHEN ties = 1 AND best.a > 0 THEN id END AS match_id FROM p LEFT JOIN s USING (process_id) LEFT JOIN t USING (process_id))
        SELECT process_id, CASE WHEN n IS NULL THEN 'NONE' WHEN match_id IS NULL THEN 'AMBIGUOUS' ELSE 'UNIQUE' END AS status, match_id FROM r"""),
    "match_document_event": sql("notices processes agencies", f"""{OWNED}
        , r AS (SELECT DISTINCT process_id, {fold(_HALF.format(2))} AS e, lower(province) AS province, published AS d FROM notices n JOIN (SELECT process_id, town, province FROM owned) o USING (process_id) WHERE n.source_id % 3 = 1)
        , v AS (SELECT process_id AS document_id, lower(province) AS province, call_date + 60 AS d, unnest(list_distinct([{fold('town')}, {fold(_HALF.format(1))}, {fold(_HALF.format(2))}])) AS e FROM owned)
        SELECT document_id, {ONE.format('r.process_id')} FROM v LEFT JOIN r ON r.e = v.e AND r.province = v.province AND r.d = v.d GROUP BY 1"""),
    "match_two_entities": sql("notices processes agencies", f"""{OWNED}
        , r AS (SELECT DISTINCT process_id, {fold(_HALF.format(2))} AS e, lower(province) AS province, published AS d FROM notices n JOIN (SELECT process_id, town, province FROM owned) o USING (process_id) WHERE n.source_id % 3 = 1)
        , o AS (SELECT process_id AS document_id, concat('Ayuntamiento de ', town) AS entity, lower(province) AS province, call_date + 60 AS d, unnest(list_distinct([{fold('town')}, {fold(_HALF.format(1))}, {fold(_HALF.format(2))}])) AS e FROM owned)
        SELECT document_id, entity, {ONE.format('r.process_id')} FROM o LEFT JOIN r ON r.e = o.e AND r.province = o.province AND r.d = o.d GROUP BY 1, 2
        UNION ALL SELECT process_id, concat('Ayuntamiento de ', town, ' de Abajo'), NULL, 'NONE' FROM owned"""),
    "match_identity": sql("notices processes", f"""
        , p AS (SELECT process_id, {identity("concat_ws(' ', name, 'convocatoria', concat(places, CASE WHEN places IS NOT NULL THEN '/1999' END))")} AS t FROM processes)
        , d AS (SELECT {identity('title')} AS t, count(*) AS n, min(notice_id) AS lo, max(notice_id) AS hi FROM notices GROUP BY 1)
        , u AS (SELECT DISTINCT t FROM p)
        , m AS (SELECT u.t, sum(d.n) AS n, min(d.lo) AS lo, max(d.hi) AS hi FROM u JOIN d ON list_has_any({_SPEC.format('u.t')}, d.t) AND (len({_CODES.format('u.t')}) = 0 OR list_has_any({_CODES.format('u.t')}, d.t)) GROUP BY 1)
        SELECT process_id, CAST(coalesce(n, 0) AS BIGINT) AS n, lo AS first_id, hi AS last_id FROM p LEFT JOIN m USING (t)"""),
    "match_signature": sql("notices", """
        , g AS (SELECT page_id, concat(html, ' /pdf/', page_id % 9 + 1992, '_', page_id % 47, '_es.pdf') AS html FROM pages)
        , s AS (SELECT DISTINCT concat_ws('_', year(published), n) AS signature FROM notices)
        , m AS (SELECT signature, count(page_id) AS n, min(page_id) AS lo FROM s LEFT JOIN g ON contains(g.html, s.signature) GROUP BY 1)
        SELECT notice_id, m.n, CASE WHEN m.n = 1 THEN lo END AS match_id, CASE WHEN m.n = 0 THEN 'NONE' WHEN m.n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status
        FROM notices x JOIN m ON m.signature = concat_ws('_', year(x.published), x.n)"""),
    "resolve_pool_refs": sql("notices processes", f"""
        , p AS (SELECT process_id AS pool_id, concat_ws(' ', name, concat(process_id % 900 + 100, '-L')) AS t FROM processes WHERE starts_with(name, 'Bolsa'))
        , k AS (SELECT DISTINCT pool_id, k FROM (
            SELECT pool_id, upper(unnest(regexp_extract_all(t, '(?i)(?:^|[^0-9])(\\d{{2,4}}-[BL])\\b', 1))) AS k FROM p
            UNION SELECT pool_id, split_part(unnest(regexp_extract_all(t, '(?i)(?:^|[^0-9])(\\d{{2,4}}-[BL])\\b', 1)), '-', 1) FROM p
            UNION SELECT pool_id, unnest(regexp_extract_all(t, '(?i)(?:^|[^0-9A-Za-z])B-(\\d{{2,4}}/\\d{{2,4}})\\b', 1)) FROM p))
        , b AS (SELECT k, count(*) AS n, min(pool_id) AS lo FROM k GROUP BY 1)
        , f AS (SELECT notice_id AS ad_id, CASE n % 4 WHEN 0 THEN concat(n, '-b') WHEN 1 THEN concat('5', n, '/22') WHEN 2 THEN concat(source_id % 900 + 100, ' L') ELSE CAST(n * 20 AS VARCHAR) END AS ref FROM notices)
        , g AS (SELECT ad_id, ref, {_POOLKEY} AS k FROM (SELECT *, trim(replace(upper(ref), ' ', '')) AS r FROM f))
        SELECT ad_id, ref, coalesce(b.n, 0) AS n, CASE WHEN b.n = 1 THEN lo END AS match_id, CASE WHEN b.n IS NULL THEN 'NONE' WHEN b.n = 1 THEN 'UNIQUE' ELSE 'AMBIGUOUS' END AS status FROM g LEFT JOIN b USING (k)"""),
    "match_any_id": sql("notices processes", """
        , n AS (SELECT notice_id AS new_id, CASE WHEN n % 2 = 0 THEN process_id END AS s, CASE WHEN n % 3 = 0 THEN process_id + 1 END AS e FROM notices)
        , a AS (SELECT new_id, s AS m FROM n WHERE s IN (SELECT process_id FROM processes) UNION SELECT new_id, e - 7 FROM n WHERE (e - 7) % 2 = 0 AND e - 7 IN (SELECT process_id FROM processes))
        SELECT n.new_id, CASE WHEN count(DISTINCT m) = 1 THEN min(m) END AS match_id, CASE count(DISTINCT m) WHEN 0 THEN 'NONE' WHEN 1 THEN 'UNIQUE' ELSE 'CONFLICT' END AS status
        FROM n LEFT JOIN a ON a.new_id = n.new_id GROUP BY 1"""),
    "keep_in": sql("processes subscriptions", "SELECT process_id, name FROM processes WHERE process_id IN (SELECT process_id FROM subscriptions WHERE active)"),
    "keep_not_in": sql("processes notices sources", "SELECT process_id, name FROM processes WHERE process_id NOT IN (SELECT process_id FROM notices WHERE source_id IN (SELECT source_id FROM sources WHERE source_kind = 'BOE'))"),
    "with_activity": sql("processes notices sources", f"""
        , u AS (SELECT process_id, url, row_number() OVER (PARTITION BY process_id ORDER BY {RANK}, published NULLS LAST, notice_id) AS r FROM notices WHERE trim(coalesce(url, '')) <> '')
        SELECT process_id, CAST((SELECT max(published) FROM notices n WHERE n.process_id = p.process_id) AS VARCHAR) AS last_notice,
               CAST((SELECT max(published) FROM notices n JOIN sources s USING (source_id) WHERE n.process_id = p.process_id AND source_kind = 'BOE') AS VARCHAR) AS last_gazette,
               CAST((SELECT min(published) FROM notices n JOIN sources s USING (source_id) WHERE n.process_id = p.process_id AND source_kind = 'BOP' AND lower(title) LIKE '%bases%') AS VARCHAR) AS first_base,
               (SELECT url FROM u WHERE u.process_id = p.process_id AND r = 1) AS best_url
        FROM processes p"""),
    "news_counts": sql("notices changes subscriptions", f"""{NEWS_UNION}
        SELECT user_id, process_id, CAST(since AS VARCHAR) AS since, count(*) AS n_news, CAST(max(detected) AS VARCHAR) AS newest
        FROM subscriptions JOIN news USING (process_id) WHERE active AND detected > since GROUP BY user_id, process_id, since"""),
    "fan_out_events": sql("processes", """
        , p AS (SELECT process_id, lower(trim(process_type)) = 'bolsa de trabajo' OR coalesce(upper(trim(category)) IN ('BOLSA', 'ADC'), false) AS private FROM processes)
        SELECT process_id, 'FULL' AS audience FROM p UNION ALL SELECT process_id, 'GENERAL' FROM p WHERE NOT private"""),
    "fan_out_recipients": "SELECT user_id, CASE WHEN max(value) > 90 THEN 'FULL' ELSE 'GENERAL' END AS audience FROM events GROUP BY 1",
    "split_collisions": sql("notices processes", f"""
        , p AS (SELECT process_id, {family('nt', R.FAMILIES_COLLISION)} AS f FROM (SELECT *, {fold('name')} AS nt FROM processes))
        , n AS (SELECT notice_id, process_id, {family('nt', R.FAMILIES_COLLISION)} AS f FROM (SELECT *, {fold('title')} AS nt FROM notices))
        SELECT notice_id, concat('DVAL:', n.process_id, CASE WHEN p.f <> n.f THEN concat(':', left(sha256(n.f), 8)) ELSE '' END) AS final_id FROM n LEFT JOIN p USING (process_id)"""),
    "nearest_date": sql("notices processes", """
        , d AS (SELECT n AS code, published AS day, count(*) AS c, min(notice_id) AS id FROM notices GROUP BY 1, 2)
        , r AS (SELECT process_id, coalesce(places, 1) AS code, call_date AS day FROM processes)
        , j AS (SELECT process_id, d.c, d.id, date_diff('day', r.day, d.day) AS o FROM r JOIN d ON d.code = r.code AND d.day BETWEEN r.day - 5 AND r.day + 5)
        , b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY process_id ORDER BY abs(o), o) = 1)
        SELECT r.process_id, CASE WHEN c IS NULL THEN 'NONE' WHEN c > 1 THEN 'NOT_UNIQUE' WHEN o = 0 THEN 'EXACT' ELSE 'NEAR' END AS status, CASE WHEN c = 1 THEN id END AS match_id FROM r LEFT JOIN b USING (process_id)"""),
    "canonical_id": sql("processes", """SELECT process_id, CASE process_id + 219600 WHEN 219621 THEN 'GVA:110135' WHEN 219862 THEN 'GVA:110206' WHEN 220197 THEN 'GVA:110235' WHEN 220291 THEN 'GVA:110202'
        ELSE concat('GVAESTATAL:', process_id + 219600) END AS stable_id FROM processes"""),
}
