from __future__ import annotations

from edictal import rules as R
from edictal.functions import text as T
from edictal.functions import extract as X
from edictal.sources import feeds as S
from oracles.views import WS, case, fold, got, hit, key, lst, q, sql, squeeze


def sub(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, {q(flags)})"


COMPACT = f"regexp_replace({fold('x')}, '[^a-z0-9]', '', 'g')"
ENTITY = "concat('Ayuntamiento de ', name, ' (', process_type, ') ')"
HEADER = (
    "CASE process_id % 4 WHEN 0 THEN concat('DIPUTACIÓ  PROVINCIAL de ', name) WHEN 1 THEN concat('AJUNTAMENT D''', name) "
    "WHEN 2 THEN concat('Ayuntamiento  de  ', name, '/otro') ELSE name END"
)
CLEAN = "nullif(trim({}, ' .:-'), '')"
NEWS = r"(?is)\s*\b(?:c[oó]digo\s+gva|codi\s+gva|descargar\s+informaci[oó]n|descarregar\s+informaci[oó])([^A-Za-zÀ-ÿ0-9_].*$|$)"


def clean_title() -> str:
    job = f"regexp_extract(trim(title), {q(T.JOB_IN_TITLE)}, 1)"
    job = f"rtrim(trim({job}), '. ')"
    job = sub(job, r",\s*[ABCabc][12]?\s*$", "")
    job = sub(job, r"(?i)^personal\s+", "")
    for pattern, words in T.WORDING:
        job = sub(job, pattern, words)
    return f"trim({sub(job, r'\s+', ' ')}, ' ,')"


# The entities that occur in the given pages.
ENTITIES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))


def html() -> str:
    t = sub("html", r"(?is)<script\b[^>]*>.*?</script>", " ")
    t = sub(t, r"(?is)<style\b[^>]*>.*?</style>", " ")
    t = sub(t, "<[^>]+>", " ")
    for name, ch in ENTITIES:
        t = f"replace({t}, {q(name)}, {q(ch)})"
    return squeeze(t)


def words(x: str, n: int, stop, alias) -> str:
    canon = "CASE w " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in alias.items()) + " ELSE w END" if alias else "w"
    return (
        f"list_sort(list_filter(list_distinct(list_transform(regexp_extract_all({fold(x)}, '[a-z0-9]{{{n},}}'), lambda w: {canon})), "
        f"lambda w: w NOT IN ({', '.join(q(s) for s in stop)})))" if stop else
        f"list_sort(list_distinct(list_transform(regexp_extract_all({fold(x)}, '[a-z0-9]{{{n},}}'), lambda w: {canon})))"
    )


def identity(x: str) -> str:
    parts = [
        f"list_transform(regexp_extract_all(upper({fold(x)}), {q(p)}, 1), lambda w: concat({q(k + ':')}, w))" for k, p in T.IDENTITY
    ]
    return f"list_sort(list_distinct(flatten([{', '.join(parts)}])))"


CALL = r"convocatoria\s*:?\s*([a-z]?\s*\d{1,3}/\d{2,4}[a-z]?)(?:[^a-z0-9]|$)"
TITLE_AT = "CASE WHEN strpos(t, '.') > 20 THEN left(t, strpos(t, '.')) ELSE t END"
_LINES = "string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))"

SQL = {
    "fold": f"SELECT doc_id, {fold('text')} AS folded FROM documents",
    "title_key": sql("notices", f"SELECT notice_id, {key('title')} AS title_key FROM notices"),
    "squeeze": f"SELECT doc_id, {squeeze('text')} AS squeezed FROM documents",
    "name_keys": sql("processes", f"""
        , k AS (SELECT process_id, {COMPACT} AS k FROM (SELECT process_id, concat('La ', name, ' els') AS x FROM processes))
        , v AS (SELECT process_id, k AS v FROM k
                UNION SELECT process_id, CASE WHEN starts_with(k, a) THEN substr(k, length(a) + 1) WHEN ends_with(k, a) THEN left(k, length(k) - length(a)) END
                FROM k, (SELECT unnest({lst(T.ARTICLES)}) AS a) WHERE length(k) > length(a))
        SELECT process_id, string_agg(v, ',' ORDER BY v) AS keys FROM v WHERE v <> '' GROUP BY 1"""),
    "entity_variants": sql("processes", f"""
        , e AS (SELECT process_id, trim(regexp_replace({ENTITY}, '\\s*\\([^)]*\\)\\s*$', '')) AS v FROM processes)
        , n AS (SELECT process_id, regexp_extract(v, '(?i)^(ayuntamiento de\\s+)(.+)$', 1) AS p, regexp_extract(v, '(?i)^(ayuntamiento de\\s+)(.+)$', 2) AS name FROM e)
        , u AS (SELECT process_id, {fold('concat(p, name)')} AS f FROM n
                UNION SELECT process_id, {fold('concat(p, trim(h))')} FROM (SELECT process_id, p, unnest(string_split(name, '/')) AS h FROM n) WHERE trim(h) <> '')
        SELECT process_id, string_agg(f, '|' ORDER BY f) AS variants FROM u GROUP BY 1"""),
    "alias_set": sql("processes", f"""
        SELECT process_id, array_to_string(list_filter(list_transform(string_split({fold('name')}, '/'), lambda x: trim(x)), lambda x: x <> ''), '|') AS aliases
        FROM processes"""),
    "stage_key": sql("readings", f"""
        , s AS (SELECT reading_id, stage, {CLEAN.format(sub(squeeze('stage'), T.STAGE_NOISE, ''))} AS c,
                       coalesce({CLEAN.format(sub(squeeze('stage'), NEWS, ''))}, stage) AS news FROM readings)
        SELECT reading_id, c AS stage, coalesce(trim(regexp_replace({fold('c')}, '[^a-z0-9]+', ' ', 'g')), '') AS stage_key, news FROM s"""),
    "clean_title": sql("notices", f"""
        , j AS (SELECT notice_id, title, {clean_title()} AS j FROM notices)
        SELECT notice_id, CASE WHEN {hit('trim(title)', T.TITLE_START)} AND length(j) BETWEEN 1 AND {T.LONGEST_JOB} AND NOT {hit('j', T.RESIDUE)}
                               THEN concat(upper(left(j, 1)), substr(j, 2)) END AS job FROM j"""),
    "issuer_town": sql("notices", f"""
        , f AS (SELECT notice_id, {fold('title')} AS n FROM notices)
        , t AS (SELECT notice_id, {hit('trim(n)', T.ISSUER_STRICT)} AS municipal, coalesce(
            {got('n', '(?:ayuntamiento|ajuntament)\\s+de\\s+(.+?)' + T.ISSUER_END)},
            {got('n', '(?:ayuntamiento|ajuntament)\\s+del\\s+(.+?)' + T.ISSUER_END)},
            {got('n', '(?:ayuntamiento|ajuntament)\\s+d[''’]\\s*(.+?)'.replace("''", "'") + T.ISSUER_END)}) AS town FROM f)
        SELECT notice_id, municipal, CASE WHEN municipal THEN left({squeeze('town')}, 120) END AS town FROM t"""),
    "agency_identity": sql("processes", f"""
        , h AS (SELECT process_id, {squeeze(HEADER)} AS h FROM processes)
        , t AS (SELECT process_id, regexp_matches(upper(h), '^DIPUTACI(?:Ó|ÓN) PROVINCIAL') AS county,
                       coalesce({got('h', "(?i)^(?:ajuntament|ayuntamiento)\\s+d['’](.+)$")}, {got('h', '(?i)^(?:ajuntament|ayuntamiento)\\s+de\\s+(.+)$')}) AS town FROM h)
        SELECT process_id, CASE WHEN county THEN 'DIPUTACION' WHEN town IS NOT NULL THEN 'AYUNTAMIENTO' ELSE 'DESCONOCIDO' END AS kind,
               CASE WHEN NOT county THEN trim(split_part(town, '/', 1)) END AS town FROM t"""),
    "html_text": f"SELECT page_id, {html()} AS text FROM pages",
    "place_sentences": sql("bodies", f"""
        , s AS (SELECT process_id, string_split_regex(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS s FROM bodies)
        , e AS (SELECT process_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM s)
        SELECT process_id, CAST(pos AS INT) AS pos, trim(sentence) AS sentence FROM e WHERE {hit('trim(sentence)', X.STATES_PLACES)}"""),
    "segment_records": sql("notices", f"""
        , p AS (SELECT DISTINCT notice_id AS page, concat(title, '. Núm. registro: 2024/', n, ' Otro Anunci de les bases de la convocatoria. Núm. de registre 2024/', n,
                       ' entidad Núm. registro 2025/', n, ' Anuncio posterior de ', ref, '. Fin') AS text FROM notices)
        , m AS (SELECT page, regexp_extract_all(text, {q(S.RECORD_MARK)}, 1) AS r, string_split_regex(text, {q(S.RECORD_MARK)}) AS b FROM p)
        , e AS (SELECT page, i, r[i] AS record, b[i] AS before, b[i + 1] AS after FROM (SELECT *, unnest(range(1, len(r) + 1)) AS i FROM m))
        , t AS (SELECT page, i, record, {got(squeeze('before'), '(?is)^.*\\b(Anuncio?\\b.*)$')} AS t1, {got(squeeze('after'), '(?is)^.*?\\b(Anuncio?\\b.*)$')} AS t2 FROM e)
        , c AS (SELECT page, i, record, {TITLE_AT.replace('t', 't1', 0).replace('strpos(t,', 'strpos(t1,').replace('left(t,', 'left(t1,').replace('ELSE t END', 'ELSE t1 END')} AS c1,
                       {TITLE_AT.replace('strpos(t,', 'strpos(t2,').replace('left(t,', 'left(t2,').replace('ELSE t END', 'ELSE t2 END')} AS c2 FROM t)
        , f AS (SELECT page, i, record, coalesce(CASE WHEN length(c1) BETWEEN 20 AND 1000 THEN c1 END, CASE WHEN length(c2) BETWEEN 20 AND 1000 THEN c2 END) AS title FROM c)
        SELECT page, record, arg_min(title, i) AS title FROM f WHERE title IS NOT NULL GROUP BY 1, 2"""),
    "line_block": sql("bodies", f"""
        , x AS (SELECT process_id, concat('PREÁMBULO', chr(10), 'TEMARIO: parte primera', chr(10), body, chr(10), 'Tema 1. La Constitución', chr(10), 'Tema 2. El acto administrativo', chr(10), 'BASES', chr(10), 'fin') AS text FROM bodies)
        , l AS (SELECT process_id, {_LINES} AS l FROM x)
        , e AS (SELECT process_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM l)
        , s AS (SELECT process_id, min(i) AS s FROM e WHERE {hit('line', S.BLOCK_START)} GROUP BY 1)
        , z AS (SELECT process_id, min(i) AS z FROM e JOIN s USING (process_id) WHERE i >= s + 3 AND {hit('line', S.BLOCK_END)} GROUP BY 1)
        , b AS (SELECT l.process_id, trim(array_to_string(l.l[s + 1:coalesce(z, len(l.l))], chr(10))) AS block FROM l LEFT JOIN s USING (process_id) LEFT JOIN z USING (process_id))
        SELECT process_id, CASE WHEN length(block) >= 80 THEN block END AS block FROM b"""),
    "code_block": sql("bodies", f"""
        , x AS (SELECT process_id, concat(process_id % 3 + 1, '/24') AS code, concat('ANEXO', chr(10), 'TEMARIO', chr(10), 'Convocatoria 1/24 administrativo', chr(10), body, chr(10), 'Tema 1. Derecho', chr(10), 'Convocatoria 2/24 auxiliar', chr(10), body, chr(10), 'Tema 9. Archivo y documentación de las administraciones públicas valencianas') AS text FROM bodies)
        , l AS (SELECT process_id, code, {_LINES} AS l FROM x)
        , e AS (SELECT process_id, code, unnest(range(len(l))) AS i, unnest(l) AS line FROM l)
        , c AS (SELECT process_id, code, i, concat(regexp_extract(line, {q(S.CALL_LINE)}, 1), '/', regexp_extract(line, {q(S.CALL_LINE)}, 2)) AS stated FROM e WHERE {hit('line', S.CALL_LINE)})
        , a AS (SELECT process_id, min(i) AS a FROM c WHERE stated = code GROUP BY 1)
        , h AS (SELECT process_id, max(i) AS h FROM e JOIN a USING (process_id) WHERE i < a AND i >= a - 11 AND {hit('line', '(?i)\\bTEMARIO\\b')} GROUP BY 1)
        , z AS (SELECT process_id, min(i) AS z FROM c JOIN a USING (process_id) WHERE i > a GROUP BY 1)
        , b AS (SELECT l.process_id, CASE WHEN a IS NOT NULL THEN trim(array_to_string(l.l[coalesce(h, a) + 1:coalesce(z, len(l.l))], chr(10))) END AS block
                FROM l LEFT JOIN a USING (process_id) LEFT JOIN h USING (process_id) LEFT JOIN z USING (process_id))
        SELECT process_id, CASE WHEN length(block) >= 80 THEN block END AS block FROM b"""),
    "norm_lines": """
        , l AS (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents))
        , t AS (SELECT doc_id, i, trim(regexp_replace(line, '[ \\t\\x{A0}]+', ' ', 'g')) AS line FROM l)
        SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS text FROM documents d LEFT JOIN t ON t.doc_id = d.doc_id AND line <> '' GROUP BY 1""".replace(", l AS", "WITH l AS", 1),
    "tokens": sql("notices", f"SELECT notice_id, array_to_string({words('title', 4, R.STOPWORDS_BASES, R.TOKEN_ALIAS)}, ',') AS words FROM notices"),
    "identity_tokens": sql("notices", f"SELECT notice_id, array_to_string({identity('title')}, ',') AS tokens FROM notices"),
    "url_facets": sql("notices", """SELECT notice_id, 'dogv.gva.es' AS host, CAST(source_id AS VARCHAR) AS id_emp,
               concat(year(published), '_', n) AS signature, CAST(published AS VARCHAR) AS url_day FROM notices"""),
    "page_facets": """SELECT page_id, lower(nullif(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1), '')) AS host,
               nullif(regexp_extract(regexp_replace(url, '#.*$', ''), '[?&]page=([^&]*)', 1), '') AS page FROM pages""",
    "repair_mojibake": sql("notices", "SELECT notice_id, title AS repaired, title AS kept FROM notices"),
    "repair_glyphs": "SELECT doc_id, text, NOT contains(text, chr(65533)) AS readable FROM documents",
    "content_hash": "SELECT doc_id, sha256(text) AS full, left(sha256(text), 16) AS short FROM documents",
    "stable_id": sql("notices", f"""
        , c AS (SELECT notice_id, {fold('title')} AS n FROM notices)
        , d AS (SELECT notice_id, n, upper(regexp_replace({got('n', CALL)}, '\\s+', '', 'g')) AS code FROM c)
        SELECT notice_id, concat('DVAL:', coalesce(code, concat('T:', left(sha256(n), 24)))) AS stable_id FROM d"""),
}
