from __future__ import annotations

from edictal import rules as R
from edictal.functions import extract as X
from edictal.plans.cards import APPLICATION
from edictal.functions.text import TITLE_START
from oracles.text import CALL, sub
from oracles.views import case, fold, got, hit, lst, q, sql, squeeze


def table(x: str, values: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v) if isinstance(v, str) else v}" for k, v in values.items()) + " END"


def num(x: str) -> str:
    return f"TRY_CAST({x} AS INT)"


def date(y: str, m: str, d: str) -> str:
    text = f"concat(lpad({y}, 4, '0'), '-', lpad(CAST({m} AS VARCHAR), 2, '0'), '-', lpad({d}, 2, '0'))"
    return f"CASE WHEN {y} IS NOT NULL AND {m} IS NOT NULL AND {d} IS NOT NULL THEN CAST(TRY_CAST({text} AS DATE) AS VARCHAR) END"


def numeric(x: str) -> str:
    p = r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})"
    return date(got(x, p, 3), got(x, p, 2), got(x, p, 1))


def worded(n: str, p: str, months=R.MONTHS, lower: bool = False) -> str:
    month = f"lower({got(n, p, 2)})" if lower else got(n, p, 2)
    return date(got(n, p, 3), table(month, months), got(n, p, 1))


_WORDED = r"\b(\d{1,2})\s+(?:de\s+|del\s+|d['’])?(" + "|".join(R.MONTHS) + r")\s+(?:de\s+|del\s+|de\s+l['’])?(\d{4})\b"
_CLOSES = (
    r"(?:plazo\s+presentacion|termini\s+presentacio)\s*:?\s*(?:hasta\s+el|hasta|fins\s+al|fins\s+a)\s+(\d{1,2})\s+"
    r"(?:de\s+|del\s+|d')?\s*([a-z]+)\s+(?:de\s+|del\s+|de\s+l')?(\d{4})"
)
_OWN = rf"(?i)resoluci[oó]n\s+de\s+(\d{{1,2}})\s+de\s+({X.MONTHS_ES})\s+de\s+(\d{{4}})"
_CITED = rf"(?i)(?:deja\s+sin\s+efecto|correcci[oó]n\s+de\s+errores\s+de)\s+la\s+de\s+(\d{{1,2}})\s+de\s+({X.MONTHS_ES})\s+de\s+(\d{{4}})"
_RANGE = (
    r"(?i)(?:Plazo|Termini)(?:\s+de\s+(?:presentaci[oó]n|presentacio|la etapa actual))?\s*:?\s*(?:Desde|Des de)?\s*(?:el\s+)?"
    r"(\d{2}[-/]\d{2}[-/]\d{4})\s*(?:hasta|fins(?:\s+al)?|a)\s*(?:el\s+)?(\d{2}[-/]\d{2}[-/]\d{4})"
)
B = f", f AS (SELECT *, {fold('body')} AS n FROM bodies)"
NT = f", f AS (SELECT notice_id, title, {fold('title')} AS n FROM notices)"
_DIGITS, _WORD = r"\b(\d+)\s+(?:dias?|dies)\b", r"\b((?:[a-z]+\s+(?:y|i)\s+)?[a-z]+)\s+(?:dias?|dies)\b"


def spelled(w: str) -> str:
    a = f"trim(regexp_extract({w}, '^(.*?)(?:\\s+[yi]\\s+(.*))?$', 1))"
    b = f"regexp_extract({w}, '^(.*?)(?:\\s+[yi]\\s+(.*))?$', 2)"
    return f"nullif({table(a, R.NUMBER_WORDS)} + CASE WHEN {b} = '' THEN 0 ELSE {table(b, R.NUMBER_WORDS)} END, 0)"


def quota(shift: str) -> str:
    return num(
        f"coalesce({got('n', rf'\b(\d+)\s+(?:plazas?|places?)\s+(?:por|en)\s+{shift}\b')}, "
        f"{got('n', rf'\b(\d+)\s+(?:por|en)\s+{shift}\b')}, {got('n', rf'\b{shift.replace('(?:el )?', '')}\s*[:,-]?\s*(\d+)\s+(?:plazas?|places?)\b')})"
    )


_SEL = "una|uno|un|dos|tres|cuatro|quatre|cinco|cinc|seis|sis|siete|set|ocho|vuit|nueve|nou|diez|deu"
_SELECTION = (
    f"coalesce({got('n', rf"(?:seleccion|seleccio)\s+(?:de |d['’])({_SEL}|\d+)\s+(?:plazas?|places?|placa)")}, "
    f"{got('n', rf'convocatoria\s+de\s+({_SEL}|\d+)\s+(?:plazas?|places?)')})"
)


def number_or(x: str, words: dict) -> str:
    return f"CASE WHEN regexp_full_match({x}, '\\d+') THEN {num(x)} ELSE {table(x, words)} END"


_FRAG = "regexp_extract(n, 'subescala\\s+(?:de\\s+|d'')?([^,.;]{1,50})', 1)"
SUBSCALE = f"""CASE WHEN contains(n, 'administracion general') THEN
        CASE WHEN (SELECT count(*) FROM (SELECT unnest({lst(R.SUBGROUP_OF_SUBSCALE)}) AS s) WHERE regexp_matches(frag, concat('\\b', s, 's?\\b'))) = 1 THEN
             CASE WHEN regexp_matches(frag, '\\btecnicas?\\b') AND regexp_matches(frag, '\\bclase\\s+(?:de\\s+)?(?:tecnico\\s+)?medi[ao]\\b') THEN 'A2'
                  {' '.join(f"WHEN regexp_matches(frag, '\\b{k}s?\\b') THEN '{v}'" for k, v in R.SUBGROUP_OF_SUBSCALE.items())} END END
     WHEN contains(n, 'administracion especial') THEN
        CASE WHEN {' + '.join(f"CAST(contains(n, '{k}') AS INT)" for k in R.SUBGROUP_OF_CLASS)} = 1 THEN
             CASE {' '.join(f"WHEN contains(n, '{k}') THEN '{v}'" for k, v in R.SUBGROUP_OF_CLASS.items())} END END END"""
SUB = f", g AS (SELECT *, {_FRAG} AS frag FROM f), c8 AS (SELECT *, {SUBSCALE} AS s8 FROM g)"
_ROW = r"\b([abc])\s+(a1|a2|c1|c2)\s+[a-z ]{3,30}?\s+(\d{1,3})\b"
_SHORT = f"upper({got('n', r'(?:subgrupo|grupo)\s*:?\s*([abc]\d(?:/\d)?)')})"
_BOTH = r"\b(?:grupo|grup)\s*/\s*(?:subgrupo|subgrup)\s*[:.\-]?\s*([a-e])\s*/\s*([a-e][1-3])\b"
_SUBG = r"\b(?:subgrupo|subgrup)\s*[:.\-]?\s*([a-e][1-3])\b"
_GRP = r"\b(?:grupo|grup)\s*[:.\-]?\s*([a-e](?:[1-3])?)\b"
_SCALE = r"\b(?:cuerpo\s*(?:/|y)?\s*escala|cos\s*(?:/|i)?\s*escala|escala)\s*(?:(?::|\.|\-)|(?:d['’](?:e)?|de))\s*administracion?\s+(general|especial)\b"


def class_name() -> str:
    n = fold("name")
    for p, by in (
        (r"\btecnico\s+o\s+tecnica\b", "tecnico"), (r"\b(administrativo)\s+(?:o|/)\s*administrativa\b", r"\1"),
        (r"\b(tecnico|administrativo|auxiliar)\s*/\s*(?:a|[a-z]+a)\b", r"\1"), (r"([a-z])/a\b", r"\1"), ("[^a-z ]", " "), (r"\s+", " "),
    ):
        n = sub(n, p, by)
    return f"trim({n})"


def shift(order) -> str:
    return case(*[(" OR ".join(f"contains(n, {q(w)})" for w in words), q(name)) for name, words in order])


_LINE = r"^\s*(\d{2,4}-[bl])\."
POOLS = f"""
    , r AS (
        SELECT process_id, replace(upper(unnest(regexp_extract_all(n, {q(X.POOL)}, 1))), ' ', '') AS ref FROM f
        UNION SELECT process_id, regexp_replace(upper(unnest(regexp_extract_all(n, {q(X.CLONED)}, 1))), '^(\\d+)-?([BL])$', '\\1-\\2') FROM f
        UNION SELECT process_id, replace(upper(unnest(regexp_extract_all(b, {q(X.POOL_REF)}, 0))), ' ', '') FROM (SELECT process_id, unnest(regexp_extract_all(n, {q(X.POOL_LIST)}, 1)) AS b FROM f)
        UNION SELECT process_id, upper({got('line', _LINE)}) FROM (SELECT process_id, unnest(string_split(left(t, 6000), chr(10))) AS line FROM (SELECT process_id, unnest((string_split_regex(n, {q(X.POOL_MARK)}))[2:]) AS t FROM f)) WHERE {hit('line', _LINE)})
"""
_STAGE_ALONE = rf"(?i)Etapa actual\s*:\s*(.+?)\s*\b{X.STAGE_END}"

SQL = {
    "spelled_number": sql("processes", f"""
        , f AS (SELECT process_id, {fold('deadline')} AS n FROM processes)
        , w AS (SELECT process_id, {got('n', _DIGITS)} AS d, {got('n', _WORD)} AS w, CASE WHEN n IS NOT NULL THEN regexp_extract(n, '^([a-z]+(?: [yi] [a-z]+)?) d', 1) END AS w2 FROM f)
        SELECT process_id, CASE WHEN d IS NOT NULL THEN {num('d')} ELSE {spelled('w')} END AS days, {spelled('w2')} AS word FROM w"""),
    "places": sql("notices", f"""
        , h AS (SELECT notice_id, trim(title) AS t FROM notices)
        , e AS (SELECT notice_id, lower(unnest(regexp_extract_all(t, {q(X.NUMBER_OF_PLACES)}, 1))) AS w, unnest(range(len(regexp_extract_all(t, {q(X.NUMBER_OF_PLACES)}, 1)))) AS i FROM h)
        , v AS (SELECT notice_id, i, CASE WHEN regexp_full_match(w, '\\d+') THEN {num('w')}
                       WHEN starts_with(w, 'vint-i-') THEN CASE WHEN {table('substr(w, 8)', R.TITLE_NUMBERS)} < 10 THEN 20 + {table('substr(w, 8)', R.TITLE_NUMBERS)} END
                       ELSE {table('w', R.TITLE_NUMBERS)} END AS v FROM e)
        , b AS (SELECT notice_id, arg_min(v, i) AS v FROM (SELECT DISTINCT * FROM v) WHERE v BETWEEN 1 AND 200 GROUP BY 1)
        SELECT h.notice_id, CASE WHEN {hit('t', TITLE_START)} THEN coalesce(v, CASE WHEN NOT {hit('t', X.SEVERAL_PLACES)} AND {hit('t', X.THE_PLACE)} THEN 1 END) END AS places
        FROM h LEFT JOIN b USING (notice_id)"""),
    "shift_places": sql("notices", f"""{NT}
        , s AS (SELECT notice_id, {quota('(?:el )?turno\\s+libre')} AS o, {quota('promocion\\s+interna')} AS i, {_SELECTION} AS w FROM f)
        SELECT notice_id, o AS open, i AS internal, coalesce(o, {number_or('w', R.NUMBER_WORDS)}) AS shown FROM s"""),
    "total_places": sql("bodies", f"""SELECT process_id,
        TRY_CAST(replace(coalesce({got('body', r'(?i)N[úu]m\.?\s+de\s+plazas\s+totales\s*:?\s*(\d[\d.]*)')}, {got('body', r'(?i)(?:N[º°o]\.?|N[úu]mero)\s*(?:de\s+)?plazas\s+totales\s*:?\s*(\d[\d.]*)')}, {got('body', r'(?i)\bPlazas\s+(\d[\d.]*)\s+Descripci[óo]n\s+de\s+plazas')}), '.', '') AS INT) AS total,
        TRY_CAST(replace({got('body', r'[\d.]+', 0)}, '.', '') AS INT) AS dotted FROM bodies"""),
    "declared_class": sql("bodies", f"""{B}
        SELECT process_id, upper(coalesce({got('n', _BOTH, 1)}, left({got('n', _SUBG)}, 1), left({got('n', _GRP)}, 1))) AS grp,
               upper(coalesce({got('n', _BOTH, 2)}, {got('n', _SUBG)}, CASE WHEN length({got('n', _GRP)}) = 2 THEN {got('n', _GRP)} END)) AS subgroup,
               CASE {got('n', _SCALE)} WHEN 'general' THEN 'Administración General' WHEN 'especial' THEN 'Administración Especial' END AS scale FROM f"""),
    "short_class": sql("bodies", f"{B} SELECT process_id, left({_SHORT}, 1) AS grp, {_SHORT} AS subgroup FROM f"),
    "class_from_subscale": sql("bodies", f"{B}{SUB} SELECT process_id, left(s8, 1) AS grp, s8 AS subgroup FROM c8"),
    "class_from_table": sql("bodies", f"""
        , f AS (SELECT *, regexp_replace({fold('body')}, '\\s+', ' ', 'g') AS n FROM bodies){SUB}
        , r AS (SELECT DISTINCT process_id, upper(regexp_extract(r, {q(_ROW)}, 2)) AS s, CAST(regexp_extract(r, {q(_ROW)}, 3) AS INT) AS k
                FROM (SELECT process_id, unnest(regexp_extract_all(substr(n, strpos(n, 'vacantes')), {q(_ROW)}, 0)) AS r FROM f WHERE contains(n, 'vacantes'))
                WHERE left(regexp_extract(r, {q(_ROW)}, 2), 1) = regexp_extract(r, {q(_ROW)}, 1))
        , t AS (SELECT process_id, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS ts, sum(k) AS tk FROM r GROUP BY 1)
        , p AS (SELECT process_id, CASE WHEN count(DISTINCT s) = 1 THEN min(s) END AS ps FROM (SELECT process_id, upper(unnest(regexp_extract_all(n, '\\bsubgrupo\\s*[:.-]?\\s*(a1|a2|c1|c2)\\b', 1))) AS s FROM f) GROUP BY 1)
        , o AS (SELECT c8.process_id, CASE WHEN t.process_id IS NOT NULL THEN ts ELSE coalesce(ps, s8) END AS subgroup, tk,
                       CASE WHEN t.process_id IS NOT NULL THEN 'TABLA' WHEN ps IS NOT NULL THEN 'TEXTO' ELSE 'SUBESCALA' END AS origin
                FROM c8 LEFT JOIN t USING (process_id) LEFT JOIN p USING (process_id))
        SELECT process_id, left(subgroup, 1) AS grp, subgroup, CAST(CASE WHEN origin = 'TABLA' AND subgroup IS NOT NULL THEN tk END AS INT) AS places,
               CASE WHEN subgroup IS NOT NULL THEN origin END AS origin FROM o"""),
    "class_agree": sql("bodies", f"""{B}{SUB}
        SELECT process_id, CASE WHEN s8 = {_SHORT} OR {_SHORT} IS NULL THEN s8 WHEN s8 IS NULL THEN {_SHORT} END AS subgroup FROM c8"""),
    "class_from_name": sql("processes", f"""
        , n AS (SELECT process_id, {table(class_name(), R.SUBGROUP_OF_NAME)} AS s FROM processes)
        SELECT process_id, left(s, 1) AS grp, s AS subgroup FROM n"""),
    "any_date": sql("bodies", f"""{B}
        SELECT process_id, coalesce({date(got('body', r'(\d{4})-(\d{1,2})-(\d{1,2})', 1), got('body', r'(\d{4})-(\d{1,2})-(\d{1,2})', 2), got('body', r'(\d{4})-(\d{1,2})-(\d{1,2})', 3))}, {numeric('body')}, {worded('n', _WORDED)}) AS day,
               {numeric('body')} AS numeric, {worded('n', _WORDED)} AS worded FROM f"""),
    "date_range": sql("bodies", f"SELECT process_id, {numeric(got('body', _RANGE, 1))} AS opens, {numeric(got('body', _RANGE, 2))} AS closes FROM bodies"),
    "closing_date": sql("bodies", f"{B} SELECT process_id, {worded('n', _CLOSES)} AS closes FROM f"),
    "call_code": sql("bodies", f"""{B}
        , c AS (SELECT process_id, n, upper(regexp_replace({got('n', CALL)}, '\\s+', '', 'g')) AS code FROM f)
        , y AS (SELECT *, {num(got('code', '/(\\d{2,4})[A-Z]?$'))} AS y FROM c)
        SELECT process_id, code, CASE WHEN y < 100 THEN y + 2000 ELSE y END AS year,
               upper(rtrim(coalesce({got('n', r'\b(?:expedient|expediente)\s*(?:num\.?|numero)?\s*[:.-]?\s*([a-z0-9][a-z0-9._/-]{3,})')}, {got('n', r'\b(?:codi|codigo)\s+(?:de\s+)?convocatoria\s*[:.-]?\s*([a-z0-9][a-z0-9._/-]{3,})')}), '.,;:')) AS file FROM y"""),
    "base_citation": sql("bodies", f"""SELECT process_id, trim({got('body', X.BASE_CITATION, 1)}) AS province, {num(got('body', X.BASE_CITATION, 2))} AS number,
        {date(got('body', X.BASE_CITATION, 5), table(f"lower({got('body', X.BASE_CITATION, 4)})", R.MONTHS), got('body', X.BASE_CITATION, 3))} AS day FROM bodies"""),
    "resolution_dates": sql("bodies", f"SELECT process_id, {worded('body', _OWN, lower=True)} AS own, {worded('body', _CITED, lower=True)} AS cited FROM bodies"),
    "deadline_literal": sql("bodies", f"SELECT process_id, trim(coalesce({', '.join(got('body', p) for p in X.DEADLINE_FORMS)})) AS literal FROM bodies"),
    "place_fragment": sql("bodies", f"""
        , w AS (SELECT process_id, body, lower({got('body', X.PLACE_FRAGMENT, 1)}) AS w FROM bodies)
        SELECT process_id, {number_or("replace(w, 'é', 'e')", R.NUMBER_WORDS)} AS places, trim({got('body', X.PLACE_FRAGMENT, 2)}) AS job,
               trim({got('body', r'(?i)por el sistema de\s+([^,.;]+)')}) AS system,
               coalesce(rtrim(trim({got('body', r'(?i)(?:en|por) turno\s+([^.;]+)')}), ','), CASE WHEN {hit('body', '(?i)promoci[oó]n interna')} THEN 'promoción interna' END) AS shift FROM w"""),
    "pool_refs": sql("bodies", f"""{B}{POOLS}
        SELECT f.process_id, coalesce(string_agg(ref, ',' ORDER BY ref), '') AS refs FROM f LEFT JOIN r USING (process_id) GROUP BY 1"""),
    "stage_phase": sql("bodies", f"""
        , t AS (SELECT process_id, {squeeze('body')} AS t FROM bodies)
        , p AS (SELECT process_id, t, {got('t', rf'(?i)\bFase\s*:?\s*(.+?){X.PHASE_END}')} AS phase, regexp_extract(t, '(?i)^(.*?)\\bFase\\s*:?\\s*.', 1) AS before FROM t)
        SELECT process_id, CASE WHEN phase IS NOT NULL THEN nullif(trim(regexp_extract(before, '(?i)^.*Etapa actual\\s*:\\s*(.*)$', 1)), '') ELSE trim({got('t', _STAGE_ALONE)}) END AS stage, phase FROM p"""),
    "shift": sql("notices", f"{NT} SELECT notice_id, {shift(X.SHIFT_BULLETIN)} AS bulletin, {shift(X.SHIFT_CARD)} AS card FROM f"),
    "process_type": sql("bodies", f"""
        , f AS (SELECT process_id, {fold('body')} AS n, {fold('name')} AS t FROM bodies)
        SELECT process_id, {case((" OR ".join(f"contains(t, {q(w)})" for w in X.POOL_TITLE), "'Bolsa de trabajo'"), (" OR ".join(f"contains(n, {q(w)})" for w in X.CONTEST), "'Concurso-oposición'"), ("contains(n, 'oposicio')", "'Oposición'"), default="'Proceso selectivo'")} AS kind FROM f"""),
    "combine_terms": sql("processes", """
        , t AS (SELECT process_id, 1 AS i, opens, closes, NULL AS bulletin FROM processes
                UNION ALL SELECT process_id, 2, call_date, call_date + 30, CASE WHEN process_id % 2 = 0 THEN deadline END FROM processes
                UNION ALL SELECT process_id, 3, NULL, exam_date, 'x' FROM processes)
        , u AS (SELECT * FROM t WHERE opens IS NOT NULL OR bulletin IS NOT NULL)
        SELECT process_id, CAST(min(opens) AS VARCHAR) AS opens, CAST(max(closes) AS VARCHAR) AS closes, list_extract(list(bulletin ORDER BY i), 1) AS bulletin FROM u GROUP BY 1"""),
    "extreme_dates": sql("bodies", """
        , d AS (SELECT process_id, TRY_CAST(concat(right(x, 4), '-', substr(x, 4, 2), '-', left(x, 2)) AS DATE) AS d FROM (SELECT process_id, unnest(regexp_extract_all(body, '\\b\\d{2}[-/]\\d{2}[-/]\\d{4}\\b')) AS x FROM bodies))
        SELECT b.process_id, CAST(min(d) AS VARCHAR) AS earliest, CAST(max(d) AS VARCHAR) AS latest FROM bodies b LEFT JOIN d USING (process_id) GROUP BY 1"""),
    "application_stages": sql("processes", """
        , s AS (SELECT process_id, i, CASE WHEN i = 2 THEN opens ELSE call_date + CAST(40 - 10 * i AS INT) END AS d FROM processes, (SELECT unnest([0, 1, 2, 3]) AS i) WHERE (process_id + i) % 3 < 2)
        , r AS (SELECT *, row_number() OVER (PARTITION BY process_id ORDER BY d NULLS LAST, i) AS r FROM s)
        SELECT process_id, string_agg(CAST(i AS VARCHAR), ',' ORDER BY r) AS stages FROM r WHERE r <= 3 GROUP BY 1"""),
    "assemble_process": sql("readings", f"""
        , a AS (SELECT reading_id AS card_id, {hit(fold('stage'), APPLICATION)} AS application, opens, closes, k FROM readings)
        SELECT card_id, CAST(CASE WHEN application THEN opens WHEN k % 4 = 0 THEN opens + INTERVAL 1 MONTH END AS DATE)::VARCHAR AS opens,
               CAST(CASE WHEN application THEN closes WHEN k % 4 = 0 THEN opens + INTERVAL 2 MONTH END AS DATE)::VARCHAR AS closes,
               CAST(2000 + 20 + k % 10 AS INT) AS year, application FROM a"""),
    "local_date": sql("readings", "SELECT reading_id, CAST(CAST(read_at AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Madrid' AS DATE) AS VARCHAR) AS local_day FROM readings"),
}
