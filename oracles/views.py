"""The notice-shaped views of the check queries, written once more in DuckDB SQL."""

from __future__ import annotations

from edictal.sources import bind as B


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(options) -> str:
    return "[" + ", ".join(q(o) for o in options) + "]"


def pick(options, index: str) -> str:
    return f"list_extract({lst(options)}, CAST({index} AS BIGINT) + 1)"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def key(x: str) -> str:
    return f"trim(regexp_replace(replace({fold(x)}, '·', ''), '[^a-z0-9]+', ' ', 'g'))"


def hit(x: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({x}, {q(pattern)}), false)"


def got(x: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def case(*rules: tuple[str, str], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def _fill(template: str, **slots: str) -> str:
    for name, value in slots.items():
        template = f"replace({template}, '{{{name}}}', {value})"
    return template


_TITLE = _fill(
    pick(B.TITLES, f"l_partkey % {len(B.TITLES)}"),
    n="CAST(CAST(l_quantity AS INT) AS VARCHAR)",
    code="concat(CAST(l_quantity AS INT), '/', year(l_shipdate))",
    town="concat(CASE WHEN l_partkey % 2 = 0 THEN 'NATION_' ELSE 'NACIÓ_' END, l_suppkey % 25)",
    w=pick(B.WORDS, f"CAST(l_quantity AS INT) % {len(B.WORDS)}"),
)

VIEWS = {
    "agencies": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS agency_id,
               concat('Ayuntamiento de ', n_name, '/', replace(n_name, 'NATION', 'NACIÓ'),
                      CASE WHEN n_nationkey % 4 = 0 THEN ' (Sede)' ELSE '' END) AS agency_name,
               {pick(("AYUNTAMIENTO", "DIPUTACION", "ADMINISTRACION_AUTONOMICA"), "n_nationkey % 3")} AS agency_kind,
               r_name AS province, concat(n_name, '/', replace(n_name, 'NATION', 'NACIÓ')) AS town,
               n_nationkey % 7 <> 6 AS active
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "sources": f"""
        SELECT s_suppkey AS source_id, CAST(s_nationkey AS BIGINT) AS agency_id, s_name AS source_name,
               {pick(("BOP", "BOE", "SEDE"), "s_suppkey % 3")} AS source_kind, s_suppkey % 11 <> 10 AS active,
               CAST(s_suppkey % 5 AS INT) AS priority
        FROM supplier""",
    "notices": f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS notice_id,
               l_orderkey AS process_id, l_suppkey AS source_id, concat_ws('-', l_orderkey, l_linenumber) AS ref,
               {_TITLE} AS title,
               CASE l_linenumber WHEN 1 THEN 'BASES' WHEN 2 THEN 'convocatoria' ELSE 'BOP' END AS kind,
               CAST(l_shipdate AS DATE) AS published,
               CASE WHEN l_partkey % 5 <> 0 THEN concat(
                   {pick(("https://bop.dival.es/d/", "https://www.boe.es/d/", "http://a.example/d/"), "l_suppkey % 3")},
                   l_orderkey, '-', l_linenumber) END AS url,
               CAST(l_quantity AS INT) AS n
        FROM lineitem""",
    "processes": f"""
        SELECT o_orderkey AS process_id, CAST(c_nationkey AS BIGINT) AS agency_id,
               {_fill(pick(B.NAMES, f"o_custkey % {len(B.NAMES)}"), n="CAST(o_custkey % 90 + 10 AS VARCHAR)", code="concat(o_custkey % 40 + 1, '/', year(o_orderdate))")} AS name,
               {pick(B.TYPES, "CAST(left(o_orderpriority, 1) AS INT) - 1")} AS process_type,
               CASE o_orderstatus WHEN 'O' THEN 'EN_CURSO' WHEN 'P' THEN 'EN_SEGUIMIENTO' ELSE 'Finalizado' END AS state,
               o_orderkey % 10 <> 9 AS is_opportunity,
               {pick(("SI", "SI", "SI", "NO", "REVISION"), "o_orderkey % 5")} AS scope,
               {pick(B.SHIFTS, "o_custkey % 4")} AS shift,
               CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 30 + 1 AS INT) END AS places,
               CAST(o_orderdate AS DATE) AS call_date,
               CASE WHEN o_orderkey % 7 = 0 THEN CAST(o_orderdate AS DATE) + 1 END AS opens,
               CASE o_orderkey % 7 WHEN 0 THEN CAST(o_orderdate AS DATE) + 25 WHEN 1 THEN CAST(o_orderdate AS DATE) + 20 END AS closes,
               CASE WHEN o_orderkey % 13 = 0 THEN CAST(o_orderdate AS DATE) + 200 END AS exam_date,
               CASE WHEN o_orderkey % 9 < 7 THEN {pick(B.DEADLINES, "o_orderkey % 7")} END AS deadline,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS gazette_date,
               o_orderkey % 100 AS source_id,
               CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'F' THEN 'RECONCILIACION' END AS closure_origin,
               CASE o_orderkey % 6 WHEN 0 THEN concat('https://sede.example/p?id=', o_orderkey) WHEN 1 THEN ' ' END AS detail_url,
               CASE o_orderkey % 17 WHEN 0 THEN 'ADC' WHEN 1 THEN 'bolsa' END AS category
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "changes": f"""
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS change_id, l_orderkey AS process_id,
               {pick(("estado", "plazas", "denominacion", "etapa_actual", "fecha_cierre", "turno", "grupo"), "l_linenumber - 1")} AS field,
               CASE WHEN CAST(round(l_tax * 100) AS INT) > 0
                    THEN {pick(("ABIERTO", "EN_SEGUIMIENTO", "Navegación", "x"), "l_partkey % 4")} END AS old,
               {pick(("EN_CURSO", "FINALIZADO", "y"), "l_suppkey % 3")} AS new,
               CAST(round(l_tax * 100) AS INT) % 3 <> 2 AS significant, CAST(l_shipdate AS DATE) AS detected
        FROM lineitem WHERE l_returnflag = 'R'""",
    "subscriptions": """
        SELECT user_id, event_id AS process_id, event_type = 'signup' AS active,
               CAST(CAST(ts AS DATE) - INTERVAL 26 YEAR AS DATE) AS since
        FROM events WHERE event_type IN ('signup', 'purchase')""",
    "readings": f"""
        SELECT event_id AS reading_id, user_id AS pool_id, ts AS read_at,
               sha256(concat_ws('|', CAST(k % 6 AS VARCHAR), CASE WHEN k % 5 = 0 THEN 'x' END)) AS content_hash,
               replace({pick(B.STAGES, f"k % {len(B.STAGES)}")}, '{{n}}', CAST(k AS VARCHAR)) AS stage,
               {pick(B.PHASES, f"k % {len(B.PHASES)}")} AS phase, CAST(ts AS DATE) AS opens,
               CASE WHEN k % 3 <> 0 THEN CAST(ts AS DATE) + k % 20 END AS closes, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)""",
    "runs": f"""
        SELECT event_id AS run_id, concat_ws('-', event_type, user_id % 7) AS source, user_id AS cycle_id,
               {pick(("OK", "SIN_NOVEDADES", "DEGRADADA", "ERROR"), "v % 4")} AS state,
               CASE WHEN v % 9 <> 0 THEN CAST(ts AS DATE) END AS until, v % 12 AS errors,
               CASE WHEN v % 4 = 3 THEN concat('timeout ', v) END AS error
        FROM (SELECT *, CAST(floor(value) AS INT) AS v FROM events)""",
    "bodies": f"""
        SELECT process_id, agency_id, name, process_type, shift, places, call_date,
               {_fill(pick(B.BODIES, f"process_id % {len(B.BODIES)}"),
                      dmy="strftime(call_date, '%d-%m-%Y')", later="strftime(call_date + 20, '%d/%m/%Y')",
                      d="CAST(day(call_date) AS VARCHAR)", month=pick(B.MONTH_NAMES, "month(call_date) - 1"),
                      year="CAST(year(call_date) AS VARCHAR)", n="CAST(process_id % 89 + 10 AS VARCHAR)", name="name")} AS body
        FROM processes""",
}
NEEDS = {"bodies": ("processes",)}


def ctes(*names: str) -> str:
    """``WITH`` clause of the named views and what they read."""
    order: list[str] = []
    for name in names:
        for need in (*NEEDS.get(name, ()), name):
            if need not in order:
                order.append(need)
    return "WITH " + ", ".join(f"{name} AS ({VIEWS[name]})" for name in order)


def sql(views: str, body: str) -> str:
    """A check query over the named views; ``body`` may open with further CTEs after a comma."""
    head = ctes(*views.split())
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head} {body}"
