"""Ordered classifiers (C1-C31) as CASE expressions; the first rule that matches wins.

``n`` arguments are folded text (N1) and ``key`` arguments title keys (N2): project them once and pass
the column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions.text import col, let


SPECIAL = set(r".^$*+?()[]{}\\")


def _balanced(parts: list[Column]) -> Column:
    """OR of many conditions as a shallow tree."""
    while len(parts) > 1:
        parts = [a | b for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def has(c: Column | str, words) -> Column:
    """The text contains one of the words; unknown text contains none.  Words that contain another of
    the words add nothing and are not tested."""
    needed = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return F.coalesce(_balanced([F.contains(col(c), F.lit(w)) for w in needed]), F.lit(False))


def matches(c: Column | str, pattern: str) -> Column:
    """The pattern is found; a mere list of words is tested without a regular expression."""
    if not SPECIAL & set(pattern):
        return has(c, pattern.split("|"))
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def either(c: Column | str, patterns) -> Column:
    """Any of the patterns: the plain ones by containment, the rest as one alternation."""
    plain = [p for p in patterns if not SPECIAL & set(p)]
    rest = [p for p in patterns if SPECIAL & set(p)]
    parts = ([has(c, plain)] if plain else []) + ([matches(c, "|".join(rest))] if rest else [])
    return _balanced(parts)


def ruled(c: Column | str, name: str, pattern: str | None = None) -> Column:
    """A closing pattern, tried only where one of its stems occurs."""
    return has(c, R.STEMS[name]) & matches(c, pattern or name)


def chain(*cases: tuple[Column, object], default=None) -> Column:
    """First match wins."""
    out = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# --- C1-C3 -----------------------------------------------------------------------------------------------

def scope(text: Column | str, job: Column | str, codes: bool = False) -> Column:
    """SI, NO or REVISION from the folded whole text and the folded job name."""
    text, job = col(text), col(job)
    rules = []
    if codes:
        stated = F.regexp_extract_all(text, F.lit(R.BODY_CODE), F.lit(0))
        general = F.arrays_overlap(stated, F.array(*[F.lit(c) for c in R.GENERAL_CODES]))
        rules.append((F.size(stated) > 0, F.when(general, "SI").otherwise("NO")))
    rules += [
        (either(text, R.OUT_OF_SCOPE), "NO"),
        (either(job, R.OUT_OF_SCOPE_JOB), "NO"),
        (either(text, R.IN_SCOPE), "SI"),
    ]
    return chain(*rules, default="REVISION")


def scope_title_first(title: Column | str, body: Column | str) -> Column:
    """The title decides; the body only when the title does not."""
    by_title = scope(title, title)
    return F.when(by_title != "REVISION", by_title).otherwise(scope(body, body))


def scope_document(scopes: Column) -> Column:
    """Best scope over the sentences of a document."""
    return chain(
        (F.array_contains(scopes, "SI"), "SI"), (F.array_contains(scopes, "REVISION"), "REVISION"), default="NO"
    )


# --- C4-C10 ----------------------------------------------------------------------------------------------

def notice_class(n: Column | str, extended: bool = True, provincial: bool = False) -> Column:
    """C4: kind of notice.  ``extended`` adds the internal-provision phrases, ``provincial`` the wording
    of provincial bulletins, which can promote a follow-up to a new call."""
    n = col(n)
    rules = []
    if extended:
        rules.append((has(n, R.INTERNAL_EXTENDED), "EXCLUIDO_INTERNO"))
    rules += [
        (has(n, R.INTERNAL) | (has(n, R.INTERNAL_PROMOTION) & ~has(n, R.OPEN_SHIFT)), "EXCLUIDO_INTERNO"),
        (has(n, R.NOISE) & ~has(n, R.NOISE_UNLESS), "RUIDO"),
        (has(n, R.TEMPORARY_POOL), "BOLSA_TEMPORAL"),
        (has(n, R.HARD_TO_FILL), "ANUNCIO_DIFICIL_COBERTURA"),
    ]
    late_new = has(n, R.PROVINCIAL_NEW) & ~has(n, R.PROVINCIAL_BLOCK) if provincial else F.lit(False)
    rules += [
        (has(n, R.FOLLOW_UP) & ~late_new, "SEGUIMIENTO"),
        (has(n, R.NEW_CALL) | late_new, "NUEVA_CONVOCATORIA"),
    ]
    return chain(*rules, default="SEGUIMIENTO")


def is_pool_type(process_type: Column | str) -> Column:
    """The process type names a pool, in either language."""
    from edictal.functions.text import title_key

    return matches(title_key(process_type), "bolsa|borsa")


def _spoiled(key: Column) -> Column:
    """A result that is provisional, revoked or only of a part of the process."""
    exercise = ruled(key, R.EXERCISE, rf"{R.EXERCISE}(?!{R.FISCAL_YEAR})")
    return ruled(key, R.PROVISIONAL) | ruled(key, R.REVOKED) | exercise | matches(key, R.PARTIAL)


def closure_rule(key: Column | str, pool: Column | bool = False) -> Column:
    """Identifier of the rule by which an official title closes a process, null when it does not."""
    key, pool = col(key), pool if isinstance(pool, Column) else F.lit(pool)
    own = ~ruled(key, R.INTERIM)
    results = [
        (ruled(key, p) & own & ~pool & ~_spoiled(key), f"RESULTADO_FINAL_{i}") for i, p in enumerate(R.FINAL_RESULTS, 1)
    ]
    return chain(
        (ruled(key, R.ANNULMENT), "ANULACION_CONVOCATORIA"),
        (ruled(key, R.DESISTANCE), "DESISTIMIENTO_CONVOCATORIA"),
        (ruled(key, R.FINALISATION, rf"{R.FINALISATION}(?!{R.MINOR_STEP})"), "FINALIZACION_PROCESO"),
        (ruled(key, R.VOID), "PROCESO_DESIERTO"),
        (ruled(key, R.APPOINTMENT) & own, "NOMBRAMIENTO_O_ADJUDICACION"),
        *results,
    )


def closes_pools(rule: Column | str) -> Column:
    """A list of passed candidates does not close a pool; every other rule does."""
    return ~col(rule).startswith("RESULTADO_FINAL")


def state_of_rule(rule: Column | str) -> Column:
    rule = col(rule)
    return (
        F.when(rule == "ANULACION_CONVOCATORIA", R.ANNULLED)
        .when(rule == "DESISTIMIENTO_CONVOCATORIA", R.DESISTED)
        .when(rule.isNotNull(), R.FINISHED)
    )


def state_label(key: Column | str) -> Column:
    """State of a structured label, which must consist of nothing else."""
    return chain(*[(matches(key, f"^(?:proceso |proces )?(?:{p})$"), s) for s, p in R.LABELS])


def is_terminal(state: Column | str) -> Column:
    """A stored state, in any of its historical spellings, of a resolved process."""
    return F.coalesce(F.lower(F.trim(col(state))).isin(*R.TERMINAL_STATES), F.lit(False))


def milestone(n: Column | str) -> Column:
    """Milestone announced by a follow-up notice."""
    return chain(
        *[(has(n, words), name) for name, words in R.MILESTONES],
        (matches(n, R.CORRECTION), "CORRECCION"),
        default=R.OTHER_MILESTONE,
    )


def follow_up_type(n: Column | str) -> Column:
    """Kind of an official follow-up publication."""
    return chain(*[(matches(n, f"(?s){p}"), name) for name, p in R.OFFICIAL_FOLLOW_UP], default=R.OTHER_OFFICIAL)


def is_continuity(n: Column | str) -> Column:
    """Clearly a later step of a selection process."""
    return has(n, R.CONTINUITY) & ~has(n, R.FOREIGN)


# --- C11-C17 ------------------------------------------------------------------------------------------------

def is_founding(n_title: Column | str, n_body: Column | str) -> Column:
    """C11: the title states the founding act; the body is read only when there is no title."""
    title = col(n_title)
    empty = F.trim(F.coalesce(title, F.lit(""))) == ""
    return ~has(title, R.LATER_ACT) & (has(title, R.FOUNDING) | (empty & has(n_body, R.FOUNDING)))


def family(n: Column | str, rules=R.FAMILIES_CALL) -> Column:
    """Job family by which notices and processes are compared."""
    text = F.regexp_replace(col(n), *R.TYPO) if rules is R.FAMILIES_CALL else col(n)
    return chain(*[(matches(text, f"(?s){p}"), name) for name, p in rules])


def document_type(title: Column | str, text: Column | str) -> Column:
    """What a gazette document does to a known call."""
    both = F.lower(F.concat_ws(" ", col(title), col(text)))
    return chain(
        (matches(both, R.DOCUMENT_ANNULS), "ANULACION"),
        (matches(both, R.DOCUMENT_RECTIFIES), "RECTIFICACION"),
        default="CONVOCATORIA",
    )


def is_employment(n: Column | str, rule: Column | str) -> Column:
    """C14: unmistakably public employment: exclusions first, then closing acts, then the vocabulary.

    ``rule`` is the closing rule of the title (C5), which callers have at hand.
    """
    terminal = has(n, R.TERMINAL_WORDS) | col(rule).isNotNull()
    return ~has(n, R.NOT_EMPLOYMENT) & (terminal | has(n, R.EMPLOYMENT))


def specialism(n: Column | str) -> Column:
    """Specialism that lies outside general administration."""
    return chain(*[(matches(n, p), reason) for p, reason in R.SPECIALISMS])


def pool_exclusion(n_title: Column | str, n_card: Column | str) -> Column:
    """Why a pool is left out, or null."""
    title = col(n_title)
    where = {"title": title, "card": col(n_card)}
    return chain(
        *[(has(where[part], (phrase,)), phrase) for phrase, part in R.POOL_EXCLUSIONS],
        (matches(title, R.INTERNAL_WORD), "promocion interna"),
        (matches(title, R.EMPLOYEES_ONLY) & ~has(title, ("libre",)), "no turno libre"),
    )


# Body codes, specialisms tolerated in the superior body and profiles without a code.
CALL_CODE = r"\b([abc][12]-\d{2}(?:-[a-z0-9]{2,5})*)\b"
TOLERATED = ("especialidad_apt", "especialidad_fondos_europeos")
PORTAL_PROFILES = (
    r"\bsuperior de administracion\b", r"\bcuerpo administrativo\b", r"\bcuerpo auxiliar\b", r"\badministrativ[oa]\b",
    r"\bauxiliar administrativ[oa]\b",
)
GENERAL_BODY = r"^(?:a1|a2|c1|c2)-01(?:-[a-z0-9]+)*$"


def call_scope(n_title: Column | str, n_call: Column | str, tolerated=TOLERATED, profiles=PORTAL_PROFILES) -> Column:
    """Whether an open call is general administration, with the reason, codes and shift."""
    title = col(n_title)
    codes = F.array_sort(F.array_distinct(F.regexp_extract_all(title, F.lit(CALL_CODE), F.lit(1))))
    internal = has(title, ("promocion interna",)) | F.coalesce(col(n_call) == "promocion interna", F.lit(False))
    other = matches(title, r"\bturno\b") & ~has(title, ("turno libre",))
    special = specialism(title)
    spared = special.isin(*tolerated) & has(title, ("cuerpo superior de administracion",)) if tolerated else F.lit(False)
    coded = F.size(codes) > 0
    special = F.when(~(coded & F.coalesce(spared, F.lit(False))), special)
    reason = chain(
        (internal, "promocion_interna"),
        (other, "turno_no_libre"),
        (coded & ~F.exists(codes, lambda x: x.rlike(GENERAL_BODY)), "cuerpo_no_administrativo_general"),
        (special.isNotNull(), special),
        (coded | either(title, profiles), F.lit(None).cast("string")),
        default="sin_perfil_administrativo",
    )
    return F.struct(
        reason.isNull().alias("administrative"),
        reason.alias("reason"),
        F.array_join(F.transform(codes, F.upper), ",").alias("codes"),
        chain((internal, "PROMOCION_INTERNA"), (other, "OTRO"), default="TURNO_LIBRE").alias("shift"),
    )


# --- C18-C22 --------------------------------------------------------------------------------------------------

def cycle_state(n_stage: Column | str) -> Column:
    """State of the selection cycle told by the current stage of a card."""
    stage = F.trim(col(n_stage))
    named = matches(stage, "^(?:nombramiento|nomenament)") & ~has(stage, ("tribunal",))
    return chain((has(stage, R.TERMINAL_STAGES) | named, R.FINISHED), default=R.RUNNING)


def ad_state(n_stage: Column | str, reason: Column | str) -> Column:
    """State of a hard-to-fill ad."""
    return chain(
        (matches(n_stage, "anulacion|anul·lacio|anullacio"), R.ANNULLED),
        (matches(n_stage, "adjudicacion|adjudicacio"), R.FINISHED),
        (F.coalesce(col(reason) == "PLAZO_CERRADO", F.lit(False)), R.FINISHED),
        default=R.RUNNING,
    )


def actionable(opens: Column | str, closes: Column | str, term: Column | str, as_of: Column) -> Column:
    """C20: whether an ad can be answered on ``as_of``, with the reason."""
    opens, closes, term = col(opens), col(closes), col(term)
    yes = F.coalesce
    no = F.lit(False)
    reason = chain(
        (yes(term == "CERRADO", no) | yes(closes < as_of, no), "PLAZO_CERRADO"),
        (yes(opens > as_of, no), "PLAZO_PENDIENTE"),
        (yes(term == "ABIERTO", no) | yes((opens <= as_of) & (closes >= as_of), no), "PLAZO_ABIERTO"),
        (opens.isNull() & yes(closes >= as_of, no), "PLAZO_ABIERTO"),
        default="PLAZO_NO_ACREDITADO",
    )
    return F.struct((reason == "PLAZO_ABIERTO").alias("actionable"), reason.alias("reason"))


def pool_operating(n_phase: Column | str) -> Column:
    """Pool in operation, from the first 80 characters of its phase; null when it cannot be read."""
    head = F.left(F.trim(col(n_phase)), F.lit(80))
    return F.when(head != "", head.rlike("en funcionamiento|en funcionament"))


# --- C23-C31 ----------------------------------------------------------------------------------------------------

def is_private(process_type: Column | str, category: Column | str) -> Column:
    """Pools and ads belong to the restricted category."""
    kind = F.coalesce(F.lower(F.trim(col(process_type))).isin(*R.PRIVATE_TYPES), F.lit(False))
    return kind | F.coalesce(F.upper(F.trim(col(category))).isin(*R.PRIVATE_CATEGORIES), F.lit(False))


# Words that state a reserve for disability.
RESERVE = ("discapacidad", "diversidad funcional", "diversitat funcional")


def shift_compatible(n_title: Column | str, n_shift: Column | str) -> Column:
    """Does the shift a notice states fit the process?  Null when the notice states none."""
    reserved = has(n_shift, RESERVE)
    return F.when(has(n_title, RESERVE), reserved).when(
        matches(n_title, r"\b(?:turno|torn)\s+(?:libre|lliure)\b"), has(n_shift, ("libre", "lliure")) & ~reserved
    )


def mentions_town(n_text: Column | str, n_agency: Column | str) -> Column:
    """The document names the municipality of the agency."""
    text = F.regexp_replace(col(n_text), "[^a-z0-9]+", " ")
    name = F.regexp_replace(
        F.trim(col(n_agency)),
        "^(?:ayuntamiento|mancomunidad|mancomunitat|diputacion provincial)\\s+(?:de |del |d')?", "",
    )
    aliases = F.transform(
        F.split(name, "/"), lambda a: F.trim(F.regexp_replace(a, "[^a-z0-9]+", " "))
    )
    return F.coalesce(let(text, lambda t: F.exists(aliases, lambda a: (a != "") & F.contains(t, a))), F.lit(False))


def term_state(n_header: Column | str) -> Column:
    """Application term stated in the head of a card page."""
    return chain(
        (has(n_header, ("plazo abierto",)), "ABIERTO"),
        (has(n_header, ("plazo cerrado",)), "CERRADO"),
        (has(n_header, ("plazo pendiente",)), "PENDIENTE"),
    )


def is_application_stage(n_stage: Column | str) -> Column:
    """Only these stages carry the application term."""
    return has(n_stage, R.APPLICATION_STAGES)


def visible_to(df: DataFrame, entitled: DataFrame, user: str = "user_id", private: str = "private") -> DataFrame:
    """Rows a user may see: the restricted category only for entitled users."""
    may = entitled.select(user).distinct().withColumn("_may", F.lit(True))
    return df.join(may, user, "left").filter(~F.col(private) | F.coalesce("_may", F.lit(False))).drop("_may")


# The start of a maintenance page, in both languages.
OUT_OF_SERVICE = r"(?i)^[^\p{L}\p{N}_]*aplicaci(?:[oó]n\s+fuera\s+de\s+servicio|[oó]\s+fora\s+de\s+servei)"


def is_maintenance(html: Column | str) -> Column:
    """The visible text of a page opens with the maintenance notice."""
    from edictal.functions.text import html_text

    said = matches(html, r"(?i)fuera\s+de\s+servicio|fora\s+de\s+servei")
    return said & matches(html_text(html), OUT_OF_SERVICE)


# Vocabulary of a manual correction.
GROUPS, SUBGROUPS = ("A", "B", "C", "D", "E"), ("A1", "A2", "B", "C1", "C2", "D", "E")
SCALES = ("administración general", "administracion general", "administración especial", "administracion especial")


def validate_correction(grp, subgroup, scale, opens, closes, evidence) -> Column:
    """Codes of what is wrong with a manual correction, none when it can be saved."""
    def given(c) -> Column:
        return F.nullif(F.trim(col(c)), F.lit(""))

    g, s, sc = F.upper(given(grp)), F.upper(given(subgroup)), F.lower(given(scale))
    o, c = col(opens), col(closes)
    bad = (
        (~F.coalesce(F.trim(col(evidence)).rlike(r"^https?://[^/\s]+"), F.lit(False)), "EVIDENCE"),
        (~g.isin(*GROUPS), "GROUP"),
        (~s.isin(*SUBGROUPS), "SUBGROUP"),
        (F.left(s, F.lit(1)) != g, "INCOHERENT"),
        (~sc.isin(*SCALES), "SCALE"),
        (o.isNull() != c.isNull(), "ONE_DATE"),
        (o > c, "DATE_ORDER"),
    )
    return F.array_compact(F.array(*[F.when(F.coalesce(wrong, F.lit(False)), F.lit(code)) for wrong, code in bad]))


# Routes of access of the state portal and what they imply; agencies it belongs to or not.
ROUTES = {
    "INGRESO_LIBRE": ("Oposición", "TURNO_LIBRE"),
    "INTERINIDAD": ("Bolsa de trabajo", "TURNO_LIBRE"),
    "CONTRATACION_FIJA": ("Contratación laboral indefinida", "TURNO_LIBRE"),
}
OWN_AGENCY = (
    "generalitat valenciana", "presidencia de la generalitat", "vicepresidencia", "conselleria", "labora",
    "agencia valenciana", "agencia tributaria valenciana", "institut valencia", "instituto valenciano",
)
FOREIGN_AGENCY = ("universitat", "universidad", "ayuntamiento", "ajuntament", "diputacion", "diputacio")


def route_defaults(route: Column | str) -> Column:
    """Process type and shift implied by a route of access."""
    route = col(route)
    return F.struct(
        chain(*[(route == r, kind) for r, (kind, _) in ROUTES.items()]).alias("kind"),
        chain(*[(route == r, shift) for r, (_, shift) in ROUTES.items()]).alias("shift"),
    )


def portal_decision(n_title, n_text, n_agency, route, own=OWN_AGENCY, foreign=FOREIGN_AGENCY, profiles=PORTAL_PROFILES) -> Column:
    """C17: whether a portal card is an opportunity, with the reason: codes in the text prevail over the
    title; then the agency, then the route of access."""
    stated = F.array_sort(F.array_distinct(F.regexp_extract_all(col(n_text), F.lit(r"\b([a-c]\d-\d{2}(?:-[a-z0-9]+)*)\b"), F.lit(1))))
    codes = F.array_intersect(stated, F.array(*[F.lit(c) for c in R.GENERAL_CODES]))
    general = F.when(F.size(stated) > 0, F.size(codes) > 0).otherwise(either(n_title, profiles))
    agency = chain((has(n_agency, foreign), "NO"), (has(n_agency, own), "SI"), default="REVISION")
    reason = chain(
        (general & (agency == "SI") & col(route).isin(*ROUTES), "incluida"),
        (col(route) == "PROMOCION_INTERNA", "promocion_interna"),
        (~general, "fuera_ambito_administrativo"),
        (agency == "NO", "organismo_excluido"),
        (agency == "REVISION", "organismo_revision"),
        default="via_no_incluida",
    )
    return F.struct(
        (reason == "incluida").alias("included"), reason.alias("reason"),
        F.array_join(F.transform(codes, lambda x: F.upper(x)), ",").alias("codes"), agency.alias("agency"),
    )


def of_agency_type(df: DataFrame, header: str, kind: str) -> DataFrame:
    """Rows whose header names an agency of one kind."""
    from edictal.functions.text import fold

    n = fold(header)
    county = has(n, ("diputacion provincial", "diputacio provincial", "diputacion de alicante"))
    found = chain((county, "DIPUTACION"), (has(n, ("ayuntamiento", "ajuntament")), "AYUNTAMIENTO"), default="OTRO")
    return df.filter(found == kind)


# Scope of a city portal, shifts it excludes and words of a finished process.
CITY_RULES = {
    "in": (
        r"\badministrativ[oa]/?a?\b", r"\baux(?:iliar)?\.?\s+administrativ[oa]/?a?\b",
        r"tecnic[oa]/?a?\s+(?:de\s+)?administracion\s+general", r"tecnic[oa]/?a?\s+gestion\s+administracion\s+general",
        r"gestio[nó]\s+administracio[nó]\s+general",
    ),
    "out": (
        r"promocion\s+interna", r"provision\s+definitiva", r"libre\s+designacion",
        r"concurso\s+de\s+meritos\s+para\s+(?:la\s+)?provision\s+de\s+(?:un|dos|\d+)\s+puesto",
    ),
    "shifts": ("promocion interna", "promocion_interna", "movilidad", "promocion interadministrativa"),
    "final": (
        "propuesta nombramiento", "propuesta de nombramiento", "nombramiento como personal", "aspirante definitivo",
        "constitucion de bolsa de trabajo", "finalizado",
    ),
}


def local_decision(n_name, n_shift, n_text, rules: dict = CITY_RULES) -> Column:
    """Scope, end and opportunity by the rules of one local portal."""
    inside = ~either(n_name, rules["out"]) & either(n_name, rules["in"])
    finished = has(n_text, rules["final"])
    return F.struct(
        inside.alias("in_scope"), finished.alias("finished"),
        (inside & ~has(n_shift, rules["shifts"]) & ~finished).alias("opportunity"),
    )
