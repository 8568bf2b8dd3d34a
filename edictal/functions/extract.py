"""Field extraction (X1-X25): numbers, dates, codes and classes stated by official texts.

Arguments named ``n`` are folded text; the others are raw.  Nothing is ever guessed: what a text does
not state is null, and two different statements are null as well where the rule asks for one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions.classify import chain, has, matches, scope
from edictal.functions.text import TITLE_START, col, fold, found, let, squeeze


def lookup(word: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), word)


def integer(c: Column) -> Column:
    return c.try_cast("int")


# --- numbers -------------------------------------------------------------------------------------------

def spelled_number(words: Column | str) -> Column:
    """Number in words, "cuarenta y cinco" included; null when any word is unknown."""
    parts = F.split(F.trim(col(words)), r"\s+(?:y|i)\s+")
    total = F.aggregate(
        F.transform(parts, lambda w: lookup(w, R.NUMBER_WORDS)), F.lit(0), lambda a, x: a + x
    )
    return F.nullif(total, F.lit(0))


def days_stated(n: Column | str) -> Column:
    """Days of a term, in digits first, else in words."""
    digits = found(n, r"\b(\d+)\s+(?:dias?|dies)\b")
    words = found(n, r"\b((?:[a-z]+\s+(?:y|i)\s+)?[a-z]+)\s+(?:dias?|dies)\b")
    return F.when(digits.isNotNull(), integer(digits)).otherwise(spelled_number(words))


NUMBER_OF_PLACES = r"(?i)\b(vint-i-[a-z]+|veinti[a-z]+|\d{1,3}|[a-z]+)\s+(?:places?|plaça|plazas?|llocs?|puestos?)\b"
SEVERAL_PLACES = r"(?i)\b(?:diverses|varias|diversas)\s+(?:places?|plazas?|llocs?)\b"
THE_PLACE = r"(?i)\b(?:la|el|del|de\s+la)\s+(?:plaça|plaza|lloc|puesto)\b"


def places(title: Column | str) -> Column:
    """Places an edict title states, 1 to 200, the first usable number; "the place" is one."""
    text = F.trim(col(title))

    def value(word: Column) -> Column:
        w = F.lower(word)
        unit = lookup(F.substr(w, F.lit(8)), R.TITLE_NUMBERS)
        return F.when(w.rlike(r"^\d+$"), integer(w)).when(w.startswith("vint-i-"), F.when(unit < 10, unit + 20)).otherwise(
            lookup(w, R.TITLE_NUMBERS)
        )

    values = F.transform(F.regexp_extract_all(text, F.lit(NUMBER_OF_PLACES), F.lit(1)), value)
    usable = F.filter(values, lambda v: v.between(1, 200))
    first = F.get(usable, F.lit(0))
    return F.when(
        text.rlike(TITLE_START),
        F.coalesce(first, F.when(~text.rlike(SEVERAL_PLACES) & text.rlike(THE_PLACE), 1)),
    )


def selection_places(n: Column | str) -> Column:
    """Places a selection announces."""
    words = "una|uno|un|dos|tres|cuatro|quatre|cinco|cinc|seis|sis|siete|set|ocho|vuit|nueve|nou|diez|deu"
    word = F.coalesce(
        found(n, rf"(?:seleccion|seleccio)\s+(?:de |d['’])({words}|\d+)\s+(?:plazas?|places?|placa)"),
        found(n, rf"convocatoria\s+de\s+({words}|\d+)\s+(?:plazas?|places?)"),
    )
    return F.when(word.rlike(r"^\d+$"), integer(word)).otherwise(lookup(word, R.NUMBER_WORDS))


def _quota(n: Column | str, shift: str) -> Column:
    return integer(
        F.coalesce(
            found(n, rf"\b(\d+)\s+(?:plazas?|places?)\s+(?:por|en)\s+{shift}\b"),
            found(n, rf"\b(\d+)\s+(?:por|en)\s+{shift}\b"),
            found(n, rf"\b{shift.replace('(?:el )?', '')}\s*[:,-]?\s*(\d+)\s+(?:plazas?|places?)\b"),
        )
    )


def shift_places(n: Column | str, shift: Column | str) -> Column:
    """Quotas stated per shift and the number to show: the open quota when the shift is open."""
    open_ = _quota(n, r"(?:el )?turno\s+libre")
    internal = _quota(n, r"promocion\s+interna")
    shown = F.coalesce(F.when(col(shift) == "TURNO_LIBRE", open_), open_, selection_places(n))
    return F.struct(open_.alias("open"), internal.alias("internal"), shown.alias("shown"))


def dotted_int(c: Column | str) -> Column:
    """Integer with dots for thousands."""
    return integer(F.replace(F.nullif(F.regexp_extract(col(c), r"[\d.]+", 0), F.lit("")), F.lit("."), F.lit("")))


def total_places(c: Column | str) -> Column:
    """Total stated by a card page, in any of its layouts."""
    return dotted_int(
        F.coalesce(
            found(c, r"(?i)N[úu]m\.?\s+de\s+plazas\s+totales\s*:?\s*(\d[\d.]*)"),
            found(c, r"(?i)(?:N[º°o]\.?|N[úu]mero)\s*(?:de\s+)?plazas\s+totales\s*:?\s*(\d[\d.]*)"),
            found(c, r"(?i)\bPlazas\s+(\d[\d.]*)\s+Descripci[óo]n\s+de\s+plazas"),
        )
    )


# --- group and subgroup ----------------------------------------------------------------------------------

def declared_class(n: Column | str) -> Column:
    """Labelled group, subgroup and scale; the combined label first."""
    text = col(n)
    # Every label of a group has this stem.
    n = F.when(F.contains(text, F.lit("grup")), text)
    both = r"\b(?:grupo|grup)\s*/\s*(?:subgrupo|subgrup)\s*[:.\-]?\s*([a-e])\s*/\s*([a-e][1-3])\b"
    combined = found(n, both, 2)
    sub = found(n, r"\b(?:subgrupo|subgrup)\s*[:.\-]?\s*([a-e][1-3])\b")
    group = found(n, r"\b(?:grupo|grup)\s*[:.\-]?\s*([a-e](?:[1-3])?)\b")
    subgroup = F.upper(F.coalesce(combined, sub, F.when(F.length(group) == 2, group)))
    scale = found(
        text,
        r"\b(?:cuerpo\s*(?:/|y)?\s*escala|cos\s*(?:/|i)?\s*escala|escala)\s*(?:(?::|\.|\-)|(?:d['’](?:e)?|de))\s*"
        r"administracion?\s+(general|especial)\b",
    )
    return F.struct(
        F.upper(F.coalesce(found(n, both, 1), F.left(sub, F.lit(1)), F.left(group, F.lit(1)))).alias("grp"),
        subgroup.alias("subgroup"),
        F.when(scale == "general", "Administración General").when(scale == "especial", "Administración Especial").alias("scale"),
    )


def short_class(n: Column | str) -> Column:
    """``grupo A1`` or ``subgrupo C1/C2`` in running text."""
    sub = F.upper(found(n, r"(?:subgrupo|grupo)\s*:?\s*([abc]\d(?:/\d)?)"))
    return F.struct(F.left(sub, F.lit(1)).alias("grp"), sub.alias("subgroup"))


def class_from_subscale(n: Column | str) -> Column:
    """Subgroup of the one subscale or class the text declares."""
    n = col(n)
    general = F.contains(n, F.lit("administracion general"))


    def only(table: dict, says) -> Column:
        """The subgroup of the one word of the table that the text says."""
        stated = F.array_compact(F.array(*[F.when(says(k), F.lit(g)) for k, g in table.items()]))
        return let(stated, lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0))))

    def by_fragment(fragment: Column) -> Column:
        middle = fragment.rlike(r"\btecnicas?\b") & fragment.rlike(r"\bclase\s+(?:de\s+)?(?:tecnico\s+)?medi[ao]\b")
        named = only(R.SUBGROUP_OF_SUBSCALE, lambda k: fragment.rlike(rf"\b{k}s?\b"))
        return let(named, lambda s: F.when(s.isNotNull() & middle, "A2").otherwise(s))

    by_subscale = let(F.regexp_extract(n, r"subescala\s+(?:de\s+|d')?([^,.;]{1,50})", 1), by_fragment)
    by_class = only(R.SUBGROUP_OF_CLASS, lambda k: F.contains(n, F.lit(k)))
    subgroup = F.when(general, by_subscale).when(F.contains(n, F.lit("administracion especial")), by_class)
    return F.struct(F.left(subgroup, F.lit(1)).alias("grp"), subgroup.alias("subgroup"))


VACANCY_ROW = r"\b([abc])\s+(a1|a2|c1|c2)\s+[a-z ]{3,30}?\s+(\d{1,3})\b"


def class_from_table(n: Column | str) -> Column:
    """Subgroup and places of the vacancy table, else the one subgroup in prose, else the subscale."""

    def stated(n: Column) -> Column:
        table = F.when(F.contains(n, F.lit("vacantes")), F.substr(n, F.locate("vacantes", n)))
        rows = F.array_distinct(
            F.filter(
                F.transform(
                    F.regexp_extract_all(table, F.lit(VACANCY_ROW), F.lit(0)),
                    lambda r: F.struct(
                        F.regexp_extract(r, VACANCY_ROW, 1).alias("g"),
                        F.upper(F.regexp_extract(r, VACANCY_ROW, 2)).alias("sub"),
                        F.regexp_extract(r, VACANCY_ROW, 3).cast("int").alias("n"),
                    ),
                ),
                lambda x: F.lower(F.left(x["sub"], F.lit(1))) == x["g"],
            )
        )
        prose = F.array_distinct(F.transform(F.regexp_extract_all(n, F.lit(r"\bsubgrupo\s*[:.-]?\s*(a1|a2|c1|c2)\b"), F.lit(1)), F.upper))
        return let(rows, lambda r: let(F.when(F.contains(n, F.lit("subgrupo")), prose), lambda p: decided(n, r, p)))

    def decided(n: Column, rows: Column, prose: Column) -> Column:
        listed = F.coalesce(F.size(rows) > 0, F.lit(False))
        in_prose = F.size(prose) == 1
        subs = F.array_distinct(F.transform(rows, lambda x: x["sub"]))
        subgroup = F.when(listed, F.when(F.size(subs) == 1, F.get(subs, F.lit(0)))).when(in_prose, F.get(prose, F.lit(0))).otherwise(
            class_from_subscale(n)["subgroup"]
        )
        origin = F.when(listed, "TABLA").when(in_prose, "TEXTO").otherwise("SUBESCALA")
        total = F.aggregate(rows, F.lit(0), lambda a, x: a + x["n"])
        return let(subgroup, lambda s: F.struct(
            F.left(s, F.lit(1)).alias("grp"),
            s.alias("subgroup"),
            F.when(listed & s.isNotNull(), total).alias("places"),
            F.when(s.isNotNull(), origin).alias("origin"),
        ))

    return let(F.regexp_replace(col(n), r"\s+", " "), stated)


def class_agree(subgroups: Column) -> Column:
    """The subgroup when all the texts that state one agree."""
    stated = F.array_distinct(F.array_compact(subgroups))
    return F.when(F.size(stated) == 1, F.get(stated, F.lit(0)))


def class_from_name(name: Column | str) -> Column:
    """Subgroup of an exact job name, gender forms removed; the last resort."""
    n = fold(name)
    for pattern, plain in (
        (r"\btecnico\s+o\s+tecnica\b", "tecnico"),
        (r"\b(administrativo)\s+(?:o|/)\s*administrativa\b", "$1"),
        (r"\b(tecnico|administrativo|auxiliar)\s*/\s*(?:a|[a-z]+a)\b", "$1"),
        (r"([a-z])/a\b", "$1"),
        ("[^a-z ]", " "),
        (r"\s+", " "),
    ):
        n = F.regexp_replace(n, pattern, plain)
    subgroup = lookup(F.trim(n), R.SUBGROUP_OF_NAME)
    return F.struct(F.left(subgroup, F.lit(1)).alias("grp"), subgroup.alias("subgroup"))


# --- dates ---------------------------------------------------------------------------------------------------

def ymd(year: Column, month: Column, day: Column) -> Column:
    """Date from its parts; null when there is no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def first_date(c: Column | str, p: str, year: int, month: int, day: int, name=lambda m: m) -> Column:
    """Date of the first place that fits ``p``, by the numbers of its groups.  The text is searched once; its parts are read from that place."""
    return let(F.regexp_extract(col(c), p, 0), lambda h: F.when(h != "", ymd(found(h, p, year), name(found(h, p, month)), found(h, p, day))))


def month_number(word: Column) -> Column:
    return lookup(word, R.MONTHS)


def numeric_date(c: Column | str) -> Column:
    """X11: first dd/mm/yyyy or dd-mm-yyyy."""
    return first_date(c, r"(\d{1,2})[-/](\d{1,2})[-/](\d{4})", 3, 2, 1)


def worded_date(n: Column | str) -> Column:
    """X11: first "5 de marzo de 1999" or "17 d'abril de 2026"."""
    p = r"\b(\d{1,2})\s+(?:de\s+|del\s+|d['’])?(" + "|".join(R.MONTHS) + r")\s+(?:de\s+|del\s+|de\s+l['’])?(\d{4})\b"
    return first_date(n, p, 3, 2, 1, month_number)


def any_date(c: Column | str, numeric: Column | str | None = None, worded: Column | str | None = None) -> Column:
    """X11: ISO, numeric or worded date, in that order; the latter two may be columns that are ready."""
    iso = r"(\d{4})-(\d{1,2})-(\d{1,2})"
    numeric = numeric_date(c) if numeric is None else col(numeric)
    return F.coalesce(first_date(c, iso, 1, 2, 3), numeric, worded_date(fold(c)) if worded is None else col(worded))


def date_range(c: Column | str, label: str = "(?:Plazo|Termini)") -> Column:
    """X12: "from … to …", only right after its label."""
    p = (
        rf"(?i){label}(?:\s+de\s+(?:presentaci[oó]n|presentacio|la etapa actual))?\s*:?\s*(?:Desde|Des de)?\s*(?:el\s+)?"
        r"(\d{2}[-/]\d{2}[-/]\d{4})\s*(?:hasta|fins(?:\s+al)?|a)\s*(?:el\s+)?(\d{2}[-/]\d{2}[-/]\d{4})"
    )
    return F.struct(numeric_date(found(c, p, 1)).alias("opens"), numeric_date(found(c, p, 2)).alias("closes"))


def all_dates(c: Column | str) -> Column:
    hits = F.regexp_extract_all(col(c), F.lit(r"\b\d{2}[-/]\d{2}[-/]\d{4}\b"), F.lit(0))
    return F.array_compact(F.transform(hits, lambda x: F.try_to_date(F.replace(x, F.lit("/"), F.lit("-")), "dd-MM-yyyy")))


def extreme_dates(c: Column | str) -> Column:
    """Earliest and latest of the numeric dates in a text."""
    dates = all_dates(c)
    return F.struct(F.array_min(dates).alias("earliest"), F.array_max(dates).alias("latest"))


def closing_date(n: Column | str) -> Column:
    """X11: closing date an ad declares in words."""
    p = (
        r"(?:plazo\s+presentacion|termini\s+presentacio)\s*:?\s*(?:hasta\s+el|hasta|fins\s+al|fins\s+a)\s+(\d{1,2})\s+"
        r"(?:de\s+|del\s+|d')?\s*([a-z]+)\s+(?:de\s+|del\s+|de\s+l')?(\d{4})"
    )
    return first_date(n, p, 3, 2, 1, month_number)


# --- codes, citations, stages ------------------------------------------------------------------------------------

def call_code(n: Column | str) -> Column:
    """Code of a call and the year it carries."""
    code = F.upper(F.regexp_replace(found(n, r"convocatoria\s*:?\s*([a-z]?\s*\d{1,3}/\d{2,4}[a-z]?)(?![a-z0-9])"), r"\s+", ""))
    year = integer(found(code, r"/(\d{2,4})[A-Z]?$"))
    return F.struct(code.alias("code"), F.when(year < 100, year + 2000).otherwise(year).alias("year"))


def file_code(n: Column | str) -> Column:
    """File or call code that identifies a process."""
    raw = F.coalesce(
        found(n, r"\b(?:expedient|expediente)\s*(?:num\.?|numero)?\s*[:.-]?\s*([a-z0-9][a-z0-9._/-]{3,})"),
        found(n, r"\b(?:codi|codigo)\s+(?:de\s+)?convocatoria\s*[:.-]?\s*([a-z0-9][a-z0-9._/-]{3,})"),
    )
    return F.upper(F.rtrim(raw, F.lit(".,;:")))


BASE_CITATION = (
    r"(?i)bolet[ií]n oficial de la provincia de\s+([^»<]+?)\s*[»\"]?\s+n[uú]mero\s+(\d+),\s+de\s+(\d{1,2})\s+de\s+"
    r"([a-záéíóúñ]+)\s+de\s+(\d{4})"
)


def base_citation(c: Column | str) -> Column:
    """Province, number and date of the provincial bulletin that carries the rules."""
    number = found(c, BASE_CITATION, 2)
    return F.struct(
        F.trim(found(c, BASE_CITATION, 1)).alias("province"),
        integer(number).alias("number"),
        ymd(found(c, BASE_CITATION, 5), lookup(F.lower(found(c, BASE_CITATION, 4)), R.MONTHS), found(c, BASE_CITATION, 3)).alias("date"),
    )


MONTHS_ES = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"


def resolution_dates(c: Column | str) -> Column:
    """Date of the resolution and of the earlier one it annuls or corrects."""
    own = rf"(?i)resoluci[oó]n\s+de\s+(\d{{1,2}})\s+de\s+({MONTHS_ES})\s+de\s+(\d{{4}})"
    cited = (
        r"(?i)(?:deja\s+sin\s+efecto|correcci[oó]n\s+de\s+errores\s+de)\s+la\s+de\s+"
        rf"(\d{{1,2}})\s+de\s+({MONTHS_ES})\s+de\s+(\d{{4}})"
    )

    def date(p: str) -> Column:
        return first_date(c, p, 3, 2, 1, lambda m: month_number(F.lower(m)))

    return F.struct(date(own).alias("own"), date(cited).alias("cited"))


DEADLINE_FORMS = (
    r"(?i)((?:El )?plazo de presentaci[oó]n de solicitudes[^.]{0,350}\.)",
    r"(?i)((?:El )?plazo para (?:la )?presentaci[oó]n de solicitudes[^.]{0,350}\.)",
    r"(?i)((?:El )?plazo para presentar solicitudes[^.]{0,350}\.)",
    r"(?i)(Las solicitudes se presentar[aá]n[^.]{0,350}\.)",
)


def deadline_literal(c: Column | str) -> Column:
    """The sentence that states the application term, not yet interpreted."""
    return F.trim(F.coalesce(*[found(c, p) for p in DEADLINE_FORMS]))


COUNT = (
    r"(\d+|una|un|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez|once|doce|trece|catorce|quince|dieciseis|"
    r"dieciséis|diecisiete|dieciocho|diecinueve|veinte)"
)
STATES_PLACES = rf"(?i)\b{COUNT}\s+plazas?\s+de\b"
PLACE_FRAGMENT = rf"(?i)\b{COUNT}\s+plazas?\s+de\s+([^,.;]+)"


def place_fragment(c: Column | str) -> Column:
    """Places, job, system and shift of a sentence that states places."""
    number = F.lower(found(c, PLACE_FRAGMENT, 1))
    turn = F.rtrim(F.trim(found(c, r"(?i)(?:en|por) turno\s+([^.;]+)")), F.lit(","))
    return F.struct(
        F.when(number.rlike(r"^\d+$"), integer(number)).otherwise(lookup(F.replace(number, F.lit("é"), F.lit("e")), R.NUMBER_WORDS)).alias("places"),
        F.trim(found(c, PLACE_FRAGMENT, 2)).alias("job"),
        F.trim(found(c, r"(?i)por el sistema de\s+([^,.;]+)")).alias("system"),
        F.coalesce(turn, F.when(matches(c, r"(?i)promoci[oó]n interna"), "promoción interna")).alias("shift"),
    )


def fragment_scope(n_fragment: Column | str, n_job: Column | str) -> Column:
    """Scope of a place fragment, the documented misprint corrected first."""
    fix = lambda x: F.regexp_replace(F.coalesce(col(x), F.lit("")), *R.TYPO)
    return scope(F.concat_ws(" ", fix(n_job), fix(n_fragment)), fix(n_job))


POOL = r"\b(?:bolsa|borsa)\s*(?:n(?:um(?:ero)?)?[.ºo]?\s*)?(\d{2,4}(?:/\d{2,4})?(?:[- ]?[bl])?)\b"
CLONED = r"\b(?:bolsa|borsa)\s+clonada\s*[-–:]?\s*(\d{2,4}-?[bl])\b"
POOL_LIST = r"\b(?:bolsas|borses)\s*[:.]?\s*((?:\d{2,4}(?:/\d{2,4})?(?:[- ]?[bl])?\s*[,.;]?\s*)+)"
POOL_REF = r"\b\d{2,4}(?:/\d{2,4})?(?:[- ]?[bl])?\b"
POOL_MARK = r"seguents\s+borses|siguientes\s+bolsas"
POOL_LINE = r"(?m)^\s*(\d{2,4}-[bl])\."
POOL_WINDOW = 6000


def pool_refs(n: Column | str) -> Column:
    """Pool references a document states: single, cloned, listed, or line by line after a header."""
    n = col(n)
    clean = lambda a: F.transform(a, lambda x: F.replace(F.upper(x), F.lit(" "), F.lit("")))
    cloned = F.transform(
        F.regexp_extract_all(n, F.lit(CLONED), F.lit(1)), lambda x: F.regexp_replace(F.upper(x), r"^(\d+)-?([BL])$", "$1-$2")
    )
    listed = F.flatten(
        F.transform(F.regexp_extract_all(n, F.lit(POOL_LIST), F.lit(1)), lambda x: F.regexp_extract_all(x, F.lit(POOL_REF), F.lit(0)))
    )
    tails = F.transform(
        F.slice(F.split(n, POOL_MARK), F.lit(2), F.size(F.split(n, POOL_MARK))), lambda t: F.left(t, F.lit(POOL_WINDOW))
    )
    lines = F.flatten(F.transform(tails, lambda t: F.regexp_extract_all(t, F.lit(POOL_LINE), F.lit(1))))
    single = F.regexp_extract_all(n, F.lit(POOL), F.lit(1))
    return F.array_sort(F.array_distinct(F.flatten(F.array(clean(single), cloned, clean(listed), clean(lines)))))


STAGE_END = (
    r"(?:Data publicaci|Fecha publicaci|Termini|Plazo|Documents?|Documentos?|C[oó]digo SIA|Codi SIA|C[oó]digo GVA|Codi GVA|"
    r"Descargar|Descarregar|Convocatoria)"
)
PHASE_END = (
    r"(?:\s+(?:Plazo|Publicaci[oó]n Web|Forma de presentaci[oó]n|Enlaces|Informaci[oó]n complementaria|Listado de etapas|"
    r"Etapa actual)\b|$)"
)


def stage_phase(c: Column | str) -> Column:
    """Current stage and phase of a card text; the stage is the last one stated before the phase."""
    text = squeeze(c)
    phase = found(text, rf"(?i)\bFase\s*:?\s*(.+?){PHASE_END}")
    before = F.regexp_extract(text, r"(?i)^(.*?)\bFase\s*:?\s*.", 1)
    last = F.nullif(F.trim(F.regexp_extract(before, r"(?i)^.*Etapa actual\s*:\s*(.*)$", 1)), F.lit(""))
    alone = F.trim(found(text, rf"(?i)Etapa actual\s*:\s*(.+?)\s*\b{STAGE_END}"))
    return F.struct(F.when(phase.isNotNull(), last).otherwise(alone).alias("stage"), phase.alias("phase"))


# --- shift and type --------------------------------------------------------------------------------------------------

# Shifts and the phrases that state them, in the order of the two kinds of source.
SHIFT_BULLETIN = (
    ("ESTABILIZACION", ("estabilizacion",)),
    ("TURNO_LIBRE", ("turno libre", "oposicion lliure", "oposicion libre")),
    ("PROMOCION_INTERNA", ("promocion interna",)),
)
SHIFT_CARD = (
    ("PROMOCION_INTERNA", ("promocion interna",)),
    ("TURNO_LIBRE", ("turno libre",)),
    ("DISCAPACIDAD_INTELECTUAL", ("discapacidad intelectual",)),
    ("DISCAPACIDAD", ("discapacidad",)),
)
SHIFT_CORRECTION = (
    ("DISCAPACIDAD_INTELECTUAL", ("discapacidad intelectual",)),
    ("PROMOCION_INTERNA", ("promocion interna",)),
    ("TURNO_LIBRE", ("turno libre",)),
    ("DISCAPACIDAD", ("discapacidad",)),
)
POOL_TITLE = ("bolsa de trabajo", "bolsa de empleo", "borsa de treball")
CONTEST = ("concurso-oposicion", "concurso oposicion", "concurs-oposicio", "concurs oposicio")


def shift(n: Column | str, order=SHIFT_BULLETIN) -> Column:
    """Shift a text states; the order of the tests belongs to the source."""
    return chain(*[(has(n, words), name) for name, words in order])


def process_type(n_text: Column | str, n_title: Column | str) -> Column:
    """Process type; a pool only if the title says so."""
    return chain(
        (has(n_title, POOL_TITLE), "Bolsa de trabajo"),
        (has(n_text, CONTEST), "Concurso-oposición"),
        (has(n_text, ("oposicion", "oposicio")), "Oposición"),
        default="Proceso selectivo",
    )


def combine_terms(stages: Column) -> Column:
    """First opening, last closing and the bulletin of the first of several application stages.

    ``stages`` is an array of structs with ``opens``, ``closes``, ``bulletin``, oldest first.
    """
    useful = F.filter(stages, lambda s: s["opens"].isNotNull() | s["bulletin"].isNotNull())
    return F.struct(
        F.array_min(F.transform(useful, lambda s: s["opens"])).alias("opens"),
        F.array_max(F.transform(useful, lambda s: s["closes"])).alias("closes"),
        F.get(useful, F.lit(0))["bulletin"].alias("bulletin"),
    )


def application_stages(stages: Column, k: int = 3) -> Column:
    """The stages that open or extend the term, oldest first, at most ``k``.

    ``stages`` is an array of structs with ``name`` (folded), ``published`` and ``stage_id``.
    """
    opening = F.filter(stages, lambda s: s["name"].rlike(R.OPENING_STAGES))
    keyed = F.transform(
        opening, lambda s: F.struct(s["published"].isNull().alias("undated"), s["published"].alias("published"), s["stage_id"].alias("stage_id"), s["name"].alias("name"))
    )
    return F.slice(F.array_sort(keyed), 1, k)
