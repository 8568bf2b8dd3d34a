"""Golden values of the text rules: official titles and what they mean."""

from __future__ import annotations

from pyspark.sql import functions as F

from edictal.functions import classify as C
from edictal.functions import extract as X
from edictal.functions import text as T

A, D, E = "ANULADO", "DESISTIDO", "FINALIZADO"
# Own example sentences, by the rule they exercise: title, process type and the state it proves.
CLOSURES = [
    # nothing to read
    (None, "Oposición", None),
    ("   ", None, None),
    # the call itself is withdrawn
    ("El pleno acuerda la anulación de la convocatoria de jardinería", "Oposición", A),
    ("Acord: es deixa sense efecte la convocatòria de conserges", "Oposició", A),
    ("Decreto de anulación de la bolsa de monitores", "Bolsa de trabajo", A),
    ("Edicto: el municipio desiste de la convocatoria de vigilantes", None, D),
    # something smaller is withdrawn
    ("Corrección: anulación de la pregunta 7 del segundo ejercicio", None, None),
    ("Se anula la lista de aprobados de jardinería", "Oposición", None),
    # it has ended
    ("Decreto de finalización del proceso selectivo de jardinería", None, E),
    ("Acuerdo: se declara desierto el proceso selectivo de conserjes", None, E),
    ("Jardinería: nombramiento como funcionaria de carrera", "Oposición", E),
    ("Toma de posesión de quienes han obtenido plaza de conserje", "Oposición", E),
    ("Resultado final del concurso de conserjes", "Concurso", E),
    # a step of it has ended, or the end is provisional
    ("Finalización del plazo de subsanación de conserjes", None, None),
    ("Relación provisional de aprobados, conserjes", "Oposición", None),
    ("Relación de aprobados del primer ejercicio, conserjes", "Oposición", None),
    ("Nombramiento de un conserje interino", None, None),
    # a list of those who passed feeds a pool and does not close it
    ("Relación de aprobados de jardinería", "Bolsa de trabajo", None),
]


def values(spark, rows, schema, **columns):
    """The computed columns of each row, in row order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    out = df.select("i", *[c.alias(n) for n, c in columns.items()]).orderBy("i").collect()
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]


def test_closing_titles(spark):
    rule = C.closure_rule(T.title_key("title"), C.is_pool_type("kind"))
    got = values(spark, [c[:2] for c in CLOSURES], "title string, kind string", state=C.state_of_rule(rule))
    assert got == [c[2] for c in CLOSURES]


def test_state_labels(spark):
    cases = {"plazo finalizado": None, "finalizado": E, "desierto": E, "anulado": A, "desistido": D, "anulada la pregunta 9": None, "abierta": None}
    assert values(spark, [(x,) for x in cases], "t string", s=C.state_label(T.title_key("t"))) == list(cases.values())


def test_terminal_states(spark):
    got = values(spark, [("FINALIZADO ",), ("anul·lat",), ("EN_CURSO",), (None,)], "s string", t=C.is_terminal("s"))
    assert got == [True, True, False, False]


# Own edict titles, the job they announce and its places.
TITLES = [
    (None, None, None),
    ("Conserje, tres plazas", None, None),
    ("Anunci sobre vint-i-dues places de conserge", "Conserge", 22),
    ("Anuncio del Ayuntamiento de Villanueva sobre bases para cubrir una plaza de arquitecto/a", "Arquitecto/a", 1),
    ("Anunci de l'Ajuntament de Vilanova sobre les bases per a cobrir quatre places d'auxiliar administratiu/va, per oposició.", "Auxiliar administrativo/a", 4),
    ("Anunci de l'Ajuntament de Vilanova sobre les bases per a diverses places d'administratiu/va.", "Administrativo/a", None),
]


def test_titles_and_places(spark):
    got = values(spark, [(t,) for t, _, _ in TITLES], "t string", job=T.clean_title("t"), n=X.places("t"))
    assert got == [(j, n) for _, j, n in TITLES]


def test_class_from_subscale(spark):
    cases = {
        None: None,
        "dos conserjes de administración": None,
        "escala de Administración General, subescala Administrativa, turno libre": "C1",
        "escala de Administración General, subescala Auxiliar": "C2",
        "escala de Administración General, subescala Técnica": "A1",
        "escala de Administración General, subescala Técnica y subescala Auxiliar": None,
        "escala de Administración Especial, subescala técnica, clase técnico medio": "A2",
    }
    assert values(spark, [(t,) for t in cases], "t string", s=X.class_from_subscale(T.fold("t"))["subgroup"]) == list(cases.values())


def test_class_from_name(spark):
    cases = {"": None, "Conserje": None, "Auxiliar administrativo": "C2", "Administrativo": "C1", "Administrativo de archivo": None, "Técnico de Administración General": "A1"}
    assert values(spark, [(t,) for t in cases], "t string", s=X.class_from_name("t")["subgroup"]) == list(cases.values())


def test_vacancy_table(spark):
    cases = [
        ("N.º VACANTES C C1 administrativa 3 C C1 auxiliar 2", ("C1", 5, "TABLA")),
        ("VACANTES C C1 administrativa 3 A A1 tecnica 2", (None, None, None)),
        ("perteneciente al subgrupo C2 y subgrupo: C2", ("C2", None, "TEXTO")),
        ("nada", (None, None, None)),
    ]
    c = X.class_from_table(T.fold("t"))
    assert values(spark, [(t,) for t, _ in cases], "t string", s=c["subgroup"], n=c["places"], o=c["origin"]) == [r for _, r in cases]


def test_dates_never_guess(spark):
    cases = [("31/02/2026", None), ("dia 5-3-2026", "2026-03-05"), ("17 d'abril de 2026", "2026-04-17"), ("30 de febrero de 2026", None), ("", None)]
    assert values(spark, [(t,) for t, _ in cases], "t string", d=X.any_date("t").cast("string")) == [d for _, d in cases]


def test_spelled_numbers(spark):
    cases = [("cuarenta y cinco días", 45), ("deu dies", 10), ("20 días", 20), ("varios días", None), (None, None)]
    assert values(spark, [(t,) for t, _ in cases], "t string", n=X.days_stated(T.fold("t"))) == [n for _, n in cases]


def test_pool_references(spark):
    text = "Bolsa 444 y bolsa clonada - 1013b. Bolsas: 241, 332-B. Següents borses:\n 112-L. Uno\n 113-B. Dos"
    assert values(spark, [(text,)], "t string", r=X.pool_refs(T.fold("t"))) == [["1013-B", "112-L", "113-B", "241", "332-B", "444"]]


def test_mojibake(spark):
    """Text read as latin-1 or in the Windows encoding, whole or by words; text that only looks like it stays."""
    right = ["conserjería", "l’edicte", "— ¿cuándo? —", "niño"]
    wrong = [t.encode().decode(e) for t, e in zip(right, ("latin-1", "cp1252", "latin-1", "cp1252"), strict=True)]
    rows = [*wrong, "α " + wrong[0], "château", None]
    assert values(spark, [(t,) for t in rows], "t string", r=T.repair_mojibake("t")) == [*right, "α conserjería", "château", None]


def test_entities(spark):
    """Named, upper-case, decimal and hexadecimal entities; what is none stays."""
    rows = ["a&ntilde;o", "A&Ntilde;O &Uuml; &ndash; &euro;", "&#243;&#xF3;&#XF3;", "&#150;", "&amp;lt; &apos;", "&none; &amp x & y;", "", None]
    assert values(spark, [(t,) for t in rows], "t string", r=T.unescape("t")) == ["año", "AÑO Ü – €", "óóó", "–", "&lt; '", "&none; &amp x & y;", "", None]


def test_unreadable_text_is_rejected(spark):
    got = values(spark, [("Conﬁrmado",), ("ges�n",)], "t string", r=T.repair_glyphs("t"), ok=T.readable("t"))
    assert got == [("Confirmado", True), ("ges�n", False)]


def test_folding_agrees_with_the_unicode_database(spark):
    import unicodedata

    text = "".join(chr(c) for c in range(0xC0, 0x250) if chr(c) != "İ")
    want = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    assert values(spark, [(text,)], "t string", f=T.fold("t")) == [want]


def test_name_keys(spark):
    got = values(spark, [("L'Eliana",), ("Vila, la",), ("El Puig",), (None,)], "t string", k=F.array_sort(T.name_keys("t")))
    assert got[:3] == [["leliana"], ["vila", "vilala"], ["elpuig", "puig"]] and not got[3]


def test_three_valued_rules(spark):
    got = values(spark, [("",), (None,), ("Bolsa cerrada",), ("Borsa en funcionament. Termini",)], "p string", o=C.pool_operating(T.fold("p")))
    assert got == [None, None, False, True]
