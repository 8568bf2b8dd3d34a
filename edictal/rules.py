"""Rule tables as data.

Fixed values: every list and pattern in this module is vocabulary of the official bulletins that must
be matched word for word (folded: lower case, no accents).  The order of a chain is part of its meaning.
"""

# --- states ---------------------------------------------------------------------------------------
RUNNING, FINISHED, ANNULLED, DESISTED = "EN_CURSO", "FINALIZADO", "ANULADO", "DESISTIDO"
TERMINAL_STATES = (
    "finalizado", "finalitzado", "finalitzat",
    "cancelado", "cancel·lado", "cancel·lat", "cancelat",
    "desistido", "desistit",
    "anulado", "anul·lat", "anullat",
)
OWN_CLOSURE = "RECONCILIACION"

# --- C5: closing events, on the title key -----------------------------------------------------------
ARTICLE = "(?:(?:la|el|las|los|les|els|l) )?(?:presente )?"
OF = "(?:de |del |d )?"
WHOLE_PROCESS = (
    "(?:convocatoria|proceso selectivo|proceso de seleccion|bases|bolsa|oposicion|concurso oposicion|"
    "oferta de empleo|proces selectiu|proces de seleccio|borsa|oposicio|concurs oposicio)"
)
CALL_OR_PROCESS = "(?:convocatoria|proceso selectivo|proces selectiu)"
ANNULMENT = (
    rf"\banul\w* {OF}{ARTICLE}{WHOLE_PROCESS}\b"
    rf"|\bsin efecto {ARTICLE}{CALL_OR_PROCESS}\b"
    rf"|\bsense efecte {ARTICLE}(?:convocatoria|proces selectiu)\b"
)
DESISTANCE = (
    rf"\bdesist\w* {OF}{ARTICLE}(?:convocatoria|proceso selectivo|proceso de seleccion|proces selectiu|"
    r"proces de seleccio|bolsa|borsa)\b"
)
FINALISATION = r"\b(?:finalizacion|finalitzacio) del? proc(?:eso|es)\b"
MINOR_STEP = " de (?:alegacion|reclamacion|inscripcion|admision|solicitud|presentacion)"
VOID = (
    rf"\bdeclar\w* desiert[oa]s? {ARTICLE}(?:proceso selectivo|convocatoria)\b"
    rf"|\bdeclar\w* deserta? {ARTICLE}(?:proces selectiu|convocatoria)\b"
)
APPOINTMENT = (
    r"\bnombramiento (?:(?:como|de) )?funcionari[oa]s?\b|\bnomenament (?:(?:com a|de) )?funcionaris?\b"
    r"|\bnombramiento mediante concurso\b|\bnomenament mitjancant concurs\b"
    r"|\btoma de posesion\b|\bpresa de possessio\b"
    r"|\badjudicacion definitiva\b|\badjudicacio definitiva\b"
    r"|\badjudicacion de destinos\b|\badjudicacio de destinacions\b"
)
INTERIM = r"\binterin\w*|\binteri\b"
PASSED = (
    "(?:aprobad[oa]s?|aprovad[oa]s?|aprovats?|superado|superat|superan|superen|seleccionad[oa]s?|seleccionats?)"
)
FINAL_RESULTS = (
    rf"\b(?:relacion|lista|listado|llista|relacio)\b.{{0,90}}?\b{PASSED}\b",
    rf"\bpropuest\w*\b.{{0,70}}?\b{PASSED}\b",
    rf"\bproposta\b.{{0,70}}?\b{PASSED}\b",
    r"\bpropuesta de nombramiento\b|\bproposta de nomenament\b",
    rf"\b{PASSED} (?:en|del?|d) (?:(?:la|el|las|los|les|els|l) )?proc(?:eso|es) selecti[vu]\w*\b",
    r"\bresultado final\b|\bresultat final\b"
    r"|\b(?:calificacion|puntuacion|calificacio|puntuacio) final del proc(?:eso|es)\b",
)
PROVISIONAL = r"\bprovisional\w*\b|\bprovisoria\w*\b"
REVOKED = r"\banul\w*|\bsin efecto\b|\bsense efecte\b|\brevoca\w*|\bsuspen\w*"
EXERCISE = r"\bejercicios?\b"
FISCAL_YEAR = r" (?:de |del )?\d{4}"
PARTIAL = (
    r"\bexercicis?\b|\bfases?\b"
    r"|\b(?:primer|segund|tercer|cuart|quint|sext)[oa]? (?:prueba|prova|parte)\b"
    r"|\bprueba (?:de|practica|fisica|psicotecnica|medica)\b|\bprova (?:de|practica)\b"
    r"|\bpregunta\w*\b|\bexamen\w*\b|\bentrevista\b|\btest\b"
)

# Words without which a pattern above cannot match; plain containment is far cheaper than a pattern.
STEMS = {
    ANNULMENT: ("anul", "sin efecto", "sense efecte"),
    DESISTANCE: ("desist",),
    FINALISATION: ("finalizacion", "finalitzacio"),
    VOID: ("declar",),
    APPOINTMENT: ("nombramiento", "nomenament", "posesion", "possessio", "adjudicacio"),
    INTERIM: ("interi",),
    PROVISIONAL: ("provis",),
    REVOKED: ("anul", "sin efecto", "sense efecte", "revoca", "suspen"),
    EXERCISE: ("ejercicio",),
    FINAL_RESULTS[0]: ("relacio", "lista", "llista"),
    FINAL_RESULTS[1]: ("propuest",),
    FINAL_RESULTS[2]: ("proposta",),
    FINAL_RESULTS[3]: ("propuesta de nombramiento", "proposta de nomenament"),
    FINAL_RESULTS[4]: ("proceso selecti", "proces selecti"),
    FINAL_RESULTS[5]: ("resultado final", "resultat final", "final del proc"),
}

# --- C6: structured state labels --------------------------------------------------------------------
LABELS = (
    (ANNULLED, "anulad[oa]|anullat|anullada|anul lat|anul lada"),
    (DESISTED, "desistid[oa]|desistit|desistida"),
    (FINISHED, "finalizad[oa]|finalitzat|finalitzada|resuelt[oa]|resolt|resolta|desiert[oa]|desert|deserta"),
)

# --- C1: administrative scope ------------------------------------------------------------------------
BODY_CODE = r"\b[ac][12]-\d{2}(?:-[a-z0-9]+)*\b"
GENERAL_CODES = ("a1-01", "a2-01", "c1-01", "c2-01")
OUT_OF_SCOPE = (
    "investigacion cientifica", "medicina(?: del trabajo)?", "metge(?:/ssa)? del treball", "enfermeria",
    "psicologia", "educacion especial", "educacio especial", "educacion infantil", "educacio infantil",
    "professor(?:/a)?", "profesor(?:/a)?", "veterinari", "ingenier", "enginyer", "arquitect",
    "laboratorio", "laboratori", "biblioteca", "bibliotecari", "servicios auxiliares de la investigacion",
    r"\bsubaltern(?:o|a|os|es)?\b", r"\bconser(?:je|ge)(?:s)?\b", r"\bnotificador(?:/a|a|es)?\b",
    "ayudante de residencia", "agricol", "forestal", "orientacion escolar", "orientacio escolar",
    "taller ocupacional", "obras publicas", "obres publiques", "mecanic", "conductor", "restaurador",
    "traductor", "linguistic", "delineant", "comunicacio audiovisual", "comercio", "comerc",
    "desarrollo local", "desenvolupament local", "gestion tributaria", "gestio tributaria",
    "recaudacion", "recaptacio", "agentes? tributarios?", "agents? tributaris?",
    "tecnico(?:/a)? tributario", "tecnic(?:/a)? tributari", "administracion especial",
    "administracio especial", "relaciones laborales", "relacions laborals", r"\bfiestas?\b",
    r"\bfestejos\b", r"\bfestes\b",
)
OUT_OF_SCOPE_JOB = (
    "tesoreri", "tresoreri", "personal laboral", "laboral fij", r"\binformador", r"\binformadora",
)
IN_SCOPE = (
    r"\bc1-01\b", r"\bc2-01\b", r"\ba1-01\b", r"\ba2-01\b", r"\bcuerpo administrativo\b",
    r"\bcuerpo auxiliar\b", r"\bcuerpo superior de administracion\b", r"\bcuerpo superior de gestion\b",
    r"\badministracion general\b", r"\badministracio general\b",
    r"\btecnico(?:/a)? de administracion general\b", r"\btecnic(?:/a)? d['’]?administracio general\b",
    r"\bauxiliar(?:es)? administrativo(?:s|/a|/va)?\b", r"\bauxiliar(?:s)? administratiu(?:s|/va)?\b",
    r"\badministrativo(?:s|/a)?\b", r"\badministratiu(?:s|/va|/ves)?\b",
)

# --- C4: notice class ----------------------------------------------------------------------------------
INTERNAL = (
    "libre designacion", "lliure designacio", "comision de servicios", "comissio de serveis",
    "concurso de traslados", "concurs de trasllats", "concurso especifico de meritos",
    "concurs especific de merits", "provision de puesto", "provisio de lloc", "provision del puesto",
    "provisio del lloc", "abierto a otras administraciones publicas",
    "obert a altres administracions publiques", "cesion de la bolsa", "cessio de la borsa",
    "cessio de les borses", "cesion de bolsas", "conveni de collaboracio", "conveni de col·laboracio",
    "convenio de colaboracion",
)
INTERNAL_EXTENDED = (
    "adscripcion definitiva", "adscripcio definitiva", "provision por concurso de meritos",
    "provisio per concurs de merits", "provision del puesto", "provisio del lloc",
    "provision de puesto", "provisio de lloc",
)
INTERNAL_PROMOTION = ("promocion interna", "promocio interna")
OPEN_SHIFT = ("turno libre", "torn lliure", "oposicion libre")
NOISE = (
    "subvencion", "subvencio", "premio", "premi", "ayuda", "ajuda", "ordenanza fiscal",
    "ordenanca fiscal", "tasa", "taxa", "gestion tributaria", "gestio tributaria", "recaptacio",
    "recaudacion",
)
NOISE_UNLESS = (
    "administratiu", "administrativo", "auxiliar administratiu", "auxiliar administrativo",
    "tecnic d'administracio", "tecnico de administracion",
)
TEMPORARY_POOL = (
    "borsa d'ocupacio", "borsa de treball", "bolsa de empleo", "bolsa de trabajo", "funcionari interi",
    "funcionario interino", "funcionaria interina", "nomenament interi",
)
HARD_TO_FILL = ("dificil cobertura",)
FOLLOW_UP = (
    "relacio provisional", "relacion provisional", "relacio definitiva", "relacion definitiva",
    "admeses", "admesos", "admitidos", "admitidas", "exclosos", "excloses", "excluidos", "excluidas",
    "tribunal", "organ tecnic de seleccio", "organo tecnico de seleccion", "primer exercici",
    "primer ejercicio", "data de l'exercici", "fecha del ejercicio", "nomenament", "nombramiento",
    "persona aprovada", "persones aprovades", "resultats", "resultados", "proposta de nomenament",
    "propuesta de nombramiento", "correccio d'errors", "correccion de errores", "modificacio",
    "modificacion", "resolucio de recursos", "resolucion de recursos", "acumulacio de places",
    "acumulacion de plazas",
)
NEW_CALL = (
    "aprovacio de les bases", "aprobacion de las bases", "bases de la convocatoria",
    "bases i la convocatoria", "bases y la convocatoria", "bases reguladores del procediment selectiu",
    "bases reguladoras del procedimiento selectivo",
)
PROVINCIAL_BLOCK = (
    "recurso", "rectificacion", "correccion", "lista provisional", "lista definitiva",
    "listado provisional", "listado definitivo", "admitidos", "admitidas", "excluidos", "excluidas",
    "tribunal", "nombramiento", "emplazamiento", "alegacion", "abstencion",
)
PROVINCIAL_NEW = (
    "bases rectoras especificas para la provision en propiedad",
    "aprobacion bases provision en propiedad", "bases concurso oposicion libre",
)

# --- C8, C9: milestones ----------------------------------------------------------------------------------
MILESTONES = (
    ("ADMITIDOS_PROVISIONAL", ("lista provisional", "relacion provisional", "relacio provisional",
                               "admitidos provisional", "admesos provisional")),
    ("ADMITIDOS_DEFINITIVA", ("lista definitiva", "relacion definitiva", "relacio definitiva",
                              "admitidos definitiva", "admesos definitiva")),
    ("TRIBUNAL", ("tribunal", "organ tecnico de seleccion", "organ tecnic de seleccio")),
    ("EXAMEN", ("primer ejercicio", "primer exercici", "fecha de examen", "data d'examen",
                "convocatoria ejercicio", "convocatoria exercici")),
    ("RESULTADOS", ("resultado", "resultat", "calificacion", "qualificacio", "puntuacion", "puntuacio")),
    ("APROBADOS", ("personas aprobadas", "persones aprovades", "propuesta de aprobados",
                   "proposta d'aprovats")),
    ("NOMBRAMIENTO", ("nombramiento", "nomenament", "toma de posesion", "presa de possessio")),
)
CORRECTION = r"\b(?:correccion|correccio)\b"
OTHER_MILESTONE = "OTRO_SEGUIMIENTO"
OFFICIAL_FOLLOW_UP = (
    ("MODIFICACION", "correccion|modificacion"),
    ("ADMITIDOS", "admitid|excluid"),
    ("TRIBUNAL", "tribunal"),
    ("EXAMEN", "examen|prueba.*fecha|fecha.*prueba"),
    ("RESULTADO", "resultado|calificacion|meritos"),
    ("NOMBRAMIENTO", "nombramiento"),
    ("ADJUDICACION", "adjudic"),
    ("LISTA", "lista|bolsa"),
)
OTHER_OFFICIAL = "SEGUIMIENTO_OFICIAL"

# --- C10: clear selective continuity ------------------------------------------------------------------------
FOREIGN = (
    "cessio de la borsa", "cessio de les borses", "cesion de la bolsa", "cesion de bolsas",
    "conveni de collaboracio", "conveni de col·laboracio", "convenio de colaboracion",
)
CONTINUITY = (
    "relacio provisional", "relacion provisional", "relacio definitiva", "relacion definitiva",
    "admeses", "admesos", "admitidos", "admitidas", "exclosos", "excloses", "excluidos", "excluidas",
    "tribunal qualificador", "tribunal calificador", "organ tecnic de seleccio",
    "organo tecnico de seleccion", "primer exercici", "primer ejercicio", "data de l'exercici",
    "fecha del ejercicio", "persona aprovada", "persones aprovades", "resultats", "resultados",
    "proposta de nomenament", "propuesta de nombramiento", "correccio d'errors",
    "correccion de errores", "acumulacio de places", "acumulacion de plazas",
    "nomenament com a funcionari", "nombramiento como funcionario", "nombramiento como funcionaria",
    "nombramiento funcionario", "nomenament funcionari", "listado definitivo", "listado provisional",
    "lista definitiva", "lista provisional", "llista definitiva", "llista provisional",
    "listados definitivos", "listados provisionales",
)

# --- C11: founding notices ------------------------------------------------------------------------------------
LATER_ACT = (
    "designacion de miembros", "designacio de membres", "designacion del organo",
    "designacio de l'organ", "designacion del tribunal", "designacio del tribunal",
    "modificacion del organo", "modificacio de l'organ", "composicion del organo",
    "composicio de l'organ", "relacion provisional", "relacio provisional", "relacion definitiva",
    "relacio definitiva", "lista provisional", "llista provisional", "lista definitiva",
    "llista definitiva", "personas admitidas", "persones admeses", "personas excluidas",
    "persones excloses", "fecha de examen", "data d'examen", "data de l'exercici", "primer ejercicio",
    "primer exercici", "calificaciones", "qualificacions", "resultados", "resultats", "nombramiento",
    "nomenament", "constitucion de bolsa", "constitucio de borsa",
)
FOUNDING = (
    "aprobacion de las bases", "aprovacio de les bases", "aprobacion de bases", "aprovacio de bases",
    "bases que han de regir", "bases especifiques", "bases especificas",
    "convocatoria para la seleccion", "convocatoria per a la seleccio", "convocatoria de la oposicion",
    "convocatoria de l'oposicio", "convocatoria del proceso selectivo",
    "convocatoria del proces selectiu",
)

# --- C12: job families -------------------------------------------------------------------------------------------
FAMILIES_TITLE = (
    ("AUXILIAR_ADMINISTRATIVO", "auxiliar administr"),
    ("TAG", "tecnic d'administracio general|tecnico de administracion general|"
            "tecnica de administracion general|tecnico/a de administracion general"),
    ("ADMINISTRATIVO", "administratiu|administrativo|administrativa"),
)
FAMILIES_CALL = (
    ("AUXILIAR_ADMINISTRATIVO", "auxiliar administr"),
    ("TAG", "(?:tecnico|tecnica|tecnic).*administracion? general|administracion? general.*(?:tecnico|tecnica|tecnic)"),
    ("ADMINISTRATIVO", "administrativo|administrativa|administratiu"),
    ("TECNICO_GESTION", "(?:tecnico|tecnica|tecnic).*gestio|gestio.*(?:tecnico|tecnica|tecnic)"),
)
FAMILIES_COLLISION = (
    ("auxiliar_administrativo", "auxiliar administratiu|auxiliar administrativo"),
    ("administrativo", "administratiu|administrativo"),
    ("recaudacion", "recaptacio|recaudacion"),
    ("taller_imprenta", "taller d'impremta|taller de imprenta"),
    ("obras_publicas", "obres publiques|obras publicas"),
    ("ingenieria", "enginyer|ingenier"),
    ("educacion", "professor|profesor|educacio|educacion"),
)
TYPO = (r"\badminstr", "administr")

# --- C13: bulletin document type, lower case with accents --------------------------------------------------------------
DOCUMENT_ANNULS = r"\b(?:deja|dejar)\s+sin\s+efecto\b|\banula(?:r|da|do|ción)?(?![\w\x{C0}-\x{17F}])"
DOCUMENT_RECTIFIES = r"\bcorrecci[oó]n\s+de\s+errores\b|\brectificaci[oó]n\b"

# --- C14: employment notices ----------------------------------------------------------------------------------------------
NOT_EMPLOYMENT = (
    "subvencion", "subvencio", "subvencions", "subvenciones", "ayuda", "ayudas", "ajuda", "ajudes",
    "premio", "premios", "premi", "premis", "bdns", "concessio de subvencions",
    "concesion de subvenciones", "justificacio de la convocatoria", "justificacion de la convocatoria",
    "concurs de merits per a cobrir el lloc", "concurso de meritos para cubrir el puesto",
    "concurs de merits per a la provisio", "concurso de meritos para la provision",
    "concurs de merits", "concurso de meritos", "lliure designacio", "libre designacion",
    "nomenament, per concurs de merits", "nomenament per concurs de merits",
    "nombramiento, por concurso de meritos", "nombramiento por concurso de meritos",
)
TERMINAL_WORDS = ("anulacion", "anullacio", "desistimiento", "desistiment")
EMPLOYMENT = (
    "proceso selectivo", "proces selectiu", "seleccion de", "seleccio de", "oposicion", "oposicio",
    "concurso oposicion", "concurs oposicio", "concurso-oposicion", "concurs-oposicio",
    "bolsa de trabajo", "borsa de treball", "bolsa de empleo", "plaza de", "plazas de", "placa de",
    "places de", "personas admitidas", "persones admeses", "personas excluidas", "persones excloses",
    "tribunal calificador", "tribunal qualificador", "organo tecnico de seleccion",
    "organ tecnic de seleccio", "data d'examen", "fecha de examen", "primer ejercicio",
    "primer exercici", "calificaciones", "qualificacions", "resultados", "resultats",
    "lista de aprobados", "llista d'aprovats", "personas aprobadas", "persones aprovades",
    "constitucio de borsa", "constitucion de bolsa", "nombramiento", "nomenament", "toma de posesion",
    "presa de possessio",
)

# --- C15, C16: pools and open calls --------------------------------------------------------------------------------------------
POOL_EXCLUSIONS = (
    ("promocion interna", "title"), ("dificil cobertura", "card"), ("acto unico", "title"),
    ("consulta de baremo", "title"), ("consulta de estados", "title"), ("cesion de integrantes", "title"),
)
INTERNAL_WORD = r"\bpi\b"
EMPLOYEES_ONLY = r"funcionari\w*\s+de\s+carrera|personal\s+(?:contratado\s+)?laboral|laborales\s+fijos"
SPECIALISMS = (
    (r"\bapt[- ]", "especialidad_apt"),
    (r"\bc1-07\b", "especialidad_c1_07"),
    (r"\bc2-01-02\b", "especialidad_c2_01_02"),
    (r"\bc2-01-edu\b|\bc1-01-edu\b", "sector_educacion"),
    ("protocolo", "especialidad_protocolo"),
    ("orientador(?:a)? laboral", "especialidad_orientacion_laboral"),
    ("comunicacion y relaciones informativas", "especialidad_comunicacion"),
    ("fondos europeos", "especialidad_fondos_europeos"),
    ("agentes tributarios", "especialidad_agentes_tributarios"),
    ("asistencia al contribuyente", "especialidad_tributaria"),
    ("discapacidad intelectual", "turno_discapacidad_intelectual"),
)

# --- C18, C19, C28: card stages -------------------------------------------------------------------------------------------------
TERMINAL_STAGES = (
    "finalizacion del proceso selectivo", "finalitzacio del proces selectiu", "toma de posesion",
    "presa de possessio", "adjudicacion de destinos y fecha de cese/toma de posesion",
    "adjudicacio de destinacions", "desistimiento", "desistiment", "anulacion", "anul·lacio",
)
APPLICATION_STAGES = (
    "bases y apertura de plazo", "bases i obertura de termini", "apertura de plazo",
    "obertura de termini", "presentacion de solicitudes", "presentacio de sollicituds",
)
OPENING_STAGES = r"bases y apertura|apertura de plazo|ampliacion (?:del )?plazo"
CARD_SECTION = r"Informaci[óo] ?b[áà]sica|Información básica"

# --- Q1: catalogue ----------------------------------------------------------------------------------------------------------------
EXCLUDED_TYPES = (
    "Promoción interna", "Libre designación", "Concurso general de méritos", "Concurso de traslados",
    "Comisiones de servicio", "Difícil cobertura", "Anuncio difícil cobertura", "Acto único telemático",
)
EXCLUDED_TITLES = (
    "promoción interna", "promocion interna", "promoció interna", "promocio interna",
    "concurso de traslados", "concurso de traslado", "libre designación", "libre designacion",
    "comisiones de servicio", "comissions de servei", "acto único telemático",
    "acto unico telematico", "acte unic telematic", "acte únic telemàtic",
    "concurs de mèrits per a la provisió", "concurs de merits per a la provisio",
    "concurso de méritos para la provisión", "concurso de meritos para la provision",
    "concurs de mèrits per a cobrir", "concurs de merits per a cobrir",
    "concurso de méritos para cubrir", "concurso de meritos para cubrir",
)
LOCAL_AGENCIES = ("AYUNTAMIENTO", "DIPUTACION")
INACTIVE_MONTHS = 12
PRIVATE_TYPES = (
    "bolsa de trabajo", "difícil cobertura", "anuncio difícil cobertura",
    "anuncio difícil cobertura (adc)",
)
PRIVATE_CATEGORIES = ("BOLSA", "ADC")
HARD_TO_FILL_TYPE = "Anuncio difícil cobertura (ADC)"
AWAITS_STATE_GAZETTE = (
    "BOP_VALENCIA", "BOP_VALENCIA_MUNICIPAL", "BOP_CASTELLON", "BOP_ALICANTE",
    "DIPUTACION_ALICANTE_OTRAS",
)
RELEVANT_FIELDS = (
    "fecha_apertura", "fecha_cierre", "fecha_examen", "lugar_examen", "estado", "plazas", "turno",
    "etapa_actual", "tipo_proceso", "url_oficial",
)
NAVIGATION = ("navegación", "navegacion")
LEGACY_STATES = ("ABIERTO", "PENDIENTE", "CERRADO", "EN_SEGUIMIENTO")

# --- X: extraction -------------------------------------------------------------------------------------------------------------------
NUMBER_WORDS = {
    "un": 1, "una": 1, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "quatre": 4, "cinco": 5, "cinc": 5,
    "seis": 6, "sis": 6, "siete": 7, "set": 7, "ocho": 8, "vuit": 8, "nueve": 9, "nou": 9, "diez": 10,
    "deu": 10, "once": 11, "onze": 11, "doce": 12, "dotze": 12, "trece": 13, "tretze": 13,
    "catorce": 14, "catorze": 14, "quince": 15, "quinze": 15, "dieciseis": 16, "setze": 16,
    "diecisiete": 17, "disset": 17, "dieciocho": 18, "divuit": 18, "diecinueve": 19, "dinou": 19,
    "veinte": 20, "vint": 20, "veintiuno": 21, "veintiun": 21, "veintidos": 22, "veintitres": 23,
    "veinticuatro": 24, "veinticinco": 25, "veintiseis": 26, "veintisiete": 27, "veintiocho": 28,
    "veintinueve": 29, "treinta": 30, "trenta": 30, "cuarenta": 40, "quaranta": 40, "cincuenta": 50,
    "cinquanta": 50, "sesenta": 60, "seixanta": 60,
}
TITLE_NUMBERS = {
    "un": 1, "una": 1, "uno": 1, "dues": 2, "dos": 2, "tres": 3, "quatre": 4, "cuatro": 4, "cinc": 5,
    "cinco": 5, "sis": 6, "seis": 6, "set": 7, "siete": 7, "vuit": 8, "ocho": 8, "nou": 9, "nueve": 9,
    "deu": 10, "diez": 10, "onze": 11, "once": 11, "dotze": 12, "doce": 12, "tretze": 13, "trece": 13,
    "catorze": 14, "catorce": 14, "quinze": 15, "quince": 15, "setze": 16, "dieciseis": 16,
    "disset": 17, "diecisiete": 17, "divuit": 18, "dieciocho": 18, "dinou": 19, "diecinueve": 19,
    "vint": 20, "veinte": 20,
}
MONTHS = {
    "enero": 1, "gener": 1, "febrero": 2, "febrer": 2, "marzo": 3, "marc": 3, "abril": 4, "mayo": 5,
    "maig": 5, "junio": 6, "juny": 6, "julio": 7, "juliol": 7, "agosto": 8, "agost": 8,
    "septiembre": 9, "setiembre": 9, "setembre": 9, "octubre": 10, "noviembre": 11, "novembre": 11,
    "diciembre": 12, "desembre": 12,
}
SUBGROUP_OF_SUBSCALE = {"tecnica": "A1", "gestion": "A2", "administrativa": "C1", "auxiliar": "C2"}
SUBGROUP_OF_CLASS = {"tecnico superior": "A1", "tecnico medio": "A2", "tecnico auxiliar": "C1"}
SUBGROUP_OF_NAME = {
    "tecnico de administracion general": "A1", "tecnico administracion general": "A1",
    "administrativo": "C1", "auxiliar administrativo": "C2", "auxiliar de administracion general": "C2",
}

# --- tokens ------------------------------------------------------------------------------------------------------------------------------
STOPWORDS_FOLLOW_UP = (
    "administracion", "administrativa", "administrativo", "personal", "plaza", "plazas", "proces",
    "proceso", "selectiu", "selectivo", "seleccion", "ajuntament", "ayuntamiento", "convocatoria",
    "cobertura", "propiedad", "general", "escala", "subescala", "turno", "torn", "libre", "lliure",
    "persona", "personas", "tecnico", "tecnica", "tecnic", "auxiliar", "grupo", "subgrupo",
)
STOPWORDS_BASES = (
    "anunci", "anuncio", "ajuntament", "ayuntamiento", "mancomunitat", "mancomunidad", "aprovacio",
    "aprobacion", "aprovar", "aprobar", "bases", "convocatoria", "proces", "proceso", "selectiu",
    "selectivo", "seleccion", "cobertura", "propietat", "propiedad", "placa", "places", "plaza",
    "plazas", "personal", "turno", "torn", "libre", "lliure", "escala", "subescala", "sistema",
    "concurs", "concurso", "oposicio", "oposicion", "mitjancant", "mediante", "sobre",
)
TOKEN_ALIAS = {
    "administratiu": "administrativo", "administrativa": "administrativo",
    "administratius": "administrativo", "administratives": "administrativo",
    "administrativos": "administrativo", "administrativas": "administrativo",
    "administracio": "administracion", "servei": "servicio", "serveis": "servicio",
    "servicios": "servicio", "benestar": "bienestar",
}
