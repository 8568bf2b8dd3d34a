"""Notice-shaped views over the generic star-schema tables the engine is checked on.

Each view is a plain projection (and at most one dimension join) of whole tables, so every query built
on it grows with them.  Titles and texts are composed by rule from the row's own values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edictal.sources.tables import load

# Title forms; {n} a count, {w} a count in words, {code} a call code, {town} a town.
TITLES = (
    "Anuncio del Ayuntamiento de {town} sobre la aprobación de las bases de la convocatoria de {w} plazas de administrativo/a, por concurso oposición, turno libre.",
    "Anunci de l'Ajuntament de {town} sobre l'aprovació de les bases i la convocatoria per a la provisió de {n} places d'administratiu/va, mitjançant oposició.",
    "Anuncio del Ayuntamiento de {town} sobre el resultado final del proceso selectivo de auxiliar administrativo, expediente {code}.",
    "Nombramiento como funcionario de carrera de técnico de administración general",
    "Anul·lació de la convocatòria del procés selectiu {code}",
    "Desistimiento del proceso selectivo de administrativo, convocatoria {code}",
    "Anuncio del Ayuntamiento de {town} sobre la relación provisional de personas admitidas y excluidas para auxiliar administrativo, turno libre, {n} plazas.",
    "Relación definitiva de aspirantes que han superado el proceso selectivo de administrativo",
    "Anunci de l'Ajuntament de {town} sobre la designació del tribunal qualificador d'administratiu/va, expedient {code}.",
    "Constitución de bolsa de trabajo de auxiliar administrativo",
    "Concurso de traslados y libre designación del puesto de tesorería",
    "Concesión de subvenciones y ayudas a entidades culturales",
    "Se declara desierto el proceso selectivo de gestión tributaria",
    "Finalización del proceso de alegaciones a las bases de administrativo",
    "Finalització del procés selectiu de {n} places d'auxiliar administratiu",
    "Corrección de errores de las bases específicas de técnico de administración general",
    "Anulación de la pregunta {n} del primer ejercicio",
    "Nombramiento como funcionario interino de administrativo",
    "Propuesta de nombramiento de las personas aprobadas, promoción interna, {n} por promoción interna",
    "Anuncio de difícil cobertura ADC {code} de auxiliar administrativo, bolsa {n}",
    "Orden 12/2024 de convocatoria {code} del cuerpo C1-01, turno libre, convocatoria de {w} plazas",
    "Lista de aprobados del segundo ejercicio de administrativo",
    "Bolsa 4{n}B específica (B-5{n}/22) A1-01 cuerpo superior de administración",
    "Relación de personas aprobadas, ejercicio de 2023, auxiliar administrativo",
    "Convocatoria de tres plazas de ingeniero técnico, escala de administración especial",
    "Anuncio del Ayuntamiento de {town} sobre la fecha del ejercicio de administrativo, turno libre {n} plazas.",
    "Selección de {w} plazas de técnico/a de gestión por el sistema de oposición, {n} plazas en turno libre",
    "Toma de posesión y adjudicación definitiva de destinos",
    "Se suspende la lista de aprobados de auxiliar administrativo",
)
WORDS = ("una", "dues", "tres", "cuatro", "cinc", "seis", "set", "ocho", "nueve", "deu", "varias")
# Names of processes.
NAMES = (
    "Administrativo/a de administración general",
    "Auxiliar administrativo",
    "Técnico de administración general",
    "Técnico/a medio de gestión, expediente {code}",
    "Administrativo",
    "Ingeniero técnico forestal",
    "Bolsa {n}-B C1-01 de administrativo",
    "Promoción interna de auxiliar administrativo",
    "Conserje-notificador, escala de administración general",
    "Tesorería: técnico/a tributario",
    "Administratiu/va, expediente {code}",
    "Relaciones laborales, escala de administración especial",
    "Bolsa específica (B-5{n}/22) de administrativo",
)
TYPES = ("Oposición", "Concurso-oposición", "Bolsa de trabajo", "Libre designación", "Proceso selectivo")
# Deadline sentences.
DEADLINES = (
    "20 días hábiles contados desde el siguiente al de la publicación",
    "veinte días naturales a partir de la publicación",
    "deu dies hàbils",
    "cuarenta y cinco días",
    "trenta dies naturals",
    "plazo de un mes",
    "quince días hábiles",
)
SHIFTS = ("TURNO_LIBRE", "PROMOCION_INTERNA", "Libre, reserva discapacidad", "Libre")
PHASES = ("Bolsa en funcionamiento. Plazo abierto", "Borsa en funcionament", "Bolsa cerrada", "")
STAGES = (
    "Bases y apertura de plazo. Código GVA: {n} Descargar información",
    "Listado provisional de admitidos Descarregar informació",
    "Nombramiento. Codi GVA: {n}",
    "Adjudicación de destinos",
    "Anul·lació de l'anunci",
)


def pick(options, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (index + 1).cast("int"))


def fill(template: Column, n: Column, code: Column, town: Column | None = None, word: Column | None = None) -> Column:
    out = F.replace(template, F.lit("{n}"), n.cast("string"))
    out = F.replace(out, F.lit("{code}"), code)
    if town is not None:
        out = F.replace(out, F.lit("{town}"), town)
    if word is not None:
        out = F.replace(out, F.lit("{w}"), word)
    return out


def agencies(spark: SparkSession, path: str) -> DataFrame:
    """M1 over nation and region."""
    nation, region = load(spark, path, "nation"), load(spark, path, "region")
    key = F.col("n_nationkey")
    kind = pick(("AYUNTAMIENTO", "DIPUTACION", "ADMINISTRACION_AUTONOMICA"), key % 3)
    town = F.concat("n_name", F.lit("/"), F.replace("n_name", F.lit("NATION"), F.lit("NACIÓ")))
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        key.cast("long").alias("agency_id"),
        F.concat(F.lit("Ayuntamiento de "), town, F.when(key % 4 == 0, " (Sede)").otherwise("")).alias("agency_name"),
        kind.alias("agency_kind"),
        F.col("r_name").alias("province"),
        town.alias("town"),
        (key % 7 != 6).alias("active"),
    )


def sources(spark: SparkSession, path: str) -> DataFrame:
    """M2 over supplier."""
    key = F.col("s_suppkey")
    return load(spark, path, "supplier").select(
        key.alias("source_id"),
        F.col("s_nationkey").cast("long").alias("agency_id"),
        F.col("s_name").alias("source_name"),
        pick(("BOP", "BOE", "SEDE"), key % 3).alias("source_kind"),
        (key % 11 != 10).alias("active"),
        (key % 5).cast("int").alias("priority"),
    )


def _key(cents: Column) -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents)


def lines(spark: SparkSession, path: str, distinct: bool = False, by: str = "l_orderkey", **codes: Column) -> DataFrame:
    """The rows of M4 before their texts are composed; ``distinct`` keeps one row of every notice_id.

    Those are brought together in their narrow form by their order, by one of the ``codes`` made of it, or by notice_id: a step that
    needs the rows of that column together moves them no second time.
    """
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = load(spark, path, "lineitem")
    if not distinct:
        return rows.withColumn("notice_id", _key(cents))
    narrow = rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("l_quantity"),
        F.to_date("l_shipdate").alias("l_shipdate"), cents.alias("_cents"),
    )
    # Dealt by what the texts will be, which are made of the numbers where they arrive.
    made = {**codes, "notice_id": _key(F.col("_cents"))}
    dealt = narrow.repartition(made.get(by, F.col(by))).withColumns(made).drop("_cents")
    return dealt.dropDuplicates([*codes, "l_orderkey", "notice_id"])


def notices(spark: SparkSession, path: str, distinct: bool = False, by: str = "l_orderkey", **codes: Column) -> DataFrame:
    """M4 over lineitem: one publication per row, with a natural key that repeats."""
    return composed(lines(spark, path, distinct, by, **codes), *codes)


def composed(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of M4, and ``more`` of the rows' own."""
    part, supp, order, line = (F.col(c) for c in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"))
    day = F.to_date("l_shipdate")
    n = F.col("l_quantity").cast("int")
    code = F.concat(n.cast("string"), F.lit("/"), F.year(day).cast("string"))
    town = F.concat(F.when(part % 2 == 0, "NATION_").otherwise("NACIÓ_"), (supp % 25).cast("string"))
    title = fill(pick(TITLES, part % len(TITLES)), n, code, town, pick(WORDS, n % len(WORDS)))
    ref = F.concat_ws("-", order, line)
    return rows.select(
        "notice_id",
        order.alias("process_id"),
        supp.alias("source_id"),
        ref.alias("ref"),
        title.alias("title"),
        F.when(line == 1, "BASES").when(line == 2, "convocatoria").otherwise("BOP").alias("kind"),
        day.alias("published"),
        F.when(
            part % 5 != 0, F.concat(pick(("https://bop.dival.es/d/", "https://www.boe.es/d/", "http://a.example/d/"), supp % 3), ref)
        ).alias("url"),
        n.alias("n"),
        *more,
    )


def processes(spark: SparkSession, path: str) -> DataFrame:
    """M3 over orders and customer."""
    orders = load(spark, path, "orders")
    customers = load(spark, path, "customer").select("c_custkey", "c_nationkey")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    day = F.to_date("o_orderdate")
    n = (cust % 90 + 10).cast("int")
    code = F.concat((cust % 40 + 1).cast("string"), F.lit("/"), F.year(day).cast("string"))
    state = pick(("EN_CURSO", "EN_SEGUIMIENTO", "Finalizado"), F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2))
    literal = F.when(key % 9 < 7, pick(DEADLINES, key % 7))
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        key.alias("process_id"),
        F.col("c_nationkey").cast("long").alias("agency_id"),
        fill(pick(NAMES, cust % len(NAMES)), n, code).alias("name"),
        pick(TYPES, F.left("o_orderpriority", F.lit(1)).cast("int") - 1).alias("process_type"),
        state.alias("state"),
        (key % 10 != 9).alias("is_opportunity"),
        pick(("SI", "SI", "SI", "NO", "REVISION"), key % 5).alias("scope"),
        pick(SHIFTS, cust % 4).alias("shift"),
        F.when(key % 4 != 0, (key % 30 + 1).cast("int")).alias("places"),
        day.alias("call_date"),
        F.when(key % 7 == 0, F.date_add(day, 1)).alias("opens"),
        F.when(key % 7 == 0, F.date_add(day, 25)).when(key % 7 == 1, F.date_add(day, 20)).alias("closes"),
        F.when(key % 13 == 0, F.date_add(day, 200)).alias("exam_date"),
        literal.alias("deadline"),
        F.when(key % 3 == 0, day).alias("gazette_date"),
        (key % 100).alias("source_id"),
        F.when((key % 3 == 0) & (F.col("o_orderstatus") == "F"), "RECONCILIACION").alias("closure_origin"),
        F.when(key % 6 == 0, F.concat(F.lit("https://sede.example/p?id="), key)).when(key % 6 == 1, " ").alias("detail_url"),
        F.when(key % 17 == 0, "ADC").when(key % 17 == 1, "bolsa").alias("category"),
    )


def changes(spark: SparkSession, path: str) -> DataFrame:
    """M5 over the returned lines."""
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    fields = ("estado", "plazas", "denominacion", "etapa_actual", "fecha_cierre", "turno", "grupo")
    tax = F.round(F.col("l_tax") * 100).cast("int")
    return load(spark, path, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.concat_ws("-", order, line, "l_partkey", "l_suppkey").alias("change_id"),
        order.alias("process_id"),
        pick(fields, line - 1).alias("field"),
        F.when(tax > 0, pick(("ABIERTO", "EN_SEGUIMIENTO", "Navegación", "x"), F.col("l_partkey") % 4)).alias("old"),
        pick(("EN_CURSO", "FINALIZADO", "y"), F.col("l_suppkey") % 3).alias("new"),
        (tax % 3 != 2).alias("significant"),
        F.to_date("l_shipdate").alias("detected"),
    )


def subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """M6 over signups and purchases; dates moved to the years of the notices."""
    events = load(spark, path, "events").filter(F.col("event_type").isin("signup", "purchase"))
    return events.select(
        F.col("user_id"),
        F.col("event_id").alias("process_id"),
        (F.col("event_type") == "signup").alias("active"),
        F.add_months(F.to_date("ts"), -26 * 12).alias("since"),
    )


def readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings of pool cards over events: one pool per user, in time order."""
    k = F.get_json_object("props", "$.k").cast("int")
    return load(spark, path, "events").select(
        F.col("event_id").alias("reading_id"),
        F.col("user_id").alias("pool_id"),
        F.col("ts").alias("read_at"),
        F.sha2(F.concat_ws("|", (k % 6).cast("string"), F.when(k % 5 == 0, "x")), 256).alias("content_hash"),
        fill(pick(STAGES, k % len(STAGES)), k, F.lit("")).alias("stage"),
        pick(PHASES, k % len(PHASES)).alias("phase"),
        F.to_date("ts").alias("opens"),
        F.when(k % 3 != 0, F.date_add(F.to_date("ts"), k % 20)).alias("closes"),
        k.alias("k"),
    )


def runs(spark: SparkSession, path: str) -> DataFrame:
    """M15 over events: one run per event, the event type as its source."""
    v = F.floor(F.col("value")).cast("int")
    return load(spark, path, "events").select(
        F.col("event_id").alias("run_id"),
        F.concat_ws("-", "event_type", (F.col("user_id") % 7).cast("string")).alias("source"),
        F.col("user_id").alias("cycle_id"),
        pick(("OK", "SIN_NOVEDADES", "DEGRADADA", "ERROR"), v % 4).alias("state"),
        F.when(v % 9 != 0, F.to_date("ts")).alias("until"),
        (v % 12).alias("errors"),
        F.when(v % 4 == 3, F.concat(F.lit("timeout "), v)).alias("error"),
    )


# Texts of calls; {d}, {month}, {year} the call date, {dmy} and {later} numeric dates.
BODIES = (
    "Resolución de {d} de {month} de {year}, del Ayuntamiento, referente a la convocatoria para proveer varias plazas. En el «Boletín Oficial de la Provincia de Valencia» número {n}, de {d} de {month} de {year}, se han publicado las bases. {n} plazas de {name}, perteneciente a la escala de Administración General, subescala Administrativa, por el sistema de oposición, en turno libre. El plazo de presentación de solicitudes será de veinte días hábiles.",
    "Resolución de {d} de {month} de {year}, que deja sin efecto la de 3 de marzo de {year}. Contiene además la convocatoria 7/{year} de tres plazas de administrativo, por el sistema de concurso, por turno de promoción interna. Las solicitudes se presentarán en el registro.",
    "Corrección de errores de la de {d} de {month} de {year}. Plazo para presentar solicitudes: diez días. Expediente num. 12/{year}.",
    "Tabla: GRUPO SUBGRUPO SUBESCALA N.º VACANTES DENOMINACIÓN C C1 administrativa {n} C C1 auxiliar 2 fin. Subgrupo: C1.",
    "Grupo/Subgrupo: C/C2. Escala de Administración General, subescala auxiliar. Una plaza de {name}. Convocatoria: {n}/24.",
    "Clasificación: grupo A, subgrupo A1, administración general, subescala técnica de clase media; {n} plazas por turno libre y 4 por promoción interna.",
    "Escala: Administración Especial, clase técnico medio. Bolsas: 241, 332-B, {n}-L. Bolsa clonada 1013B. Borsa 444. Siguientes bolsas:\n 112-B. Uno\n 113-L. Dos\n",
    "Etapa actual: Bases y apertura de plazo Etapa actual: Listado provisional Fase: Bolsa en funcionamiento Plazo: Desde el {dmy} hasta el {later} Forma de presentación. Núm. de plazas totales 1.{n}",
    "PLAZO PRESENTACIÓN: Hasta el {d} de {month} de {year} a las 23:59. Publicado {later} y {dmy}. Selección de dos plazas de administrativo, grupo C1/C2. Subescala técnica o auxiliar de administración general.",
    "Texto sin fecha 31/02/2026 ni plazas.\r\n\r\nCódigo de convocatoria: ab-12/{year}.",
)
MONTH_NAMES = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """Text of the call of every process."""
    day = F.col("call_date")
    text = pick(BODIES, F.col("process_id") % len(BODIES))
    slots = (
        ("{dmy}", F.date_format(day, "dd-MM-yyyy")), ("{later}", F.date_format(F.date_add(day, 20), "dd/MM/yyyy")),
        ("{d}", F.dayofmonth(day).cast("string")), ("{month}", pick(MONTH_NAMES, F.month(day) - 1)),
        ("{year}", F.year(day).cast("string")), ("{n}", (F.col("process_id") % 89 + 10).cast("string")), ("{name}", F.col("name")),
    )
    for slot, value in slots:
        text = F.replace(text, F.lit(slot), value)
    return processes(spark, path).select("process_id", "agency_id", "name", "process_type", "shift", "places", "call_date", text.alias("body"))


VIEWS = {
    "bodies": bodies,
    "agencies": agencies, "sources": sources, "notices": notices, "processes": processes,
    "changes": changes, "subscriptions": subscriptions, "readings": readings, "runs": runs,
}


def view(spark: SparkSession, path: str, name: str) -> DataFrame:
    return VIEWS[name](spark, path)
