"""Semi-structured feeds as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictal.functions import text as X

# --- N13 ------------------------------------------------------------------------------------------------

RECORD_MARK = r"(?i)N[uú]m\.\s*(?:de\s*)?(?:registre|registro)\s*:?\s*(\d{4}/\d+)"
NOTICE_WORD = r"(?i)\b(?:Anunci|Anuncio)\b"
SHORTEST, LONGEST = 20, 1000


LAST_NOTICE, FIRST_NOTICE = r"(?is)^.*\b(Anuncio?\b.*)$", r"(?is)^.*?\b(Anuncio?\b.*)$"


def record_title(text: Column) -> Column:
    """Text from a notice word on, cut at its first full stop, if it has the size of a title."""
    stop = F.locate(".", text)
    title = F.when(stop > SHORTEST, F.left(text, stop)).otherwise(text)
    return F.when(F.length(title).between(SHORTEST, LONGEST), title)


def segment_records(df: DataFrame, page: str, text: str) -> DataFrame:
    """The records of a bulletin index: number and title.

    The number is the delimiter: its title is the last notice before it, else the first after it, and
    never crosses into the next record.  Blocks and numbers are two aligned arrays of one row; a number that repeats in a page keeps its
    first title.  A page is one row, so it is cut and its numbers are told apart without any shuffle.
    """
    numbers = F.regexp_extract_all(F.col(text), F.lit(RECORD_MARK), F.lit(1))
    blocks = F.split(F.col(text), RECORD_MARK)
    cut = df.select(page, numbers.alias("_n"), blocks.alias("_b"))
    title = lambda block, pattern: X.let(F.regexp_extract(X.squeeze(block), pattern, 1), record_title)
    # What follows a number is read only where nothing before it is a title.
    first = F.transform("_n", lambda x, i: F.struct(x.alias("record"), F.coalesce(title(F.get("_b", i), LAST_NOTICE), title(F.get("_b", i + 1), FIRST_NOTICE)).alias("title")))
    titled = cut.select(page, F.filter(first, lambda r: r["title"].isNotNull()).alias("_r"))
    # Of equal numbers a map keeps the last (``tune``), which is the first of the reversed list.
    return X.unfold(titled, "_e", F.map_entries(F.map_from_entries(F.reverse("_r")))).select(page, F.col("_e.key").alias("record"), F.col("_e.value").alias("title"))


# --- N14 ------------------------------------------------------------------------------------------------

# Lines that open and close the syllabus of a call.
BLOCK_START = r"(?i)^\s*(?:ANEXO\s+[^\n]{0,80}\s*)?(?:TEMARIO|PROGRAMA|PROGRAMA DE MATERIAS|MATERIAS)\s*:?.*$"
BLOCK_END = (
    r"(?i)^\s*(?:ANEXO|BASES|PRIMERA|SEGUNDA|TERCERA|CUARTA|QUINTA|SEXTA|SÉPTIMA|SEPTIMA|OCTAVA|NOVENA|DÉCIMA|DECIMA|"
    r"SOLICITUDES|TRIBUNAL|COMISIÓN DE SELECCIÓN|COMISION DE SELECCION|RECURSOS)\b"
)
CALL_LINE = r"(?i)^\s*Convocatoria\s+(\d+)\s*/\s*(\d+)\b"
SMALLEST_GAP, SMALLEST_BLOCK, LOOK_BACK = 3, 80, 11


def _first(flags: Column, after: Column) -> Column:
    """Index of the first true flag beyond ``after``, null if there is none."""
    return F.array_min(F.filter(F.transform(flags, lambda f, i: F.when(f & (i > after), i)), lambda x: x.isNotNull()))


def _block(lines: Column, start: Column, end: Column) -> Column:
    last = F.coalesce(end, F.size(lines))
    text = F.trim(F.array_join(F.slice(lines, start + 1, F.greatest(last - start, F.lit(0))), "\n"))
    return F.when(start.isNotNull(), X.let(text, lambda t: F.when(F.length(t) >= SMALLEST_BLOCK, t)))


def line_block(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """From the first opening line to the first closing line at least three lines later."""
    lines = df.select(*keys, F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n").alias("_l"))
    start = _first(F.transform("_l", lambda x: x.rlike(BLOCK_START)), F.lit(-1))
    placed = lines.withColumn("_s", start)
    end = _first(F.transform("_l", lambda x: x.rlike(BLOCK_END)), F.col("_s") + SMALLEST_GAP - 1)
    return placed.withColumn("_e", end).select(*keys, _block(F.col("_l"), F.col("_s"), F.col("_e")).alias("block"))


def code_block(df: DataFrame, key: str | list[str], text: str, code: str) -> DataFrame:
    """The part of a shared syllabus under the line of one call, with its heading if close above."""
    keys = [key] if isinstance(key, str) else key
    lines = df.select(*keys, F.col(code).alias("_code"), F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n").alias("_l"))
    stated = lambda x: F.concat_ws("/", F.regexp_extract(x, CALL_LINE, 1), F.regexp_extract(x, CALL_LINE, 2))
    at = F.when(F.col("_code").isNotNull(), _first(F.transform("_l", lambda x: x.rlike(CALL_LINE) & (stated(x) == F.col("_code"))), F.lit(-1)))
    placed = lines.withColumn("_at", at)
    heading = F.array_max(
        F.filter(
            F.transform("_l", lambda x, i: F.when(x.rlike(r"(?i)\bTEMARIO\b") & (i < F.col("_at")) & (i >= F.col("_at") - LOOK_BACK), i)),
            lambda x: x.isNotNull(),
        )
    )
    end = F.when(F.col("_at").isNotNull(), _first(F.transform("_l", lambda x: x.rlike(CALL_LINE)), F.col("_at")))
    ready = placed.withColumn("_s", F.when(F.col("_at").isNotNull(), F.coalesce(heading, "_at"))).withColumn("_e", end)
    return ready.select(*keys, _block(F.col("_l"), F.col("_s"), F.col("_e")).alias("block"))


# --- S4 -------------------------------------------------------------------------------------------------

# Section of competitions and department of local administration.
COMPETITIONS, LOCAL = "2B", "9525"


def _listed(c: Column) -> Column:
    """A JSON value that may be one object or a list of them, as a list of JSON texts."""
    return X.let(c, lambda v: F.when(F.trim(v).startswith("["), F.from_json(v, "array<string>")).when(v.isNotNull(), F.array(v)))


def flatten_summary(df: DataFrame, raw: str = "json", section: str = COMPETITIONS, department: str = LOCAL) -> DataFrame:
    """Items of a daily summary: diary, section, department, heading, item, each one or many."""
    part = lambda c, name: F.get_json_object(c, f"$.{name}")
    keep = [c for c in df.columns if c != raw]
    out = X.unfold(df, "_j", _listed(part(F.col(raw), "data.sumario.diario"))).select(*keep, "_j")
    out = X.unfold(out, "_j", _listed(part(F.col("_j"), "seccion"))).select(*keep, "_j")
    out = out.filter(F.trim(part(F.col("_j"), "codigo")) == section)
    out = X.unfold(out, "_j", _listed(part(F.col("_j"), "departamento"))).select(*keep, "_j")
    out = out.filter(F.trim(part(F.col("_j"), "codigo")) == department)
    body = X.let(part(F.col("_j"), "texto"), lambda t: F.coalesce(F.when(t.startswith("{"), t), F.col("_j")))
    out = X.unfold(out, "_j", _listed(part(body, "epigrafe"))).select(*keep, "_j")
    out = X.unfold(out.withColumn("heading", part(F.col("_j"), "nombre")), "_j", _listed(part(F.col("_j"), "item"))).select(*keep, "heading", "_j")
    url = X.let(part(F.col("_j"), "url_html"), lambda html: F.trim(F.coalesce(F.when(html.startswith("{"), part(html, "texto")), html)))
    return out.select(
        *keep, "heading", part(F.col("_j"), "identificador").alias("item_id"), part(F.col("_j"), "titulo").alias("title"),
        url.alias("url"),
    )


# --- S5 -------------------------------------------------------------------------------------------------

FEED = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "link", "guid", "pubDate")])
WEEKDAY = r"(?i)\b(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\w*,?\s*"


def feed_date(c: Column | str) -> Column:
    """Publication day in numeric or RFC 822 form."""
    from edictal.functions.extract import numeric_date

    bare = F.trim(F.regexp_replace(X.col(c), WEEKDAY, ""))
    return F.coalesce(numeric_date(c), F.try_to_date(X.found(bare, r"^(\d{1,2} \w{3} \d{4})"), "d MMM yyyy"))


def feed_rows(items: DataFrame) -> DataFrame:
    """Title, link (or the guid in its place) and day of feed items; items without an address are dropped."""
    link = F.coalesce(F.nullif(X.squeeze("link"), F.lit("")), F.nullif(X.squeeze("guid"), F.lit("")))
    rest = [c for c in items.columns if c not in ("title", "link", "guid", "pubDate")]
    return items.select(*rest, X.squeeze("title").alias("title"), link.alias("url"), feed_date("pubDate").alias("published")).filter(
        F.col("url").isNotNull()
    )


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A folder of RSS files, read by Spark's XML source."""
    return feed_rows(spark.read.format("xml").option("rowTag", "item").schema(FEED).load(path))


# --- S6 -------------------------------------------------------------------------------------------------

def value(c: Column | str) -> Column:
    """A value or a list whose first element counts, as trimmed text; empty becomes ''."""
    c = X.col(c)
    first = F.when(F.trim(c).startswith("["), F.get(F.from_json(c, "array<string>"), F.lit(0))).otherwise(c)
    return F.trim(F.coalesce(first, F.lit("")))


def normalise_records(df: DataFrame, prefix: str) -> DataFrame:
    """Records of a bulletin service with a prefixed reference and one text to classify.

    Columns: year, edict, extract, definition, name, publisher (each a value or a JSON list).
    """
    fields = ("year", "edict", "extract", "definition", "name", "publisher")
    plain = df.withColumns({f"_{f}": value(f) for f in fields})
    text = F.concat_ws(" ", *[F.nullif(f"_{f}", F.lit("")) for f in ("extract", "definition", "name", "publisher")])
    both = (F.col("_year") != "") & (F.col("_edict") != "")
    ref = F.when(both, F.concat_ws(":", F.lit(prefix), "_year", "_edict")).otherwise("")
    return plain.select(
        *[c for c in df.columns if c not in fields], ref.alias("ref"),
        F.coalesce(F.nullif("_publisher", F.lit("")), "_definition").alias("agency"), text.alias("text"),
    )
