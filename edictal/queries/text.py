from __future__ import annotations

from pyspark.sql import functions as F

from edictal import rules as R
from edictal.functions import classify as C
from edictal.functions import extract as X
from edictal.functions import text as T
from edictal.queries.common import day, read_once, scalar, staged, text_of, view
from edictal.sources.bind import notices

def entity():
    return F.concat(F.lit("Ayuntamiento de "), "name", F.lit(" ("), "process_type", F.lit(") "))


def header():
    k = F.col("process_id") % 4
    return (
        F.when(k == 0, F.concat(F.lit("DIPUTACIÓ  PROVINCIAL de "), "name"))
        .when(k == 1, F.concat(F.lit("AJUNTAMENT D'"), "name"))
        .when(k == 2, F.concat(F.lit("Ayuntamiento  de  "), "name", F.lit("/otro")))
        .otherwise(F.col("name"))
    )


def address():
    return F.concat(
        F.lit("https://dogv.gva.es/datos/"), F.date_format("published", "yyyy/MM/dd"), F.lit("/pdf/"), F.year("published"), F.lit("_"),
        F.col("n"), F.lit("_es.pdf?id_emp="), F.col("source_id"),
    )


def garbled():
    """The title as it looks when its UTF-8 bytes are read one by one."""
    return F.decode(F.encode(F.col("title"), "UTF-8"), "ISO-8859-1")


def place_sentences(spark, path):
    """The sentences of a text that state places."""
    df = view(spark, path, "bodies").select("process_id", F.posexplode(T.sentences("body")).alias("pos", "sentence"))
    return df.filter(C.matches("sentence", X.STATES_PLACES))


def segment_records(spark, path):
    from edictal.sources.feeds import segment_records

    # An index of three records per notice: title before the number, a repeated number, title after it.
    text = F.concat(
        "title", F.lit(". Núm. registro: 2024/"), "n", F.lit(" Otro Anunci de les bases de la convocatoria. Núm. de registre 2024/"), "n",
        F.lit(" entidad Núm. registro 2025/"), "n", F.lit(" Anuncio posterior de "), "ref", F.lit(". Fin"),
    )
    pages = notices(spark, path, distinct=True).select(F.col("notice_id").alias("page"), text.alias("text"))
    return segment_records(pages, "page", "text")


def syllabus_text():
    return F.concat(
        F.lit("PREÁMBULO\nTEMARIO: parte primera\n"), "body", F.lit("\nTema 1. La Constitución\nTema 2. El acto administrativo\nBASES\nfin")
    )


def line_block(spark, path):
    from edictal.sources.feeds import line_block

    return line_block(view(spark, path, "bodies").select("process_id", syllabus_text().alias("text")), ["process_id"], "text")


def code_block(spark, path):
    from edictal.sources.feeds import code_block

    text = F.concat(
        F.lit("ANEXO\nTEMARIO\nConvocatoria 1/24 administrativo\n"), "body", F.lit("\nTema 1. Derecho\nConvocatoria 2/24 auxiliar\n"), "body",
        F.lit("\nTema 9. Archivo y documentación de las administraciones públicas valencianas"),
    )
    code = F.concat((F.col("process_id") % 3 + 1).cast("string"), F.lit("/24"))
    return code_block(view(spark, path, "bodies").select("process_id", text.alias("text"), code.alias("code")), "process_id", "text", "code")


QUERIES = {
    "fold": scalar("documents", "doc_id", folded=lambda: T.fold("text")),
    "title_key": scalar("notices", "notice_id", title_key=lambda: T.title_key("title")),
    "squeeze": scalar("documents", "doc_id", squeezed=lambda: T.squeeze("text")),
    "name_keys": scalar("processes", "process_id", keys=lambda: text_of(F.array_sort(T.name_keys(F.concat(F.lit("La "), "name", F.lit(" els")))))),
    "entity_variants": scalar("processes", "process_id", variants=lambda: F.array_join(F.array_sort(T.entity_variants(entity())), "|")),
    "alias_set": scalar("processes", "process_id", aliases=lambda: F.array_join(T.alias_set("name"), "|")),
    "stage_key": scalar("readings", "reading_id", stage=lambda: T.clean_stage("stage"), stage_key=lambda: T.stage_key("stage"), news=lambda: T.clean_news("stage")),
    "clean_title": scalar("notices", "notice_id", job=lambda: T.clean_title("title")),
    "issuer_town": scalar("notices", "notice_id", municipal=lambda: T.is_municipal("title"), town=lambda: T.issuer_town("title")),
    "agency_identity": staged("processes", "process_id", lambda: {"a": T.agency_identity(header())}, kind=lambda: F.col("a.kind"), town=lambda: F.col("a.town")),
    "html_text": scalar("pages", "page_id", text=lambda: T.html_text("html")),
    "place_sentences": place_sentences,
    "segment_records": segment_records,
    "line_block": line_block,
    "code_block": code_block,
    "norm_lines": scalar("documents", "doc_id", text=lambda: T.norm_lines("text")),
    "tokens": scalar("notices", "notice_id", words=lambda: text_of(F.array_sort(T.tokens("title", 4, R.STOPWORDS_BASES, R.TOKEN_ALIAS)))),
    "identity_tokens": read_once("notices", "notice_id", "title", tokens=lambda: text_of(T.identity_tokens("title"))),
    "url_facets": staged("notices", "notice_id", lambda: {"u": address()}, host=lambda: T.url_host("u"), id_emp=lambda: T.url_param("u", "id_emp"), signature=lambda: T.bulletin_signature("u"), url_day=lambda: day(T.url_date("u"))),
    "page_facets": scalar("pages", "page_id", host=lambda: T.url_host("url"), page=lambda: T.url_param("url", "page")),
    "repair_mojibake": read_once("notices", "notice_id", "title", lambda: {"bad": garbled()}, repaired=lambda: T.repair_mojibake("bad"), kept=lambda: T.repair_mojibake("title")),
    "repair_glyphs": staged(
        "documents", "doc_id", lambda: {"odd": F.replace(F.replace(F.col("text"), F.lit("ti"), F.lit("Ɵ")), F.lit("fi"), F.lit("ﬁ"))},
        text=lambda: T.repair_glyphs("odd"), readable=lambda: T.readable("odd"),
    ),
    "content_hash": scalar("documents", "doc_id", full=lambda: T.content_hash("text"), short=lambda: T.content_hash("text", 16)),
    "stable_id": staged("notices", "notice_id", lambda: {"nt": T.fold("title")}, stable_id=lambda: T.stable_id("DVAL", X.call_code("nt")["code"], "title")),
}
