"""Text normal forms (N1-N18) and repairs (S7-S9) as column expressions.

Everything here is a built-in expression.  Callers that apply many rules to one text should project
its normal form once (``df.withColumn("key", title_key("title"))``) and pass that column on, so the
regular expressions that follow read a ready column.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character a Unicode-aware "\s" accepts; Java and RE2 only know the ASCII ones by default.
# Printable ASCII is told first, by one comparison.
WS = (
    r"[[^!-~]&&[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unfold(df: DataFrame, name: str, array: Column | str) -> DataFrame:
    """A row for every element of an array that is not null.

    Under a plain explode Spark first filters on the size of the array, below the projections and shuffles that make it, so the rules
    that make it run once more, and over rows that lie as they were read; an outer one is not given that filter.
    """
    return df.withColumn(name, F.explode_outer(col(array))).filter(F.col(name).isNotNull())


def let(c: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` reads it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def found(c: Column | str, pattern: str, group: int = 1) -> Column:
    """The captured group, or null when the pattern does not match."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def any_of(words) -> str:
    """One alternation for "the text contains any of these"."""
    special = set(r".^$*+?()[]{}|\\/")
    return "(?:" + "|".join("".join("\\" + ch if ch in special else ch for ch in w) for w in words) + ")"


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Composed characters and their bases, then the combining marks, which have no counterpart and are
    deleted; derived from the Unicode database."""
    composed, plain, marks = [], [], []
    for code in range(0x80, 0xD800):
        if 0xAC00 <= code <= 0xD7A3:
            continue
        ch = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if base == "":
            marks.append(ch)
        elif base != ch and len(base) == 1:
            composed.append(ch)
            plain.append(base)
    return "".join(composed + marks), "".join(plain)


def is_ascii(c: Column | str) -> Column:
    return F.octet_length(col(c)) == F.char_length(col(c))


def unaccent(c: Column | str) -> Column:
    """Canonical decomposition without the combining marks, in one pass; plain ASCII is left alone."""
    c = col(c)
    return F.when(is_ascii(c), c).otherwise(F.translate(c, *_accents()))


def fold(c: Column | str) -> Column:
    """Lower case without accents."""
    return unaccent(F.lower(col(c)))


def title_key(c: Column | str) -> Column:
    """Folded, middle dots removed, everything else that is not a letter or digit one space."""
    return F.trim(F.regexp_replace(F.replace(fold(c), F.lit("·"), F.lit("")), "[^a-z0-9]+", " "))


# A run of white space that is not one blank already; most texts have none, and are left as they are.
RUN = rf"{WS}(?:(?<! ){WS}*|{WS}+)"


def squeeze(c: Column | str) -> Column:
    """Runs of white space, no-break spaces included, become one space."""
    return F.trim(F.regexp_replace(col(c), RUN, " "))


# Leading and trailing articles of place names.
ARTICLES = ("la", "el", "les", "los")


def compact(c: Column | str) -> Column:
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def name_keys(c: Column | str) -> Column:
    """Compact name key and its variants without an article at either end."""
    key = compact(c)
    variants = []
    for article in ARTICLES:
        n = len(article)
        variants.append(
            F.when(
                F.length(key) > n,
                F.when(key.startswith(article), F.substr(key, F.lit(n + 1))).when(
                    key.endswith(article), F.left(key, F.length(key) - n)
                ),
            )
        )
    return F.array_distinct(F.array_compact(F.array(F.nullif(key, F.lit("")), *variants)))


def visible_entity(c: Column | str) -> Column:
    """Display name without a trailing parenthesis; null when nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(col(c), r"\s*\([^)]*\)\s*$", "")), F.lit(""))


def entity_variants(c: Column | str) -> Column:
    """The folded name and each half of a bilingual ``a/b``, the "Ayuntamiento de" prefix kept."""
    visible = visible_entity(c)
    prefix = F.regexp_extract(visible, r"(?i)^(ayuntamiento de\s+)(.+)$", 1)
    name = F.substr(visible, F.length(prefix) + 1)
    halves = F.filter(F.transform(F.split(name, "/"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(
        F.transform(F.array_union(F.array(name), halves), lambda x: fold(F.concat(prefix, x)))
    )


def alias_set(c: Column | str) -> Column:
    """Folded forms of a municipality split on ``/``."""
    return F.array_distinct(F.array_remove(F.transform(F.split(fold(c), "/"), lambda x: F.trim(x)), ""))


# Layout residue that card pages append to a stage name.
STAGE_NOISE = (
    r"(?is)\s*\b(?:c[oó]digo\s+gva|codi\s+gva|descargar\s+informaci[oó]n|descarregar\s+informaci[oó]|"
    r"descargar|descarregar)\b.*$"
)
NEWS_NOISE = (
    r"(?is)\s*\b(?:c[oó]digo\s+gva|codi\s+gva|descargar\s+informaci[oó]n|"
    r"descarregar\s+informaci[oó])(?![A-Za-zÀ-ÿ0-9_]).*$"
)
EDGE_MARKS = " .:-"


def clean_stage(c: Column | str) -> Column:
    """Stage name without layout residue; null when nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(squeeze(c), STAGE_NOISE, ""), F.lit(EDGE_MARKS)), F.lit(""))


def stage_key(c: Column | str) -> Column:
    """Comparison form of a stage name."""
    return F.coalesce(F.trim(F.regexp_replace(fold(clean_stage(c)), "[^a-z0-9]+", " ")), F.lit(""))


def clean_news(c: Column | str) -> Column:
    """News text without layout residue; the original when nothing would be left."""
    return F.coalesce(
        F.nullif(F.trim(F.regexp_replace(squeeze(c), NEWS_NOISE, ""), F.lit(EDGE_MARKS)), F.lit("")), col(c)
    )


def news_key(c: Column | str) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(fold(clean_news(c)), "[^a-z0-9]+", " ")), F.lit(""))


# How a raw edict title announces the job, and the ordered Valencian to Spanish wording.
JOB_IN_TITLE = (
    r"(?i)\b(?:places?|pla[çÇ]a|plazas?|llocs?|lugar(?:es)?|puestos?)\s+(?:vacants?\s+|vacantes\s+)?"
    r"(?:(?:de|d'|per\s+a|para)\s*)(.+?)"
    r"(?:,?\s+(?:mitjan[cçÇ]ant|per\s+concurs|per\s+oposici|de\s+l'oferta|pel\s+sistema|per\s+torn|"
    r"mediante|por\s+concurso|por\s+oposici|de\s+la\s+oferta)|\.\s*$|$)"
)
TITLE_START = r"(?i)^anuncio?\b"
WORDING = (
    (r"(?i)t[eèÈ]cnic/a\s+mitj[aàÀ]/na", "técnico/a medio/a"),
    (r"(?i)t[eèÈ]cnic/a\s+superior", "técnico/a superior"),
    (r"(?i)t[eèÈ]cnic/a", "técnico/a"),
    (r"(?i)administratiu/va", "administrativo/a"),
    (r"(?i)cap\s+de\s+negociat", "jefe/a de negociado"),
    (r"(?i)administraci[oóÓ]\s+general", "Administración General"),
    (r"(?i)pad[rò]n?[oó]?\s+d'habitants", "Padrón de habitantes"),
    (r"(?i)\bi\b", "y"),
    (r"(?i)\bd'", "de "),
)
RESIDUE = r"(?i)[àèòçïÀÈÒÇÏ·]|\b(?:lloc|plaça|per|amb|dels?|les|els|una?|mitjan[cç]ant)\b"
LONGEST_JOB = 120


def clean_title(c: Column | str) -> Column:
    """Readable job title of a raw edict title, null when it is not one or Valencian residue stays."""
    text = F.trim(col(c))
    job = F.rtrim(F.trim(F.regexp_extract(text, JOB_IN_TITLE, 1)), F.lit(". "))
    job = F.regexp_replace(job, r",\s*[ABCabc][12]?\s*$", "")
    job = F.regexp_replace(job, r"(?i)^personal\s+", "")
    for pattern, words in WORDING:
        job = F.regexp_replace(job, pattern, words)
    job = F.trim(F.regexp_replace(job, r"\s+", " "), F.lit(" ,"))
    good = text.rlike(TITLE_START) & (F.length(job) > 0) & (F.length(job) <= LONGEST_JOB) & ~job.rlike(RESIDUE)
    return F.when(good, F.concat(F.upper(F.left(job, F.lit(1))), F.substr(job, F.lit(2))))


# How a municipal edict names its issuer.
ISSUER = (
    r"^(?:anunci|anuncio) (?:(?:de|del) )?(?:l['’] *)?(?:ayuntamiento|ajuntament) (?:de|del|d['’]) ?"
)
ISSUER_STRICT = (
    r"^(?:anunci|anuncio)\s+(?:(?:de|del)\s+)?(?:l['’]\s*)?(?:ayuntamiento|ajuntament)\s+(?:de|del|d['’])\s+"
)
ISSUER_END = r"(?:\s+sobre\b|\s+per\s+a\b|\s+para\b|[.,;:]|$)"


def is_municipal(c: Column | str) -> Column:
    """The edict title names a town hall as its issuer."""
    return F.trim(fold(c)).rlike(ISSUER_STRICT)


def issuer_town(c: Column | str) -> Column:
    """Municipality named by a municipal edict title, at most 120 characters."""
    n = fold(c)
    town = F.coalesce(
        found(n, r"(?:ayuntamiento|ajuntament)\s+de\s+(.+?)" + ISSUER_END),
        found(n, r"(?:ayuntamiento|ajuntament)\s+del\s+(.+?)" + ISSUER_END),
        found(n, r"(?:ayuntamiento|ajuntament)\s+d['’]\s*(.+?)" + ISSUER_END),
    )
    return F.when(is_municipal(c), F.left(squeeze(town), F.lit(120)))


def agency_identity(c: Column | str) -> Column:
    """Kind of agency and municipality stated by a bulletin header; of an ``a/b`` pair the first."""
    text = squeeze(c)
    town = F.coalesce(
        found(text, r"(?i)^(?:ajuntament|ayuntamiento)\s+d['’](.+)$"),
        found(text, r"(?i)^(?:ajuntament|ayuntamiento)\s+de\s+(.+)$"),
    )
    county = F.upper(text).rlike("^DIPUTACI(?:Ó|ÓN) PROVINCIAL")
    return F.struct(
        F.when(county, "DIPUTACION").when(town.isNotNull(), "AYUNTAMIENTO").otherwise("DESCONOCIDO").alias("kind"),
        F.when(~county, F.trim(F.split_part(town, F.lit("/"), F.lit(1)))).alias("town"),
    )


# What one byte of 80 to 9F means in the Windows encoding, which pages and repaired texts mean by such codes.
WINDOWS = {b: bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _character(code: Column) -> Column:
    """The character of a code point; what is none is the replacement character."""
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    found = F.decode(F.unhex(F.lpad(F.hex(F.when(real, code)), 8, "0")), "UTF-32")
    return F.translate(F.coalesce(found, F.lit("\ufffd")), "".join(map(chr, WINDOWS)), "".join(WINDOWS.values()))


def _entity(piece: Column) -> Column:
    """What follows an ampersand, its entity restored; as it was, ampersand included, if it begins with none."""
    name = F.regexp_extract(piece, "^(#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]{0,30});", 1)
    named = F.create_map(*[F.lit(x) for n, code in name2codepoint.items() for x in (n, chr(code))], F.lit("apos"), F.lit("'"))
    digits = F.regexp_replace(name, "^#[xX]?", "")
    code = F.when(F.lower(F.left(name, F.lit(2))) == "#x", F.conv(digits, 16, 10)).when(F.left(name, F.lit(1)) == "#", digits).cast("long")
    found = F.when(code.isNotNull(), _character(code)).when(name != "", F.try_element_at(named, name))
    return F.coalesce(F.concat(found, F.substring(piece, F.length(name) + 2, F.length(piece))), F.concat(F.lit("&"), piece))


def unescape(c: Column | str) -> Column:
    """Character entities restored: named ones, and decimal and hexadecimal code points."""
    pieces = F.split(col(c), "&")
    rest = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _entity)
    return F.when(F.contains(col(c), F.lit("&")), F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))).otherwise(col(c))


def html_text(c: Column | str) -> Column:
    """Visible text of a page: scripts, styles and tags dropped, entities restored, squeezed."""
    text = F.regexp_replace(col(c), r"(?is)<script\b[^>]*>.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style\b[^>]*>.*?</style>", " ")
    return squeeze(unescape(F.regexp_replace(text, "<[^>]+>", " ")))


SENTENCE_END = r"(?<=[.!?])\s+"


def sentences(c: Column | str) -> Column:
    """The trimmed sentences of a text."""
    return F.transform(F.split(col(c), SENTENCE_END), lambda x: F.trim(x))


def norm_lines(c: Column | str) -> Column:
    """Unix line ends, single inner blanks, blank lines dropped."""
    text = F.regexp_replace(col(c), r"\r\n?", "\n")
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\x{A0}]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def tokens(c: Column | str, min_len: int = 1, stop=(), alias: dict[str, str] | None = None) -> Column:
    """Distinct canonical words of at least ``min_len`` characters that are not stopwords."""
    return canonical(F.regexp_extract_all(fold(c), F.lit(f"[a-z0-9]{{{min_len},}}"), F.lit(0)), stop, alias)


def canonical(words: Column | str, stop=(), alias: dict[str, str] | None = None) -> Column:
    """The distinct words by their common name, without stopwords."""
    words = col(words)
    if alias:
        by_target: dict[str, list[str]] = {}
        for word, target in alias.items():
            if word != target:
                by_target.setdefault(target, []).append(word)

        def canon(x: Column) -> Column:
            out = None
            for target, sources in by_target.items():
                out = (F.when if out is None else out.when)(x.isin(*sources), F.lit(target))
            return out.otherwise(x)

        words = F.transform(words, canon)
    words = F.array_distinct(words)
    return F.array_except(words, F.array(*[F.lit(w) for w in sorted(set(stop))])) if stop else words


# Strong identifiers a notice can carry.
IDENTITY = (
    ("CODIGO", r"\b([A-C]\d-\d{2}(?:-\d{2})?)\b"),
    ("ORDEN", r"\bORDEN\s+(\d{1,3}/\d{4})\b"),
    ("CONVOCATORIA", r"\bCONVOCATORIA\s+(\d{1,3}/\d{2,4})\b"),
    ("BOLSA", r"\bBOLSA\s+([0-9]{2,5}-?[A-Z])\b"),
)


def identity_tokens(c: Column | str) -> Column:
    """``KIND:value`` identifiers, distinct and sorted."""
    text = F.upper(fold(c))

    def stated(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.concat(F.lit(kind + ":"), x))

    return F.array_sort(F.array_distinct(F.flatten(F.array(*[stated(*rule) for rule in IDENTITY]))))


def url_host(c: Column | str) -> Column:
    return F.lower(F.try_parse_url(col(c), F.lit("HOST")))


def url_param(c: Column | str, name: str) -> Column:
    return F.nullif(F.try_parse_url(col(c), F.lit("QUERY"), F.lit(name)), F.lit(""))


def bulletin_signature(c: Column | str) -> Column:
    """``yyyy_n`` signature from the path or the ``signatura`` parameter of a document address."""
    u = col(c)
    path = F.regexp_extract(u, r"(?i)/pdf/(\d{4})_(\d+)_", 0)
    value = F.replace(F.trim(url_param(u, "signatura")), F.lit("%2F"), F.lit("/"))
    return F.when(path != "", found(u, r"(?i)/pdf/(\d{4}_\d+)_")).otherwise(
        F.when(value.rlike(r"^\d{4}/\d+$"), F.replace(value, F.lit("/"), F.lit("_")))
    )


def url_date(c: Column | str) -> Column:
    """Publication date from the path of a document address."""
    return F.try_to_date(
        found(c, r"(?i)/datos/(\d{4}/\d{2}/\d{2})/"), "yyyy/MM/dd"
    )


def url_facets(c: Column | str) -> Column:
    return F.struct(
        url_host(c).alias("host"),
        url_param(c, "id_emp").alias("id_emp"),
        bulletin_signature(c).alias("signature"),
        url_date(c).alias("date"),
    )


# What UTF-8 looks like when it was read as a one-byte encoding.
MOJIBAKE = ("Ã", "Â", "â")


def _marks(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "".join(MOJIBAKE), ""))


def _reread(c: Column) -> Column:
    """The string re-read as UTF-8 from either one-byte encoding, if it fits in one byte per character and marks disappear."""
    return F.coalesce(_from_bytes(c, c), _from_bytes(c, F.translate(c, "".join(WINDOWS.values()), "".join(map(chr, WINDOWS)))))


def _from_bytes(marked: Column, c: Column) -> Column:
    fits = ~c.rlike(r"[^\x{00}-\x{FF}]")
    again = F.when(fits, F.try_validate_utf8(F.encode(F.when(fits, c), "ISO-8859-1").cast("string")))
    return F.when((_marks(marked) > 0) & again.isNotNull() & (_marks(again) < _marks(marked)), again)


def repair_mojibake(c: Column | str) -> Column:
    """UTF-8 read as latin-1 or as the Windows encoding, repaired whole if possible, else word by word."""
    c = col(c)
    words = F.array_join(F.transform(F.split(c, " "), lambda w: F.coalesce(_reread(w), w)), " ")
    return F.when(_marks(c) > 0, F.coalesce(_reread(c), words)).otherwise(c)


# Glyphs that text extraction of one font family returns for letter pairs.
GLYPHS = (("Ɵ", "ti"), ("ơ", "tí"), ("İ", "fí"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
UNREADABLE = "\ufffd"


@lru_cache(maxsize=1)
def _compatible() -> tuple[str, str]:
    """Compatibility characters with a one-character normal form, derived from the Unicode database."""
    odd, plain = [], []
    for code in range(0x80, 0xFFFE):
        if 0xAC00 <= code < 0xE000:
            continue
        normal = unicodedata.normalize("NFKC", chr(code))
        if normal != chr(code) and len(normal) == 1:
            odd.append(chr(code))
            plain.append(normal)
    return "".join(odd), "".join(plain)


def repair_glyphs(c: Column | str) -> Column:
    """Compatibility characters and ligatures restored."""
    c = F.translate(col(c), *_compatible())
    for bad, good in GLYPHS:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def readable(c: Column | str) -> Column:
    """No character was lost in extraction."""
    return ~F.contains(col(c), F.lit(UNREADABLE))


def content_hash(c: Column | str, n: int = 64) -> Column:
    """SHA-256 of the text, cut to ``n`` hexadecimal digits."""
    return F.left(F.sha2(col(c), 256), F.lit(n)) if n < 64 else F.sha2(col(c), 256)


def stable_id(prefix: str, code: Column | str, title: Column | str) -> Column:
    """Natural key: the stated code, else 24 digits of the hash of the folded title."""
    return F.concat(
        F.lit(prefix + ":"), F.coalesce(col(code), F.concat(F.lit("T:"), content_hash(fold(title), 24)))
    )
