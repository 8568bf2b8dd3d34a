"""Quality rules with adaptive thresholds.

A fixed cutoff that suits one language or site is wrong for the next.  Here every document is measured once, the measures of a language
and source are summed up in quantile sketches, and a document fails where a measure lies far outside the quartiles of its own kind.

A sketch is the count of every bucket of a whole number: a value keeps its ``LEADING`` leading bits, so a bucket is narrower than one part
in 2 ** (LEADING - 1) of its values, and there are at most a few hundred at any size.  Counts of equal buckets add up, so sketches of parts
merge exactly, in any order: of tasks into a source, of sources into a language, of languages into the whole.  A source with few documents
takes the limits of its language, a language with few those of all.

The words of a text, its lines and its 3-word windows stay arrays of its row; only bucket counts and limits move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictal.session import stage

# Fixed values of the contract: what ends a word, and the symbols.
BLANKS, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
# A document with fewer words, or with a larger share of repeated words, fails before any threshold.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50
LEADING = 7
# Documents that a source or a language needs for limits of its own.
ENOUGH = 200
# A limit lies so many quartile ranges beyond the quartile.
REACH = 5
# Of every rule: its measure, the least range that counts as one (so that a measure nearly all documents share is not a limit
# to the others), and whether too little fails as well as too much.
RULES = (("mean_word", 100, True), ("symbol_share", 100, False), ("duplicate_share", 1000, False), ("repeat_share", 1000, False))
# A third of all rows may share a language and source; they are dealt over so many copies of its limits.
SALTS = 16


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), "")


def bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(array: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array.

    A window is first a number: its hash, whose lowest bits give way to its place.  Sorted numbers bring equal hashes together; the few
    windows that have one are sorted by their words, so equal ones are neighbours.  A word is counted with the first repeated window
    that holds it.
    """
    def mask(w: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(F.size(w)))) - 1

    def hashed(w: Column) -> Column:
        number = lambda low: F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))
        )
        near = lambda low, s, x, j: F.coalesce(x.bitwiseXOR(F.get(s, j - 1)).between(0, low), F.lit(False)) | F.coalesce(x.bitwiseXOR(F.get(s, j + 1)).between(0, low), F.lit(False))
        places = lambda low, s: F.transform(F.filter(s, lambda x, j: near(low, s, x, j)), lambda x: x.bitwiseAND(low).cast("int"))
        return bound(mask(w), lambda low: bound(F.sort_array(number(low)), lambda s: places(low, s)))

    def windows(w: Column, places: Column) -> Column:
        return F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j - 1)["t"] == x["t"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["t"] == x["t"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        new = F.transform(p, lambda i, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), i - F.get(p, j - 1))))
        return F.aggregate(new, F.lit(0).cast("long"), lambda n, x: n + x)

    counted = bound(array, lambda w: bound(hashed(w), lambda places: bound(windows(w, places), lambda s: bound(starts(s), covered))))
    return F.when(F.size(array) < 4, F.lit(0).cast("long")).otherwise(counted)


def measured(docs: DataFrame, columns: list[Column], text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``columns`` of every row (as __keep) with its counts, the measures of the rules (whole numbers) and base_failed; the text stays behind."""
    rows = docs.select(F.struct(*columns).alias("__keep"), F.col(lang_col).cast("string").alias("__lang"), F.col(source_col).cast("string").alias("__source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    rows = rows.withColumns({
        "__words": words(F.col("__text")),
        "__lines": F.filter(F.split("__text", "\n"), lambda x: F.translate(x, BLANKS, "") != ""),
    })
    long = lambda c: c.cast("long")
    rows = rows.withColumns({
        "n_words": long(F.size("__words")),
        "word_chars": long(F.char_length(F.translate("__text", BLANKS, ""))),
        "n_symbols": long(F.char_length("__text") - F.char_length(F.translate("__text", SYMBOLS, ""))),
        "n_lines": long(F.size("__lines")),
        "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
        "n_repeat_words": repeated_words(F.col("__words")),
    }).drop("__words", "__lines", "__text")
    share = lambda part, whole, scale: F.when(F.col(whole) > 0, F.floor(scale * F.col(part) / F.col(whole))).otherwise(F.lit(0)).cast("long")
    return rows.withColumns({
        "mean_word": share("word_chars", "n_words", 1000),
        "symbol_share": share("n_symbols", "word_chars", 10000),
        "duplicate_share": share("n_dup_lines", "n_lines", 10000),
        "repeat_share": share("n_repeat_words", "n_words", 10000),
        "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")),
    })


def bucket(value: Column) -> Column:
    """The least value with the same leading bits."""
    dropped = F.greatest(F.length(F.bin(value)) - LEADING, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, dropped), dropped)


def sketches(rows: DataFrame) -> DataFrame:
    """Counts of the buckets of every rule by language and source (level 0), by language (1) and of all rows (2)."""
    values = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), bucket(F.col(name)).alias("bucket")) for k, (name, _, _) in enumerate(RULES)]))
    counted = rows.select("__lang", "__source", values.alias("v")).groupBy("__lang", "__source", "v.rule", "v.bucket").agg(F.count("*").alias("n"))
    one = stage(counted)
    none = F.lit(None).cast("string")
    language = one.groupBy("__lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    whole = language.groupBy("rule", "bucket").agg(F.sum("n").alias("n"))
    return (
        one.withColumn("level", F.lit(0))
        .unionByName(language.withColumns({"level": F.lit(1), "__source": none}))
        .unionByName(whole.withColumns({"level": F.lit(2), "__source": none, "__lang": none}))
    )


def quartiles(sketch: DataFrame) -> DataFrame:
    """Documents, first and third quartile of every sketch: the first bucket with a quarter, or three, of all at or below it."""
    key = ["level", "__lang", "__source", "rule"]
    below = F.sum("n").over(Window.partitionBy(*key).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*key))
    placed = sketch.withColumns({"below": below, "total": total})
    at = lambda quarters: F.min(F.when(4 * F.col("below") >= quarters * F.col("total"), F.col("bucket")))
    return placed.groupBy(*key).agg(F.first("total").alias("total"), at(1).alias("low"), at(3).alias("high"))


def limits(rows: DataFrame, enough: int = ENOUGH, reach: int = REACH) -> DataFrame:
    """Least and greatest value of every rule for every language and source, as arrays in the order of the rules."""
    rule = F.col("rule")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), rule + 1)
    spread = reach * F.greatest(F.col("high") - F.col("low"), pick([r[1] for r in RULES]))
    least = F.when(pick([r[2] for r in RULES]), F.col("low") - spread).otherwise(F.lit(-1)).cast("long")
    limit = F.struct("rule", least.alias("least"), (F.col("high") + spread).cast("long").alias("most"))
    found = quartiles(sketches(rows)).groupBy("level", "__lang", "__source").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(limit)).alias("limits"))
    found = stage(found)
    own = found.filter("level = 0").alias("o")
    language = found.filter("level = 1").select(F.col("__lang").alias("l"), F.col("total").alias("lang_total"), F.col("limits").alias("lang_limits"))
    whole = found.filter("level = 2").select((F.col("level") - 2).alias("w"), F.col("limits").alias("all_limits"))
    beside = own.join(language, F.col("__lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(whole), F.col("level") == F.col("w"), "left")  # whole: one row
    chosen = F.when(F.col("total") >= enough, F.col("limits")).when(F.col("lang_total") >= enough, F.col("lang_limits")).otherwise(F.col("all_limits"))
    return beside.select("__lang", "__source", chosen.alias("limits"))


def judge(docs: DataFrame, columns: list[Column], text_col: str = "text", lang_col: str = "lang", source_col: str = "source", enough: int = ENOUGH, reach: int = REACH) -> DataFrame:
    """``columns`` of every row with its counts, base_failed, kept, and failed: the first rule it fails, ``base``, or null.

    Limits are learned from all rows that pass the base rules, and hold for those.  Null and empty texts have no words and fail the base
    rules, as in a table of nothing else, which has no limits.  A null language or source is a kind of its own.  Rows that are repeated
    count as often as they occur.  An empty table gives no rows.  Other columns are not read.
    """
    # Measuring reads every text; it is done once and written, without the texts.
    rows = stage(measured(docs, columns, text_col, lang_col, source_col).withColumn("__salt", F.pmod(F.xxhash64("n_words", "word_chars", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")))
    dealt = limits(rows.filter(~F.col("base_failed")), enough, reach).select(
        F.col("__lang").alias("l"), F.col("__source").alias("s"), "limits", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
    )
    held = rows.join(dealt, F.col("__lang").eqNullSafe(F.col("l")) & F.col("__source").eqNullSafe(F.col("s")) & (F.col("__salt") == F.col("salt")), "left")
    failed = F.when(F.col("base_failed"), F.lit("base"))
    for k, (name, _, _) in enumerate(RULES):
        limit = F.get("limits", F.lit(k))
        failed = failed.when(~F.col(name).between(limit["least"], limit["most"]), F.lit(name))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return held.select("__keep.*", *counts, failed.isNull().alias("kept"), failed.alias("failed"))
