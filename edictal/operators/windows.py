"""First, best, top-k and neighbour operators.

Ranks are always filtered by a constant, so Spark prunes every group on the map side before the
shuffle (WindowGroupLimit); a hot group costs one task at most k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictal.functions.classify import chain, pool_operating
from edictal.functions.text import clean_news, fold, news_key
from edictal.session import once


def top_by(df: DataFrame, keys: list, order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of every group in a total order, with their ``rank``."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def first_by(df: DataFrame, keys: list, order: list[Column]) -> DataFrame:
    """The first row of every natural key."""
    return top_by(df, keys, order, 1).drop("rank")


def dedup_news(news: DataFrame) -> DataFrame:
    """The same news of a process once, the oldest kept, its text cleaned.

    Expects process_id, news_kind, kind, field, summary, url, detected and news_id.  A text is cleaned once, however many news have it.
    """
    keyed = once(news, ["summary"], {"_text": news_key("summary"), "_clean": clean_news("summary")}).drop("summary").withColumnRenamed("_clean", "summary")
    keys = ["process_id", "news_kind", F.coalesce(F.upper("kind"), F.lit("")), F.coalesce(F.lower("field"), F.lit("")), "_text", "url"]
    kept = first_by(keyed, keys, [F.col("detected").asc_nulls_first(), F.col("news_id").asc()])
    return kept.select(*news.columns)


# Host names by which documents of the two bulletins are told apart.
PROVINCIAL_HOST, STATE_HOST = "bop.dival.es", "boe.es"


def url_rank(kind: Column, title: Column, url: Column) -> Column:
    """How official an address is for a process: founding notice first, state gazette last."""
    kind, title, url = (F.coalesce(c, F.lit("")) for c in (kind, title, url))
    return chain(
        (F.upper(F.trim(kind)) == "BASES", 0),
        (F.upper(F.trim(kind)) == "CONVOCATORIA", 1),
        (F.contains(F.lower(kind), F.lit("convoc")), 2),
        (F.contains(F.lower(title), F.lit("convoc")), 3),
        (F.contains(F.lower(url), F.lit(PROVINCIAL_HOST)), 4),
        (F.contains(F.lower(url), F.lit(STATE_HOST)), 6),
        default=5,
    )


def best_url_agg() -> Column:
    """W4 as an aggregate over the notices of a process."""
    usable = F.trim(F.coalesce(F.col("url"), F.lit(""))) != ""
    order = F.struct(
        url_rank(F.col("kind"), F.col("title"), F.col("url")).alias("r"),
        F.col("published").isNull().alias("u"), F.col("published").alias("d"), F.col("notice_id").alias("i"),
    )
    return F.min_by("url", F.when(usable, order))


def best_url(notices: DataFrame) -> DataFrame:
    """Best official address of each process, one partial aggregate per task."""
    return notices.groupBy("process_id").agg(best_url_agg().alias("best_url"))


def source_score(kind: Column, title: Column, url: Column) -> Column:
    """Additive score of a document as a source of the syllabus."""
    kind, title, url = (F.lower(F.coalesce(c, F.lit(""))) for c in (kind, title, url))
    points = (
        (kind.isin("convocatoria", "bases"), 100),
        (F.contains(kind, F.lit("convoc")), 60),
        (F.contains(kind, F.lit("base")) | F.contains(title, F.lit("bases")), 50),
        (F.contains(title, F.lit("convoc")), 30),
        (F.contains(url, F.lit("boe.es")), 20),
        (F.contains(url, F.lit("bop")), 15),
        (title.rlike("tribunal|admit|resultado|nombr"), -100),
    )
    total = F.lit(0)
    for condition, value in points:
        total = total + F.when(condition, value).otherwise(0)
    return total


def scored_sources(notices: DataFrame) -> DataFrame:
    """The source documents with an address, and their score."""
    return notices.filter(F.trim(F.coalesce("url", F.lit(""))) != "").withColumn(
        "score", source_score(F.col("kind"), F.col("title"), F.col("url"))
    )


def rank_sources(notices: DataFrame, k: int | None = None) -> DataFrame:
    """The source documents of each process by their worth, the ``k`` best of them if a limit is given."""
    scored = scored_sources(notices)
    order = [F.col("score").desc(), F.col("published").desc_nulls_last(), F.col("notice_id").desc()]
    if k is not None:
        return top_by(scored, ["process_id"], order, k)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("process_id").orderBy(*order)))


def first_non_null(df: DataFrame, key: str, order: Column, cols: list[str]) -> DataFrame:
    """Every field from the first document, in ``order``, that states it."""
    return df.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])


def debounce(readings: DataFrame, n: int = 2) -> DataFrame:
    """Pools to close: the last ``n`` readings all say the pool no longer operates.

    Only the newest ``n`` readings of a pool ever leave a map task.
    """
    last = top_by(
        readings.withColumn("_off", F.coalesce(~pool_operating(fold("phase")), F.lit(False))),
        ["pool_id"], [F.col("read_at").desc(), F.col("reading_id").desc()], n,
    )
    return (
        last.groupBy("pool_id")
        .agg(
            F.count("*").alias("n"), F.min("_off").alias("_all_off"),
            F.max_by("phase", F.struct("read_at", "reading_id")).alias("phase"),
        )
        .select("pool_id", "phase", ((F.col("n") == n) & F.col("_all_off")).alias("close"))
    )


def previous(df: DataFrame, key: str, at: str, tie: str, value: str, out: str) -> DataFrame:
    """The value of the row before, per key in time order, without one task holding a whole key.

    Rows are compared inside a key and day; only the last row of each day meets the next day, and there
    are no more of those than calendar days.
    """
    day = df.withColumn("_day", F.to_date(at))
    inner = Window.partitionBy(key, "_day").orderBy(at, tie)
    boxed = F.struct(F.col(value).alias("v"))
    seen = day.withColumn("_prev", F.lag(boxed).over(inner))
    ends = day.groupBy(key, "_day").agg(F.max_by(boxed, F.struct(at, tie)).alias("_end"))
    before = ends.select(
        key, "_day", F.lag("_end").over(Window.partitionBy(key).orderBy("_day")).alias("_before")
    )
    joined = seen.join(before, [key, "_day"])
    return joined.withColumn(out, F.coalesce("_prev", "_before")["v"]).drop("_day", "_prev", "_before")


def transitions(readings: DataFrame) -> DataFrame:
    """Stage changes between consecutive readings, both stages known."""
    seen = previous(readings, "pool_id", "read_at", "reading_id", "stage", "old_stage")
    return seen.filter((F.col("old_stage") != F.col("stage"))).withColumn(
        "summary", F.concat(F.lit("Nueva etapa del proceso: "), F.col("stage"))
    )


def slices(df: DataFrame, first: str, last: str, days: int) -> DataFrame:
    """A date range cut into windows of ``days`` days without gaps."""
    step = F.expr(f"INTERVAL {int(days)} DAY")
    starts = df.withColumn("slice_from", F.explode(F.sequence(F.col(first), F.col(last), step)))
    return starts.withColumn("slice_to", F.least(F.date_add("slice_from", days - 1), F.col(last)))


def neighbourhood(dates: DataFrame, day: str, days: int = 5) -> DataFrame:
    """Distinct dates within ``days`` of the given ones; the input is reduced first."""
    seeds = dates.select(day).filter(F.col(day).isNotNull()).distinct()
    return seeds.select(F.explode(F.sequence(F.date_sub(day, days), F.date_add(day, days))).alias("day")).distinct()


def recent(day: Column | str, as_of: Column, days: int | None = None, months: int | None = None) -> Column:
    """Within the last days or months before a date."""
    day = F.col(day) if isinstance(day, str) else day
    return day >= (F.date_sub(as_of, days) if days is not None else F.add_months(as_of, -months))


# --- order and limit ----------------------------------------------------------------------------------------

def page(n: int, most: int = 200) -> int:
    """A page size; one that cannot be served is refused, not changed."""
    if not 1 <= n <= most:
        raise ValueError(f"a page has 1 to {most} rows, not {n}")
    return n


def top_catalogue(df: DataFrame, n: int = 100) -> DataFrame:
    """K1: catalogue order, newest first; a top-k, never a total sort."""
    day = F.coalesce("exam_date", "call_date", "opens")
    return df.orderBy(day.desc_nulls_last(), F.col("process_id").desc()).limit(page(n))


def review_queue(df: DataFrame, n: int = 300) -> DataFrame:
    """K3: undecided first, then accepted, then rejected, the most recent first."""
    place = F.when(F.col("scope") == "REVISION", 0).when(F.col("scope") == "SI", 1).otherwise(2)
    return df.orderBy(place, F.col("updated").desc_nulls_last(), F.col("process_id").desc()).limit(n)


def history(df: DataFrame, process_id, day: str, tie: str, n: int = 100) -> DataFrame:
    """K4: newest rows of one process."""
    return df.filter(F.col("process_id") == process_id).orderBy(F.col(day).desc_nulls_last(), F.col(tie).desc()).limit(page(n))


def batch_after(df: DataFrame, last_id, n: int | None = None, recent_first: bool = False) -> DataFrame:
    """K5: resumable enrichment batch: rows after an id with an incomplete classification."""
    empty = F.lit(False)
    for c in ("grp", "subgroup", "scale"):
        empty = empty | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    rest = df.filter(empty & (F.col("process_id") > last_id))
    order = ([F.col("updated").desc_nulls_last()] if recent_first else []) + [F.col("process_id")]
    return rest.orderBy(*order).limit(n) if n is not None else rest


def pending(df: DataFrame, n: int = 100) -> DataFrame:
    """K6: processes that wait for a review, the most recent first."""
    wait = df.filter(F.col("review_state") == "PENDIENTE_REVISION")
    return wait.orderBy(F.col("updated").desc(), F.col("process_id").desc()).limit(n)
