"""URL filters by a sort-merge range join.

A host is written backwards, label by label with a dot after each: a host and its subdomains are then one interval of keys that begin
with the host's key, and a path prefix is an interval in the same way.  Intervals of prefixes are nested or apart.  Keys and interval
ends are sorted together and swept once: a running sum of opened less closed intervals is the height of the stack of active rules, and
the rule last opened at each height is its content.  The sort is dealt out by ranges; what is open at the beginning of a range comes
from the summaries of the ranges before it, so no key, however frequent, has to stay in one task.

Two sweeps make the join: one over hosts finds the rule hosts a url lies under, one over (rule host, path) finds the innermost rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictal.session import stage

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, POINT, CLOSE = 0, 1, 2


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWERED)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``a.example.org`` as ``org.example.a.``; the hosts under a host are those whose key begins with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(points: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``points`` (key and any other columns) with ``stack``, the prefixes of their key from the outermost to the innermost.

    ``prefixes`` has the distinct column ``key``.  Points may repeat; the columns ``kind``, ``part``, ``step`` and those that begin with
    ``open_`` or ``ahead_`` are taken.
    """
    carried = [c for c in points.columns if c != "key"]
    blank = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carried]
    # No byte of a text is FF: the end of a prefix sorts after everything that begins with it, and after the ends inside it.
    key = F.col("key").cast("binary")
    events = (
        points.select(key.alias("key"), F.lit(POINT).alias("kind"), *carried)
        .unionByName(prefixes.select(key.alias("key"), F.lit(OPEN).alias("kind"), *blank))
        .unionByName(prefixes.select(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(CLOSE).alias("kind"), *blank))
    )
    order = ["key", "kind", *carried]
    events = stage(events.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    events = events.withColumn("step", step)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a range: as many as there are shuffle partitions.
    heights = events.groupBy("part").agg(F.sum("step").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead_height"))
    ends = events.filter(F.col("kind") != POINT).join(heights, "part")
    opened = stage(ends.withColumn("height", (F.col("ahead_height") + F.sum("step").over(inside)).cast("int")).filter(F.col("kind") == OPEN).select("key", "height", "part"))
    deepest = opened.agg(F.max("height")).first()[0] or 0
    if not deepest:
        return events.filter(F.col("kind") == POINT).select(F.col("key").cast("string").alias("key"), *carried, F.array().cast("array<string>").alias("stack"))
    levels = range(1, deepest + 1)
    last = opened.groupBy("part").agg(*[F.max(F.when(F.col("height") == i, F.col("key"))).alias(f"open_{i}") for i in levels])
    ahead = heights.join(last, "part", "left").select("part", "ahead_height", *[F.last(f"open_{i}", ignorenulls=True).over(before).alias(f"ahead_{i}") for i in levels])
    # The height just after a key: for an opening, its own level.
    marked = events.join(ahead, "part").withColumn("open_height", (F.col("ahead_height") + F.sum("step").over(inside)).cast("int"))
    opening = F.col("kind") == OPEN
    here = [F.coalesce(F.last(F.when(opening & (F.col("open_height") == i), F.col("key")), ignorenulls=True).over(inside), F.col(f"ahead_{i}")).alias(f"open_{i}") for i in levels]
    swept = marked.select("key", "kind", *carried, "open_height", *here).filter(F.col("kind") == POINT)
    stack = F.slice(F.array(*[F.col(f"open_{i}").cast("string") for i in levels]), F.lit(1), F.col("open_height"))
    return swept.select(F.col("key").cast("string").alias("key"), *carried, stack.alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``urls`` by ``rules`` (host, path, verdict).

    A rule fits its host and all subdomains where the url's path begins with the rule's.  The longest rule (host and path together)
    wins, of equally long ones the one of the longer host; of rules given twice the smallest verdict.  Where none fits, rule is null and
    the verdict is ``default``.  Null urls and those without ``://`` have an empty host, which no rule fits.  Rules without a host are
    not used.  Rows are never merged, and other columns of ``urls`` are not read.
    """
    url = F.col(url_col).cast("string")
    rows = urls.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = lower_ascii(F.col("host"))
    rules = stage(
        rules.filter(F.coalesce(F.col("host"), F.lit("")) != "").select(host_key(hosts).alias("node"), hosts.alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .groupBy("node", "rule_host", "rule_path").agg(F.min("verdict").alias("verdict"))
    )
    distinct = rows.filter(F.col("host") != "").select("host", "path").distinct().withColumn("key", host_key(F.col("host")))
    under = sweep(distinct, rules.select(F.col("node").alias("key")).distinct())
    asked = under.select("host", "path", F.explode("stack").alias("node")).withColumn("key", F.concat("node", "path"))
    rule_keys = rules.withColumn("key", F.concat("node", "rule_path"))
    found = sweep(asked, rule_keys.select("key").distinct()).filter(F.size("stack") > 0)
    best = found.select("host", "path", F.get("stack", F.size("stack") - 1).alias("key")).groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key"))).alias("best"))
    # Rules of equal length differ in how much of it is host; a key can be read as several of them.
    named = rule_keys.groupBy("key").agg(F.max(F.struct(F.length("rule_host").alias("n"), "rule_host", "rule_path", "verdict")).alias("named"))
    answers = stage(best.select("host", "path", F.col("best.key").alias("key")).join(named, "key").select("host", "path", F.concat("named.rule_host", "named.rule_path").alias("rule"), "named.verdict"))
    return rows.join(answers, ["host", "path"], "left").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
