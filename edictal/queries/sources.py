from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictal.queries.common import day, view
from edictal.session import checkpoint_dir
from edictal.sources import feeds as S
from edictal.sources import sinks, tables


def scratch(spark) -> str:
    """A fresh folder below the shared one."""
    return f"{checkpoint_dir(spark)}/edictal-{uuid.uuid4().hex}"


def load(spark, path):
    """A projection and filter that reach the scan."""
    df = tables.load(spark, path, "lineitem").filter(F.col("l_quantity") > 40)
    return df.select("l_orderkey", "l_linenumber", day(F.to_date("l_shipdate")).alias("shipped"))


def seed(spark, path):
    p = view(spark, path, "processes")
    dim = p.filter(F.col("scope") == "SI").select("process_id", "name")
    return tables.seed(dim, p.select("process_id", F.concat(F.lit("seed "), "name").alias("name")), ["process_id"])


def municipalities(spark, path):
    """S3: a catalogue file written from the parts table, read back with its aliases."""
    p = view(spark, path, "part")
    code = F.concat(F.element_at(F.array(F.lit("3"), F.lit("12"), F.lit("46"), F.lit("99")), (F.col("p_partkey") % 4 + 1).cast("int")), F.lpad("p_partkey", 6, "0"))
    rows = p.select(F.when(F.col("p_partkey") % 4 == 0, F.substring(code, 1, 4)).otherwise(F.left(code, F.lit(5))).alias("codigo_ine"), F.concat(F.lit("La "), "p_name").alias("nombre"), F.col("p_name").alias("nombre_val"))
    folder = scratch(spark)
    sinks.write_report(rows, folder)
    towns = tables.load_municipalities(spark, folder, smallest=10)
    return towns.groupBy("province", "name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.max("aliases")), ",").alias("aliases"))


def flatten_summary(spark, path):
    """A summary per notice; its items are one object or a list, its section varies."""
    n = view(spark, path, "notices")
    item = lambda suffix: F.struct(F.concat("notice_id", F.lit(suffix)).alias("identificador"), F.col("title").alias("titulo"), F.col("url").alias("url_html"))
    name = F.lit("Ayuntamientos").alias("nombre")
    heading = F.when(F.col("n") % 2 == 0, F.to_json(F.struct(F.array(item(""), item("-b")).alias("item"), name))).otherwise(F.to_json(F.struct(item("").alias("item"), name)))
    section = F.when(F.col("source_id") % 3 == 2, "1").otherwise("2B")
    text = F.concat(
        F.lit('{"data":{"sumario":{"diario":[{"seccion":[{"codigo":"'), section, F.lit('","departamento":{"codigo":"9525","texto":{"epigrafe":['), heading, F.lit("]}}}]}]}}}"),
    )
    return S.flatten_summary(n.select(day("published").alias("published"), text.alias("json")))


def feed_rows(spark, path):
    """Feed items with dates in two forms and the address in either field."""
    n = view(spark, path, "notices")
    when = F.when(F.col("n") % 2 == 0, F.date_format("published", "dd/MM/yyyy")).otherwise(F.concat(F.lit("Mon, "), F.date_format("published", "d MMM yyyy"), F.lit(" 08:00:00 +0200")))
    items = n.select("notice_id", F.concat(F.lit("  "), "title").alias("title"), F.when(F.col("n") % 3 == 0, F.col("url")).alias("link"), F.when(F.col("n") % 3 == 1, F.col("url")).otherwise(" ").alias("guid"), when.alias("pubDate"))
    return S.feed_rows(items).withColumn("published", day("published"))


def read_feed(spark, path):
    """S5 end to end: the processes as an XML feed, written and read by Spark."""
    p = view(spark, path, "processes").select(F.col("name").alias("title"), F.concat(F.lit("https://a.example/"), "process_id").alias("link"), F.lit(None).cast("string").alias("guid"), F.date_format("call_date", "dd-MM-yyyy").alias("pubDate"))
    folder = scratch(spark)
    p.write.format("xml").option("rowTag", "item").option("rootTag", "channel").save(folder)
    return S.read_feed(spark, folder).withColumn("published", day("published"))


def normalise_records(spark, path):
    p = view(spark, path, "processes")
    listed = lambda c: F.when(F.col("process_id") % 2 == 0, F.to_json(F.array(c))).otherwise(c)
    raw = p.select(
        "process_id", F.year("call_date").cast("string").alias("year"), F.when(F.col("process_id") % 9 != 0, listed(F.concat(F.lit(" "), "process_id", F.lit(" ")))).alias("edict"),
        listed(F.col("name")).alias("extract"), F.lit("[]").alias("definition"), F.coalesce("category", F.lit("")).alias("name"), listed(F.col("process_type")).alias("publisher"),
    )
    return S.normalise_records(raw, "BOPAL")


def snapshot_version(spark, path):
    """A snapshot version written to the shared folder and read back."""
    p = view(spark, path, "processes")
    target = sinks.write_snapshot(p.select("process_id", "name", "state"), scratch(spark), "2")
    schema = T.StructType([T.StructField("process_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("state", T.StringType())])
    return spark.read.schema(schema).parquet(target)


def fact_window(spark, path):
    """Facts appended in two batches by month, and a window read with partition pruning."""
    n = view(spark, path, "notices").select("notice_id", "published")
    folder = scratch(spark)
    months = n.repartition(F.date_format("published", "yyyy-MM"))
    sinks.append_facts(months.filter(F.col("published") < F.lit("1998-01-01").cast("date")), folder)
    sinks.append_facts(months.filter(F.col("published") >= F.lit("1998-01-01").cast("date")), folder)
    schema = T.StructType([T.StructField("notice_id", T.StringType()), T.StructField("published", T.DateType()), T.StructField("month", T.StringType())])
    out = sinks.read_window(spark, folder, schema, datetime.date(1997, 6, 15), datetime.date(1998, 2, 10))
    return out.select("notice_id", day("published").alias("published"))


def write_report(spark, path):
    """The review report written as CSV and read back."""
    p = view(spark, path, "processes").filter(F.col("scope") == "REVISION").select("process_id", "name", "state")
    folder = scratch(spark)
    sinks.write_report(p, folder)
    return spark.read.csv(folder, sep=";", header=True, schema="process_id BIGINT, name STRING, state STRING")


QUERIES = {f.__name__: f for f in (
    load, seed, municipalities, flatten_summary, feed_rows, read_feed, normalise_records, snapshot_version, fact_window, write_report,
)}
