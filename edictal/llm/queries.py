"""The queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import edictal
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edictal.llm import adaptive_rules, bin_completion, chat_pairs, exact_dups, kd_search, near_dups, ordinal, periodic_runs, token_counts, toxicity, url_rules, whitening, word_table
from edictal.llm.adaptive_rules import bound, words
from edictal.llm.common import table


# Fixed values of the contract: host, path and verdict of every rule.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


# Grades of the labels: 0 poor, 1 good but toxic, 2 good.
LEVELS = 3


def ratings(labels: DataFrame) -> DataFrame:
    """Graded ratings of labelled rows; rows that are held out as for toxicity are left to measure with."""
    quality, toxic = F.col("quality").cast("int"), F.coalesce(F.col("toxic").cast("int"), F.lit(0))
    return labels.filter(~toxicity.held_out("doc_id")).select("doc_id", F.when(quality == 0, 0).when(toxic > 0, 1).when(quality > 0, 2).alias("grade"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = ordinal.fit(docs, ratings(table(spark, sf_dir, "labels")), LEVELS)
    return ordinal.grade(docs, model, [F.col("doc_id"), toxicity.held_out("doc_id").alias("held_out")])


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_search.top_k(table(spark, sf_dir, "embeddings"))


WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    out = word_table.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.col("written").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE)).withColumnRenamed("id", "doc_id")


def preferences(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs for ``format_pairs`` of conversations without preferences.  Every conversation, as it is, is preferred to its own turns up to
    its last reply with the last reply of the conversation of the next id in that place.  Where a conversation has no reply, the other's comes
    after its last turn; where the next one is missing or has none, nothing takes the place.  Of replies with one turn number the largest is last.
    """
    said = turns.filter("conv_id is not null").select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    reply = F.max(F.when(F.col("role") == "assistant", F.struct("turn", "text")))
    ends = said.groupBy("conv_id").agg(F.max("turn").alias("last"), reply.alias("reply"))
    other = ends.filter("reply is not null").select(F.try_subtract(F.col("conv_id"), F.lit(1)).alias("conv_id"), F.col("reply.text").alias("other"))
    closing = ends.select("conv_id", F.coalesce("reply.turn", F.col("last") + 1).alias("cut")).join(other, "conv_id", "left")
    before = said.join(closing.select("conv_id", "cut"), "conv_id").filter("turn < cut").drop("cut")
    instead = closing.filter("other is not null").select("conv_id", F.col("cut").alias("turn"), F.lit("assistant").alias("role"), F.col("other").alias("text"))
    side = lambda k: F.struct("conv_id", F.lit(k).alias("side"))
    rejected = before.unionByName(instead)
    both = said.withColumn("conv_id", side(0)).unionByName(rejected.withColumn("conv_id", side(1)))
    return both, ends.select(F.col("conv_id").alias("pair_id"), side(0).alias("chosen_id"), side(1).alias("rejected_id"))


def op6_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation makes a pair: ``preferences``."""
    out = chat_pairs.format_pairs(*preferences(table(spark, sf_dir, "conversations")))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["length"], F.lit(":"), x["learned"].cast("int"))), " ")
    return out.withColumns({c: written(c) for c in ("chosen_mask", "rejected_mask")})


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dups.near_dups(table(spark, sf_dir, "documents"), percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dups.dedup(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bin_completion.cut(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    # The sum is taken before the pieces are placed, so that no token moves.
    out = bin_completion.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return out.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, [F.col("doc_id"), toxicity.held_out("doc_id").alias("held_out")])


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whole_numbers(table(spark, sf_dir, "embeddings"), "embedding", [F.col("vec_id")])
    out = whitening.whiten(rows, whitening.fit(rows))
    # The contract's long; a larger sum, as of millions of far rows, is null.
    return out.withColumn("deviation", F.col("deviation").try_cast("long"))


def with_period(text: Column, doc_id: Column) -> Column:
    """The texts of the contract of op12: of a tenth of the rows, by a checksum of the id, the words from some place on repeat a block."""
    checksum = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(checksum / 10)

    def repeating(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " ")).otherwise(text)

    return F.when(checksum % 10 == 0, bound(words(text), repeating)).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.find_runs(docs.withColumn("text", with_period(F.coalesce("text", F.lit("")), F.col("doc_id"))), [F.col("doc_id")])
    # Runs are in the order of start and period, so the first of the greatest exponent is the one of the contract.
    better = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judge(table(spark, sf_dir, "documents"), [F.col("doc_id")])


Query = Callable[[SparkSession, str], DataFrame]


def prepared(spark: SparkSession) -> SparkSession:
    """A session for the operators: Python workers find this package where the driver has it, if it is not installed."""
    root, env = str(Path(edictal.__file__).resolve().parents[1]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH")]))
    # Texts are long: batches of the default 10,000 rows would hold tens of MB in each of several buffers.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def _ready(query: Query) -> Query:
    return lambda spark, sf_dir: query(prepared(spark), sf_dir)


QUERIES: dict[str, Query] = {q.__name__: _ready(q) for q in (op1_url_filter, op2_quality, op3_top_k, op4_bpe_round_trip, op5_token_counts, op6_preference_format, op7_near_dedup, op8_exact_dedup, op9_best_fit_packing, op10_toxicity, op11_whitening, op12_periodic_runs, op13_quality_rules)}
