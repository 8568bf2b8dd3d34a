"""Corpus pipeline: documents without toxic and poor ones, without exact and near copies, packed into sequences.

Every stage reads what the one before it kept.  All but the last return the columns of documents, whatever they are; the last returns
where the pieces of each document go.  Rows are never told apart by their ids, so null and repeated ids are handled as everything else.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edictal.llm import bin_completion, exact_dups, near_dups, ordinal, toxicity
from edictal.llm.common import table, without
from edictal.llm.queries import LEVELS, WORD_BPE, prepared, ratings
from edictal.session import stage

# Near copies: five-word shingles, this similarity or more.
NEAR_PERCENT = 80
# Words that a worker of the last stage remembers: fewer than packing alone may, beside what the stages before it left in the executor.
REMEMBERED = 150_000


def _whole(docs: DataFrame):
    """All columns as one, so that no name of theirs meets one of an operator's."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; null and empty texts stay."""
    model = toxicity.fit(docs, table(prepared(spark), sf_dir, "labels"))
    return toxicity.score(docs, model, [_whole(docs)]).filter("predicted = 0").select("doc.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely than not of grade 1 or better."""
    model = ordinal.fit(docs, ratings(table(prepared(spark), sf_dir, "labels")), LEVELS)
    return ordinal.grade(docs, model, [_whole(docs)]).filter("selected").select("doc.*")


def _kept(docs: DataFrame, judge) -> DataFrame:
    """Documents whose row ``judge`` keeps; rows are numbered in a written copy, so that every reading numbers them alike."""
    numbered = stage(docs.select(F.monotonically_increasing_id().alias("row"), _whole(docs)))
    judged = judge(numbered.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text")))
    return without(numbered, stage(judged.filter("not kept").select("row")), "row").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every text: the one with the largest doc_id."""
    prepared(spark)
    return _kept(docs, lambda rows: exact_dups.dedup(rows, row_col="row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies: the one with the smallest doc_id.  Documents without words stay."""
    prepared(spark)
    return _kept(docs, lambda rows: near_dups.near_dups(rows, percent=NEAR_PERCENT, row_col="row"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    prepared(spark)
    pieces = bin_completion.cut(docs, public_tokenizers.path(WORD_BPE), remembered=REMEMBERED)
    placed = bin_completion.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]
# Trained models and tokenizers have no SQL; tests hold every stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = apply(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
