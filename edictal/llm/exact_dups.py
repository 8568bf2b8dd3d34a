"""Exact dedup by composable polynomial fingerprints.

A text is cut into byte chunks.  Every chunk is hashed on its own as a polynomial of its bytes modulo two primes and shifted by
the bytes that follow it, so that the fingerprint of a text is a plain modular sum of its chunks: they can be hashed in any task and
in any order, and Spark adds them with a partial aggregate.  Texts of equal length and fingerprint are then compared chunk by chunk:
if the smallest and the largest chunk of a position agree, all do, again a partial aggregate without pairs and without a place where
all copies meet.  Fingerprints under which texts differ are split by the SHA-256 of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal.llm.common import LOWER, flat, likely, steps, trimmed
from edictal.session import stage

CHUNK_BYTES = 1 << 20
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1812433253)
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def powers(base: int, prime: int, n: int) -> np.ndarray:
    """base ** 0 .. n - 1 modulo prime."""
    out, done = np.ones(max(n, 1), np.uint64), 1
    while done < n:
        take = min(done, n - done)
        out[done : done + take] = out[:take] * np.uint64(pow(base, done, prime)) % np.uint64(prime)
        done += take
    return out


def chunk_hashes(data: np.ndarray, offsets: np.ndarray, base: int, prime: int) -> np.ndarray:
    """Polynomial of every value's bytes; values are at most 2^20 bytes, so no sum leaves 64 bits."""
    lengths = np.diff(offsets)
    out = np.zeros(len(lengths), np.int64)
    if not len(data):
        return out
    table = powers(base, prime, int(lengths.max()))
    place = np.repeat(offsets[1:], lengths) - 1 - np.arange(len(data))
    terms = (data.astype(np.uint64) + np.uint64(1)) * table[place]
    full = lengths > 0
    out[full] = (np.add.reduceat(terms, offsets[:-1][full]) % np.uint64(prime)).astype(np.int64)
    return out


def combine(left: int, right: int, right_bytes: int, base: int, prime: int) -> int:
    """Fingerprint of a text from those of its two halves."""
    return (left * pow(base, right_bytes, prime) + right) % prime


def _hash_chunks(primes: tuple[int, ...], chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Chunks of a text follow each other in one task, so its digest can go on from chunk to chunk.
        digest = None
        for batch in batches:
            place, n_bytes = batch.column("place").to_numpy(), batch.column("n_bytes").to_numpy()
            raw, offsets = flat(batch.column("chunk"))
            hashes = [np.zeros(batch.num_rows, np.int64) for _ in primes]
            shas: list[str | None] = [None] * batch.num_rows
            for i, j in steps(offsets):
                data = LOWER[raw[offsets[i] : offsets[j]]]
                at = offsets[i : j + 1] - offsets[i]
                for k, prime in enumerate(primes):
                    hashes[k][i:j] = chunk_hashes(data, at, BASES[k] % prime, prime)
                view = memoryview(data)
                for r in range(i, j):
                    digest = hashlib.sha256() if place[r] == 0 else digest
                    digest.update(view[at[r - i] : at[r - i + 1]])
                    rest = int(n_bytes[r]) - (int(place[r]) * chunk_bytes + int(at[r - i + 1] - at[r - i]))
                    if rest == 0:
                        shas[r] = digest.hexdigest()
                    else:
                        for k, prime in enumerate(primes):
                            hashes[k][r] = int(hashes[k][r]) * pow(BASES[k] % prime, rest, prime) % prime
            columns = [batch.column(c) for c in ("row", "id", "probe", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(h) for h in hashes), pa.array(shas, pa.string())], names=["row", "id", "probe", "n_bytes", "f1", "f2", "sha"])

    return run


def _chunks(body: Column, n_bytes: Column, chunk_bytes: int) -> Column:
    """(place, chunk) of every chunk; an empty text has one empty chunk."""
    last = F.greatest(F.floor((n_bytes - 1) / chunk_bytes), F.lit(0)).cast("int")
    return F.inline(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("place"), F.substring(body, i * chunk_bytes + 1, F.lit(chunk_bytes)).alias("chunk"))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, primes: tuple[int, int] = PRIMES, row_col: str | None = None) -> DataFrame:
    """One row per document: row, id, probe (hash of the raw text), n_bytes, f1, f2 (fingerprint) and sha of the normalised text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select((F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text).alias("probe"), text.cast("binary").alias("body")).withColumn("n_bytes", F.octet_length("body").cast("long"))
    kind = docs.schema[id_col].dataType.simpleString()
    chunks = source.select("row", "id", "probe", "n_bytes", _chunks(F.col("body"), F.col("n_bytes"), chunk_bytes))
    hashed = chunks.mapInArrow(trimmed(_hash_chunks(primes, chunk_bytes)), f"row long, id {kind}, probe long, n_bytes long, f1 long, f2 long, sha string")
    sums = [F.pmod(F.sum(f"f{k + 1}"), F.lit(p)).alias(f"f{k + 1}") for k, p in enumerate(primes)]
    return hashed.groupBy("row").agg(F.first("id").alias("id"), F.first("probe").alias("probe"), F.first("n_bytes").alias("n_bytes"), *sums, F.max("sha").alias("sha"))


def _differing(docs: DataFrame, prints: DataFrame, text_col: str, chunk_bytes: int) -> DataFrame:
    """Fingerprints under which texts differ, found by comparing chunks; only texts that may have a copy are moved."""
    key = ["n_bytes", "f1", "f2"]
    copied = prints.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    probes = stage(prints.select("probe", *key).distinct().join(copied, key, "left_semi"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = likely(docs.select(text.alias("t"), F.xxhash64(text).alias("probe")), probes, "probe").select("probe", F.translate("t", UPPER, LOWERED).cast("binary").alias("body"))
    chunks = found.withColumn("n_bytes", F.octet_length("body").cast("long")).select("probe", "n_bytes", _chunks(F.col("body"), F.col("n_bytes"), chunk_bytes))
    ends = chunks.groupBy("probe", "n_bytes", "place").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    met = ends.join(probes, ["probe", "n_bytes"]).groupBy(*key, "place").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return met.filter("low < high").select(*key).distinct()


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, primes: tuple[int, int] = PRIMES, row_col: str | None = None) -> DataFrame:
    """Groups of texts that are the same after lower-casing A-Z, a row per input row.

    Columns: row, id, keep_id, group_size, kept, text_sha256.  Null counts as the empty text.  The row with the largest id stays, a null
    id being the smallest; of rows that share it the one with the largest row number.  Other columns of ``docs`` are not read.
    ``row_col`` may name a column of distinct whole numbers to know rows by.  An empty table gives an empty result.
    """
    key = ["n_bytes", "f1", "f2"]
    prints = stage(fingerprints(docs, id_col, text_col, chunk_bytes, primes, row_col))
    differing = stage(_differing(docs, prints, text_col, chunk_bytes)).withColumn("split", F.lit(True))
    rows = prints.join(differing, key, "left").withColumn("part", F.when(F.col("split"), F.col("sha")).otherwise(F.lit(""))).drop("split")
    by = [*key, "part"]
    groups = rows.groupBy(*by).agg(F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep")).filter("group_size > 1")
    # Written, so that the join below reads two scans and Spark can split the side of a text with very many copies.
    groups = stage(groups)
    return rows.join(groups, by, "left").select(
        "row", "id", F.when(F.col("keep").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("keep").isNull() | (F.col("keep.row") == F.col("row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )
