"""Helpers of the operators: table reading, flat views of text columns, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15 | 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Bits of the filter that ``likely`` broadcasts: 2 MB at any size.  It only spares moving rows; a full one lets all pass.
FILTER_BITS = 1 << 24


def _filtered(rows: DataFrame, wanted: DataFrame, column: str):
    """``rows`` beside the bits of their bucket, and whether the bit of their hash is set."""

    def slot(name: str):
        return F.pmod(F.col(name), F.lit(FILTER_BITS)) + 1

    # At most FILTER_BITS / 32768 rows of 4 KB.
    bits = wanted.groupBy(F.bitmap_bucket_number(slot(column)).alias("filter_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot(column))).alias("filter_bits"))
    place = f"bitmap_bit_position(pmod(`{column}`, {FILTER_BITS}L) + 1)"
    byte = f"conv(hex(substring(filter_bits, cast({place} div 8 as int) + 1, 1)), 16, 10)"
    beside = rows.withColumn("filter_bucket", F.bitmap_bucket_number(slot(column))).join(F.broadcast(bits), "filter_bucket", "left")
    return beside, F.coalesce(F.expr(f"({byte} div cast(power(2, {place} % 8) as int)) % 2 = 1"), F.lit(False))


def likely(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows whose hash in ``column`` is in that of ``wanted``, and few others: a semi-join ahead of the real one that moves no row."""
    beside, held = _filtered(rows, wanted, column)
    return beside.filter(held).drop("filter_bucket", "filter_bits")


def without(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``rows`` whose ``key`` is not in ``dropped``; only those that may be in it are moved to be joined."""
    rows, dropped = rows.withColumn("filter_hash", F.xxhash64(key)), dropped.select(key, F.xxhash64(key).alias("filter_hash"))
    beside, held = _filtered(rows, dropped, "filter_hash")
    kept = beside.filter(~held).select(rows.columns)
    return kept.unionByName(likely(rows, dropped, "filter_hash").join(dropped.select(key), key, "left_anti").select(rows.columns)).drop("filter_hash")


# What one operator keeps in a Python worker from task to task; the next operator that uses the worker drops it.
kept: dict[str, object] = {}


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run``, after which the worker gives freed memory back to the system: it lives on, beside the JVM, for other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept.clear()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return whole


def in_one_task(rows: DataFrame, make: Callable[[pa.Table], object]):
    """What ``make`` makes of all of a bounded sample, made on an executor: its working memory stays off the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            made = pickle.dumps(make(pa.Table.from_batches(held)))
            yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["made"])

    got = rows.coalesce(1).mapInArrow(trimmed(run), "made binary").collect()
    return pickle.loads(got[0]["made"]) if got else make(pa.table({n: pa.array([], pa.string()) for n in rows.columns}))


def fill(column: pa.Array, value="") -> pa.Array:
    """A text column as one array, null as the given value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, value) if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text or binary column and the offsets of its values, without a copy."""
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of values that hold about ``size`` bytes together, one value at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, j
        i = j


# Fixed values of the word contracts: space and the control characters 9 to 13 end a word; A-Z are lower-cased.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of a hash depends on every bit of its input."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            out, done = np.ones(size, np.uint64), 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            _powers[name] = out
    return _powers["up"], _powers["down"]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of every word; no word reaches over the end of a value."""
    word = ~SPACE[data]
    before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner] = False
    after[inner - 1] = False
    return np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span: a polynomial of its bytes, taken from running sums, then mixed."""
    up, down = _power_table(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


def words_per_value(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of every value, and the number of words at the end."""
    return np.searchsorted(starts, offsets)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that follow each other with equal ``keys``, each run as a table; a run may reach over batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(k).to_numpy() for k in keys])
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            if held and last != tuple(key[i]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = tuple(key[i])
    if held:
        yield pa.Table.from_batches(held)
