"""Quality by ordinal regression: a cumulative-link model on hashed text.

All grades share one score, the mean weight of a text's hashed byte trigrams plus the weights of what describes it as a whole (its length,
how many of its words are distinct, how many repeat the word before them); ordered thresholds cut the score into grades: P(grade >= j) = sigmoid(score - threshold j).
That gives the expected grade and the tail probability to select by.  Weights and thresholds are fitted together in numpy, on a bounded
sample of rated rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictal.llm.common import fill, flat, in_one_task, span_hashes, steps, trimmed, word_spans, words_per_value

# Bounds of the training sample: rated rows, and bytes of a text that may be among them.
TRAIN_ROWS, TRAIN_BYTES = 4000, 1 << 17
BUCKETS = 1 << 15
# Weights of a whole text: 24 classes of length, 17 each of the part of its words that are distinct and that repeat the word before.
LENGTHS, RATIOS = 24, 17
WHOLE = LENGTHS + 2 * RATIOS
SCALE, STEPS, BATCH, RATE, DECAY = 40.0, 1400, 128, 0.02, 1e-4
TAIL, CUT = 1, 0.5


def trigram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that begins at every byte but the last two."""
    d = data.astype(np.uint32)
    h = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(17)).astype(np.int32)


def descriptions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The three weights of every text as a whole: its classes of length, of distinct words and of repeated ones."""
    lengths = np.diff(offsets)
    out = np.zeros((len(lengths), 3), np.int64)
    out[:, 0] = np.minimum(np.log2(lengths + 1).astype(np.int64), LENGTHS - 1)
    starts, ends = word_spans(data, offsets)
    if len(starts):
        counts = np.diff(words_per_value(starts, offsets))
        text = np.repeat(np.arange(len(counts)), counts)
        hashes = span_hashes(data, starts, ends)
        same = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])])
        order = np.lexsort((hashes, text))
        new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (text[1:] != text[:-1])])
        for k, n in ((1, np.bincount(text[new], minlength=len(counts))), (2, np.bincount(text[same], minlength=len(counts)))):
            out[:, k] = np.where(counts > 0, 1 + np.minimum(n * (RATIOS - 2) // np.maximum(counts, 1), RATIOS - 2), 0)
    return BUCKETS + out + np.array([0, LENGTHS, LENGTHS + RATIOS])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Ordinal:
    """weights: of the buckets, then of whole texts; thresholds are ordered."""

    weights: np.ndarray
    thresholds: np.ndarray

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = self.weights[descriptions(data, offsets)].sum(axis=1)
        if len(data) < 3:
            return out
        worth = np.zeros(len(data), np.float32)
        worth[:-2] = self.weights[trigram_buckets(data)]
        # A trigram that reaches over the end of its text does not count.
        ends = offsets[1:]
        worth[ends[ends > 0] - 1] = 0
        worth[np.maximum(ends[ends > 1] - 2, 0)] = 0
        lengths = np.diff(offsets)
        full = lengths > 2
        sums = np.add.reduceat(worth.astype(np.float64), offsets[:-1][lengths > 0])
        mean = np.zeros(len(lengths))
        mean[lengths > 0] = sums
        out = out.astype(np.float64)
        out[full] += SCALE * mean[full] / (lengths[full] - 2)
        return out

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade >= j) of every text, for j from 1 on."""
        return sigmoid(self.raw(data, offsets)[:, None] - self.thresholds)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (column, value, ends) of the same sum that ``Ordinal.raw`` takes."""
    whole = descriptions(data, offsets)
    columns, values, ends = [], [], [0]
    for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        at, n = np.unique(trigram_buckets(data[a:b]), return_counts=True) if b - a > 2 else (np.zeros(0, np.int32), np.zeros(0))
        columns += [at, whole[r]]
        values += [SCALE * n / max(b - a - 2, 1), np.ones(3)]
        ends.append(ends[-1] + len(at) + 3)
    return np.concatenate([*columns, np.zeros(0)]).astype(np.int32), np.concatenate([*values, np.zeros(0)]).astype(np.float32), np.array(ends)


def train(texts: list[str], grades: np.ndarray, levels: int) -> Ordinal:
    """Weights and ordered thresholds for grades 0 .. levels - 1; without rows all grades are equally likely."""
    width = BUCKETS + WHOLE
    grades = np.asarray(grades, np.int64)
    # Thresholds begin where the rates of the grades lie; gaps between them are kept positive as exponentials.
    above = (np.array([(grades >= j).sum() for j in range(1, levels)]) + 1) / (len(grades) + 2)
    thresholds = -np.log(above / (1 - above))
    thresholds = thresholds[0] + np.concatenate([[0], np.cumsum(np.maximum(np.diff(thresholds), 0.05))])
    model = Ordinal(np.zeros(width, np.float32), thresholds)
    if not len(grades) or grades.min() == grades.max():
        return model
    column, offsets = pa.array(texts, pa.large_string()), None
    data, offsets = flat(column)
    parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets)]
    columns, values = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))])
    first, gaps = model.thresholds[:1].copy(), np.log(np.diff(model.thresholds))
    params, rng = [model.weights, first, gaps], np.random.default_rng(3)
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    order = np.zeros(0, np.int64)
    for _ in range(STEPS):
        if not len(order):
            order = rng.permutation(len(grades))
        rows, order = order[:BATCH], order[BATCH:]
        many = np.diff(ends)[rows]
        at = np.repeat(ends[rows], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row = np.repeat(np.arange(len(rows)), many)
        c, x = columns[at], values[at]
        score = np.bincount(row, weights=model.weights[c] * x, minlength=len(rows))
        cuts = first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        # P(grade) is the difference of two neighbouring tails; the outer ones are 1 and 0.
        tails = np.concatenate([np.ones((len(rows), 1)), sigmoid(score[:, None] - cuts), np.zeros((len(rows), 1))], axis=1)
        slope = tails * (1 - tails)
        y, k = grades[rows], np.arange(len(rows))
        likely = np.maximum(tails[k, y] - tails[k, y + 1], 1e-9)
        d_score = -(slope[k, y] - slope[k, y + 1]) / likely / len(rows)
        d_cuts = np.zeros(len(cuts) + 2)
        np.add.at(d_cuts, y, slope[k, y] / likely / len(rows))
        np.add.at(d_cuts, y + 1, -slope[k, y + 1] / likely / len(rows))
        d_cuts = d_cuts[1:-1]
        grads = [np.bincount(c, weights=d_score[row] * x, minlength=width) + DECAY * model.weights, d_cuts.sum(keepdims=True), np.array([d_cuts[j + 1 :].sum() for j in range(len(gaps))]) * np.exp(gaps)]
        t += 1
        scale = RATE * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for p, g, a, b in zip(params, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= (scale * a / (np.sqrt(b) + 1e-7)).astype(p.dtype)
    model.thresholds = first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return model


def fit(docs: DataFrame, ratings: DataFrame, levels: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", rows: int = TRAIN_ROWS) -> Ordinal:
    """A model from at most ``rows`` rated rows, taken by a hash of the id, of texts up to TRAIN_BYTES.

    Of several ratings of an id the smallest counts; ratings that are null or outside 0 .. levels - 1 are left out.
    """
    rated = ratings.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").between(0, levels - 1)).groupBy("id").agg(F.min("y").alias("y"))
    sample = rated.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES)
    # The sample has at most ``rows`` rows of an id and a grade.
    got = texts.join(F.broadcast(sample), "id").select("id", "y", "text").orderBy("id", "text").limit(rows)
    return in_one_task(got, lambda t: train(t.column("text").to_pylist(), np.array(t.column("y").to_pylist(), np.int64), levels))


def grade(docs: DataFrame, model: Ordinal, columns: list[Column], text_col: str = "text", tail: int = TAIL, cut: float = CUT) -> DataFrame:
    """``columns`` of every row with expected_grade, tail_probability (of ``tail`` or better) and selected (not below ``cut``).

    Null counts as the empty text, which is graded by its length alone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(fill(batch.column("__text")))
            tails = np.zeros((batch.num_rows, len(shared.value.thresholds)))
            for i, j in steps(offsets):
                tails[i:j] = shared.value.tails(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            kept, chosen = batch.schema.names[:-1], tails[:, tail - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(tails.sum(axis=1)), pa.array(chosen), pa.array(chosen >= cut)], names=[*kept, "expected_grade", "tail_probability", "selected"])

    added = [T.StructField(n, t) for n, t in (("expected_grade", T.DoubleType()), ("tail_probability", T.DoubleType()), ("selected", T.BooleanType()))]
    return rows.mapInArrow(trimmed(run), T.StructType([*rows.schema[:-1], *added]))
