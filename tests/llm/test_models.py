"""Toxicity and quality: gradients, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from edictal.llm import ordinal, toxicity
from edictal.llm.common import flat
from edictal.llm.text_model import F32, Network

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"
NICE = [a + b for a in ("ba", "do", "ki", "lu", "me", "ny") for b in ("fan", "gor", "hul", "jes", "pim", "quo", "rst")]


def make(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Texts of one to 150 words; toxic ones hold one or more words of a bad stem, with endings not all seen in training."""
    rng, texts, marks = random.Random(seed), [], []
    for k in range(n):
        words = [rng.choice(NICE) for _ in range(rng.randint(4, 150))]
        if k % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randrange(len(words)), rng.choice(("Zrakk", "zvuzz")) + "".join(rng.choice("aeiou") for _ in range(3)) + rng.choice(",. "))
        texts.append(" ".join(words))
        marks.append(int(k % 4 == 0))
    return texts, np.array(marks)


def scored(model, texts):
    return model.score(*flat(pa.array(texts, pa.large_string())))


def test_gradients():
    net, rng = Network(5, 3), np.random.default_rng(1)
    for name in net.params:
        net.params[name] = net.params[name].astype(np.float64)
    gates, mask = rng.standard_normal((6, 4, 18)), rng.random((6, 4)) < 0.8
    mask[0] = True
    mask = np.sort(mask, axis=0)[::-1]
    weights = rng.standard_normal(4)
    logit, kept = net.forward(gates, mask, keep=True)
    grads, d_gates = net.backward(weights, kept)
    for target, grad in [(net.params[k], g) for k, g in grads.items()] + [(gates, d_gates)]:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in target.shape)
            old = target[at]
            ends = []
            for step in (1e-3, -1e-3):
                target[at] = old + step
                ends.append(float((net.forward(gates, mask) * weights).sum()))
            target[at] = old
            assert grad[at] == pytest.approx((ends[0] - ends[1]) / 2e-3, abs=3e-3)


def test_toxicity_generalises():
    model = toxicity.train(*make(600, 1))
    texts, marks = make(300, 2)
    found = scored(model, texts)
    assert ((found >= toxicity.THRESHOLD) == (marks == 1)).mean() > 0.97
    # Every place of a long text counts, and a text scores the same in any company.
    long = " ".join(NICE * 100)
    assert scored(model, [long, long + " zrakkeio", "zrakkeio " + long]).round(3).tolist() == scored(model, [long]).round(3).tolist() + scored(model, [long + " zrakkeio"]).round(3).tolist() + scored(model, ["zrakkeio " + long]).round(3).tolist()
    assert scored(model, [long])[0] < 0.5 < scored(model, [long + " zrakkeio"])[0]


def test_windows_cover_every_word():
    for n in (0, 1, 24, 25, 40, 41, 100):
        text, start, length = toxicity.windows_of(np.array([0, n]))
        assert set().union(*(range(s, s + w) for s, w in zip(start, length, strict=True)), set()) == set(range(n))


def test_lookup():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000)).astype(np.uint64)
    table = toxicity.Lookup(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (table.find(keys + np.uint64(1)) == -1).mean() > 0.99
    assert toxicity.Lookup(keys[:0]).find(keys[:3]).tolist() == [-1] * 3


def test_toxicity_of_tables(frame):
    texts, marks = make(400, 3)
    rows = list(enumerate(texts)) + [(400, None), (401, ""), (402, "123 !!"), (None, "zrakkaei"), (None, "zrakkaei")]
    labels = [(i, 1, int(m)) for i, m in enumerate(marks)] + [(0, 1, None), (None, 1, 1), (9999, 1, 1)]
    docs = frame(rows, DOCS)
    model = toxicity.fit(docs, frame(labels, LABELS))
    got = toxicity.score(docs, model, [F.col("doc_id"), toxicity.held_out("doc_id").alias("held_out")]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.95
    assert [r.predicted for r in got if r.doc_id is None] == [1, 1]
    assert {round(r.score, 6) for r in got if r.doc_id in (400, 401, 402)} == {round(float(1 / (1 + np.exp(-model.net.params["bias"][0]))), 6)}


def test_toxicity_never_reads_held_out_labels(frame):
    texts, marks = make(120, 4)
    docs = frame(list(enumerate(texts)), DOCS)
    kept = [(i, 1, int(m)) for i, m in enumerate(marks)]
    turned = [(i, 1, 1 - m if zlib.crc32(str(i).encode()) % 3 == 1 else m) for i, _, m in kept]
    scores = [[r.score for r in toxicity.score(docs, toxicity.fit(docs, frame(x, LABELS)), [F.col("doc_id")]).orderBy("doc_id").collect()] for x in (kept, turned)]
    assert scores[0] == scores[1]


def test_nothing_to_learn_from(frame):
    docs = frame([(1, "a b"), (2, None)], DOCS)
    for labels, want in (([], 0.0), ([(0, 1, 0)], 0.0), ([(1, 1, 1)], 2 / 3)):
        model = toxicity.fit(docs, frame(labels, LABELS))
        assert [r.score for r in toxicity.score(docs, model, [F.col("doc_id")]).collect()] == pytest.approx([want] * 2)
    assert toxicity.score(frame([], DOCS), model, [F.col("doc_id")]).collect() == []
    assert toxicity.train(["", "1"], np.array([0, 1])).score(np.zeros(0, np.uint8), np.array([0, 0])).dtype == F32


def graded(n: int, seed: int) -> tuple[list[str], np.ndarray]:
    """The worse the grade, the more of the words end in marks."""
    rng, texts, grades = random.Random(seed), [], []
    for k in range(n):
        texts.append(" ".join(rng.choice(NICE) + ("%%" if rng.random() < (3 - k % 4) * 0.3 else "") for _ in range(rng.randint(20, 150))))
        grades.append(k % 4)
    return texts, np.array(grades)


def test_ordinal_regression():
    model = ordinal.train(*graded(800, 1), 4)
    assert (np.diff(model.thresholds) > 0).all()
    texts, grades = graded(200, 2)
    tails = model.tails(*flat(pa.array(texts, pa.large_string())))
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = tails.sum(axis=1)
    assert np.abs(expected - grades).mean() < 0.35
    for j in (1, 2, 3):
        assert ((tails[:, j - 1] >= 0.5) == (grades >= j)).mean() > 0.9


def test_ordinal_features_are_what_is_scored():
    texts = ["", "a", "ab", "abc", "é a a a", "x" * 50, "word word other\n" * 20]
    data, offsets = flat(pa.array(texts, pa.large_string()))
    rng = np.random.default_rng(1)
    model = ordinal.Ordinal(rng.standard_normal(ordinal.BUCKETS + ordinal.WHOLE).astype(np.float32), np.array([0.0]))
    columns, values, ends = ordinal.features(data, offsets)
    want = [float((model.weights[columns[a:b]] * values[a:b]).sum()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert model.raw(data, offsets) == pytest.approx(want, abs=1e-3)
    alone = [float(model.raw(*flat(pa.array([t], pa.large_string())))[0]) for t in texts]
    assert alone == pytest.approx(want, abs=1e-3)


def test_quality_of_tables(frame):
    texts, grades = graded(200, 3)
    rows = list(enumerate(texts)) + [(200, None), (None, ""), (0, texts[1])]
    ratings = [(i, int(g)) for i, g in enumerate(grades)] + [(1, 9), (2, None), (None, 1)]
    model = ordinal.fit(frame(rows, DOCS), frame(ratings, "doc_id long, grade int"), 4)
    got = ordinal.grade(frame(rows, DOCS), model, [F.col("doc_id")], tail=2).collect()
    assert len(got) == len(rows) and all(0 <= r.expected_grade <= 3 and r.selected == (r.tail_probability >= 0.5) for r in got)
    assert np.mean([r.selected == (grades[r.doc_id] >= 2) for r in got if r.doc_id is not None and 0 < r.doc_id < 200]) > 0.9
    empty = ordinal.fit(frame([], DOCS), frame([], "doc_id long, grade int"), 4)
    assert ordinal.grade(frame([], DOCS), empty, [F.col("doc_id")]).collect() == []
    assert len(ordinal.grade(frame(rows, DOCS), empty, [F.col("doc_id")]).collect()) == len(rows)
