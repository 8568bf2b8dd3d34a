"""Periodic runs beside brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from edictal.llm import periodic_runs as P
from edictal.llm.queries import QUERIES


def plain_runs(w, least_words=24, least_periods=3):
    """Every maximal stretch of every period that no smaller period explains."""
    out, n = [], len(w)
    for p in range(1, n // least_periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            length = j + p - i
            if j > i and length >= max(least_words, least_periods * p) and not any(all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, p)):
                out.append((i, length, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w, runs):
    return " ".join(x for k, x in enumerate(w) if not any(s + p <= k < s + length for s, length, p in runs))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_words(rng):
    n, letters = rng.randint(0, 90), rng.randint(1, 5)
    w = [f"é{rng.randrange(letters)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n:
            p, a = rng.randint(1, 8), rng.randrange(n)
            b = rng.randint(a, n)
            for i in range(a + p, b):
                w[i] = w[i - p]
    return w


@pytest.mark.parametrize("least", [(1, 2), (2, 2), (5, 3), (24, 3)])
def test_runs_of_words(least):
    rng = random.Random(sum(least))
    for _ in range(300):
        w = some_words(rng)
        numbers = [sorted(set(w)).index(x) for x in w]
        assert sorted(map(tuple, P.runs_of(numbers, *least).tolist())) == sorted(plain_runs(w, *least))


def test_stretches_hold_all_runs():
    rng = random.Random(12)
    for _ in range(300):
        w = some_words(rng) + [f"x{i}" for i in range(rng.randint(0, 20))] + some_words(rng)
        assert [tuple(r) for r in P.text_runs([x.encode() for x in w]).tolist()] == plain_runs(w)


def test_tree_agrees_with_comparing():
    rng = random.Random(3)
    for _ in range(60):
        w = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(2, 40))]
        agree, n = P.Agreement(P.SuffixTree(w)), len(w)
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        got = agree(*map(__import__("numpy").array, zip(*pairs, strict=True)))
        for (i, j), k in zip(pairs, got.tolist(), strict=True):
            assert w[i : i + k] == w[j : j + k] and (i + k >= n or j + k >= n or w[i + k] != w[j + k])
        assert sorted(range(n + 1), key=lambda i: w[i:]) == agree.rank.argsort().tolist()
        assert sorted(range(n + 1), key=lambda i: [-x for x in w[i:]]) == P.SuffixTree(w).backward().argsort().tolist()


def test_rows_and_edges(frame):
    long = [str(i % 40_000) for i in range(130_000)]  # near a megabyte, one run of it all
    texts = [None, "", " \n", "a", "a " * 24, "a " * 23, "a b " * 12, "A a " * 12, "a\x0bb\tc\r\n" * 8 + "d", " ".join(map(str, range(50))), " ".join(long)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[6]), (4, texts[4]), (4, texts[4])]
    got = P.find_runs(frame(rows, "doc_id long, text string"), [F.col("doc_id"), F.col("n"), F.col("row").alias("runs_too")]).collect()
    told = sorted(((r.doc_id, r.n, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr)
    want = []
    for i, t in rows:
        runs = [(0, 130_000, 40_000)] if i == 10 else plain_runs(words(t))
        want.append((i, "x", len(words(t)), runs, " ".join(long[:40_000]) if i == 10 else plain_collapsed(words(t), runs)))
    assert told == sorted(want, key=repr)
    assert P.find_runs(frame([], "doc_id long, text string"), [F.col("doc_id")]).collect() == []


def test_query(frame, ready, tmp_path):
    rng = random.Random(5)
    rows = [(i, "  ".join(some_words(rng) + some_words(rng))) for i in range(150)] + [(i, "") for i in range(150, 160)] + [(160, None), (None, "a b " * 20)]
    frame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want, planted = {}, 0
    for i, text in rows:
        w = words(text)
        n = len(w)
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            planted += 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = plain_runs(w)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
        want[i] = (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(plain_collapsed(w, runs)), n)
    got = {r.doc_id: tuple(r) for r in QUERIES["op12_periodic_runs"](ready, str(tmp_path)).collect()}
    assert planted > 5 and got == want
