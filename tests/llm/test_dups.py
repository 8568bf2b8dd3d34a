"""Exact and near dedup beside brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from edictal.llm import exact_dups, near_dups
from edictal.llm.common import flat
from edictal.llm.components import components

LOWER = {i: i + 32 for i in range(65, 91)}
DOCS = "doc_id long, text string"


def shingles(text: str) -> frozenset:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < 5 else frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def copies(rng: random.Random, n: int) -> list[str]:
    """Texts, exact copies in another case, near copies, short and empty ones."""
    base = [" ".join(rng.choice(("alpha", "Beta", "gamma", "délta", "eps", "zeta\n", "Eta")) + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    out = list(base)
    for text in base:
        out += [text.upper() if rng.random() < 0.3 and text.isascii() else text for _ in range(rng.choice((0, 0, 1, 3)))]
        for _ in range(rng.choice((0, 1, 4))):
            words = text.split(" ")
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return [*out, "", "", " \n", None, "one", "one two", "one two"]


def test_chunk_hashes_combine():
    text = bytes(range(256)) * 5
    prime, base = exact_dups.PRIMES[0], exact_dups.BASES[0]
    whole = int(exact_dups.chunk_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)]), base, prime)[0])
    for cut in (0, 1, 700, len(text)):
        left, right = (int(exact_dups.chunk_hashes(np.frombuffer(t, np.uint8), np.array([0, len(t)]), base, prime)[0]) for t in (text[:cut], text[cut:]))
        assert exact_dups.combine(left, right, len(text) - cut, base, prime) == whole


@pytest.mark.parametrize(("chunk", "primes"), [(1 << 20, exact_dups.PRIMES), (7, exact_dups.PRIMES), (64, (2, 3))])
def test_exact_dedup(frame, chunk, primes):
    """Small chunks are combined; tiny primes let different texts share a fingerprint, which the comparison must tell apart."""
    rows = list(enumerate(copies(random.Random(1), 25)))
    rows += [rows[3], (None, rows[3][1]), (None, "only here"), (7, "another text of id 7")]
    got = exact_dups.dedup(frame(rows, DOCS), chunk_bytes=chunk, primes=primes).collect()
    groups: dict[str, list] = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(LOWER), []).append(i)
    want = sorted((repr(i), repr(max((x for x in ids if x is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert sorted((repr(r.id), repr(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_exact_dedup_of_nothing(frame):
    assert exact_dups.dedup(frame([], DOCS)).collect() == []


def links(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    label = {k: k for k in range(len(sets))}

    def find(k):
        while label[k] != k:
            k = label[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                label[max(find(a), find(b))] = min(find(a), find(b))
    members: dict[int, list] = {}
    for k in range(len(sets)):
        members.setdefault(find(k), []).append(k)
    return [(repr(sets[k][0]), len(sets[k][1]), repr(min((sets[m][0] for m in ms if sets[m][0] is not None), default=None) if sets[k][1] else sets[k][0])) for ms in members.values() for k in ms]


@pytest.mark.parametrize("percent", [80, 85])
def test_near_dedup(frame, percent):
    rows = list(enumerate(copies(random.Random(2), 25)))
    random.Random(3).shuffle(rows)
    rows += [rows[0], (None, rows[1][1])]
    got = near_dups.near_dups(frame(rows, DOCS), percent=percent).collect()
    assert sorted((repr(r.id), r.n_shingles, repr(r.component_id)) for r in got) == sorted(links(rows, percent))
    with_words = [r for r in got if r.n_shingles]
    assert sum(r.kept for r in with_words) == len({repr(r.component_id) for r in with_words})
    assert all(r.kept for r in got if not r.n_shingles)


def test_near_dedup_over_blocks(frame, monkeypatch):
    """A chain of edits, none similar to one far away, in buckets and families larger than a block."""
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 7)
    monkeypatch.setattr(near_dups, "BUCKET_ROWS", 9)
    rng, words, rows = random.Random(4), [f"w{i}" for i in range(90)], []
    for i in range(60):
        words = list(words)
        words[rng.randrange(90)] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = near_dups.near_dups(frame(rows, DOCS)).collect()
    assert sorted((repr(r.id), r.n_shingles, repr(r.component_id)) for r in got) == sorted(links(rows, 85))


def test_near_dedup_of_nothing(frame):
    assert near_dups.near_dups(frame([], DOCS)).collect() == []
    assert near_dups.near_dups(frame([(1, None)], DOCS)).select("n_shingles", "component_id", "kept").collect() == [(0, 1, True)]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    samples = np.array([near_dups.min_hashes(np.unique(pool[a:b])) for a, b in ((0, 2000), (100, 2100), (1000, 3000))])
    s = near_dups.odd_sketches(samples).view(np.uint64)
    found = near_dups.estimate(np.array([np.bitwise_count(s[0] ^ s[k]).sum() for k in (1, 2)]))
    assert abs(found[0] - 1900 / 2100) < 0.1 and abs(found[1] - 1000 / 3000) < 0.2
    assert near_dups.estimate(np.array([near_dups.most_differing(0.7)]))[0] == pytest.approx(0.7, abs=0.005)


def test_shingles_of_arrow_slices():
    texts = ["a b c d e f", None, "", "x", "A b  c\td e f"]
    sets = list(near_dups.shingle_sets(pa.array(["zz", *texts]).slice(1)))
    assert [len(s) for s in sets] == [2, 0, 0, 1, 2] and (sets[0] == sets[4]).all()
    assert flat(pa.array(["zz", "ab", "c"]).slice(1))[1].tolist() == [0, 2, 3]


def test_components(ready):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (100, 300), (7, 7), (500, 500)] + [(rng.randint(600, 650), rng.randint(600, 650)) for _ in range(40)]
    label = {x: x for p in pairs for x in p}
    for _ in range(60):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(map(tuple, components(ready.createDataFrame(pairs, "a long, b long")).collect())) == label
    assert components(ready.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("percent", [85, 80])
def test_sketches_refuse_fewer_than_bands_miss(percent):
    """Exact over the samples that differ (binomial) and the bits that are odd after two throws for each of them."""
    n, bits, p = near_dups.SAMPLES, near_dups.BITS, percent / 100
    most = near_dups.most_differing(p - near_dups.LEEWAY)
    differ, refused, at = np.zeros(bits + 1), 0.0, np.arange(bits + 1)
    differ[0], weight = 1, p**n
    for k in range(n + 1):
        refused += weight * differ[most + 1 :].sum()
        for _ in range(2):
            up, down = differ[:-1] * (bits - at[:-1]) / bits, differ[1:] * at[1:] / bits
            differ = np.concatenate([[0], up]) + np.concatenate([down, [0]])
        weight *= (n - k) / (k + 1) * (1 - p) / p
    rows = near_dups.band_rows(percent)
    assert refused < (1 - p**rows) ** (n // rows)
