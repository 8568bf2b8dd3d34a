"""Tokenizing and packing beside the tokenizers library."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from edictal.llm import bin_completion, token_counts, word_table

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string"
ODD = [
    "", "a  b", " \n\nb", "x \n\ny", "don't STOP's ΑΣ ΣΑΣ İstanbul", "a\x1cb c\x1f d", "<|endoftext|>hi <|startoftext|> x", "foo <|endoftext|> bar", "<|end",
    "é ́x", " 　 q​z", "!!'s 12 34", "a\tb\n\n c\r\nd  ", "  lead", "trail   ", "日本語　全角", "﻿bom ᠎ x", "😀👍🏽 \x85next", "ab" * 3000, "word " * 2500,
]


def texts(n: int) -> list[str]:
    rng = random.Random(7)
    pool = list("ab'sSé \n\t\r  \x1c\x0b1٣!?<|>́ßİΣ日  ")
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("table_words", [0, 5, 1 << 18])
def test_encode_and_decode(frame, table_words):
    """With a table for no word, some or all of them, ids and texts are the library's."""
    rows = [(i, t) for i, t in enumerate(texts(300))] + [(0, None), (0, "again"), (None, "again")]
    lib = Tokenizer.from_file(WORDS)
    encoded = word_table.encode(frame(rows, DOCS), WORDS, table_words=table_words)
    got = Counter((r.id, tuple(r.ids), r.decoded, r.written) for r in word_table.decode(encoded, WORDS).collect())
    at_once = word_table.encode(frame(rows, DOCS), WORDS, table_words=table_words, decoded=True)
    assert Counter((r.id, tuple(r.ids), r.decoded, r.written) for r in at_once.collect()) == got
    want = Counter()
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i, tuple(ids), lib.decode(ids, skip_special_tokens=False), " ".join(map(str, ids))] += 1
    assert got == want


def test_frequent_words_are_bounded(frame):
    rows = [(i, " ".join(f"w{k}" for k in range(i))) for i in range(30)]
    for most in (0, 3, 12, 100):
        assert word_table.frequent_words(frame(rows, DOCS), "text", most).count() <= most


def test_rare_words_are_forgotten():
    enc = word_table.WordEncoder(WORDS, {}, remembered=3)
    lib = Tokenizer.from_file(WORDS)
    for text in ("a b c d e", "f g a", "b c x y z", "a"):
        assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


def test_only_vocabularies_without_a_decoder(ready):
    with pytest.raises(ValueError, match="decoder"):
        word_table.decode(ready.createDataFrame([], "id long, ids array<int>"), BYTES)


def test_token_counts(frame):
    rows = [(i, t) for i, t in enumerate(texts(300))] + [(0, None), (None, "again")]
    lib = Tokenizer.from_file(BYTES)
    got = Counter(map(tuple, token_counts.count_tokens(frame(rows, DOCS), BYTES, limit=20).collect()))
    counts = [(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows]
    assert got == Counter((*c, c[2] > 20) for c in counts)


def test_whole_tokens_are_proved():
    whole, lib = token_counts.whole_tokens(BYTES), Tokenizer.from_file(BYTES)
    assert len(whole) > 50_000 and "<|endoftext|>" not in whole
    assert all(len(lib.model.tokenize(t)) == 1 for t in random.Random(1).sample(sorted(whole), 200))


def packed(plan, counts, capacity):
    total = Counter()
    for times, content in plan:
        assert times > 0 and 0 < sum(n * k for n, k in content.items()) <= capacity
        for n, k in content.items():
            total[n] += times * k
    assert total == Counter({n: c for n, c in counts.items() if c})
    return sum(t for t, _ in plan)


def fewest(items: list[int], capacity: int) -> int:
    """By trying every place for every item."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(items):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= items[k]}):
            rest = list(rooms)
            rest.remove(r)
            go(k + 1, [*rest, r - items[k]])
        go(k + 1, [*rooms, capacity - items[k]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        assert packed(bin_completion.plan(dict(Counter(items)), 20), Counter(items), 20) == fewest(items, 20)


def test_bin_completion_improves_on_best_fit():
    rng = np.random.default_rng(4)
    counts = Counter(rng.integers(300, 1500, 5000).tolist())
    first = packed(bin_completion.best_fit_decreasing(counts, 2048), counts, 2048)
    better = packed(bin_completion.plan(dict(counts), 2048), counts, 2048)
    assert -(-sum(n * c for n, c in counts.items()) // 2048) <= better < first
    with pytest.raises(ValueError, match="capacity"):
        bin_completion.plan({9: 1}, 8)
    assert bin_completion.plan({}, 8) == []


def test_packing(frame):
    rows = [(i, t) for i, t in enumerate(texts(200))] + [(None, "again"), (1000, None)]
    lib = Tokenizer.from_file(WORDS)
    capacity = 128
    got = bin_completion.pack(frame(rows, DOCS), WORDS, capacity=capacity).collect()
    pieces, places = Counter(), defaultdict(list)
    for r in got:
        pieces[r.id, r.piece, r.start, r.length, zlib.crc32(r.ids)] += 1
        places[r.sequence_id].append((r.offset, r.length))
    want, total = Counter(), 0
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert pieces == want
    for taken in places.values():
        at = 0
        for offset, length in sorted(taken):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(places) == list(range(len(places))) and len(places) <= -(-total // capacity) + 1
    assert bin_completion.pack(frame([], DOCS), WORDS).collect() == []


@pytest.mark.parametrize(("capacity", "counts", "fewest"), [(50, {12: 4, 28: 3, 31: 6, 9: 6, 19: 3}, 9), (20, {3: 7, 7: 5, 8: 5, 4: 2, 9: 4}, 7)])
def test_fillings_are_also_applied_fewer_times(capacity, counts, fewest):
    made = bin_completion.plan(counts, capacity, 400)
    placed = Counter()
    for times, content in made:
        assert sum(n * k for n, k in content.items()) <= capacity
        for n, k in content.items():
            placed[n] += times * k
    assert placed == counts and sum(times for times, _ in made) == fewest == -(-sum(n * k for n, k in counts.items()) // capacity)


def test_tokens_of_an_empty_table(frame):
    for decoded in (False, True):
        assert word_table.encode(frame([], DOCS), WORDS, decoded=decoded).collect() == []
    assert token_counts.count_tokens(frame([], DOCS), BYTES).collect() == []


def test_packing_cuts_alike_however_few_words_are_remembered(spark):
    """The pipeline remembers fewer words than packing alone; a worker that packed with more does not go on with those."""
    from edictal.llm import bin_completion

    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)], "doc_id long, text string")
    rows = lambda **k: sorted(tuple(r) for r in bin_completion.cut(docs, WORDS, **k).select("id", "piece", "start", "length", "ids").collect())
    assert rows() == rows(remembered=2)
