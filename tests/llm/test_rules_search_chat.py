"""Url rules, top-k search and preference formatting beside brute force."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from edictal.llm import chat_pairs, kd_search, queries, url_rules

LOWER = {i: i + 32 for i in range(65, 91)}


def parts(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate(LOWER), found[2]) if found else ("", "")


def judged(url, rules, default="allow"):
    host, path = parts(url)
    fit = [(len(h + p), len(h), h, p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fit:
        return host, path, None, default
    best = max(f[:2] for f in fit)
    h, p = max(f[2:4] for f in fit if f[:2] == best)
    return host, path, h + p, min(f[4] for f in fit if f[2:4] == (h, p))


URLS = [
    None, "", "no scheme", "http://", "http://Example.ORG", "http://example.org/", "http://a.example.org/en/1#x", "http://a.example.org/en/12?q", "http://b.a.example.org/es/é",
    "ftp://notexample.org/en/1", "http://org/x", "http://org./x", "x://com/fr/", "x://y://com/fr/", "http://c.com/de/1", "http://com/de", "http://a.com?/fr/", "http://a..com/fr/", "http://é.org/fr/\nx",
]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@pytest.mark.parametrize("rules", [RULES, [], [("", "/", "block"), ("org", "", "block"), ("ORG", "/", "block"), ("a.example.org", "/en", "allow"), ("example.org", "/en/12", "allow"), ("org", "", "allow")]])
def test_url_rules(frame, rules):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[6]), (4, URLS[6]), (4, URLS[6])]
    got = url_rules.judge(frame(rows, "page_id long, url string"), frame(rules, "host string, path string, verdict string"))
    lower = [(h.translate(LOWER), p, v) for h, p, v in rules]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, *judged(u, lower))) for i, u in rows)


def test_url_rules_at_random(frame):
    """Nested hosts and paths; the sort is dealt over several ranges."""
    rng = random.Random(6)
    host = lambda: ".".join(rng.choice(("a", "b", "ab", "c-d")) for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 5)))
    rules = list({(h, p): (h, p, rng.choice(("allow", "block"))) for h, p in ((host(), path()) for _ in range(60))}.values())
    rows = [(i, f"http://{host()}{path()}") for i in range(400)]
    got = url_rules.judge(frame(rows, "page_id long, url string"), frame(rules, "host string, path string, verdict string"), default="none")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *judged(u, rules, "none")) for i, u in rows), key=repr)


def test_url_rules_of_nothing(frame):
    assert url_rules.judge(frame([], "page_id long, url string"), frame(RULES, "host string, path string, verdict string")).collect() == []


def nearest(rows, k, every):
    good = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    good = list({(i, tuple(v)) for i, v in good})
    out = []
    for q, x in good:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in good if i != q)
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("large", [1.0, 1e6])
def test_top_k(frame, monkeypatch, large):
    """Copies, ties, repeated rows, unusable vectors; shards, leaves and blocks small enough to need several."""
    for name, n in (("SAMPLE", 64), ("REGIONS", 4), ("SHARD_ROWS", 40), ("LEAF_ROWS", 8), ("BLOCK", 8)):
        monkeypatch.setattr(kd_search, name, n)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(3) * (large if i % 7 == 0 else 1)).tolist()) for i in range(200)]
    rows += [(i, [0.5, 0.25, -1.0]) for i in range(200, 300)]  # copies: more than a shard
    rows += [rows[50], (None, [1.0, 1.0, 1.0]), (301, None), (350, [1.0, None, 1.0]), (400, [float("nan"), 1.0, 1.0]), (450, [float("inf"), 0.0, 0.0]), (500, [1.0, 2.0]), (501, [])]
    got = kd_search.top_k(frame(rows, "vec_id long, embedding array<double>"), k=5, every=10)
    assert sorted(map(tuple, got.collect())) == nearest(rows, 5, 10)


def test_top_k_of_little(frame):
    schema = "vec_id long, embedding array<double>"
    assert kd_search.top_k(frame([], schema)).collect() == []
    assert kd_search.top_k(frame([(0, [1.0])], schema)).collect() == []
    assert sorted(map(tuple, kd_search.top_k(frame([(0, [1.0]), (50, [-0.5]), (3, [0.001])], schema)).collect())) == [(0, 1, 3, 0), (0, 2, 50, -32768), (50, 1, 3, 0), (50, 2, 0, -32768)]


def test_kd_tree_prunes():
    rng = np.random.default_rng(3)
    rows = np.concatenate([rng.integers(0, 10, (200, 2)), rng.integers(900, 1000, (200, 2))]).astype(float)
    tree = kd_search.Tree.build(np.arange(400), rows, 8)
    seen = []
    tree.bound, bound = lambda node, q: seen.append(node) or bound(node, q), tree.bound
    ids, scores = tree.search(-1, np.array([1.0, 1.0]), 3, (kd_search.NO_SCORE, kd_search.NO_SCORE))
    assert scores.tolist() == sorted(rows.sum(axis=1))[::-1][:3] and len(seen) < len(tree.low) / 2 and (rows[:, 0].size, len(ids)) == (400, 3)


TURNS = "conv_id long, turn long, role string, text string"
A, B = ("user", "hi"), ("assistant", "hé")


def said(conv, *messages):
    return [(conv, t, *m) for t, m in enumerate(messages)]


def written(*messages):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in messages)


def test_preference_pairs(frame):
    turns = said(0, A, B, A, B) + said(1, A, B, ("user", "no"), ("assistant", "why")) + said(2, A, B) + said(3, A, B) + said(4, A)
    turns += [(6, 0, None, None), (6, 0, "assistant", "a"), (6, 0, "assistant", "a"), (7, 0, "", ""), (7, None, "system", "s")] + said(9, B)
    pairs = [(0, 0, 1), (1, 2, 3), (2, 4, 5), (3, 6, 7), (4, 8, 9), (5, None, 10)]
    got = {r.pair_id: r for r in chat_pairs.format_pairs(frame(turns, TURNS), frame(pairs, "pair_id long, chosen_id long, rejected_id long")).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    assert (got[0].prompt, got[0].chosen, got[0].rejected, got[0].prefix_turns) == (written(A, B), written(A, B), written(("user", "no"), ("assistant", "why")), 2)
    assert [tuple(x) for x in got[0].chosen_mask] == [(17, False), (12, False), (1, False), (22, False), (12, True), (1, False)]
    assert (got[1].prompt, got[1].chosen, got[1].rejected, got[1].chosen_mask) == (written(A, B), "", "", [])
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("", written(A), "")
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == ("", written(("", ""), ("assistant", "a"), ("assistant", "a")), written(("system", "s"), ("", "")))
    assert (got[4].chosen, got[4].rejected) == ("", written(B))
    for r in got.values():
        assert sum(x.length for x in r.chosen_mask) == len(r.chosen) and sum(x.length for x in r.rejected_mask) == len(r.rejected)


def test_long_conversations_come_in_pieces(frame):
    turns = said(0, *[A, B] * 10) + said(1, *[A, B] * 4, B, A)
    got = sorted(chat_pairs.format_pairs(frame(turns, TURNS), frame([(0, 0, 1)], "pair_id long, chosen_id long, rejected_id long"), piece_turns=6).collect())
    assert [r.piece for r in got] == [0, 1, 2, 3]
    assert "".join(r.prompt for r in got) == written(*[A, B] * 4) and "".join(r.chosen for r in got) == written(*[A, B] * 6) and "".join(r.rejected for r in got) == written(B, A)


def test_preference_pairs_of_nothing(frame):
    assert chat_pairs.format_pairs(frame([], TURNS), frame([(0, 0, 1)], "pair_id long, chosen_id long, rejected_id long")).collect() == []


def preferred(turns):
    """Chosen and rejected turns of every conversation, one conversation after the other."""
    of = {}
    for c, t, role, text in turns:
        if c is not None:
            of.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    last = {c: max(((t, text) for t, role, text in rows if role == "assistant"), default=None) for c, rows in of.items()}
    out = []
    for c, rows in of.items():
        cut = last[c][0] if last[c] else max(rows)[0] + 1
        other = last.get(c + 1)
        out += [(c, 0, *x) for x in rows] + [(c, 1, *x) for x in rows if x[0] < cut] + ([(c, 1, cut, "assistant", other[1])] if other else [])
    return out


def test_preferences_replace_the_last_reply(frame):
    turns = said(0, A, B, A, B) + said(1, A, ("assistant", "other"), A) + said(2, A) + said(3, A, B) + said(5) + said(7, A, B)
    turns += [(8, None, None, None), (9, 0, "assistant", "x"), (9, 0, "assistant", "y"), (9, None, "system", "s"), (None, 0, "user", "u"), (10, 0, "assistant", None)]
    wide = frame([(*r, "e") for r in turns], TURNS + ", extra string").withColumnRenamed("extra", "side")
    both, pairs = queries.preferences(wide)
    assert sorted((r.conv_id.conv_id, r.conv_id.side, r.turn, r.role, r.text) for r in both.collect()) == sorted(preferred(turns))
    got = {r.pair_id: r for r in chat_pairs.format_pairs(both, pairs).collect()}
    assert set(got) == {c for c, *_ in turns if c is not None}
    assert (got[0].prompt, got[0].chosen, got[0].rejected, got[0].prefix_turns) == (written(A, B, A), written(B), written(("assistant", "other")), 3)
    # The next one has no reply; no reply of its own; no next one.
    assert (got[1].prompt, got[1].chosen, got[1].rejected) == (written(A), written(("assistant", "other"), A), "")
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == (written(A), "", written(B))
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == (written(A), written(B), "")
    assert all(r.prefix_turns > 0 for c, r in got.items() if c in (0, 1, 2, 3, 7))


def test_preferences_of_nothing(frame):
    assert chat_pairs.format_pairs(*queries.preferences(frame([], TURNS))).collect() == []
