"""Adaptive quality rules beside brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from edictal.llm import adaptive_rules as A

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    repeated = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)], len(lines)


def floored(v, leading=A.LEADING):
    dropped = max(v.bit_length() - leading, 0)
    return v >> dropped << dropped


def verdicts(rows, enough, reach=A.REACH):
    """(id, counts, base_failed, failed) of every row, by plain lists instead of sketches."""
    told = []
    for i, text, lang, source in rows:
        (n, chars, symbols, dups, repeats), lines = counts(text)
        base = n < 50 or 100 * repeats > 50 * n
        told.append((i, lang, source, [n, chars, symbols, dups, repeats], base, [1000 * chars // max(n, 1), 10000 * symbols // max(chars, 1), 10000 * dups // max(lines, 1), 10000 * repeats // max(n, 1)]))

    def limit(kind, rule):
        values = sorted(floored(t[5][rule]) for t in told if not t[4] and kind(t))
        low, high = values[(len(values) + 3) // 4 - 1], values[(3 * len(values) + 3) // 4 - 1]
        _, least, both = A.RULES[rule]
        return (low - reach * max(high - low, least) if both else -1), high + reach * max(high - low, least)

    out = []
    for i, lang, source, c, base, m in told:
        failed = "base" if base else None
        kinds = [lambda t: t[1:3] == (lang, source), lambda t: t[1] == lang, lambda t: True]
        kind = next((k for k in kinds if sum(k(t) and not t[4] for t in told) >= enough), kinds[2])
        for rule, (name, _, _) in enumerate(A.RULES):
            if failed is None:
                low, high = limit(kind, rule)
                failed = None if low <= m[rule] <= high else name
        out.append((i, *c, base, failed is None, failed))
    return out


def test_counts(frame):
    texts = [None, "", " \n\t\x0b", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "x\n x\nx\n\n \nx \r\nx", "é b # *|", "a b c d a b c e a b", "äöü 日本 🙂 <>$%&", "to be or not to be or not"]
    rng = random.Random(4)
    texts += [" ".join(rng.choices("abcd", k=rng.randint(0, 60))) for _ in range(150)] + ["\n".join(rng.choices(["a b", "b a", "", " "], k=9)) for _ in range(20)]
    texts.append(" ".join(str(i % 70001) for i in range(200_000)))  # over a megabyte
    got = A.measured(frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("s")}), [F.col("doc_id")]).select("__keep.doc_id", *COUNTS).collect()
    assert {r.doc_id: list(r)[1:] for r in got} == {i: counts(t)[0] for i, t in enumerate(texts)}


@pytest.mark.parametrize("enough", [1, 12, 10_000])
def test_limits_by_language_and_source(frame, enough):
    """Sources with limits of their own, others that take their language's or those of all; nulls are kinds of their own."""
    rng = random.Random(enough)
    rows = []
    for i in range(160):
        lang, source = rng.choice([("a", "s"), ("a", "t"), ("b", "s"), (None, "s"), ("c", None)])
        longer = 3 if lang == "b" else 1
        w = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6) * longer)) + ("###" if rng.random() < 0.03 else "") for _ in range(rng.randint(40, 90))]
        if i % 20 == 7:
            w = [x * 5 for x in w]
        rows.append((i // 2 if i % 9 == 0 else i, " ".join(w) if i % 11 else "\n".join(w[:3] + w), lang, source))
    rows += [(None, None, "a", "s"), (None, "", None, None)]
    got = A.judge(frame(rows, "doc_id long, text string, lang string, source string"), [F.col("doc_id")], enough=enough).collect()
    want = verdicts(rows, enough)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert {w[-1] for w in want} > {None, "base"}


def test_sketches_merge(frame):
    """The sketch of a language is the sum of those of its sources, however the rows are dealt."""
    rows = [(i, " ".join(str(j * i % 97) for j in range(60 + i)), "l", f"s{i % 3}") for i in range(40)]
    docs = frame(rows, "doc_id long, text string, lang string, source string")
    told = [sorted(map(repr, A.sketches(A.measured(d, [F.col("doc_id")])).collect())) for d in (docs.coalesce(1), docs.repartition(5))]
    assert told[0] == told[1]


def test_rules_of_nothing(frame):
    empty = frame([], "doc_id long, text string, lang string, source string")
    assert A.judge(empty, [F.col("doc_id")]).collect() == []
    only = A.judge(frame([(1, None, None, None), (1, "a b", "l", "s")], "doc_id long, text string, lang string, source string"), [F.col("doc_id")]).collect()
    assert [(r.kept, r.failed, r.base_failed) for r in only] == [(False, "base", True)] * 2


def test_names_of_columns_do_not_clash(frame):
    rows = [(i, "word " * 3 + " ".join(map(str, range(i, i + 60))), "l", "s", 5) for i in range(5)]
    got = A.judge(frame(rows, "doc_id long, text string, lang string, source string, limits int"), [F.col("doc_id"), F.col("limits"), F.col("row"), F.col("n").alias("l")])
    assert got.columns[:4] == ["doc_id", "limits", "row", "l"] and got.filter("kept and limits = 5 and l = 'x'").count() == 5
