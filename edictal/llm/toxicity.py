"""Toxicity of whole texts by a recurrent network over words and their characters.

A word enters as an embedding, the embedding of its most telling character n-gram, and how much more often each of the two stood in toxic
texts than in others; a text is read in overlapping windows, all of them, and scores as its most toxic window.  Words and n-grams are
looked up by hash in tables of what the training rows showed often enough; what they did not show enters as zeros.

The network is trained on a bounded sample of labelled rows: each round finds the most toxic window of every text as the network sees it
and teaches the text's label on it.  In training, a text's words are rated by texts other than itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictal.llm.common import LOWER, fill, flat, in_one_task, span_hashes, steps, trimmed, words_per_value
from edictal.llm.text_model import F32, Adam, Network, sigmoid

# Bounds of the training sample: labelled rows, and bytes of a text that may be among them.
TRAIN_ROWS, TRAIN_BYTES = 4000, 1 << 17
WINDOW, STRIDE = 24, 16
HIDDEN, EMBEDDING, GRAMS, SEEN = 6, 4, (4, 5), 4
ROUNDS, STEPS, BATCH, RATE = 3, 125, 256, 0.01
THRESHOLD = 0.7
STEP, WINDOWS = 1 << 21, 4096
# A word is a run of letters: A-Z, a-z and the bytes of all other characters.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Lookup:
    """Places of 64-bit hashes in a fixed list, by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.slots, self.keys = np.full(self.size, -1, np.int32), np.zeros(self.size, np.uint64)
        left, slot = np.arange(len(keys)), (keys & np.uint64(self.size - 1)).astype(np.int64)
        while len(left):
            free = self.slots[slot[left]] < 0
            self.slots[slot[left[free]]] = left[free]
            self.keys[slot[left[free]]] = keys[left[free]]
            left = left[self.slots[slot[left]] != left]
            slot[left] = (slot[left] + 1) & (self.size - 1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int32)
        slot = (hashes & np.uint64(self.size - 1)).astype(np.int64)
        at = self.slots[slot]
        hit = (at >= 0) & (self.keys[slot] == hashes)
        out[hit] = at[hit]
        left = np.flatnonzero((at >= 0) & ~hit)
        while len(left):
            slot[left] = (slot[left] + 1) & (self.size - 1)
            at = self.slots[slot[left]]
            hit = (at >= 0) & (self.keys[slot[left]] == hashes[left])
            out[left[hit]] = at[hit]
            left = left[(at >= 0) & ~hit]
        return out


@dataclass
class Words:
    """Words of some texts: ``at`` numbers the distinct words in order of the text, ``first`` is the first word of every text."""

    at: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    grams: np.ndarray
    gram_word: np.ndarray


def read_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    data = LOWER[data]
    letter = LETTER[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    first = words_per_value(starts, offsets)
    hashes, one, at = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True) if len(starts) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # The distinct words once more, each between a mark of its beginning and one of its end, for their n-grams.
    starts, lengths = starts[one], (ends - starts)[one]
    edge = np.concatenate([[0], np.cumsum(lengths + 2)])
    marked = np.full(int(edge[-1]), 1, np.uint8)
    word = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    marked[edge[word] + 1 + place] = data[starts[word] + place]
    grams, owners = [], []
    for n in GRAMS:
        many = np.maximum(lengths + 3 - n, 0)
        owner = np.repeat(np.arange(len(starts)), many)
        begin = edge[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        grams.append(span_hashes(marked, begin, begin + n) if len(begin) else np.zeros(0, np.uint64))
        owners.append(owner)
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return Words(at, first, hashes, grams[order], owners[order])


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of every window; the windows of a text overlap and cover all its words."""
    counts = np.diff(first)
    many = np.where(counts > 0, np.maximum(-(-(counts - (WINDOW - STRIDE)) // STRIDE), 1), 0)
    text = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    start = first[:-1][text] + nth * STRIDE
    return text, start, np.minimum(first[1:][text] - start, WINDOW)


def log_odds(toxic: np.ndarray, other: np.ndarray, rate: float) -> np.ndarray:
    """How much likelier a text is toxic that holds the word, with the weight of four texts on no difference."""
    return (np.log((toxic + 4 * rate) / (other + 4 * (1 - rate))) - np.log(rate / (1 - rate))).astype(F32)


class Model:
    """Tables of words and n-grams, their embeddings and the network."""

    def __init__(self, words: np.ndarray, word_odds: np.ndarray, grams: np.ndarray, gram_odds: np.ndarray):
        rng = np.random.default_rng(11)
        self.words, self.grams = Lookup(words), Lookup(grams)
        # The last row stands for what is not in a table.
        self.word_odds, self.gram_odds = np.append(word_odds, F32(0)), np.append(gram_odds, F32(0))
        self.tables = {"word": (0.1 * rng.standard_normal((len(words) + 1, EMBEDDING))).astype(F32), "gram": (0.1 * rng.standard_normal((len(grams) + 1, EMBEDDING))).astype(F32)}
        for t in self.tables.values():
            t[-1] = 0
        self.net = Network(2 + 2 * EMBEDDING, HIDDEN)

    def places(self, words: Words, word_odds: np.ndarray, gram_odds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the distinct words in both tables, and their odds; of the n-grams the most telling one counts."""
        word = self.words.find(words.hashes)
        gram = self.grams.find(words.grams)
        odds = gram_odds[gram]
        best, top = np.full(len(word), -1, np.int64), np.zeros(len(word), F32)
        edges = np.searchsorted(words.gram_word, np.arange(len(word) + 1))
        full = edges[1:] > edges[:-1]
        if full.any():
            strength = np.abs(odds)
            most = np.maximum.reduceat(strength, edges[:-1][full])
            is_top = strength == np.repeat(most, np.diff(edges)[full])
            where = np.flatnonzero(is_top)[::-1]  # the first of several is written last
            best[words.gram_word[where]] = gram[where]
            top[words.gram_word[where]] = odds[where]
        return word, best, np.column_stack([word_odds[word], top])

    def vectors(self, word: np.ndarray, gram: np.ndarray, odds: np.ndarray) -> np.ndarray:
        return np.concatenate([odds, self.tables["word"][word], self.tables["gram"][gram]], axis=1)

    def logits(self, at: np.ndarray, gates: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """One logit a window; ``gates`` by distinct word, ``at`` by word of the text."""
        out = np.empty(len(start), F32)
        reach = np.arange(WINDOW)[:, None]
        for i in range(0, len(start), WINDOWS):
            s, n = start[i : i + WINDOWS], length[i : i + WINDOWS]
            mask = reach < n
            index = at[np.minimum(s + reach, len(at) - 1)]
            out[i : i + WINDOWS] = self.net.forward(gates[index], mask)
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Score of every text, its most toxic window's; of a text without words the network's own bias."""
        words = read_words(data, offsets)
        out = np.full(len(offsets) - 1, self.net.params["bias"][0], F32)
        text, start, length = windows_of(words.first)
        if len(text):
            gates = self.net.project(self.vectors(*self.places(words, self.word_odds, self.gram_odds)))
            found = self.logits(words.at, gates, start, length)
            edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[edges]] = np.maximum.reduceat(found, edges)
        return sigmoid(out)


@dataclass
class Constant:
    """Where the labels teach nothing, the rate of toxic rows among them."""

    rate: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return np.full(len(offsets) - 1, self.rate, F32)


def gathered(starts: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Indices of ``many`` places from each of ``starts`` on, one after the other."""
    return np.repeat(starts, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)


def read_texts(texts: list[str]) -> Words:
    """Words of many texts, read in steps and numbered together."""
    data, offsets = flat(pa.array(texts, pa.large_string()))
    parts = [read_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in list(steps(offsets)) or [(0, 0)]]
    base = np.cumsum([0, *(len(p.hashes) for p in parts)])
    hashes, one, number = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
    at = np.concatenate([number[b + p.at] for b, p in zip(base, parts, strict=False)])
    counts = np.concatenate([np.diff(p.first) for p in parts])
    owners = np.concatenate([b + p.gram_word for b, p in zip(base, parts, strict=False)])
    edges = np.searchsorted(owners, np.arange(base[-1] + 1))
    many = np.diff(edges)[one]
    grams = np.concatenate([p.grams for p in parts])[gathered(edges[:-1][one], many)]
    return Words(at, np.concatenate([[0], np.cumsum(counts)]), hashes, grams, np.repeat(np.arange(len(hashes)), many))


def document_counts(words: Words) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of words and of n-grams: (hashes, in how many texts each stands); some texts at a time."""
    grams, of = np.unique(words.grams, return_inverse=True)
    edges = np.searchsorted(words.gram_word, np.arange(len(words.hashes) + 1))
    in_texts, gram_texts = np.zeros(len(words.hashes), np.int64), np.zeros(len(grams), np.int64)
    for i in range(0, len(words.first) - 1, 100):
        first = words.first[i : i + 101]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        pairs = np.unique(text * np.int64(max(len(words.hashes), 1)) + words.at[first[0] : first[-1]])
        word, text = pairs % max(len(words.hashes), 1), pairs // max(len(words.hashes), 1)
        np.add.at(in_texts, word, 1)
        many = np.diff(edges)[word]
        pairs = np.unique(np.repeat(text, many) * np.int64(max(len(grams), 1)) + of[gathered(edges[:-1][word], many)])
        np.add.at(gram_texts, pairs % max(len(grams), 1), 1)
    return (words.hashes, in_texts), (grams, gram_texts)


def aligned(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes that stand in at least SEEN texts, and their counts of every list."""
    keys = np.unique(np.concatenate([k for k, _ in counts]))
    found = [np.zeros(len(keys), np.float64) for _ in counts]
    for c, (k, n) in zip(found, counts, strict=True):
        c[np.searchsorted(keys, k)] = n
    often = sum(found) >= SEEN
    return keys[often], [c[often] for c in found]


def train(texts: list[str], labels: np.ndarray) -> Model | Constant:
    """A model from texts and their labels (1: toxic)."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        return Constant(float((labels.sum() + 1) / (len(labels) + 2)) if len(labels) else 0.0)
    rate = float(labels.mean())
    # Four groups: both labels, each in two halves.  The words of a half are rated by the other one, so that no text votes on its own.
    groups = [(label, half) for label in (0, 1) for half in (0, 1)]
    place = np.zeros(len(labels), np.int64)
    for label in (0, 1):
        place[labels == label] = np.arange(int((labels == label).sum())) % 2
    sides = [read_texts([t for t, y, h in zip(texts, labels, place, strict=True) if (y, h) == g]) for g in groups]
    counts = [document_counts(side) for side in sides]
    words, word_counts = aligned([c[0] for c in counts])
    grams, gram_counts = aligned([c[1] for c in counts])
    model = Model(words, log_odds(word_counts[2] + word_counts[3], word_counts[0] + word_counts[1], rate), grams, log_odds(gram_counts[2] + gram_counts[3], gram_counts[0] + gram_counts[1], rate))
    parts = []
    for (label, half), side in zip(groups, sides, strict=True):
        odds = [np.append(log_odds(c[3 - half], c[1 - half], rate), F32(0)) for c in (word_counts, gram_counts)]
        parts.append((label, side, model.places(side, *odds), windows_of(side.first)))
    rng, reach = np.random.default_rng(5), np.arange(WINDOW)[:, None]
    params = model.net.params | model.tables
    adam = Adam(params, RATE)
    for _ in range(ROUNDS):
        chosen = []
        for k, (_, side, at, (text, start, length)) in enumerate(parts):
            if not len(text):
                continue
            found = model.logits(side.at, model.net.project(model.vectors(*at)), start, length)
            order = np.lexsort((-found, text))
            top = order[np.flatnonzero(np.concatenate([[True], text[order][1:] != text[order][:-1]]))]
            chosen += [(k, w) for w in top.tolist()]
        for step in range(STEPS):
            at = step * BATCH % max(len(chosen), 1)
            if at < BATCH:
                rng.shuffle(chosen)
            batch = chosen[at : at + BATCH]
            if not batch:
                break
            n, group = len(batch), np.array([k for k, _ in batch])
            target = (group >= 2).astype(F32)
            word, gram = np.full((WINDOW, n), -1, np.int64), np.full((WINDOW, n), -1, np.int64)
            odds, mask = np.zeros((WINDOW, n, 2), F32), np.zeros((WINDOW, n), bool)
            for k, (_, side, known, (_, start, length)) in enumerate(parts):
                columns = np.flatnonzero(group == k)
                if not len(columns):
                    continue
                w = np.array([batch[c][1] for c in columns])
                inside = reach < length[w]
                index = side.at[np.minimum(start[w] + reach, len(side.at) - 1)]
                mask[:, columns] = inside
                word[:, columns], gram[:, columns] = known[0][index], known[1][index]
                odds[:, columns] = known[2][index]
            x = model.vectors(word.ravel(), gram.ravel(), odds.reshape(-1, 2))
            logit, kept = model.net.forward(model.net.project(x).reshape(WINDOW, n, -1), mask, keep=True)
            grads, d_gates = model.net.backward((sigmoid(logit) - target) / F32(n), kept)
            d_gates = d_gates.reshape(WINDOW * n, -1)
            grads |= {"wx": x.T @ d_gates, "bx": d_gates.sum(axis=0)}
            d_x = d_gates @ params["wx"].T
            for name, at, columns in (("word", word.ravel(), slice(2, 2 + EMBEDDING)), ("gram", gram.ravel(), slice(2 + EMBEDDING, None))):
                g = np.zeros_like(model.tables[name])
                known = at >= 0
                np.add.at(g, at[known], d_x[known, columns])
                grads[name] = g
            adam.step(grads)
    return model


def held_out(id_col: str | Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 by 3."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Model | Constant:
    """A model from at most ``rows`` labelled rows that are not held out, taken by a hash of the id, of texts up to TRAIN_BYTES.

    Of several labels of an id the largest counts.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    sample = marked.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter(F.octet_length("text") <= TRAIN_BYTES)
    # The sample has at most ``rows`` rows of an id and a label.
    got = texts.join(F.broadcast(sample), "id").select("id", F.least("y", F.lit(1)).alias("y"), "text").orderBy("id", "text").limit(rows)
    return in_one_task(got, lambda t: train(t.column("text").to_pylist(), np.array(t.column("y").to_pylist(), np.int64)))


def score(docs: DataFrame, model: Model | Constant, columns: list[Column], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``columns`` of every row with its score and whether it is toxic (predicted); null and empty texts score as texts without words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*columns, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(fill(batch.column("__text")))
            found = np.zeros(batch.num_rows, np.float64)
            for i, j in steps(offsets, STEP):
                found[i:j] = shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            kept = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[*kept, "score", "predicted"])

    schema = T.StructType([*rows.schema[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return rows.mapInArrow(trimmed(run), schema)
