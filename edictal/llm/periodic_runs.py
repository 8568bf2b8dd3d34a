"""Periodic runs of words: stretches that repeat a block of words at least three times.

The words of a text become numbers.  A suffix tree of the numbers (Ukkonen's construction) and one of their reversal answer how far two
places agree, to the right and to the left, in constant time: a walk of each tree lists the depths it passes, and the depth of the lowest
common ancestor of two leaves is the least depth between them, which a table of minima over powers of two gives.

A run has a Lyndon root: by the runs theorem, the longest Lyndon word from some place of it, for the words' order or its reversal, is one
period long.  The longest Lyndon word from a place ends where the next smaller suffix begins, and the walk has the suffixes in order.  So
every place offers one candidate for either order; extended both ways as far as words one period apart agree, it is a run or too short.

Only stretches that can hold a run get a tree: every window of ``WINDOW`` words of a run occurs in it twice, so a place covered by no
window that occurs twice is in no run, and neither is a stretch shorter than the least run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from edictal.llm.common import BASE, fill, mix, trimmed

# Fixed values of the contract: the least length of a run in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
# A run of L words and period q repeats each of its windows of up to L - 2 q + 1 words; with the values above that is 9 or more.
WINDOW = LEAST_WORDS - 2 * LEAST_WORDS // LEAST_PERIODS


class SuffixTree:
    """Depths and parents of the nodes, and the sorted children of each; the sequence is closed by -1, which is less than every word.

    Nodes are numbered as they are made.  A node is the end of an edge whose words stand at ``start`` .. ``end`` of the sequence.
    """

    def __init__(self, words: list[int]):
        s = [*words, -1]
        n = len(s)
        start, end, link = [0], [0], [0]
        # The child of a node by the first word of its edge, all nodes in one table.
        width = max(s) + 2
        child: dict[int, int] = {}
        node = edge = length = rest = 0
        for i in range(n):
            made = -1
            rest += 1
            c = s[i]
            while rest:
                if not length:
                    edge = i
                key = node * width + s[edge] + 1
                down = child.get(key)
                if down is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if made >= 0:
                        link[made] = node
                    made = -1
                else:
                    first = start[down]
                    span = min(end[down], i + 1) - first
                    if length >= span:
                        node, edge, length = down, edge + span, length - span
                        continue
                    if s[first + length] == c:
                        length += 1
                        if made >= 0:
                            link[made] = node
                        break
                    split = len(start)
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    child[key] = split
                    child[split * width + c + 1] = split + 1
                    start[down] = first + length
                    child[split * width + s[first + length] + 1] = down
                    if made >= 0:
                        link[made] = split
                    made = split
                rest -= 1
                if not node and length:
                    length -= 1
                    edge = i - rest + 1
                elif node:
                    node = link[node]
        self.n, self.width = n, width
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        self.spans = np.array(end) - np.array(start)
        order = np.argsort(keys)
        # Children of a node stand together, sorted by their first word.
        self.parent_of, self.children, self.first_word = keys[order] // width, below[order], keys[order] % width

    def walk(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the suffixes in their order, and for neighbours of it the depth of their lowest common ancestor.

        The Euler tour, of which only the visits between two leaves that follow each other are kept: the least depth between two visits.
        """
        edges = np.searchsorted(self.parent_of, np.arange(len(self.spans) + 1)).tolist()
        children, spans = self.children.tolist(), self.spans.tolist()
        suffixes, between = [], []
        stack, low = [(0, 0)], 0
        while stack:
            node, depth = stack.pop()
            if node < 0:  # back at an inner node, between two of its children
                low = min(low, depth)
                continue
            a, b = edges[node], edges[node + 1]
            if a == b:
                suffixes.append(self.n - depth)
                between.append(low)
                low = depth
                continue
            for k in range(b - 1, a - 1, -1):
                down = children[k]
                stack.append((down, depth + spans[down]))
                if k > a:
                    stack.append((-1, depth))
        return np.array(suffixes), np.array(between)

    def backward(self) -> np.ndarray:
        """Ranks of the suffixes where the order of words is reversed, the end being less than every word as before."""
        edges = np.searchsorted(self.parent_of, np.arange(len(self.spans) + 1)).tolist()
        children, spans, first = self.children.tolist(), self.spans.tolist(), self.first_word.tolist()
        suffixes, stack = [], [(0, 0)]
        while stack:
            node, depth = stack.pop()
            a, b = edges[node], edges[node + 1]
            if a == b:
                suffixes.append(self.n - depth)
                continue
            closed = a < b and not first[a]
            for k in range(a + closed, b):
                stack.append((children[k], depth + spans[children[k]]))
            if closed:
                stack.append((children[a], depth + spans[children[a]]))
        return ranks(np.array(suffixes))


def ranks(suffixes: np.ndarray) -> np.ndarray:
    out = np.empty(len(suffixes), np.int64)
    out[suffixes] = np.arange(len(suffixes))
    return out


class Agreement:
    """How many words agree from two places on, for arrays of places."""

    def __init__(self, tree: SuffixTree):
        suffixes, between = tree.walk()
        self.rank, self.n = ranks(suffixes), tree.n - 1
        self.minima = [between]
        while 2 << len(self.minima) - 1 <= len(between):
            last, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places i != j from 0 to n."""
        a, b = self.rank[i], self.rank[j]
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((b - a + 1).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][a[at]], self.minima[k][b[at] + 1 - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every place the next one whose suffix is smaller; the last is the empty suffix, smaller than all."""
    values, out, stack = rank.tolist(), [0] * len(rank), []
    for i, r in enumerate(values):
        while stack and values[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return np.array(out[:-1], np.int64)


def runs_of(words: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows of start, length and smallest period of all runs of at least ``least_words`` words and ``least_periods`` (2 or more) periods."""
    n = len(words)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    tree = SuffixTree(words)
    right, left = Agreement(tree), Agreement(SuffixTree(words[::-1]))
    place = np.arange(n)
    i = np.concatenate([place, place])
    j = np.concatenate([next_smaller(right.rank), next_smaller(tree.backward())])
    period = j - i
    fits = least_periods * period <= n
    i, j, period = i[fits], j[fits], period[fits]
    # To the left, places are counted from the end: the word before place i is place n - i of the reversal.
    start = i - left(n - i, n - j)
    length = j + right(i, j) - start
    found = np.column_stack([start, length, period])[length >= np.maximum(least_words, least_periods * period)]
    return np.unique(found, axis=0).reshape(-1, 3)


def repeated(words: np.ndarray, window: int) -> np.ndarray:
    """Whether a place lies in a window of words that occurs twice or more; by hashes, so that a few others may pass."""
    n = len(words) - window + 1
    if n < 2:
        return np.zeros(len(words), bool)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(BASE) + words[k : k + n].astype(np.uint64) + np.uint64(1)
    h = mix(h)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(n + 1, np.int64)
    twice[order[1:][same]] = 1
    twice[order[:-1][same]] = 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + window, -1)
    return np.cumsum(covered[:-1]) > 0


def stretches(words: np.ndarray, least_words: int, window: int) -> Iterator[tuple[int, int]]:
    """Stretches outside which there is no run; each is narrowed until all its places are covered by windows it repeats itself."""
    todo = [(0, len(words))]
    while todo:
        a, b = todo.pop()
        held = repeated(words[a:b], window)
        if held.all() and b - a >= least_words:
            yield a, b
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], held.view(np.int8), [0]])))
        todo += [(a + i, a + j) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True) if j - i >= least_words]


def text_runs(words: list[bytes]) -> np.ndarray:
    """Runs of a text, sorted by start and period."""
    if len(words) < LEAST_WORDS:
        return np.zeros((0, 3), np.int64)
    number: dict[bytes, int] = {}
    numbers = np.array([number.setdefault(w, len(number)) for w in words])
    found = [runs_of(np.unique(numbers[a:b], return_inverse=True)[1].tolist()) + [a, 0, 0] for a, b in stretches(numbers, LEAST_WORDS, WINDOW)]
    out = np.concatenate([np.zeros((0, 3), np.int64), *found])
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """Words that no run holds behind its first period."""
    if not len(runs):
        return words
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
    np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()]


RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def find_runs(docs: DataFrame, columns: list[Column], text_col: str = "text") -> DataFrame:
    """``columns`` of every row with n_words, runs (start, length, period; sorted by start, then period) and collapsed, the text of the
    words that remain where of every run only the first period is kept, joined by one space.

    Words are told apart by all their bytes.  Null and empty texts have no words and no runs.  Every row is judged by itself, so repeated
    rows give equal results and an empty table none.  Of a text, only the stretches described above are held as trees, one at a time.
    Other columns are not read.
    """
    rows = docs.select(F.struct(*columns).alias("__keep"), F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many, found, texts = [], [], []
            for text in fill(batch.column("__text")).cast(pa.large_binary()):
                words = text.as_py().split()  # at the six bytes of the contract
                runs = text_runs(words)
                many.append(len(words))
                found.append(runs)
                texts.append(b" ".join(collapsed(words, runs)))
            ends = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("__keep"), pa.array(many, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), struct), pa.array(texts, pa.binary()).cast(pa.string())],
                names=["__keep", "n_words", "runs", "collapsed"],
            )

    schema = T.StructType([rows.schema["__keep"], T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(trimmed(run), schema).select("__keep.*", "n_words", "runs", "collapsed")
