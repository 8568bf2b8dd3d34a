"""Packing token pieces into sequences by bin completion on the histogram of lengths.

A sequence has a few thousand tokens, so however many pieces there are, they have only that many lengths.  The driver gets the count
of every length and nothing else, and plans on counts: best-fit decreasing gives the first solution; bin completion then takes the
largest length left, takes a few undominated fillings of the room beside it and applies one as often as the counts allow, going
back within a budget of nodes as long as fewer sequences are possible; with nodes left over, it applies them fewer times too.
Branches that waste more than a better solution may are pruned.  The plan says which ranks within a length go to which sequences; Spark numbers the pieces and looks their places up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edictal.llm.common import trimmed
from edictal.llm.word_table import REMEMBERED, WordEncoder, encoder, text_steps
from edictal.session import stage

CAPACITY = 2048
# Bounds of the search; beyond them the best solution so far stands, which is complete at any time.
FILLINGS, FILLING_NODES, NODES = 3, 300, 4_000

Pattern = dict[int, int]
Plan = list[tuple[int, Pattern]]


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing on counts: bins of equal content are kept together."""
    rooms: list[int] = []
    bins: dict[int, list[tuple[int, Pattern]]] = {}

    def put(room: int, times: int, content: Pattern) -> None:
        if times:
            if room not in bins:
                bins[room] = []
                insort(rooms, room)
            bins[room].append((times, content))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                times, content = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, content = capacity, {}
                times = -(-left // (capacity // length))
            each = room // length
            whole = min(times, left // each)
            put(room - each * length, whole, {**content, length: each})
            left -= whole * each
            if whole < times:
                rest = min(left, each)
                if rest:
                    put(room - rest * length, 1, {**content, length: rest})
                    left, whole = left - rest, whole + 1
                put(room, times - whole, content)
    return [x for group in bins.values() for x in group if x[1]]


def fillings(counts: np.ndarray, room: int, waste: int) -> list[tuple[int, Pattern]]:
    """(waste, filling) of undominated fillings of ``room`` that waste no more than ``waste``, the least waste and fewest pieces first.

    A filling is dominated when a free length could stand for one or two of its pieces without needing more than the room wasted.
    """
    free = np.flatnonzero(counts[: room + 1])
    if not len(free):
        return [(room, {})] if room <= waste else []
    lengths = free[::-1].tolist()
    present = np.concatenate([[0], np.cumsum(counts[: room + 1] > 0)])
    found: list[tuple[int, Pattern]] = []
    nodes = 0

    def dominated(items: list[int], spare: int) -> bool:
        used: Pattern = {}
        for x in items:
            used[x] = used.get(x, 0) + 1

        def has(low: int, high: int) -> bool:
            high = min(high, room)
            if low > high:
                return False
            inside = int(present[high + 1] - present[low])
            return inside > sum(1 for x, n in used.items() if low <= x <= high and counts[x] <= n)

        if spare and any(has(x + 1, x + spare) for x in used):
            return True
        return any(has(a + b, a + b + spare) for i, a in enumerate(items) for b in items[i + 1 : i + 4])

    stack: list[tuple[int, int, list[int]]] = [(room, 0, [])]
    while stack and nodes < FILLING_NODES and len(found) < FILLINGS:
        left, at, items = stack.pop()
        nodes += 1
        # Skip lengths that no longer fit.
        while at < len(lengths) and lengths[at] > left:
            at += 1
        if left == 0 or at == len(lengths):
            if left <= waste and not dominated(items, left):
                found.append((left, {x: items.count(x) for x in set(items)}))
            continue
        length = lengths[at]
        most = min(left // length, int(counts[length]))
        # The branch with most of the larger length is searched first; exact fits before all.
        exact = left <= room and left < len(counts) and counts[left] > 0 and left < length
        stack.append((left, at + 1, items))
        for n in range(1, most + 1):
            stack.append((left - n * length, at + 1, items + [length] * n))
        if exact:
            stack.append((0, len(lengths), [*items, left]))
    found.sort(key=lambda f: (f[0], sum(f[1].values())))
    return found


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Plan:
    """(times, {length: pieces}) for all counted pieces, in as few sequences as the search finds."""
    counts = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a length is outside 1 .. capacity")
    if not counts:
        return []
    whole: Plan = [(counts.pop(capacity), {capacity: 1})] if capacity in counts else []
    total = sum(n * c for n, c in counts.items())
    least = -(-total // capacity)
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(t for t, _ in best)
    spent = 0
    # A search that ends before its nodes do is repeated with fewer repeats of every filling allowed.
    for fewer in (False, True):
        left = np.zeros(capacity + 1, np.int64)
        for n, c in counts.items():
            left[n] = c
        # Depth first: each step fills bins around the largest length; ``ways`` holds the fillings of a step not tried yet.
        steps: list[tuple[int, Pattern]] = []
        ways: list[list[tuple[int, Pattern, int]]] = []
        wasted, used_bins, descend = 0, 0, True
        while fewest > least and spent < nodes:
            allowed = (fewest - 1) * capacity - total - wasted
            if descend:
                spent += 1
                some = np.flatnonzero(left)
                if not len(some):
                    best, fewest, descend = list(steps), used_bins, False
                    # A level without ways, so that the last step is taken back before its other fillings are tried.
                    ways.append([])
                    continue
                largest = int(some[-1])
                left[largest] -= 1
                found = fillings(left, capacity - largest, allowed)
                left[largest] += 1
                ways.append([(w, {**f, largest: f.get(largest, 0) + 1}, total) for w, f in reversed(found)])
            if ways and ways[-1]:
                waste, filling, most = ways[-1].pop()
                if waste > allowed:
                    descend = False
                    continue
                times = min(most, *(int(left[n]) // k for n, k in filling.items()))
                if waste:
                    times = min(times, max(1, allowed // waste))
                for n, k in filling.items():
                    left[n] -= times * k
                steps.append((times, filling))
                wasted, used_bins, descend = wasted + times * waste, used_bins + times, True
                continue
            if not ways:
                break
            ways.pop()
            descend = False
            if not steps:
                break
            times, filling = steps.pop()
            for n, k in filling.items():
                left[n] += times * k
            waste = capacity - sum(n * k for n, k in filling.items())
            wasted -= times * waste
            used_bins -= times
            if fewer and times > 1:
                # After the other fillings of the step.
                ways[-1].insert(0, (waste, filling, times - 1))
    return whole + best


class Places:
    """Where the pieces of a plan go, by length and rank: runs of ranks that go to following sequences."""

    def __init__(self, made: Plan):
        rows, ranks, sequence = [], {}, 0
        for times, content in made:
            offset = 0
            for length in sorted(content, reverse=True):
                k, rank = content[length], ranks.get(length, 0)
                rows.append((length, rank, sequence, k, offset))
                ranks[length] = rank + times * k
                offset += k * length
            sequence += times
        rows.sort()
        self.sequences = sequence
        self.length, self.rank, self.first, self.each, self.offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5
        self.key = (self.length << 46) + self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        run = np.searchsorted(self.key, (length << 46) + rank, "right") - 1
        ahead = rank - self.rank[run]
        return self.first[run] + ahead // self.each[run], self.offset[run] + ahead % self.each[run] * length


def cut(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, remembered: int = REMEMBERED) -> DataFrame:
    """(id, piece, start, length, ids, part, nth) of every piece: the ids of a document, ``end_id`` after them, cut where they do not fit.

    ids are little-endian unsigned 32-bit integers.  Null counts as the empty text, which is one piece of ``end_id``.  nth numbers the
    pieces of a length within a task, part is the task: Spark then needs no shuffle of the pieces to rank them.  ``remembered`` bounds the
    words a worker remembers, see ``WordEncoder``; the ids do not depend on it.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(f"{path} {remembered}", lambda: WordEncoder(path, remembered=remembered)), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i, _, texts in text_steps(batch.column("text"), 1 << 20):
                row, piece, start, lengths, nth, ids = [], [], [], [], [], []
                for r, body in enumerate(enc.encode(texts), i):
                    body += end
                    n = len(body) // 4
                    for k, at in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - at)
                        row.append(r), piece.append(k), start.append(at), lengths.append(length), nth.append(seen[length])
                        ids.append(body[4 * at : 4 * (at + length)])
                        seen[length] += 1
                columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(np.full(len(row), part, np.int32)), pa.array(np.array(nth, np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids", "part", "nth"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary, part int, nth long")


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows that have length, part and nth; every other column is carried along.

    Sequences are numbered from 0 and have no gaps.  No rows give no rows.
    """
    pieces = stage(pieces)
    counts = stage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    places = pieces.sparkSession.sparkContext.broadcast(Places(plan(total, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("ahead")).drop("ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.find(batch.column("length").to_numpy(), batch.column("nth").to_numpy())
            kept = [n for n in batch.schema.names if n not in ("part", "nth")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = [f for f in ranked.schema if f.name not in ("part", "nth")]
    # Workers drop the words that ``cut`` remembered.
    return ranked.mapInArrow(trimmed(run), T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack(docs: DataFrame, path: str, **options) -> DataFrame:
    """The pieces of all documents with their ids and places: id, piece, start, ids, length, sequence_id, offset."""
    return place(cut(docs, path, **options), options.get("capacity", CAPACITY))
