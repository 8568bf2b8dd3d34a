"""Exact top-k search by inner product, with a KD-tree per shard.

A tree fitted on a bounded sample deals all vectors into regions; a region with many rows is split further by a hash of the id, so
copies of one vector do not fill a shard.  Every shard builds a tree by median splits, with the tight bounding box and smallest id of
each node.  No vector of a box can score more than the sum of the larger products of its sides with the query: nodes are visited by
falling bound until none can reach the kth score.  A query is searched in its own shard first; its kth score goes with it to the other
shards, of which only those are asked whose region may hold something as good.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edictal.session import stage

# Rows that the region tree is fitted on, regions at most, rows of a shard and of a leaf, queries of a block.
SAMPLE, REGIONS, SHARD_ROWS, LEAF_ROWS, BLOCK = 4096, 16, 8192, 256, 512
NO_SCORE = np.iinfo(np.int64).min


@dataclass
class Tree:
    """Median splits over ``rows``; ``low``/``high`` are tight boxes and ``least`` the smallest id of every node."""

    ids: np.ndarray
    rows: np.ndarray
    low: list = field(default_factory=list)
    high: list = field(default_factory=list)
    least: list = field(default_factory=list)
    child: list = field(default_factory=list)
    span: list = field(default_factory=list)
    split: list = field(default_factory=list)

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf_rows: int) -> Tree:
        order, tree = np.arange(len(ids)), cls(ids, rows)
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            start, stop, parent, side = waiting.pop()
            part = order[start:stop]
            low, high, node = rows[part].min(axis=0), rows[part].max(axis=0), len(tree.low)
            tree.low.append(low), tree.high.append(high), tree.least.append(int(ids[part].min()))
            tree.child.append([-1, -1]), tree.span.append((start, stop)), tree.split.append(None)
            if parent >= 0:
                tree.child[parent][side] = node
            axis = int(np.argmax(high - low)) if rows.shape[1] else 0
            if stop - start > leaf_rows and rows.shape[1] and high[axis] > low[axis]:
                values = rows[part, axis]
                pivot = np.partition(values, len(values) // 2)[len(values) // 2]
                left = values < pivot if pivot > low[axis] else values <= pivot
                order[start:stop] = np.concatenate([part[left], part[~left]])
                middle = start + int(left.sum())
                tree.split[node] = (axis, values[left].max())
                waiting += [(start, middle, node, 0), (middle, stop, node, 1)]
        tree.ids, tree.rows = ids[order], rows[order]
        return tree

    def bound(self, node: int, query: np.ndarray):
        return np.maximum(query * self.low[node], query * self.high[node]).sum()

    def search(self, own: int, query: np.ndarray, k: int, floor: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the query's own; rows behind ``floor`` (score, id) of a kth found elsewhere are left out."""
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        heap = [(-self.bound(0, query), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < floor[0]:
                break
            if -bound == floor[0] and self.least[node] > floor[1]:
                continue
            left, right = self.child[node]
            if left >= 0:
                for child in (left, right):
                    limit = self.bound(child, query)
                    if limit >= floor[0]:
                        heapq.heappush(heap, (-limit, child))
                continue
            start, stop = self.span[node]
            found = self.rows[start:stop] @ query
            at = np.flatnonzero((found >= floor[0]) & (self.ids[start:stop] != own))
            if not len(at):
                continue
            if len(at) > k:
                at = at[found[at] >= np.sort(found[at])[-k]]
            ids, scores = np.concatenate([ids, self.ids[start:stop][at]]), np.concatenate([scores, found[at]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k and (scores[-1], -ids[-1]) > (floor[0], -floor[1]):
                floor = (scores[-1], int(ids[-1]))
        return ids, scores


def exact_type(*values: np.ndarray) -> type:
    """float64 where every sum of products is a whole number it holds exactly, else Python's integers."""
    width = max((v.shape[1] for v in values), default=1)
    top = 1
    for v in values:
        top *= max(1, int(np.abs(v.astype(object)).max())) if v.size else 1
    return np.float64 if width * top < 1 << 53 else object


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of ``width`` integers; a shorter list counts as having zeros at its end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def components(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(vector: Column) -> Column:
    """No component is null or not finite."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _fit(sample: np.ndarray) -> Tree | None:
    """The region tree; the regions are its leaves."""
    return Tree.build(np.arange(len(sample)), sample, max(1, -(-len(sample) // REGIONS))) if len(sample) else None


def _region(tree: Tree, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.int64)
    waiting = [(0, np.arange(len(rows)))]
    while waiting:
        node, at = waiting.pop()
        if tree.split[node] is None:
            out[at] = node
        elif len(at):
            axis, most = tree.split[node]
            left = rows[at, axis] <= most
            waiting += [(tree.child[node][0], at[left]), (tree.child[node][1], at[~left])]
    return out


def _distinct(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without rows that repeat both id and vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, rows
    both = np.unique(np.column_stack([ids, rows]), axis=0)
    return both[:, 0], both[:, 1:]


FOUND = "query_id long, vec_id long, score long"


def _results(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    scores = [int(s) for _, _, found in parts for s in found]
    return pa.table({
        "query_id": pa.array([q for q, ids, _ in parts for _ in ids], pa.int64()),
        "vec_id": pa.array([int(i) for _, ids, _ in parts for i in ids], pa.int64()),
        "score": pa.array(scores, pa.int64()),
    })


def _search(vectors: pa.Table, queries: pa.Table, width: int, k: int) -> pa.Table:
    if not vectors.num_rows or not queries.num_rows:
        return _results([])
    ids, rows = _distinct(vectors.column("vec_id").to_numpy(), matrix(vectors.column("v"), width))
    asked = matrix(queries.column("v"), width)
    kind = exact_type(rows, asked)
    tree = Tree.build(ids, rows.astype(kind), LEAF_ROWS)
    out = []
    floors = zip(queries.column("floor").to_pylist(), queries.column("floor_id").to_pylist(), strict=True)
    for own, query, (floor, last) in zip(queries.column("vec_id").to_pylist(), asked.astype(kind), floors, strict=True):
        out.append((own, *tree.search(own, query, k, (floor, last))))
    return _results(out)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every`` the k rows of highest inner product, ties to the
    smaller id; all, if there are fewer.  Components are floor(scale * x).

    Rows with a null id, a null vector or a component that is null or not finite take no part.  A shorter vector counts as having zeros at
    its end.  A row is never its own neighbour, nor are rows with its id; rows that repeat id and vector count once.  Scores are exact
    whole numbers; one beyond 64 bits is an error.  Other columns are not read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("raw")).filter(F.col("vec_id").isNotNull() & usable(F.col("raw")))
    rows = rows.select("vec_id", components(F.col("raw"), scale).alias("v"))
    # The sample is bounded; it shapes the regions, every row is dealt into one.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    if not sample.num_rows:
        return spark.sql("SELECT 0L AS query_id, 1 AS rank, 0L AS vec_id, 0L AS score").filter(F.lit(False))
    tree = _fit(matrix(sample.column("v"), width))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            region = _region(tree, matrix(batch.column("v"), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], names=["vec_id", "v", "region"])

    dealt = stage(rows.mapInArrow(deal, "vec_id long, v array<long>, region long"))
    # At most REGIONS rows, with their boxes.
    each = [F.struct(F.min(F.get("v", F.lit(i))).alias("low"), F.max(F.get("v", F.lit(i))).alias("high")) for i in range(width)]
    regions = dealt.groupBy("region").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("most"), F.min(F.size("v")).alias("fewest"), F.array(*each).alias("box")).collect()
    parts = {r["region"]: max(1, -(-r["n"] // SHARD_ROWS)) for r in regions}
    boxes = np.array([[[b["low"] or 0, b["high"] or 0] for b in r["box"]] for r in regions], np.int64).reshape(len(regions), width, 2)
    for box, r in zip(boxes, regions, strict=True):  # zeros that stand for missing components
        box[r["fewest"] :, 0] = np.minimum(box[r["fewest"] :, 0], 0)
        box[r["fewest"] :, 1] = np.maximum(box[r["fewest"] :, 1], 0)
    split = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("region")]
    shards = stage(dealt.select("vec_id", "v", (F.col("region") * (1 << 32) + F.pmod(F.xxhash64("vec_id"), split)).alias("shard")))

    queries = shards.filter(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id", "v"])
    home = stage(queries.select("vec_id", "v", "shard", F.lit(NO_SCORE).alias("floor"), F.lit(NO_SCORE).alias("floor_id")))

    def search(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        return _search(vectors, asked, width, k)

    # Only shards that hold a query are searched for the first bound.
    near = stage(shards.join(home.select("shard").distinct(), "shard", "left_semi").groupBy("shard").cogroup(home.groupBy("shard")).applyInArrow(search, FOUND))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"), F.col("vec_id").alias("floor_id"))
    n_blocks = max(1, -(-home.count() // BLOCK))
    bounded = home.select("vec_id", "v", "shard").join(kth, "vec_id", "left").fillna(NO_SCORE, ["floor", "floor_id"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The shards that may hold something as good as the kth found so far; boxes are few and bounded.
        keys = np.array([r["region"] for r in regions], np.int64)
        counts = np.array([parts[r] for r in keys.tolist()], np.int64)
        of = np.repeat(keys, counts) * (1 << 32) + np.concatenate([np.arange(c) for c in counts])
        for batch in batches:
            asked = matrix(batch.column("v"), width)
            kind = exact_type(asked, boxes.reshape(len(boxes), -1)) if width else np.float64
            q, b = asked.astype(kind), boxes.astype(kind)
            up, down = np.where(q > 0, q, 0), np.where(q < 0, q, 0)
            bounds = up @ b[:, :, 1].T + down @ b[:, :, 0].T
            floor = np.array(batch.column("floor").to_pylist(), np.int64).astype(kind)
            row, shard = np.nonzero(np.repeat(bounds >= floor[:, None], counts, axis=1))
            other = of[shard] != batch.column("shard").to_numpy()[row]
            row, shard = row[other], shard[other]
            taken = batch.select(["vec_id", "v", "floor", "floor_id", "block"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(of[shard])], names=[*taken.schema.names, "shard"])

    asked = stage(bounded.mapInArrow(ask, "vec_id long, v array<long>, floor long, floor_id long, block long, shard long"))
    units = asked.select(F.col("shard").alias("unit_shard"), F.col("block").alias("unit_block")).distinct()
    far = shards.join(units, F.col("shard") == F.col("unit_shard")).groupBy("unit_shard", "unit_block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, FOUND)
    ranked = near.unionByName(far).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
