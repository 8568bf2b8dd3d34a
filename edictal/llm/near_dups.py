"""MinHash near-dedup with odd sketches.

Every document becomes its set of word shingles.  MinHash samples of the set are banded for candidates and folded into a parity bitmap,
the odd sketch: the bits in which two sketches differ count the samples that differ, so a population count of their XOR estimates high
similarities closely.  Documents of equal sets are one class from the start.

Within a bucket of a band a search by sketches links what may be similar, one link for every class it reaches, never all pairs.  What is
so connected is a family.  Families meet in blocks of bounded size, where pairs not yet connected are confirmed on full sets, the most
similar first; a family of several blocks then compares, across blocks, only classes that are still in different components, at least
one of them outside the largest.  Sketches and bands only say where to look; every link is confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edictal.llm.common import LOWER, fill, flat, likely, mix, runs, span_hashes, steps, trimmed, word_spans, words_per_value
from edictal.llm.components import components
from edictal.session import stage

WORDS = 5
SAMPLES, BITS = 128, 1024
# Sketches refuse a pair of similarity 0.85 five times in a hundred billion, one of 0.8 two times in a billion: far less often than bands miss it.
LEEWAY = 0.25
# Classes and bytes of sets of a block, classes of a bucket that are searched by sketch.
BLOCK_ROWS, BLOCK_BYTES, BUCKET_ROWS = 1024, 8 << 20, 2048
_RANDOM = np.random.default_rng(20240501)
FACTORS = (_RANDOM.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
BAND_FACTORS = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) | np.uint64(1)
SHINGLE_FACTORS = mix(np.arange(101, 101 + 64, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every value; of a text with fewer words, its whole sequence as one; none without words."""
    raw, offsets = flat(fill(column))
    for i, j in steps(offsets):
        data = LOWER[raw[offsets[i] : offsets[j]]]
        at = offsets[i : j + 1] - offsets[i]
        starts, ends = word_spans(data, at)
        hashes = span_hashes(data, starts, ends) if len(data) else np.zeros(0, np.uint64)
        first = words_per_value(starts, at)
        long = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
        for k in range(words):
            long += hashes[k : k + len(long)] * SHINGLE_FACTORS[k]
        long = mix(long)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(long[a : b - words + 1])
            elif b > a:
                yield mix((hashes[a:b] * SHINGLE_FACTORS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 2048):
        np.minimum(out, (FACTORS[:, None] * short[None, at : at + 2048]).min(axis=1), out=out)
    return out


def band_rows(percent: int) -> int:
    """Samples of a band.  Bands of 5 meet at similarity 0.85 but for 4 pairs in ten million, bands of 4 at 0.8 but for 5 in a hundred million."""
    return 5 if percent >= 85 else 4


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of every band of every row of samples."""
    many = SAMPLES // rows
    bands = samples[:, : many * rows].reshape(len(samples), many, rows).astype(np.uint64)
    return mix((bands * BAND_FACTORS[:rows]).sum(axis=2, dtype=np.uint64) + mix(np.arange(1, many + 1, dtype=np.uint64))).view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps of ``BITS`` bits: every sample, with its number, turns one bit over."""
    place = mix(samples.astype(np.uint64) | (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    at = (np.arange(len(samples))[:, None] * BITS + place.astype(np.int64)).ravel()
    return np.packbits(np.bincount(at, minlength=len(samples) * BITS).reshape(len(samples), BITS) & 1, axis=1)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity of two sets whose sketches differ in so many bits."""
    odd = np.minimum(2 * differing / BITS, 1 - 1e-9)
    return 1 + BITS / (4 * SAMPLES) * np.log1p(-odd)


def most_differing(similarity: float) -> int:
    """Bits in which sketches may differ for an estimate of at least ``similarity``."""
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / BITS)))


def sketch_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITS // 64)


def _read(words: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums, samples = [], [], np.full((batch.num_rows, SAMPLES), 0xFFFFFFFF, np.uint32)
            for r, found in enumerate(shingle_sets(batch.column("text"), words)):
                n.append(len(found))
                sums.append((int(found.sum(dtype=np.uint64)), int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))))
                if len(found):
                    samples[r] = min_hashes(found)
            sets = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            keys = pa.FixedSizeListArray.from_arrays(pa.array(band_keys(samples, rows).ravel()), SAMPLES // rows).cast(pa.list_(pa.int64()))
            sketches = pa.array([s.tobytes() for s in odd_sketches(samples)], pa.binary())
            columns = [batch.column("row"), batch.column("id"), batch.column("probe"), pa.array(n, pa.int64()), pa.array(sets[:, 0]), pa.array(sets[:, 1]), keys, sketches]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "probe", "n", "s1", "s2", "keys", "sketch"])

    return run


def _join_by_sketch(most: int):
    """One link for every class of a bucket that a chain of similar sketches reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for group in runs(batches, ["bucket"]):
            ids, sketches = group.column("cid").to_numpy(), sketch_rows(group.column("sketch"))
            left = np.arange(len(ids))
            while len(left) > 1:
                waiting, left = [int(left[0])], left[1:]
                chain = list(waiting)
                while waiting and len(left):
                    at = waiting.pop()
                    near = np.bitwise_count(sketches[left] ^ sketches[at]).sum(axis=1) <= most
                    waiting += left[near].tolist()
                    chain += left[near].tolist()
                    left = left[~near]
                # A star about the smallest.
                found = np.sort(ids[chain])
                a += [int(found[0])] * (len(found) - 1)
                b += found[1:].tolist()
            if len(a) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class Forest:
    """Union-find over the places of a block."""

    def __init__(self, labels: np.ndarray):
        _, self.parent = np.unique(labels, return_inverse=True)
        n, at = int(self.parent.max()) + 1, self.parent
        self.parent, self.at = np.arange(n), at

    def find(self, place: int) -> int:
        x, parent = int(self.at[place]), self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    def union(self, a: int, b: int) -> None:
        self.parent[max(a, b)] = min(a, b)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on sorted distinct hashes."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(most: int, percent: int):
    """Links of a block, confirmed on full sets, as many as connect what is connected.  Rows of side 1 are only met by those of side 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["family", "x", "y"]):
            ids, labels, n, side = (group.column(c).to_numpy() for c in ("cid", "label", "n", "side"))
            sketches, sets = sketch_rows(group.column("sketch")), group.column("shingles").to_pylist()
            forest, across = Forest(labels), bool(side.any())
            asking = np.flatnonzero(side == 0)
            other = np.flatnonzero(side == 1) if across else None
            pairs = []
            for k, i in enumerate(asking.tolist()):
                to = other if across else asking[k + 1 :]
                # Sets whose sizes are too far apart cannot be similar enough.
                to = to[(labels[to] != labels[i]) & (100 * np.minimum(n[to], n[i]) >= percent * np.maximum(n[to], n[i]))]
                if len(to):
                    differ = np.bitwise_count(sketches[to] ^ sketches[i]).sum(axis=1).astype(np.int32)
                    near = differ <= most
                    if near.any():
                        pairs.append(np.column_stack([differ[near], np.full(int(near.sum()), i, np.int32), to[near].astype(np.int32)]))
            a, b = [], []
            if pairs:
                pairs = np.concatenate(pairs)
                for _, i, j in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
                    p, q = forest.find(i), forest.find(j)
                    if p != q and similar(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64), percent):
                        forest.union(p, q)
                        a.append(int(ids[i])), b.append(int(ids[j]))
            if a and not across:
                # Stars about the smallest of what is connected; rows of a block have labels of their own.
                root = np.array([forest.find(k) for k in range(len(ids))])
                order = np.lexsort((ids, root))
                first = np.flatnonzero(np.diff(root[order], prepend=-1))
                hub = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
                held = hub != ids[order]
                a, b = hub[held].tolist(), ids[order][held].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _sets_of(docs: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """(s1, s2, shingles) of the texts whose probe is in ``wanted``; only texts that may be wanted are moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, sets = [], []
            for found in shingle_sets(batch.column("text"), words):
                sums.append((int(found.sum(dtype=np.uint64)), int(mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))))
                sets.append(found.tobytes())
            pair = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(sets, pa.binary())], names=["s1", "s2", "shingles"])

    text, probe = _text(text_col)
    found = likely(docs.select(text.alias("text"), probe.alias("probe")), wanted.select("probe"), "probe")
    one = found.groupBy("probe").agg(F.first("text").alias("text")).join(wanted.select("probe").distinct(), "probe", "left_semi")
    return one.select("text").mapInArrow(trimmed(run), "s1 long, s2 long, shingles binary")


def _text(text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return text, F.xxhash64(text, F.octet_length(text))


def _blocks(members: DataFrame, keys: list[str]) -> DataFrame:
    return members.repartition(*keys).sortWithinPartitions(*keys)


def near_dups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, words: int = WORDS, row_col: str | None = None) -> DataFrame:
    """(row, id, n_shingles, component_id, kept) of every row, linked where the shingle sets are similar by ``percent`` at least.

    A-Z are lower-cased and words are runs without white space (bytes 32 and 9 to 13).  Null and texts without words have the empty set
    and are linked with nothing.  component_id is the smallest id that can be reached, null ids coming last, and one row of each component
    is kept: the one with that id, of several the one with the smallest row number.  ``row_col`` may name a column of
    distinct whole numbers to know rows by; other columns of ``docs`` are not read.  An empty table gives an empty result.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    text, probe = _text(text_col)
    most = most_differing(percent / 100 - LEEWAY)
    source = docs.select((F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("row"), F.col(id_col).alias("id"), probe.alias("probe"), text.alias("text"))
    read = stage(source.mapInArrow(trimmed(_read(words, band_rows(percent))), f"row long, id {kind}, probe long, n long, s1 long, s2 long, keys array<long>, sketch binary"))
    # A class for every set: the row with the smallest number stands for it.
    first = stage(read.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("cid")))
    classes = stage(read.join(first.select(F.col("cid").alias("row")), "row", "left_semi").select(F.col("row").alias("cid"), "probe", "n", "s1", "s2", "keys", "sketch"))

    banded = classes.select("cid", F.explode("keys").alias("bucket"))
    shared = stage(banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("cid").alias("hub")).filter("size > 1"))
    met = stage(banded.join(shared, "bucket"))
    small = met.filter(F.col("size") <= BUCKET_ROWS).select("bucket", "cid").join(classes.select("cid", "sketch"), "cid")
    maybe = _blocks(small, ["bucket"]).mapInArrow(trimmed(_join_by_sketch(most)), "a long, b long")
    # A larger bucket is one family as it is; only confirmation decides.
    maybe = maybe.union(met.filter((F.col("size") > BUCKET_ROWS) & (F.col("cid") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("cid").alias("b")))
    families = stage(components(maybe).select(F.col("node").alias("cid"), F.col("label").alias("family")))

    wanted = stage(classes.join(families, "cid").select("cid", "family", "probe", "n", "s1", "s2", "sketch"))
    sets = _sets_of(docs, wanted, text_col, words).dropDuplicates(["s1", "s2"])
    sizes = stage(wanted.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("chunks")))
    members = stage(wanted.join(sets, ["s1", "s2"]).join(sizes, "family").select("family", "chunks", "cid", "n", "sketch", "shingles", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int").alias("x")))
    own = members.select("family", "x", F.lit(0).alias("y"), F.lit(0).alias("side"), "cid", F.col("cid").alias("label"), "n", "sketch", "shingles")
    links = stage(_blocks(own, ["family", "x", "y"]).mapInArrow(trimmed(_confirm(most, percent)), "a long, b long"))

    # Families of several blocks: what is outside the largest component meets all blocks.
    wide = members.filter("chunks > 1").select("family", "chunks", "cid", "x")
    if not wide.isEmpty():
        labels = components(links).select(F.col("node").alias("cid"), "label")
        labelled = stage(wide.join(labels, "cid", "left").select("family", "chunks", "cid", "x", F.coalesce("label", "cid").alias("label")))
        counts = labelled.groupBy("family", "label").agg(F.count("*").alias("c"))
        largest = stage(counts.groupBy("family").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("all")).filter("top.c < all").select("family", F.col("top.label").alias("top"), F.ceil((F.col("all") - F.col("top.c")) / BLOCK_ROWS).cast("int").alias("outside")))
        full = labelled.join(largest, "family").join(members.select("cid", "n", "sketch", "shingles"), "cid")
        columns = ["cid", "label", "n", "sketch", "shingles"]
        outside = full.filter("label <> top").select("family", F.pmod(F.xxhash64(F.col("cid") + 1), F.col("outside")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("y"), F.lit(0).alias("side"), *columns)
        everyone = full.select("family", F.explode(F.sequence(F.lit(0), F.col("outside") - 1)).alias("x"), F.col("x").alias("y"), F.lit(1).alias("side"), *columns)
        more = _blocks(outside.unionByName(everyone), ["family", "x", "y"]).mapInArrow(trimmed(_confirm(most, percent)), "a long, b long")
        links = stage(links.union(more))

    component = components(links).select(F.col("node").alias("cid"), "label")
    grouped = stage(first.join(component, "cid", "left").select("s1", "s2", F.coalesce("label", "cid").alias("label")))
    labelled = stage(read.select("row", "id", "n", "s1", "s2").join(grouped, ["s1", "s2"], "left").select("row", "id", "n", F.when(F.col("n") > 0, F.col("label")).alias("label")))
    # Components of one row need no second look.
    best = labelled.filter("label is not null").groupBy("label").agg(F.count("*").alias("size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    best = stage(best.filter("size > 1").select("label", F.col("best.id").alias("best_id"), F.col("best.row").alias("best_row")))
    return labelled.join(best, "label", "left").select(
        "row", "id", F.col("n").alias("n_shingles"), F.when(F.col("best_row").isNull(), F.col("id")).otherwise(F.col("best_id")).alias("component_id"),
        (F.col("best_row").isNull() | (F.col("best_row") == F.col("row"))).alias("kept"),
    )
