"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A benchmark item is the set of its five-word shingles; an item of fewer words is one shingle of all
its words. A document holds an item if it holds 0.8 or more of its shingles.

Items are partitioned by size, a quarter apart. For a partition of up to c shingles a document is read in
windows of c + c/4 shingles, a new one every c/4, so the comparison is of sets of like size however
long the document is. A window that holds 0.8 of an item has a Jaccard similarity with it of at least
``least_jaccard``; each partition chooses its own bands of MinHash values: the most rows a band for
which ``FUNCTIONS`` hash functions still make a collision likelier than 1 - ``MISS`` at that similarity.
Items and windows meet by a join on band keys, and a document that meets an item is verified by exact
containment of its shingles. So an item that lies in one window is found; one whose shingles are scattered
over more is found if a part of it collides. No document below the threshold is ever reported.

Two bitmaps of ``MOST_BITS`` bits at most go to every task: of all item shingles and of all item band keys.
Signatures are made only for windows with a shingle in the first, and keys leave the task only if they
are in the second; both are necessary for a collision and a match, so they only save work. The shingles
that pass the first are all that exact containment needs, and all that leaves a task. Documents are read once.

Cases: null or wordless items match nothing; null, empty and wordless documents are clean; repeated
documents each match; repeated items, and different ones of equal shingles, match under each id, of any
type; an empty table on either side gives no matches; other columns are ignored, or kept by
``remove_contaminated``. A very long text is one row in memory with 16 bytes a word. There are no ties.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.licenses import bands, bounds, least_jaccard, stride
from tidemark.llm.words import SHINGLE, WordHashes, mix, shingles

THRESHOLD = 0.8
MISS, FUNCTIONS = 1e-6, 64
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 29
SEEDS = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
LIMITS = bounds(1 << 31)


def item_set(words: np.ndarray) -> tuple[int, np.ndarray]:
    """(words a shingle, distinct shingles) of an item."""
    n = min(SHINGLE, len(words))
    return n, np.unique(shingles(words, n))


@cache
def banding(smallest: int, bound: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """(bands, rows) of a partition whose least item has ``smallest`` shingles. One row a band if no more fit ``FUNCTIONS``."""
    for rows in range(8, 0, -1):
        n = bands(smallest, bound, threshold, rows, MISS) if least_jaccard(smallest, bound, threshold) < 1 else 1
        if n * rows <= FUNCTIONS or rows == 1:
            return min(n, FUNCTIONS), rows
    raise AssertionError


Partitions = dict[tuple[int, int], int]  # (words a shingle, bound) -> least size


def band_keys(own: np.ndarray, partition: tuple[int, int], smallest: int, threshold: float) -> np.ndarray:
    """Keys of a set in a partition, one a band."""
    n, rows = banding(smallest, partition[1], threshold)
    low = np.full(n * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        low = np.minimum(low, mix(own[at : at + 4096, None] ^ SEEDS[: n * rows]).min(axis=0))
    key = np.arange(n, dtype=np.uint64) + np.uint64(partition[0] << 40 | partition[1] << 8)
    for r in range(rows):
        key = mix(key ^ low[r::rows])
    return key


def windows(hits: np.ndarray, bound: int) -> np.ndarray:
    """Numbers of the windows that hold any of some places."""
    step = stride(bound)
    lo, hi = np.maximum(0, (hits - bound) // step)[:, None], (hits // step)[:, None]
    k = lo + np.arange((hi - lo).max(initial=-1) + 1)
    return np.unique(k[k <= hi])


# --- bitmaps ------------------------------------------------------------------------------------


PROBES = 3


def place(x: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """A place in a bitmap from a hash's own bits; the numbers are well mixed already."""
    return (x >> np.uint64(17 * probe) & np.uint64(bits - 1)).astype(np.int64)


def inside(x: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Which of some numbers a bitmap may hold."""
    at = np.arange(len(x))
    for probe in range(PROBES):
        p = place(x[at], probe, 8 * len(bitmap))
        at = at[bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1 > 0]
    out = np.zeros(len(x), bool)
    out[at] = True
    return out


def bitmap(numbers: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of a column of longs, of 64 bits or more a number up to ``MOST_BITS`` in all."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (64 * max(1, count) - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for probe in range(PROBES):
                p = place(b.column(0).to_numpy().view(np.uint64), probe, bits)
                np.bitwise_or.at(own, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["own"])

    out = np.zeros(bits // 8, np.uint8)
    for r in numbers.coalesce(4).mapInArrow(run, "own binary").toLocalIterator():
        out |= np.frombuffer(r["own"], np.uint8)
    return out


# --- search -------------------------------------------------------------------------------------


def _longs(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    flat = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))


def _item_sets(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, set, n, bound, size, own) of every item with words; ``set`` tells sets of shingles apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            made = [item_set(words.of(t)) for t in b.column(1).to_pylist()]
            at = [i for i, (_, own) in enumerate(made) if len(own)]
            own = [made[i][1] for i in at]
            name = np.array([xxhash.xxh64_intdigest(s.tobytes(), made[i][0]) for i, s in zip(at, own)], np.uint64).view(np.int64)
            ints = lambda x: pa.array(x, pa.int32())
            columns = [b.column(0).take(pa.array(at, pa.int64())), pa.array(name), ints([made[i][0] for i in at]), ints([LIMITS[bisect_left(LIMITS, len(s))] for s in own]), ints([len(s) for s in own]), _longs(own)]
            yield pa.RecordBatch.from_arrays(columns, names=["item_id", "set", "n", "bound", "size", "own"])

    kind = items.schema[item_id].dataType.simpleString()
    return cut(items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).mapInArrow(run, f"item_id {kind}, set long, n int, bound int, size int, own array<long>"))


def doc_key(doc_id: str, text: str) -> list[Column]:
    """A document's id, the smallest long if it has none, and a hash that tells texts of one id apart."""
    return [F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(-(1 << 63))).alias("k_id"), F.xxhash64(f"`{text}`").alias("k_text")]


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(row, doc_id, k_id, k_text, item_id, containment) of every row of ``docs`` and item that it holds."""
    given = _item_sets(items, item_id, text)
    sets = cut(given.dropDuplicates(["set"]).drop("item_id"))
    partitions: Partitions = {(r["n"], r["bound"]): r["least"] for r in sets.groupBy("n", "bound").agg(F.min("size").alias("least")).collect()}  # a quarter apart, so few

    def item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3))
            keys = [band_keys(own.values.to_numpy().view(np.uint64), (n, bound), partitions[n, bound], threshold) for n, bound, own in at]
            yield pa.RecordBatch.from_arrays([b.column(0), _longs(keys)], names=["set", "keys"])

    index = cut(sets.select("set", "n", "bound", "own").mapInArrow(item_keys, "set long, keys array<long>").select("set", F.explode("keys").alias("key")))
    held = bitmap(sets.select(F.explode("own")), sets.agg(F.sum("size")).first()[0] or 0)
    shipped = docs.sparkSession.sparkContext.broadcast((held, bitmap(index.select("key"), index.count())))  # 2 * ``MOST_BITS`` at most

    def search(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The item shingles of a document, and the band keys of its windows that items have."""
        known, wanted = shipped.value
        found, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for n in {n for n, _ in partitions}:
            own = shingles(words, n)
            hits = np.flatnonzero(inside(own, known))
            if not len(hits):
                continue
            found.append(np.unique(own[hits]))
            for p, smallest in partitions.items():
                if p[0] == n:
                    step = stride(p[1])
                    keys += [band_keys(own[k * step : k * step + p[1] + step], p, smallest, threshold) for k in windows(hits, p[1])]
        keys = np.unique(np.concatenate(keys))
        return np.concatenate(found), keys[inside(keys, wanted)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            got = [search(words.of(t.as_py())) for t in b.column(3)]
            at = [i for i, (_, keys) in enumerate(got) if len(keys)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:3]), _longs([got[i][0] for i in at]), _longs([got[i][1] for i in at])], names=["doc_id", "k_id", "k_text", "hits", "keys"])

    some = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *doc_key(doc_id, text), F.col(text).alias("text"))
    some = cut(some.mapInArrow(run, "doc_id long, k_id long, k_text long, hits array<long>, keys array<long>").withColumn("row", F.monotonically_increasing_id()))
    met = some.select("row", F.explode("keys").alias("key")).join(index, "key").select("row", "set").distinct()
    share = F.size(F.array_intersect("hits", "own")) / F.col("size")
    held_by = met.join(sets.select("set", "own", "size"), "set").join(some, "row").select("row", "doc_id", "k_id", "k_text", "set", share.alias("containment"))
    return held_by.where(F.col("containment") >= threshold - 1e-12).join(given.select("set", "item_id"), "set").drop("set")


def find_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, containment) of every document that holds a benchmark item."""
    return matches(docs, items, threshold, doc_id, item_id, text).select("doc_id", "item_id", "containment")


def remove_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    gone = cut(matches(docs, items, threshold, doc_id, item_id, text).select("k_id", "k_text").distinct())
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *doc_key(doc_id, text))
    return packed.join(gone, ["k_id", "k_text"], "left_anti").select("row.*")
