"""Embedding near-duplicates by a pivot-permutation index.

A vector is described by its nearest reference points (pivots). Two vectors are candidates if they
share two of them, which is when they meet in the inverted list of a pair of pivots; every vector
stands in the lists of all pairs of its prefix. Candidates are verified by their cosine in double
precision. A pair that meets in several lists is counted in the list of its two smallest shared pivots
alone, so counts need no list of pairs.

The number of pivots grows with the square root of the number of distinct vectors, between
``LEAST_PIVOTS`` and ``MOST_PIVOTS``, so that lists keep their length and work grows with the vectors, not
their pairs; the prefix grows by one with every fourfold, which holds the share of pairs at the
threshold that meet (0.95 or more of random ones at cosine 0.9). Pivots are drawn from a bounded sample
(two vectors a pivot, in hash order, none close to another), and filled up with random directions; every
vector is indexed. Vectors of each length have pivots of their own.

Lists hold the vectors as they are stored, in 4 bytes a component if they are floats: verifying where
the lists are is what spares pairs. Equal vectors are one class with a count. A list of over ``BLOCK``
classes is dealt out in parts, and each pair of parts is compared in a task of its own, so that no
task holds more than two parts; only counts and a forest of links leave a task.

Cases: a vector that is null, empty or zero, or holds null or non-finite components, or has no vec_id,
links with nothing and is kept; vectors of different lengths don't link; very large and very small
components neither overflow nor vanish; repeated rows are vectors of their own that link with each
other, and rows of one vec_id too; equal distances are settled by the pivots' numbers; an empty table
gives no rows; other columns are ignored. A very long vector is one row in memory, and so is a pivot.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.graph import components

LEAST_PIVOTS, MOST_PIVOTS, PREFIX = 256, 8192, 6
#: Vectors a list has on average, about, and at most in a part.
LIST, BLOCK = 64, 3000


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def plan(n: int) -> tuple[int, int]:
    """(pivots, prefix) for ``n`` distinct vectors."""
    pivots, prefix = LEAST_PIVOTS, PREFIX
    while pivots < MOST_PIVOTS and PREFIX * (PREFIX - 1) * n > LIST * pivots**2:
        pivots *= 2
    while LEAST_PIVOTS * 4 ** (prefix - PREFIX) < pivots:
        prefix += 1
    return pivots, prefix


def choose_pivots(sample: np.ndarray, n: int, apart: float = 0.8, seed: int = 11) -> np.ndarray:
    """Up to ``n`` points of which no two have a cosine of ``apart`` or more: sample vectors, then random
    directions and their opposites. Few components have room for few."""
    fill = unit(np.random.default_rng(seed).normal(size=(2 * n, sample.shape[1])))
    out, k = np.zeros((n, sample.shape[1])), 0
    for v in np.concatenate([unit(sample.astype(float)) if len(sample) else sample, fill[:1], -fill[:1], fill[1:]]):
        if k == n:
            break
        if not k or (out[:k] @ v).max() < apart:
            out[k] = v
            k += 1
    return out[:k]


def prefixes(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, in ascending order of their numbers."""
    near = np.argsort(-(unit(v) @ pivots.T), axis=1, kind="stable")[:, :prefix]
    return np.sort(near, axis=1)


def compare(ids: np.ndarray, counts: np.ndarray, prefix: np.ndarray, v: np.ndarray, side: np.ndarray, q: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links of each that this list counts, a, b): a-b is a forest of the links in this list.

    The list is that of pivot ``q`` and a smaller one. side: 0 for all if the list is compared with
    itself; else 0 and 1, and only pairs across count.
    """
    n = len(ids)
    v = unit(v)
    below = np.where(prefix < q, prefix, -1)
    crossed = side.any()
    near = np.zeros((n, n), bool)
    links = np.zeros(n, np.int64)
    for at in range(0, n, 512):
        block = slice(at, at + 512)
        near[block] = v[block] @ v.T >= threshold
        if crossed:
            near[block] &= side[block, None] != side[None, :]
        near[np.arange(n)[block], np.arange(n)[block]] = False
        i, j = np.nonzero(near[block])
        for lo in range(0, len(i), 1 << 18):
            a, b = i[lo : lo + (1 << 18)] + at, j[lo : lo + (1 << 18)]
            shared = np.zeros(len(a), np.int8)  # pivots before q
            for c in range(prefix.shape[1]):
                shared += ((below[b] == below[a, c, None]) & (below[b] >= 0)).any(axis=1)
            own = shared == 1
            links += np.bincount(a[own], counts[b[own]], n).astype(np.int64)
    label = np.arange(n)
    linked = near.any(axis=1)
    while linked.any():
        new = label.copy()
        for at in range(0, n, 512):
            new[at : at + 512] = np.minimum(label[at : at + 512], np.where(near[at : at + 512], label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(n))
    return ids, links, ids[at], ids[label[at]]


def _matrix(raw: pa.Array | list[bytes], kind: np.dtype) -> np.ndarray:
    raw = raw.to_pylist() if isinstance(raw, pa.Array) else raw
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)


def _stored(vectors: DataFrame, vec_id: str, embedding: str) -> tuple[DataFrame, np.dtype]:
    """(vec_id, raw): the components' bytes, null if the vector links with nothing."""
    element = getattr(vectors.schema[embedding].dataType, "elementType", None)
    kind = np.dtype("<f4") if element is not None and element.simpleString() == "float" else np.dtype("<f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            starts, ends = v.offsets.to_numpy()[:-1], v.offsets.to_numpy()[1:]
            flat = v.values.to_numpy(zero_copy_only=False).astype(kind)  # null is not a number
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            good = (bad[ends] == bad[starts]) & (some[ends] > some[starts]) & v.is_valid().to_numpy(zero_copy_only=False) & b.column(0).is_valid().to_numpy(zero_copy_only=False)
            raw = [flat[i:j].tobytes() if g else None for i, j, g in zip(starts, ends, good)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["vec_id", "raw"])

    typed = "array<float>" if kind.itemsize == 4 else "array<double>"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(typed).alias("v"))
    return cut(rows.mapInArrow(run, "vec_id long, raw binary")), kind


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", pivots: int | None = None, prefix: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    rows, kind = _stored(vectors, vec_id, embedding)
    usable, rest = rows.where("raw IS NOT NULL"), rows.where("raw IS NULL")
    classes = cut(usable.groupBy("raw").agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("c", F.monotonically_increasing_id()))  # ids may repeat, classes don't
    usual = plan(classes.count())
    points, width = pivots or usual[0], prefix or usual[1]
    drawn = [r["raw"] for r in classes.orderBy(F.xxhash64(F.lit("pivots"), "raw"), "raw").select("raw").limit(2 * points).collect()]
    by_size: dict[int, list[bytes]] = {}
    for raw in drawn:
        by_size.setdefault(len(raw) // kind.itemsize, []).append(raw)
    shipped = vectors.sparkSession.sparkContext.broadcast({d: choose_pivots(_matrix(own, kind), points) for d, own in by_size.items()})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_size = lru_cache(4)(lambda d: shipped.value[d] if d in shipped.value else choose_pivots(np.zeros((0, d)), points))
        for b in batches:
            sizes = np.array([len(x) for x in b.column(0).to_pylist()], np.int64) // kind.itemsize
            for d in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == d)
                for at in range(0, len(of), 2000):
                    part = b.take(pa.array(of[at : at + 2000]))
                    near = prefixes(_matrix(part.column(0), kind), of_size(d), width)
                    pairs = np.array(list(combinations(range(near.shape[1]), 2)), np.int64).reshape(-1, 2)
                    row = np.repeat(np.arange(part.num_rows), len(pairs))
                    key = ((d << 32) + near[:, pairs[:, 0]] * points + near[:, pairs[:, 1]]).ravel()
                    own = pa.array([x.tobytes() for x in near.astype("<i2")], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key), *[x.take(pa.array(row)) for x in (part.column(1), part.column(2), own, part.column(0))]], names=["key", "c", "n", "near", "raw"])

    keyed = classes.select("raw", "c", "n").mapInArrow(index, "key long, c long, n long, near binary, raw binary")
    long_lists = cut(keyed.select("key").groupBy("key").count().where(F.col("count") > BLOCK).select(F.col("key").alias("long_key"), F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")))
    dealt = keyed.join(long_lists, F.col("key") == F.col("long_key"), "left") if long_lists.take(1) else keyed.withColumn("parts", F.lit(None).cast("int"))
    parts, own = F.coalesce("parts", F.lit(1)), F.pmod(F.xxhash64("c"), F.coalesce("parts", F.lit(1))).cast("int")
    other = F.sequence(F.lit(0), parts - 1)
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(other)).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).cast("int").alias("side"), "c", "n", "near", "raw")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(group: pa.Table) -> pa.RecordBatch | None:
            if len(group) < 2:
                return None
            q = (group["key"][0].as_py() & 0xFFFFFFFF) % points
            g = {c: group[c].combine_chunks() for c in ("c", "n", "near", "raw", "side")}
            near = np.frombuffer(b"".join(g["near"].to_pylist()), "<i2").reshape(len(group), -1)
            ids, links, a, b = compare(g["c"].to_numpy(), g["n"].to_numpy(), near, _matrix(g["raw"], kind), g["side"].to_numpy(), q, threshold)
            some = links > 0
            zero = np.zeros(len(a), np.int64)
            c, n, to = np.concatenate([ids[some], a]), np.concatenate([links[some], zero]), np.concatenate([ids[some], b])
            return pa.RecordBatch.from_arrays([pa.array(c), pa.array(n), pa.array(to)], names=["c", "links", "to"]) if len(c) else None

        for batch in _closed(batches):
            if batch is not None and not batch.num_rows:
                continue
            if batch is not None:
                held.append(batch)
            table = pa.Table.from_batches(held) if held else None
            if table is None:
                continue
            at = np.stack([table[c].to_numpy() for c in ("key", "lo", "hi")], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(at)]])
            last = len(cuts) - 1 if batch is None else len(cuts) - 2
            for i in range(last):
                if (out := done(table.slice(cuts[i], cuts[i + 1] - cuts[i]))) is not None:
                    yield out
            held = table.slice(cuts[last]).to_batches() if batch is not None else []

    found = cut(dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(verify, "c long, links long, to long"))
    links = found.groupBy("c").agg(F.sum("links").alias("links")).withColumnRenamed("c", "l_c")
    names = cut(components(found.select(F.col("c").alias("a"), F.col("to").alias("b"))))
    least = cut(names.join(classes.select("c", "low"), F.col("node") == F.col("c")).groupBy("component").agg(F.min("low").alias("least")).withColumnRenamed("component", "of_component"))
    named = names.join(least, F.col("component") == F.col("of_component")).select("node", "least")
    told = cut(classes.join(links, F.col("c") == F.col("l_c"), "left").join(named, F.col("c") == F.col("node"), "left").select(F.col("raw").alias("of_raw"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "low").alias("component_id")))
    out = usable.join(told, F.col("raw") == F.col("of_raw")).select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    """The batches, and a null after the last."""
    yield from batches
    yield None
