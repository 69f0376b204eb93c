"""One document of each group of near copies: op2's SimHash rule, widened by verified shingle similarity.

Two documents are linked if their fingerprints are within three bits, as op2 has it, or if the
Jaccard similarity of their sets of five-word shingles is ``LEAST`` or more. Three bits find few of
the latter, so their candidates share one of ``BANDS`` keys of ``ROWS`` MinHash values each; a pair at
0.8 shares none with a chance of 0.67232**24, under 0.0001. Every candidate is verified on the whole
sets, so no pair below ``LEAST`` is linked by them.

Texts of one set are one node. Sets are shipped to buckets, never to pairs: a task takes a bucket's
nodes in turn, counts what each shares with all others, and returns a forest of links. It ends when one
component is left, so a bucket of copies costs one turn. Buckets of the same nodes are one bucket. A bucket of
over ``NODES`` nodes or ``SHINGLES`` shingles is dealt out in parts, the smallest node to each of them; if
that leaves more than one component in it, each pair of parts is compared too.

Cases: those of ``simhash``; a text of fewer than five words has one shingle, one without words none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.common import cut
from tidemark.llm.graph import components

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
#: Nodes and shingles of a bucket that a task holds of a part, more or less.
NODES, SHINGLES = 1000, 1 << 20
_ODD = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(simhash.shingle_hashes(text, WORDS))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band; none for a set without shingles."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    low = np.full(len(_ODD), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        low = np.minimum(low, (shingles[at : at + 4096, None] * _ODD).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _members(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, fp, node, size, bands) of each document; node is a hash of its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, nodes, sizes, bands = [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t)
                fps.append(simhash.fingerprint(simhash.shingle_hashes(t)))
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                bands.append(band_keys(s))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), long(fps), long(nodes), pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "fp", "node", "size", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long, node long, size int, bands array<long>")


def _shingles(texts: DataFrame) -> DataFrame:
    """(node, shingles) of (node, text); shingles are the bytes of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def forest(sets: list[np.ndarray], label: np.ndarray, hub: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Links (positions) that join the components of ``label`` as all pairs of ``least`` or more with a ``hub`` do; ``label`` is changed."""
    size = np.array([len(s) for s in sets])
    name, at = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(at, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]  # by shingle
    first = np.searchsorted(at[order], np.arange(len(name) + 1))
    ends = np.cumsum(size)
    step = max(1, (1 << 20) // len(sets))
    links = []
    for i in np.flatnonzero(hub).tolist():
        if (label == label[i]).all():
            break
        own = at[ends[i] - size[i] : ends[i]]
        shared = np.zeros(len(sets), np.int64)
        for a in range(0, len(own), step):
            start = first[own[a : a + step]]
            n = first[own[a : a + step] + 1] - start
            places = np.arange(n.sum()) + np.repeat(start - np.cumsum(n) + n, n)
            shared += np.bincount(holder[places], minlength=len(sets))
        near = np.flatnonzero((shared >= least * (size[i] + size - shared)) & (label != label[i]))
        for j in near.tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                links.append((i, j))
    return links


def _verified(rows: DataFrame, least: float) -> DataFrame:
    """Links (a, b) of buckets (key, lo, hi) of rows (node, label, hub, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sets = np.zeros((6, 0), np.int64), []  # key, lo, hi, node, label, hub

        def done(n: int) -> pa.RecordBatch:
            cuts = np.flatnonzero(np.concatenate([[True], (held[:3, 1:n] != held[:3, : n - 1]).any(axis=0)])) if n else np.zeros(0, int)
            a, b = [], []
            for at, end in zip(cuts.tolist(), np.append(cuts, n)[1:].tolist()):
                node = held[3, at:end]
                for i, j in forest([np.frombuffer(s, np.uint64) for s in sets[at:end]], held[4, at:end].copy(), held[5, at:end] > 0, least):
                    a.append(node[i])
                    b.append(node[j])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns[:6]])], axis=1)
            sets += batch.column(6).to_pylist()
            last = int(np.flatnonzero((held[:3] == held[:3, -1:]).all(axis=0))[0])
            yield done(last)
            held, sets = held[:, last:], sets[last:]
        yield done(len(sets))

    dealt = rows.select("key", "lo", "hi", "node", "label", F.col("hub").cast("long").alias("hub"), "shingles")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a long, b long")


def _key(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(-(1 << 63)))


def similar(docs: DataFrame, nodes: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """Links (a, b) that make the same components as all candidate pairs of ``least`` or more."""
    keys = nodes.select("node", "size", F.explode("bands").alias("key"))
    best = keys.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n"), F.sum("size").alias("shingles"), F.bit_xor(F.xxhash64("node")).alias("sign")).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / NODES, F.col("shingles") / SHINGLES)).cast("int").alias("parts")
    best = best.groupBy("low", "n", "sign", "shingles").agg(F.min("key").alias("key")).select("key", "low", parts)
    keys = cut(keys.join(best, "key").select("key", "node", "low", "parts"))  # those of buckets with company alone
    wanted = nodes.join(keys.select("node").distinct(), "node", "left_semi").select("node", _key(F.col("best.doc_id")).alias("k_id"), F.col("best.text_hash").alias("k_text"))
    texts = docs.select(_key(F.col(f"`{doc_id}`")).alias("k_id"), F.xxhash64(text).alias("k_text"), F.col(text).alias("text"))
    sets = cut(_shingles(texts.join(wanted, ["k_id", "k_text"])).dropDuplicates(["node"]))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    mine = keys.select("key", "node", F.explode(F.when(F.col("node") == F.col("low"), every).otherwise(F.array(own))).alias("lo"))
    within = cut(_verified(mine.join(sets, "node").withColumns({"hi": F.col("lo"), "label": F.col("node"), "hub": F.lit(True)}), least))
    long = keys.where("parts > 1")
    if not long.take(1):
        return within
    group = cut(components(within)).select(F.col("node").alias("of"), "component")
    long = cut(long.join(group, F.col("node") == F.col("of"), "left").select("key", "node", "parts", own.alias("own"), F.coalesce("component", "node").alias("label")))
    mixed = long.groupBy("key").agg(F.min("label").alias("c1"), F.max("label").alias("c2")).where("c1 <> c2").select("key")
    dealt = long.join(mixed, "key", "left_semi").withColumn("other", F.explode(every)).where("own <> other")
    dealt = dealt.select("key", "node", "label", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") < F.col("other")).alias("hub"))
    return within.unionByName(_verified(dealt.join(sets, "node"), least))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all its columns; as ``simhash.keep_one``."""
    members = cut(_members(docs, doc_id, text))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best")
    nodes = cut(members.groupBy("node").agg(best, F.first("size").alias("size"), F.first("bands").alias("bands")))
    of_fp = cut(members.groupBy("fp").agg(F.min("node").alias("low")))
    same = members.join(of_fp, "fp").select(F.col("node").alias("a"), F.col("low").alias("b"))
    name = lambda f, c: of_fp.select(F.col("fp").alias(f), F.col("low").alias(c))
    close = simhash.links(of_fp).select(F.col("a").alias("f"), F.col("b").alias("g")).join(name("f", "a"), "f").join(name("g", "b"), "g").select("a", "b")
    edges = same.unionByName(close).unionByName(similar(docs, nodes, doc_id, text)).where("a <> b")
    group = cut(components(edges)).select(F.col("node").alias("of"), "component")
    chosen = nodes.join(group, F.col("node") == F.col("of"), "left").groupBy(F.coalesce("component", "node").alias("c")).agg(F.min("best").alias("chosen"))
    return simhash.keep_chosen(docs, members, chosen, doc_id, text)
