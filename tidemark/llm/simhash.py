"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

The 64 bits are cut into segments of 21, 21 and 22 bits, each read as a word of the perfect binary
Golay code (23, 12, 7). The keys of a segment are the codewords to which the word and all words
one bit away decode: one, or six for words at distance 3. Two words up to two bits apart share the
key of a word between them. Of three errors in all,

* either some segment has none; then it, exact, and the keys of the next one, or of the one whose
  next it is, meet (three key kinds), or
* each segment has one; then the keys of the first and an errorless half of each other one meet
  (four key kinds).

So every pair within three bits shares a key of 33 bits or more, and random pairs seldom do.
Buckets are streamed in key order; a bucket of over ``BUCKET`` distinct fingerprints is dealt out in parts,
and each pair of parts is compared for itself. A task compares what it holds in blocks, and returns a
forest of links, never pairs.

Cases: null text is empty text; a text without words has fingerprint zero, linked like any other;
repeated rows share a component; a null doc_id is a row that never names a component unless all
of it are null; an empty table gives no rows; other columns are ignored. A very long text is one row in
memory with 8 bytes a word. Of a component's rows of the smallest doc_id the one of the least text hash stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut
from tidemark.llm.graph import components

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DISTANCE = 3
#: Fingerprints of a bucket that a task holds of either of two parts.
BUCKET = 4000


# --- fingerprints -------------------------------------------------------------------------------


def shingle_hashes(text: str | None, words_each: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of words, repeats included; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= words_each:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    pairs = zip(starts[: len(words) - words_each + 1].tolist(), (ends[words_each - 1 :] - 1).tolist())
    return np.array([h(joined[a:b], seed) for a, b in pairs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) of each document's whole text; fp holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingle_hashes(t.as_py())) for t in b.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


# --- Golay keys ---------------------------------------------------------------------------------

GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of d * x^11, and the error of weight 3 at most with each remainder."""

    def rem(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GENERATOR << (i - 11)
        return x

    high = np.array([rem(d << 11) for d in range(4096)], np.uint32)
    error = np.zeros(2048, np.uint32)
    one = [1 << i for i in range(23)]
    for i in range(23):
        for e in [one[i]] + [one[i] | one[j] for j in range(i)] + [one[i] | one[j] | one[k] for j in range(i) for k in range(j)]:
            error[high[e >> 11] ^ (e & 0x7FF)] = e
    return high, error


HIGH, ERROR = _tables()


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the only codeword within three bits of each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ ERROR[HIGH[words >> 11] ^ (words & 0x7FF)]) >> 11


def near_keys(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): the distinct indices of each word and of the words one bit away."""
    flips = np.array([0] + [1 << i for i in range(bits)], np.uint32)
    keys = np.sort(decode(words.astype(np.uint32)[:, None] ^ flips), axis=1)
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    return np.nonzero(new)[0], keys[new]


SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) such that any two fingerprints within three bits share a key."""
    fps = fps.view(np.uint64)
    part = [(fps >> np.uint64(at)) & np.uint64((1 << n) - 1) for at, n in SEGMENTS]
    golay = [near_keys(p, n) for p, (_, n) in zip(part, SEGMENTS)]
    rows, keys = [], []
    for i in range(3):
        row, k = golay[(i + 1) % 3]
        rows.append(row)
        keys.append(np.uint64(i << 60) | (part[i][row] << np.uint64(12)) | k.astype(np.uint64))
    row, k = golay[0]
    for a in (0, 1):
        for b in (0, 1):
            half_a = (part[1] >> np.uint64(11 * a)) & np.uint64(0x7FF)
            half_b = (part[2] >> np.uint64(11 * b)) & np.uint64(0x7FF)
            rows.append(row)
            keys.append(np.uint64((3 + 2 * a + b) << 60) | (half_a[row] << np.uint64(23)) | (half_b[row] << np.uint64(12)) | k.astype(np.uint64))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


# --- links --------------------------------------------------------------------------------------


def forest(fps: np.ndarray, distance: int = DISTANCE, block: int = 1024) -> np.ndarray:
    """For each fingerprint the first position of its component under links of ``distance`` bits, in this bucket."""
    label = np.arange(len(fps))
    while True:
        new = label.copy()
        for a in range(0, len(fps), block):
            for b in range(0, len(fps), block):
                near = np.bitwise_count(fps[a : a + block, None] ^ fps[None, b : b + block]) <= distance
                low = np.where(near, label[None, b : b + block], len(fps)).min(axis=1)
                new[a : a + block] = np.minimum(new[a : a + block], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that make the same components as all pairs within ``distance``."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            for at in range(0, len(fp), 20_000):
                part = fp[at : at + 20_000]
                row, key = fuzzy_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # key, lo, hi, fp

        def done(rows: np.ndarray) -> pa.RecordBatch:
            fp = rows[3]
            cuts = np.flatnonzero(np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])) if len(fp) else np.zeros(0, int)
            size = np.diff(np.append(cuts, len(fp)))
            two = cuts[size == 2]
            two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= distance]
            a, b = [fp[two]], [fp[two + 1]]
            for at, n in zip(cuts[size > 2], size[size > 2]):
                own = fp[at : at + n]
                first = forest(own.view(np.uint64), distance)
                linked = np.flatnonzero(first != np.arange(n))
                a.append(own[linked])
                b.append(own[first[linked]])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns])], axis=1)
            if not rows.shape[1]:
                continue
            last = int(np.flatnonzero((rows[:3] == rows[:3, -1:]).all(axis=0))[0])
            yield done(rows[:, :last])
            held = rows[:, last:]
        yield done(held)

    keyed = fps.select("fp").mapInArrow(emit, "key long, fp long")
    long = cut(keyed.groupBy("key").count().where(F.col("count") > BUCKET).select(F.col("key").alias("long_key"), F.ceil(F.col("count") / BUCKET).cast("int").alias("parts")))
    if long.take(1):
        dealt = keyed.join(long, F.col("key") == F.col("long_key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    else:
        dealt = keyed.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(verify, "a long, b long").distinct()


def _groups(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of all documents; and the smallest doc_id of the component of each distinct one, with a row that has it."""
    members = cut(fingerprints(docs, doc_id, text))
    best = lambda c: F.min(c).alias("best")
    first = cut(members.groupBy("fp").agg(best(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))))
    nodes = cut(components(links(first)))
    low = cut(nodes.join(first, F.col("node") == F.col("fp")).groupBy("component").agg(best("best")).select(F.col("component").alias("c"), F.col("best").alias("low")))
    named = nodes.join(low, F.col("component") == F.col("c")).select("node", "low")
    return members, cut(first.join(named, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("of_fp"), F.coalesce("low", "best").alias("chosen")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every document; component_id is the smallest doc_id reachable by links."""
    members, named = _groups(docs, doc_id, text)
    return members.join(named, F.col("fp") == F.col("of_fp")).select("doc_id", "fp", F.col("chosen.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, the one of the smallest doc_id, with all its columns.

    Of rows that share that id the one of the least text hash stays, and of equal rows any one.
    """
    return keep_chosen(docs, *_groups(docs, doc_id, text), doc_id, text)


def keep_chosen(docs: DataFrame, members: DataFrame, named: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` (all of them in ``members``) that are ``chosen`` in ``named``."""
    chosen = cut(named.select("chosen.doc_id", "chosen.text_hash").distinct())
    key = lambda id_: F.coalesce(id_.cast("long"), F.lit(-(1 << 63)))
    keys = chosen.select(key(F.col("doc_id")).alias("k_id"), F.col("text_hash").alias("k_text"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key(F.col(f"`{doc_id}`")).alias("r_id"), F.xxhash64(text).alias("r_text"))
    kept = packed.join(keys, (F.col("r_id") == F.col("k_id")) & (F.col("r_text") == F.col("k_text")), "left_semi")
    if members.groupBy("doc_id", "text_hash").count().where("count > 1").take(1):  # else nothing is repeated
        kept = kept.dropDuplicates(["r_id", "r_text"])
    return kept.select("row.*")
