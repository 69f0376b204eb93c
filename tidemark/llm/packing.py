"""Best-fit packing of tokenized documents by bin completion.

Lengths are whole numbers up to the capacity, so a plan needs only their histogram, of at most
``capacity`` counts whatever the corpus. Best-fit decreasing on the histogram is the first
incumbent. Where it misses the lower bound, bin completion branches on the undominated fillings
around the largest document left and prunes by the waste that an incumbent of one bin less could
spare: first over the bins that best fit left with waste, then over all. Each search ends at the
lower bound or after ``nodes`` branches, the only cap; a search that ends before is exact. The plan
is a list of patterns with repeats; documents take places by their rank among those of their length.

Tokenizing, writing and ranking are distributed: the pieces are written once, and a common length is
ranked in parts, so that no length gathers in one task, whatever the corpus.

Cases: null text is empty text and gives the closing id alone; longer documents are cut every
``capacity`` ids; repeated rows and null ids are packed as rows of their own; an empty table gives
no rows; other columns are ignored. A very long text is tokenized in parts cut at white space; only a
word without any is tokenized at once. Pieces of equal length are ranked by doc_id and piece; which of
several equal rows takes which place is not defined.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

CAPACITY = 4096
#: Branches of each search of the plan.
NODES = 400
#: A length is ranked in parts of about a 512th of all pieces, within these bounds.
LEAST_RANKED, MOST_RANKED = 1000, 1_000_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


BLANK = re.compile("[ \t\n\v\f\r]")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return {b: chr(b) if b in prints else chr(next(rest)) for b in range(256)}


BYTE_LETTERS = _byte_letters()


class WordIds:
    """Ids of texts, cut into words at ASCII white space. The tokenizer's normalizer and splitter never
    look across white space, so a text's ids are those of its words in turn.

    A batch is split and its distinct words are numbered by Arrow; only words that no batch since the
    last ``MOST`` new ones had are tokenized. Of those, words of plain letters and marks are lowered
    and split here, as the tokenizer does it, and go to its model in one call; others go to the whole
    tokenizer one by one.
    """

    MOST = 1_000_000
    #: Texts are numbered in parts of about so many characters, so memory doesn't grow with a text of words.
    PART = 2_000_000
    PLAIN = re.compile("[\x21-\x7e\xa1-\u024f\u0400-\u0482\u048a-\u04ff]+")
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.tokenizer.model)  # knows no normalizer or splitter but white space
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.pool, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, words: list[str]) -> None:
        """Number new words and add their ids to the pool."""
        plain, pieces, counts, other = [], [], [], []
        for w in words:
            if not self.PLAIN.fullmatch(w) or "<|" in w:
                other.append(w)
                continue
            low = w.lower()
            parts = [low] if low.isalpha() else self.SPLIT.findall(low)
            if low.isascii() or self.PLAIN.fullmatch(low):
                plain.append(w)
                counts.append(len(parts))
                pieces += parts if low.isascii() else [p.encode().decode("latin-1").translate(BYTE_LETTERS) for p in parts]
            else:
                other.append(w)
        lines = [" ".join(pieces[i : i + 500]) for i in range(0, len(pieces), 500)]
        ids = [np.asarray(e.ids, "<u4") for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate([np.zeros(0, "<u4"), *ids])
        ends = np.flatnonzero(self.last[flat]) + 1
        if len(ends) != len(pieces):  # a model whose last tokens can't be told apart
            plain, flat, ends, counts, other = [], flat[:0], ends[:0], [], words
        stop = np.concatenate([[0], ends])[np.cumsum([0, *counts])]
        rest = [self.of(w) for w in other]
        sizes = np.concatenate([np.diff(stop), np.array([len(r) for r in rest], np.int64)])
        at = len(self.pool)
        self.pool = np.concatenate([self.pool, flat, *rest])
        self.start = np.concatenate([self.start, at + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.number.update(zip(plain + other, range(len(self.number), len(self.number) + len(words))))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and where each text's ids end."""
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.number) > self.MOST:
            self.forget()
        if new := [w for w in words if w not in self.number]:
            self.learn(new)
        k = np.array([self.number[w] for w in words], np.int64)[coded.indices.to_numpy()]
        size = self.size[k]
        upto = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.start[k] - upto[:-1], size) + np.arange(upto[-1])
        offsets = split.offsets.to_numpy()
        return self.pool[at], upto[offsets[1:] - offsets[0]]

    def parts(self, texts: pa.Array) -> Iterator[tuple[int, str]]:
        """(row, text), long texts in parts cut at white space, a text at least once."""
        for row, text in enumerate(texts.to_pylist()):
            at, text = 0, text or ""
            while len(text) - at > self.PART and (space := BLANK.search(text, at + self.PART)):
                yield row, text[at : space.start()]
                at = space.end()
            yield row, text[at:] if at else text

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(row, ids) in order; the ids of a long text come in several turns."""
        held: list[tuple[int, str]] = []

        def flush() -> Iterator[tuple[int, np.ndarray]]:
            ids, ends = self.ids(pa.array([t for _, t in held], pa.string()))
            for (row, _), a, b in zip(held, [0, *ends[:-1].tolist()], ends.tolist()):
                yield row, ids[a:b]

        chars = 0
        for part in self.parts(texts):
            held.append(part)
            chars += len(part[1])
            if chars > self.PART:
                yield from flush()
                held, chars = [], 0
        if held:
            yield from flush()


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
    return WordIds(path)


def cut_pieces(path: str, capacity: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path), np.asarray([end_id], "<u4")
        for b in batches:
            rows, sizes, crcs = [], [], []
            for row, turns in groupby(words.encode(b.column(1)), lambda r: r[0]):
                ids = np.concatenate([*(t for _, t in turns), end])
                for at in range(0, len(ids), capacity):
                    x = ids[at : at + capacity]
                    rows.append((row, at))
                    sizes.append(len(x))
                    crcs.append(zlib.crc32(x))
            at = np.array(rows, np.int64).reshape(-1, 2)
            columns = [b.column(0).take(pa.array(at[:, 0])), pa.array((at[:, 1] // capacity).astype(np.int32)), pa.array(at[:, 1]), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


# --- the plan -----------------------------------------------------------------------------------

Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: patterns and how many bins each fills."""
    open_: dict[int, list[tuple[Pattern, int]]] = {}  # by room left
    rooms: list[int] = []  # its keys in order

    def put(room: int, pattern: Pattern, bins: int) -> None:
        if bins:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pattern, bins))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        for room in rooms[bisect_left(rooms, length) :]:
            if not left:
                break
            each = room // length
            rooms.remove(room)
            for pattern, bins in open_.pop(room):
                full, rest = min(bins, left // each), 0
                left -= full * each
                if full < bins and left:
                    rest, left = left, 0
                    put(room - rest * length, pattern + ((length, rest),), 1)
                put(room - each * length, pattern + ((length, each),), full)
                put(room, pattern, bins - full - bool(rest))
        each = capacity // length
        put(capacity - each * length, ((length, each),), left // each)
        if left % each:
            put(capacity - left % each * length, ((length, left % each),), 1)
    return [x for group in open_.values() for x in group]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello and Toth's L2: for each k, documents over capacity - k stand alone with what can't join them."""
    if not hist:
        return 0
    sizes = np.array(sorted(hist))
    counts = np.array([hist[int(s)] for s in sizes], dtype=np.int64)
    best = max(-(-int((sizes * counts).sum()) // capacity), int(counts[sizes > capacity // 2].sum()))
    n_up = np.concatenate([[0], counts.cumsum()])  # documents below a place, and their lengths
    sum_up = np.concatenate([[0], (sizes * counts).cumsum()])
    half = np.searchsorted(sizes, capacity // 2, side="right")
    k = np.arange(half)  # each small size as the least that counts
    mid = np.searchsorted(sizes, capacity - sizes[k], side="right")
    room = (n_up[mid] - n_up[half]) * capacity - (sum_up[mid] - sum_up[half])
    extra = np.maximum(0, -(-(sum_up[half] - sum_up[k] - room) // capacity))
    return max(best, int((n_up[-1] - n_up[half] + extra).max(initial=0)))


def fillings(hist: dict[int, int], room: int, most_waste: int) -> Iterator[tuple[int, Pattern]]:
    """(waste, filling) of ``room``, all undominated ones of up to ``most_waste``, least waste first.

    A filling is dominated, and not given, if a document left over fits beside it, or fits in the
    place of a smaller one or of two that it isn't smaller than together. Sums that the documents
    from each size down can make are bits of a number, so the walk meets no dead ends.
    """
    sizes = sorted((s for s in hist if s <= room), reverse=True)
    reach = [1]
    for s in reversed(sizes):
        sums, left, step = reach[-1], min(hist[s], room // s), 1
        while left:
            n = min(step, left)
            sums |= sums << n * s
            left, step = left - n, 2 * step
        reach.append(sums & (1 << room + 1) - 1)
    reach.reverse()  # reach[i]: sums of sizes[i:]

    def walk(i: int, target: int, taken: Pattern) -> Iterator[Pattern]:
        while target and sizes[i] > target:
            i += 1
        if not target:
            yield taken
            return
        size = sizes[i]
        for n in range(min(hist[size], target // size), -1, -1):
            if reach[i + 1] >> target - n * size & 1:
                yield from walk(i + 1, target - n * size, taken + ((size, n),) if n else taken)

    ascending = sizes[::-1]

    def dominated(waste: int, filling: Pattern) -> bool:
        used = dict(filling)
        spare = lambda low, high: any(hist[s] > used.get(s, 0) for s in ascending[bisect_left(ascending, low) : bisect_right(ascending, high)])
        if spare(0, waste) or any(spare(s + 1, s + waste) for s in used):
            return True
        return any(spare(a + b, a + b + waste) for a in used for b in used if a > b or a == b and used[a] > 1)

    for waste in range(min(room, most_waste) + 1):
        if reach[0] >> room - waste & 1:
            for f in walk(0, room - waste, ()):
                if not dominated(waste, f):
                    yield waste, f


def search(hist: dict[int, int], capacity: int, nodes: int) -> tuple[list[tuple[Pattern, int]], bool]:
    """Bin completion with best-fit incumbents: the best plan found, and whether it is proven to be one of fewest bins.

    A branch fills one bin around the largest document left with an undominated filling; the same
    filling is first tried in as many bins as the counts allow. The waste that fillings may leave is
    bounded by what an incumbent of one bin less has to spare. Proven: the plan meets the lower
    bound, or the search ended before ``nodes`` branches, of any kind, were made.
    """
    best = best_fit(hist, capacity)
    best_n = sum(n for _, n in best)
    bound = lower_bound(hist, capacity)
    total = sum(s * n for s, n in hist.items())
    left = nodes
    now = dict(hist)  # changed and restored in place, so the search holds one histogram
    used: list[tuple[Pattern, int]] = []

    def take(need: dict[int, int], times: int) -> None:
        for s, c in need.items():
            now[s] = now.get(s, 0) - times * c
            if not now[s]:
                del now[s]

    def go(n: int, waste: int) -> None:
        nonlocal best, best_n, left
        left -= 1
        if best_n <= bound or left < 0 or n + lower_bound(now, capacity) >= best_n:
            return
        tail = best_fit(now, capacity)
        if n + (m := sum(k for _, k in tail)) < best_n:
            best, best_n = used + tail, n + m
        if not now:
            return
        top = max(now)
        rest = {s: c for s, c in now.items() if s != top or c > 1}
        if now[top] > 1:
            rest[top] = now[top] - 1
        for w, f in fillings(rest, capacity - top, (best_n - 1) * capacity - total - waste):
            need = Counter(dict(f)) + Counter({top: 1})
            most = min(now[s] // c for s, c in need.items())
            for times in dict.fromkeys((most, 1)):
                if best_n <= bound or left < 0 or waste + times * w > (best_n - 1) * capacity - total:
                    continue
                take(need, times)
                used.append((tuple(sorted(need.items(), reverse=True)), times))
                go(n + times, waste + times * w)
                used.pop()
                take(need, -times)
            if best_n <= bound or left < 0:
                return

    depth = sys.getrecursionlimit()
    sys.setrecursionlimit(max(depth, 4 * nodes + 5000))
    try:
        go(0, 0)
    finally:
        sys.setrecursionlimit(depth)
    return best, best_n <= bound or left >= 0


def complete(hist: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[Pattern, int]]:
    """A plan of as few bins as the node budget finds.

    If best fit misses the lower bound, its bins with waste are packed anew as an instance of their
    own, then all bins; each search has ``nodes`` branches. ``search`` tells whether a plan is proven.
    """
    plan = best_fit(hist, capacity)
    bound = lower_bound(hist, capacity)
    waste = lambda p: capacity - sum(s * c for s, c in p)
    if sum(n for _, n in plan) > bound:
        full = [(p, n) for p, n in plan if not waste(p)]
        loose: Counter = Counter()
        for p, n in plan:
            if waste(p):
                loose.update({s: c * n for s, c in p})
        plan = full + search(loose, capacity, nodes)[0]
    if (fewest := sum(n for _, n in plan)) > bound:
        whole = search(hist, capacity, nodes)[0]
        plan = whole if sum(n for _, n in whole) < fewest else plan
    return plan


def places(patterns: list[tuple[Pattern, int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, copies in a sequence, offset), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for length, copies in pattern:
            rows[length].append((rank[length], sequence, copies, offset))
            rank[length] += times * copies
            offset += length * copies
        sequence += times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1, nodes: int = NODES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    spark = docs.sparkSession
    pieces = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut_pieces(tokenizer_path, capacity, end_id), PIECES))
    hist = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = max(LEAST_RANKED, min(MOST_RANKED, sum(hist.values()) // 512))
    deal = spark.createDataFrame([(k, -(-n // rows)) for k, n in hist.items()], "of_length int, parts int")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32") + F.spark_partition_id(), F.col("parts")).cast("int")
    pieces = pieces.join(F.broadcast(deal), F.col("length") == F.col("of_length")).withColumn("salt", salt).drop("of_length", "parts")  # at most ``capacity`` rows
    base: dict[int, list[int]] = defaultdict(lambda: [0])
    for r in sorted(pieces.groupBy("length", "salt").count().collect()):  # a row for each part
        own = base[r["length"]]
        own += [own[-1]] * (r["salt"] + 1 - len(own)) + [own[-1] + r["count"]]
    base = {k: np.array(v, np.int64) for k, v in base.items()}
    plan = spark.sparkContext.broadcast((places(complete(hist, capacity, nodes)), base))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spots, first = plan.value
        for b in batches:
            sequence, offset = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for length, at in b.groupby("length").indices.items():
                rows = spots[int(length)]
                rank = b["rank"].to_numpy()[at] + first[int(length)][b["salt"].to_numpy()[at]]
                k = np.searchsorted(rows[:, 0], rank, side="right") - 1
                nth = rank - rows[k, 0]
                sequence[at] = rows[k, 1] + nth // rows[k, 2]
                offset[at] = rows[k, 3] + nth % rows[k, 2] * int(length)
            yield b.drop(columns=["salt", "rank"]).assign(doc_id=b["doc_id"].astype("Int64"), sequence_id=sequence, offset=offset)

    ranked = pieces.withColumn("rank", (F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1).cast("long"))
    out = ranked.mapInPandas(place, "doc_id long, piece int, start long, length int, ids_crc32 long, sequence_id long, offset long")
    return out.withColumn("length", F.col("length").cast("long"))
