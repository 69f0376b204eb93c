"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the sum of the vectors of its hashed character n-grams (with word borders) and of the
word itself; a document is the mean over all its words; a softmax layer scores it. Vectors and
layer are trained together in numpy on a bounded sample of labelled rows. Misspellings that were
never seen share most n-grams with the words they come from. The trained model is linear in the
bag, so scoring needs one number for each word, which is kept for words that come again.

Cases: null text is empty text; a document without words scores the bias alone; repeated rows are
scored alike, and are one row of the sample; equal places in hash order are settled by doc_id and
text; without rows of both labels every score is the smoothed share of label 1 (0.5 without any
row); an empty table gives no rows; other columns are ignored. Very long texts and words are scored
whole, and are left out of the sample if over ``ROW_BYTES``. A document's label is the greatest that it has.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: The sample for training: at most so many rows, of so many bytes of text in all, and a row of so many.
SAMPLE_ROWS, SAMPLE_BYTES, ROW_BYTES = 3000, 10_000_000, 200_000
#: Characters whose n-grams are hashed at once, and characters of texts that are scored together.
BLOCK, GROUP = 1 << 16, 1 << 20
#: Usual share of a telling n-gram in a document.
SCALE = 0.003


def _ngrams(pieces: list[tuple[int, str]], buckets: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of the n-grams that start in the first ``BLOCK`` characters of each piece, by a polynomial in the code points."""
    code = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.array([len(p) for _, p in pieces])
    end = np.cumsum(length)
    place = np.arange(len(code))
    left = np.repeat(end, length) - place
    own = place - np.repeat(end - length, length) < BLOCK
    word = np.repeat(np.array([i for i, _ in pieces]), length)
    h, rows, out = np.zeros(len(code), np.uint64), [], []
    for n in range(1, high + 1):
        starts = max(0, len(code) - n + 1)
        h[:starts] = h[:starts] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n >= low:
            at = np.flatnonzero((left >= n) & own)
            x = h[at] + np.uint64(n)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            rows.append(word[at])
            out.append(((x >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(out)


def bags(words: list[str], buckets: int, low: int = 3, high: int = 6) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the word, bucket) of each word itself and of the n-grams of whole words, in blocks, so memory doesn't grow with a word."""
    marked = [f"<{w}>" for w in words]
    yield np.arange(len(words)), np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in marked], np.int64)
    held, size = [], 0
    for i, w in enumerate(marked):
        for at in range(0, len(w), BLOCK):
            piece = w[at : at + BLOCK + high - 1]
            if held and size + len(piece) > BLOCK + high:
                yield _ngrams(held, buckets, low, high)
                held, size = [], 0
            held.append((i, piece))
            size += len(piece)
    if held:
        yield _ngrams(held, buckets, low, high)


def grams(word: str, buckets: int, low: int = 3, high: int = 6) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a whole word and of the word itself, in blocks."""
    return (g for _, g in bags([word], buckets, low, high))


@dataclass
class Model:
    """logit of a document = mean over its words of ``weight`` summed over their n-grams, plus bias."""

    weight: np.ndarray
    bias: float
    buckets: int

    def scorer(self):
        return Scorer(self)


class Scorer(dict):
    """Weights of words, kept for words that come again."""

    MOST = 400_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def weigh(self, words: list[str]) -> list[float]:
        total, n = np.zeros(len(words)), np.zeros(len(words))
        for i, g in bags(words, self.model.buckets):
            if len(i):
                low, high = i.min(), i.max() + 1
                total[low:high] += np.bincount(i - low, self.model.weight[g], high - low)
                n[low:high] += np.bincount(i - low, minlength=high - low)
        return (total / np.maximum(n, 1)).tolist()

    def __missing__(self, word: str) -> float:
        return self.weigh([word])[0]

    def _scores(self, texts: list[str | None]) -> list[float]:
        found = [WORD.findall((t or "").lower()) for t in texts]
        if len(self) > self.MOST:
            self.clear()
        new = list({w for words in found for w in words if w not in self})
        self.update(zip(new, self.weigh(new)))
        z = np.array([self.model.bias + (sum(map(self.__getitem__, words)) / len(words) if words else 0.0) for words in found])
        for w in new:
            if len(w) >= 64:
                del self[w]
        return (1 / (1 + np.exp(-np.clip(z, -500, 500)))).tolist()

    def scores(self, texts: list[str | None]) -> list[float]:
        """Scores of whole texts; the words of about ``GROUP`` characters of text are weighed together."""
        out, held, size = [], [], 0
        for t in texts:
            held.append(t)
            size += len(t or "")
            if size >= GROUP:
                out += self._scores(held)
                held, size = [], 0
        return out + self._scores(held) if held else out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


def train(texts: list[str | None], labels: list[int], buckets: int = 1 << 18, dim: int = 4, epochs: int = 100, rate: float = 0.05, decay: float = 1e-4, least: int = 20, seed: int = 7) -> Model:
    """Joint training of n-gram vectors and softmax layer by Adam on the whole sample.

    N-grams of fewer than ``least`` sample documents keep a zero vector: they would only be learnt by heart.
    """
    if len(set(labels)) < 2:
        ones = sum(labels)
        return Model(np.zeros(buckets), math.log((ones + 1) / (len(labels) - ones + 1)), buckets)
    cols, vals, ends = [], [], []
    for t in texts:
        words = Counter(WORD.findall((t or "").lower()))
        parts = list(bags(list(words), buckets))  # a sampled text has ``ROW_BYTES`` at most
        i, g = (np.concatenate(x) for x in zip(*parts))
        share = np.array(list(words.values()), float) / max(1, sum(words.values())) / np.bincount(i, minlength=len(words))
        c, inverse = np.unique(g, return_inverse=True)
        cols.append(c.astype(np.int32))
        vals.append((np.bincount(inverse, share[i], len(c)) / SCALE).astype(np.float32))
        ends.append(len(c))
    row = np.repeat(np.arange(len(texts), dtype=np.int32), ends)
    col, val = np.concatenate(cols), np.concatenate(vals)
    spread = np.bincount(col, minlength=buckets)
    used = np.flatnonzero(spread >= least)
    place = np.full(buckets, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    col = place[col]
    keep = col >= 0
    row, col, val = row[keep], col[keep], val[keep]
    if not len(used):
        return Model(np.zeros(buckets), float(np.log(np.mean(labels) / (1 - np.mean(labels)))), buckets)
    by_col = np.argsort(col, kind="stable").astype(np.int32)
    t_row, t_val = row[by_col], val[by_col]
    rows, row_at = np.unique(row, return_index=True)
    _, col_at = np.unique(col[by_col], return_index=True)
    del by_col, keep
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.01, (len(used), dim)).astype(np.float32)
    layer = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    prior = float(np.mean(labels))
    bias = np.array([np.log(1 - prior), np.log(prior)], np.float32)
    y = np.eye(2, dtype=np.float32)[labels]
    state = [(p, np.zeros_like(p), np.zeros_like(p)) for p in (vectors, layer, bias)]
    mean, g_vectors = np.zeros((len(texts), dim), np.float32), np.zeros_like(vectors)
    for step in range(1, epochs + 1):
        for d in range(dim):
            mean[rows, d] = np.add.reduceat(vectors[:, d][col] * val, row_at)
        z = mean @ layer + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        err = (p - y) / len(y)
        g_mean = err @ layer.T
        for d in range(dim):
            g_vectors[:, d] = np.add.reduceat(g_mean[:, d][t_row] * t_val, col_at)
        for (x, m, v), g in zip(state, (g_vectors + decay * vectors, mean.T @ err + decay * layer, err.sum(0))):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weight = np.zeros(buckets)
    weight[used] = vectors @ (layer[:, 1] - layer[:, 0]) / SCALE
    return Model(weight, float(bias[1] - bias[0]), buckets)


def sample(docs: DataFrame, labels: DataFrame, train_rows, label: str = "toxic", rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES, row_bytes: int = ROW_BYTES) -> tuple[list, list]:
    """Whole texts and labels of labelled rows in hash order, without those of over ``row_bytes``, up to ``rows`` and ``most_bytes``."""
    marked = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull() & train_rows(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    order = ["h", "doc_id", "t"]
    narrow = docs.select("doc_id", size.alias("n"), F.xxhash64("text").alias("t")).where(F.col("n") <= row_bytes).join(marked, "doc_id")
    narrow = narrow.withColumn("h", F.xxhash64(F.lit("toxicity"), "doc_id")).dropDuplicates(["doc_id", "t"]).orderBy(*order).limit(rows)
    chosen = narrow.withColumn("sum", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("sum") <= most_bytes)  # ``rows`` rows at most
    keys = chosen.select(F.col("doc_id").alias("c_id"), F.col("t").alias("c_t"), "h", "y")
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    got = texts.join(F.broadcast(keys), (F.col("doc_id") == F.col("c_id")) & (F.col("t") == F.col("c_t"))).dropDuplicates(["doc_id", "t"])
    taken = got.select("text", "y", *order).orderBy(*order).collect()  # ``most_bytes`` at most
    return [r["text"] for r in taken], [int(r["y"]) for r in taken]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every document's whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = shipped.value.scorer()
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": np.array(scorer.scores(b["text"].tolist()), dtype=float)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, score double")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2
