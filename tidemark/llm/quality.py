"""Document quality by co-training of two views.

One classifier sees the text's content (byte frequencies, words, repetition, lines), the other
the document's metadata (source, language, length, which the text view doesn't see). Both start from
the labelled rows. In each round, either view labels the unlabelled rows of which it is most
confident, and the other view learns from them. Each view is then calibrated by Platt's method on
labelled rows that neither has learnt from, and the views are combined as independent evidence: their
calibrated log-odds are added and the prior, which both contain, is taken off once. A view that knows
nothing calibrates to the prior and so changes nothing.

Only labelled rows are sampled (``LABELLED`` documents at most); all others are the pool. Features
are made once, where the whole texts are, and written; in each round every row of the pool is scored
and the most confident ones are found by a top-k in each task, then over tasks in ``MERGE`` parts, then
over those. The driver gets the features of the chosen rows alone.

Cases: null text is empty text; null metadata is a value of its own; without labels of both kinds
every document scores 1; repeated rows score alike and teach once; of several texts of a labelled
doc_id the one of the least features is learnt from; equal confidence is settled by a hash of the
features; a document's label is the greatest that it has; an empty table gives no rows; other columns
are ignored, or kept by ``keep_good``. A very long text is one row in memory while its features are made.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Labelled documents to learn from, at most.
LABELLED = 3000
#: Rounds of the exchange, rows that a view teaches in each, and the confidence that it takes.
ROUNDS, EACH, SURE = 4, 100, 0.95
MERGE = 64


def text_features(text: str | None) -> np.ndarray:
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.sqrt(np.bincount(raw, minlength=256) / max(1, len(raw)))
    words = text.split()
    n = len(words)
    seen = Counter(words)
    lines = text.split("\n")
    lengths = np.array([len(w) for w in words] or [0])
    common = max(seen.values(), default=0)
    pairs = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(not w[-1].isalnum() for w in words)
    more = [
        lengths.mean() / 10, lengths.std() / 10, len(seen) / max(1, n), common / max(1, n), pairs / max(1, n), odd / max(1, n),
        sum(w.isupper() for w in words) / max(1, n), sum(w.isalpha() for w in words) / max(1, n), len(set(lines)) / len(lines), math.log1p(n / len(lines)),
    ]
    return np.concatenate([share, more]).astype(np.float32)


TEXT, META = 256 + 10, (64, 16, 24)


def meta_places(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """The places of a document's three metadata features that are set."""
    place = lambda x, n: zlib.crc32((x if x is not None else "\0").encode("utf-8", "surrogatepass")) % n
    return [place(source, META[0]), META[0] + place(lang, META[1]), META[0] + META[1] + (23 if n_chars is None else min(22, max(0, int(n_chars)).bit_length()))]


def one_hot(places: np.ndarray) -> np.ndarray:
    x = np.zeros((len(places), sum(META)))
    x[np.arange(len(places))[:, None], places] = 1
    return x


@dataclass
class View:
    """A logistic regression on standardised features, with its calibration a * z + b."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(1))
    a: float = 1.0
    b: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight[:-1] + self.weight[-1]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.a * self.raw(x) + self.b


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 25) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-6)) @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray, ridge: float = 3.0) -> View:
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1e9  # a feature that never varied says nothing
    return View(mean, scale, _newton((x - mean) / scale, y, ridge))


@dataclass
class Model:
    text: View | None = None
    meta: View | None = None
    prior: float = 0.0

    def scores(self, x_text: np.ndarray, x_meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view, and both."""
        if self.text is None:
            one = np.ones(len(x_text))
            return one, one, one
        a, b = self.text.logit(x_text), self.meta.logit(x_meta)
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


@dataclass
class Ask:
    """What a view teaches in a round: ``count`` rows that it gives ``label`` with a probability of ``bar`` or more."""

    teacher: str
    label: int
    count: int
    bar: float


Pool = Callable[[dict[str, View], list[Ask], dict[str, set[int]]], list[tuple[Ask, int, np.ndarray, np.ndarray]]]


def most_confident(models: dict[str, View], asks: list[Ask], taken: dict[str, set[int]], keys: np.ndarray, text: np.ndarray, meta: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ask the best of these rows, distinct by key, which ``taken`` doesn't hold: (row, probability), best first."""
    p = {"text": _sigmoid(models["text"].raw(text)), "meta": _sigmoid(models["meta"].raw(meta))}
    free = {name: ~np.isin(keys, np.fromiter(t, np.int64, len(t))) for name, t in taken.items()}
    _, first = np.unique(keys, return_index=True)
    own = np.zeros(len(keys), bool)
    own[first] = True
    out = []
    for a in asks:
        q = p[a.teacher] if a.label else 1 - p[a.teacher]
        at = np.flatnonzero(own & free[a.teacher] & (q >= a.bar))
        at = at[np.lexsort((keys[at], -q[at]))][: a.count]
        out.append((at, q[at]))
    return out


def in_memory(keys: np.ndarray, text: np.ndarray, meta: np.ndarray) -> Pool:
    """A pool of rows that are at hand."""

    def ask(models, asks, taken):
        found = most_confident(models, asks, taken, keys, text, meta)
        return [(a, int(keys[i]), text[i], meta[i]) for a, (at, _) in zip(asks, found) for i in at]

    return ask


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool | None, rounds: int = ROUNDS, each: int = EACH, sure: float = SURE) -> Model:
    """y: 0 or 1 for each labelled row; a fifth of those rows is kept for calibration."""
    y = np.asarray(y, float)
    kept = np.arange(len(y)) % 5 == 4
    if len(set(y[~kept])) < 2 or len(set(y[kept])) < 2:
        return Model()
    base = y[~kept]
    prior = float(base.mean())
    known = {name: ([x[~kept]], [base]) for name, x in (("text", text), ("meta", meta))}
    taken: dict[str, set[int]] = {"text": set(), "meta": set()}  # by teacher
    for r in range(rounds + 1):
        models = {name: fit_view(np.vstack(x), np.concatenate(labels)) for name, (x, labels) in known.items()}
        if r == rounds or pool is None:
            break
        # As rare as a label is, a confident one must be rarer than chance: the bar rises with the label's prior.
        shares = ((1, prior), (0, 1 - prior))
        asks = [Ask(t, label, max(1, round(each * share)), max(sure, 1 - (1 - share) / 2)) for t in taken for label, share in shares]
        for a, key, x, m in pool(models, asks, taken):
            pupil, own = ("meta", m) if a.teacher == "text" else ("text", x)
            taken[a.teacher].add(key)
            known[pupil][0].append(own[None])
            known[pupil][1].append(np.array([float(a.label)]))
    for name, own in (("text", text), ("meta", meta)):
        v = models[name]
        v.a, v.b = map(float, _newton(np.clip(v.raw(own[kept]), -12, 12)[:, None], y[kept], 0.1))
        if v.a < 0:  # worse than chance on unseen rows: it says no more than the prior
            v.a, v.b = 0.0, math.log(prior / (1 - prior))
    return Model(models["text"], models["meta"], math.log(prior / (1 - prior)))


COLUMNS = ("doc_id", "text", "source", "lang", "n_chars")
FEATURES = "doc_id long, x binary, m binary, key long"


def _made(batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[bytes]]:
    get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
    return [text_features(t) for t in get("text")], [bytes(meta_places(*r)) for r in zip(get("source"), get("lang"), get("n_chars"))]


def _views(x: list[bytes], m: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of both views from their written forms."""
    return np.frombuffer(b"".join(x), np.float32).reshape(-1, TEXT).astype(float), one_hot(np.frombuffer(b"".join(m), np.uint8).reshape(-1, len(META)))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x, m, key): both views' features of every document in bytes, and a hash of them, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, m = _made(b)
            x = [v.tobytes() for v in x]
            key = np.array([xxhash.xxh64_intdigest(v + w) for v, w in zip(x, m)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), pa.array(m, pa.binary()), pa.array(key)], names=["doc_id", "x", "m", "key"])

    return cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:]).mapInArrow(run, FEATURES))


def spread(rows: DataFrame) -> Pool:
    """A pool of all rows of ``features``."""

    def ask(models, asks, taken):
        shipped = rows.sparkSession.sparkContext.broadcast((models, asks, taken))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, asks, taken = shipped.value
            best: list[dict[int, tuple]] = [{} for _ in asks]  # of this task: key -> row
            for b in batches:
                if not b.num_rows:
                    continue
                x, m, keys = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_numpy()
                for k, (at, q) in enumerate(most_confident(models, asks, taken, keys, *_views(x, m))):
                    best[k].update({int(keys[i]): (k, float(p), int(keys[i]), x[i], m[i]) for i, p in zip(at, q)})
                    if len(best[k]) > asks[k].count:
                        best[k] = {r[2]: r for r in sorted(best[k].values(), key=lambda r: (-r[1], r[2]))[: asks[k].count]}
            out = [r for own in best for r in own.values()]
            yield pa.RecordBatch.from_pylist([dict(zip(("ask", "q", "key", "x", "m"), r)) for r in out], pa.schema([("ask", pa.int32()), ("q", pa.float64()), ("key", pa.int64()), ("x", pa.binary()), ("m", pa.binary())]))

        found = rows.select("x", "m", "key").mapInArrow(run, "ask int, q double, key long, x binary, m binary")
        most = max(a.count for a in asks)
        for part in (F.pmod(F.col("key"), F.lit(MERGE)), F.lit(0)):
            w = Window.partitionBy("ask", part).orderBy(F.desc("q"), "key")
            found = found.dropDuplicates(["ask", "key"]).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")
        got = sorted(found.collect(), key=lambda r: (r["ask"], -r["q"], r["key"]))  # ``most`` rows an ask
        out = []
        for k, a in enumerate(asks):
            own = [r for r in got if r["ask"] == k][: a.count]
            text, meta = _views([r["x"] for r in own], [r["m"] for r in own])
            out += [(a, r["key"], text[i], meta[i]) for i, r in enumerate(own)]
        return out

    return ask


def train(docs: DataFrame, labels: DataFrame, train_rows=None, label: str = "quality", labelled: int = LABELLED, made: DataFrame | None = None) -> Model:
    """Co-train on up to ``labelled`` labelled documents, drawn in hash order, and all other rows. ``made``: the features of ``docs``, if at hand."""
    made = features(docs) if made is None else made
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    usable = marked.where(train_rows(F.col("doc_id"))) if train_rows is not None else marked
    own = cut(made.select("doc_id").distinct().join(usable, "doc_id").orderBy(F.xxhash64(F.lit("quality"), "doc_id"), "doc_id").limit(labelled))
    ids = F.broadcast(own)  # ``labelled`` rows at most
    got = made.join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min(F.struct("x", "m")).alias("f")).collect()
    if not got:
        return Model()
    got.sort(key=lambda r: (zlib.crc32(r["f"]["x"]), r["doc_id"]))
    text, meta = _views([r["f"]["x"] for r in got], [r["f"]["m"] for r in got])
    return co_train(text, meta, np.array([r["y"] for r in got]), spread(made.join(ids, "doc_id", "left_anti")))


def score(docs: DataFrame, model: Model, made: DataFrame | None = None) -> DataFrame:
    """doc_id and the scores of both views and of the combination, for every document."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, shipped.value.scores(*_views(b.column(1).to_pylist(), b.column(2).to_pylist())))], names=["doc_id", "text_score", "meta_score", "score"])

    return (features(docs) if made is None else made).select("doc_id", "x", "m").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score ``least`` or more, with all their columns."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, m = _made(b)
                yield b.filter(pa.array(shipped.value.scores(*_views([v.tobytes() for v in x], m))[2] >= least))

    return docs.mapInArrow(run, docs.schema)
