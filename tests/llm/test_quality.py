"""Quality: the exchange helps, the distributed pool is the one in memory, and labels held out are met."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, score string"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def two_weak_views(n, seed):
    """Views independent given the label, neither of which suffices; few features of many tell it."""
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    make = lambda dim, shift: rng.normal(0, 1, (n, dim)) + np.where(np.arange(dim) < 4, shift, 0) * (2 * y - 1)[:, None]
    return make(60, 0.7), make(60, 0.7), y


def test_the_exchange_helps_where_neither_view_suffices():
    gains = []
    for seed in range(5):
        text, meta, y = two_weak_views(3000, seed)
        test_t, test_m, test_y = two_weak_views(2000, 100 + seed)
        pool = Q.in_memory(np.arange(2950), text[50:], meta[50:])
        score = lambda rounds: [auc(test_y, s) for s in Q.co_train(text[:50], meta[:50], y[:50], pool, rounds=rounds).scores(test_t, test_m)]  # noqa: B023, E731
        before, after = score(0), score(6)
        gains.append([a - b for a, b in zip(after, before)])
    assert (np.mean(gains, axis=0) > 0.02).all(), gains


def test_the_distributed_pool_is_the_one_in_memory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").unionByName(table(spark, sf_dir, "documents"))
    made = Q.features(docs)
    rows = made.collect()
    text, meta = Q._views([r["x"] for r in rows], [r["m"] for r in rows])
    keys = np.array([r["key"] for r in rows])
    y = np.arange(len(rows)) % 3 == 0
    models = {"text": Q.fit_view(text[:200], y[:200]), "meta": Q.fit_view(meta[:200], y[:200])}
    asks = [Q.Ask("text", 1, 30, 0.0), Q.Ask("text", 0, 7, 0.6), Q.Ask("meta", 1, 1, 0.0), Q.Ask("meta", 0, 5000, 0.0)]
    taken = {"text": set(keys[:300].tolist()), "meta": set()}
    got, want = ([(a.teacher, a.label, k, x.tolist()) for a, k, x, _ in pool(models, asks, taken)] for pool in (Q.spread(made), Q.in_memory(keys, text, meta)))
    assert got == want and len({g[2] for g in got if g[:2] == ("text", 1)}) == 30


def test_held_out_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = lambda c: F.crc32(c.cast("string").cast("binary")) % 4 == 2
    made = Q.features(docs)
    model = Q.train(docs, labels, lambda c: ~held(c), made=made)
    got = Q.score(docs, model, made).join(labels.where(held(F.col("doc_id"))), "doc_id").select("score", "quality").toPandas()
    assert len(got) > 50 and auc(got.quality.to_numpy(), got.score.to_numpy()) > 0.95
    kept = {r[0] for r in Q.keep_good(docs, model).select("doc_id").collect()}
    assert kept == {r[0] for r in Q.score(docs, model).where("score >= 0.5").select("doc_id").collect()}


def test_cases(spark):
    rows = [(i, "good words make a fair text " * (i % 3 + 1), "web", "en", 5, "x") for i in range(40)] + [(100 + i, "zzzz zzzz 0000 #### " * (i % 3 + 1), "spam", "en", 5, "x") for i in range(40)]
    odd = [(None, None, None, None, None, None), (200, "", "web", "en", 0, ""), (1, "another text of one id", "web", "en", -3, ""), (201, "w" * 300_000 + " a" * 100_000, None, "en", 1, "")]
    docs = spark.createDataFrame(rows + odd + odd[:1], SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 100)) for r in rows] + [(None, 1), (7, None), (7, 0), (999, 1)], "doc_id long, quality int")
    model = Q.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, model).collect()}
    assert all((got[r[0]] >= 0.5) == (r[0] < 100) for r in rows) and all(0 <= s <= 1 for s in got.values())
    assert Q.score(docs, model).count() == len(rows) + 5 and Q.keep_good(docs, model).columns == docs.columns
    none = Q.train(docs, labels.where("quality = 1"))
    assert Q.score(docs, none).where("score <> 1").count() == 0 and Q.keep_good(docs, none).count() == len(rows) + 5
    empty = docs.limit(0)
    assert Q.score(empty, Q.train(empty, labels)).collect() == [] and Q.keep_good(empty, model).collect() == []


@pytest.mark.parametrize("n", [1, 3])
def test_the_sample_of_labelled_documents_is_bounded(spark, n):
    docs = spark.createDataFrame([(i % 5, f"text {i}", "s", "l", 1, "") for i in range(20)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    assert Q.train(docs, labels, labelled=n).text is None
