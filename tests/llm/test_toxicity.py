"""Toxicity: whole texts and words, a sample that large texts don't empty, held-out labels."""

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity as T
from tidemark.llm.common import table
from tests.llm.test_quality import auc

ALL = lambda c: F.lit(True)


def model():
    rng = np.random.default_rng(1)
    plain, bad = [f"plain{i}" for i in range(50)], ["horriblest", "disgustingly"]
    texts = [" ".join(rng.choice(plain, 30).tolist() + ([bad[i % 2]] * 3 if i % 3 == 0 else [])) for i in range(300)]
    return T.train(texts, [int(i % 3 == 0) for i in range(300)])


def test_unseen_misspellings_score_like_their_words():
    s = model().scorer()
    assert s.score("plain1 plain2 horribblest plain3") > s.score("plain1 plain2 plain4 plain3")


def test_a_word_is_scored_whole():
    m, s = model(), model().scorer()
    pad = "q" * 100
    assert s[f"{pad}horriblest"] != s[f"{pad}plain1"]
    long = "ab" * 5_000 + "horriblest"
    g = np.concatenate(list(T.grams(long, m.buckets)))
    assert len(g) == 1 + sum(len(long) + 2 - n + 1 for n in range(3, 7)) and np.isclose(s[long], m.weight[g].mean())
    assert len(np.concatenate(list(T.grams("x" * 40_000, m.buckets)))) == 1 + sum(40_002 - n + 1 for n in range(3, 7))


def test_a_text_is_scored_whole():
    s = model().scorer()
    assert s.score("plain1 " * 100_000 + "horriblest " * 50_000) > s.score("plain1 " * 150_000)


def test_a_large_text_does_not_empty_the_sample(spark):
    order = [r[0] for r in spark.range(60).orderBy(F.xxhash64(F.lit("toxicity"), "id"), "id").collect()]
    texts = {i: "x" * 100 for i in range(60)} | {order[0]: "y" * 20_000_000, order[1]: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got, ys = T.sample(docs, labels, ALL)
    assert len(got) == 59 and ys == [i % 2 for i in order[1:]] and got[0] is None
    assert len(T.sample(docs, labels, ALL, most_bytes=1500, row_bytes=1000)[0]) == 16
    assert len(T.sample(docs, labels, ALL, rows=7)[0]) == 7


def test_cases(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "", "x"), (3, "...", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    texts, ys = T.sample(docs, labels, ALL)
    assert (texts, ys) == (["a b"], [1])
    one_kind = T.score(docs, T.train(texts, ys)).collect()
    assert len(one_kind) == 5 and all(abs(r["score"] - 2 / 3) < 1e-9 for r in one_kind)
    got = T.score(docs, model()).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 3, None} and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] != 1}) == 1
    assert all(r["score"] == 0.5 for r in T.score(docs, T.train([], [])).collect())
    assert T.score(docs.limit(0), model()).collect() == [] and T.sample(docs.limit(0), labels, ALL) == ([], [])


def test_held_out_labels(spark, sf_dir):
    docs, labels = table(spark, sf_dir.replace("sf0.01", "sf0.1"), "documents"), table(spark, sf_dir.replace("sf0.01", "sf0.1"), "labels")
    trained = T.train(*T.sample(docs, labels, lambda c: ~T.held_out(c)))
    got = T.score(docs, trained).join(labels.where(T.held_out(F.col("doc_id")) & F.col("toxic").isNotNull()), "doc_id").select("score", "toxic").toPandas()
    hit = got.score >= 0.3
    print("held out: AUC", auc(got.toxic.to_numpy(), got.score.to_numpy()), "precision", got.toxic[hit].mean(), "recall", hit[got.toxic == 1].mean(), "rows", len(got))
    assert auc(got.toxic.to_numpy(), got.score.to_numpy()) > 0.9 and got.toxic[hit].mean() > 0.7 and hit[got.toxic == 1].mean() > 0.7
