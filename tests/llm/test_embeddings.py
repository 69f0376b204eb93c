"""Embedding near-duplicates against brute force, with recall on planted pairs at the threshold."""

import numpy as np
import pytest

from tidemark.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<double>, label string, c long"


def pairs_at(cosines, d, seed):
    """Random directions, and one for each at that cosine."""
    rng = np.random.default_rng(seed)
    a = E.unit(rng.normal(size=(len(cosines), d)))
    n = rng.normal(size=a.shape)
    n = E.unit(n - (n * a).sum(1, keepdims=True) * a)
    return a, cosines[:, None] * a + np.sqrt(1 - cosines[:, None] ** 2) * n


def brute(ids, vs):
    """(n_links, component) of each, over all pairs of vectors of one length."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in zip(ids, vs)]
    links, comp = [0] * len(ids), list(range(len(ids)))
    for n in {len(v) for v, g in zip(vs, ok) if g}:
        at = [i for i, v in enumerate(vs) if ok[i] and len(v) == n]
        u = E.unit(np.array([vs[i] for i in at], float))
        for x, y in zip(*np.nonzero(u @ u.T >= 0.9)):
            if x != y:
                links[at[x]] += 1
                low, high = sorted((comp[at[x]], comp[at[y]]))
                comp = [low if c == high else c for c in comp]
    least = {}
    for i, c in enumerate(comp):
        least[c] = min(least.get(c, ids[i]), ids[i]) if ids[i] is not None else least.get(c)
    return [(links[i], least[comp[i]]) for i in range(len(ids))]


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    vs = [(b + rng.normal(0, s, 16)).tolist() for b in base for s in (0, 0.05, 0.1, 0.2)] + rng.normal(size=(100, 16)).tolist()
    vs += [vs[0], vs[0], (np.array(vs[1]) * 3).tolist(), [1.0, 2.0], [1.0, 2.0], [2.0, 4.0, 0.0], [-1.0, -2.0], [5.0], [7.0]]
    vs += [[1e200, 1e200], [1e-200, 1e-200], [3.0, 3.0], [0.0, 0.0], [], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0]]
    ids = list(range(len(vs)))
    ids[7] = ids[8]
    rows = [(i, v, "x", 1) for i, v in zip(ids, vs)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_duplicates(spark.createDataFrame(rows, SCHEMA), prefix=12).collect())
    assert got == sorted((i, n, c, i == c) for i, (n, c) in zip(ids, brute(ids, vs)))
    assert E.near_duplicates(spark.createDataFrame(rows[:0], SCHEMA)).collect() == []
    assert [tuple(r) for r in E.near_duplicates(spark.createDataFrame([(None, [1.0], "x", 1), (3, [0.0], "x", 1)], SCHEMA)).orderBy("vec_id").collect()] == [(None, 0, None, True), (3, 0, 3, True)]


@pytest.mark.parametrize("d", [64, 768])
def test_recall_at_the_threshold(spark, d):
    cosines = np.linspace(0.9001, 0.92, 400)
    a, b = pairs_at(cosines, d, d)
    v = np.concatenate([a, b])
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["component_id"] for r in E.near_duplicates(rows).collect()}
    recall = np.mean([got[i + 400] == i for i in range(400)])
    print("recall at 0.90 to 0.92, length", d, recall)
    assert recall >= 0.9


@pytest.mark.parametrize("n", [10_000, 2_000_000, 30_000_000, 10**9])
def test_recall_holds_as_pivots_grow(n):
    pivots, prefix = E.plan(n)
    a, b = pairs_at(np.full(800, 0.9), 64, 3)
    points = E.choose_pivots(np.zeros((0, 64)), pivots)
    shared = [len(set(x) & set(y)) >= 2 for x, y in zip(E.prefixes(a, points, prefix).tolist(), E.prefixes(b, points, prefix).tolist())]
    print("pivots", pivots, "prefix", prefix, "recall", np.mean(shared))
    assert np.mean(shared) >= 0.9


def test_a_long_list_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 40)
    rng = np.random.default_rng(5)
    v = rng.normal(size=32) + rng.normal(0, 0.05, (300, 32))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = E.near_duplicates(rows, pivots=64, prefix=8).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)} and len(got) == 300


def test_the_query(spark, sf_dir):
    from tidemark.llm.common import table
    from tidemark.llm.queries import op9_embedding_dedup

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").orderBy("vec_id").collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op9_embedding_dedup(spark, sf_dir).collect()}
    assert [got[r[0]] for r in rows] == brute([r[0] for r in rows], [r[1] for r in rows])
