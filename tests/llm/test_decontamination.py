"""Decontamination against brute force over all documents and items."""

import random

import numpy as np
import pytest

from tidemark.llm import decontamination as D
from tidemark.llm.common import table
from tidemark.llm.licenses import least_jaccard, stride
from tidemark.llm.words import WordHashes, shingles

WORDS = WordHashes()


def brute(docs, items):
    """(must, may): pairs that a window holds, and all that documents hold, with their containment."""
    must, may = set(), {}
    for d, text in docs:
        w = WORDS.of(text)
        for i, item in items:
            n, own = D.item_set(WORDS.of(item))
            if not len(own):
                continue
            h = shingles(w, n)
            if (share := np.isin(own, h).mean()) < 0.8 - 1e-12:
                continue
            may[d, i] = share
            bound = next(b for b in D.LIMITS if b >= len(own))
            step = stride(bound)
            if any(np.isin(own, h[k : k + bound + step]).mean() >= 0.8 - 1e-12 for k in range(0, len(h), step)):
                must.add((d, i))
    return must, may


def held(got, docs, items):
    must, may = brute(docs, items)
    found = {(r["doc_id"], r["item_id"]): r["containment"] for r in got}
    assert must <= set(found) <= set(may), (must - set(found), set(found) - set(may))
    assert all(abs(found[k] - may[k]) < 1e-12 for k in found)
    return must, found


def test_matches_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.choice([1, 2, 3, 4, 5, 6, 9, 15, 30, 60, 130, 300]))) for i in range(60)]
    items += [(100, None), (101, " . "), (102, items[30][1]), (103, items[30][1].upper() + "!")]

    def edited(text, n):
        w = text.split()
        for _ in range(n):
            w[rng.randrange(len(w))] = "edit"
        return " ".join(w)

    docs = [(1000 + k, say(rng.randrange(300)) + " " + edited(t or "", k // 64 * (len((t or "").split()) // 25)) + " " + say(rng.randrange(3000))) if t and t.strip(" .") else (1000 + k, say(50)) for k, (_, t) in enumerate(items * 3)]
    docs += [(1, None), (2, ""), (3, "..."), (4, items[40][1] + " " + say(100_000) + " " + items[41][1])]
    frame = spark.createDataFrame([(*d, 0.5, "x") for d in docs], "doc_id long, text string, containment double, item_id string")
    got = D.find_contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()
    must, found = held(got, docs, items)
    assert len(must) > 120 and len(found) - len(must) < 20
    clean = {r["doc_id"] for r in D.remove_contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in found}


def test_the_query_matches_brute_force(spark, sf_dir):
    from tidemark.llm.queries import op6_decontamination

    docs = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    must, found = held(op6_decontamination(spark, sf_dir).collect(), docs, items)
    assert must == set(found) and found


@pytest.mark.parametrize("bound", [1, 2, 7, 50, 1000, 100_000])
def test_each_partition_has_bands_that_suffice(bound):
    smallest = bound * 4 // 5 + 1 if bound > 2 else bound
    n, rows = D.banding(smallest, bound)
    s = least_jaccard(smallest, bound)
    assert n * rows <= D.FUNCTIONS and (1 - s**rows) ** n <= D.MISS


def test_windows_are_those_that_hold_a_place():
    rng = np.random.default_rng(1)
    for bound in (1, 3, 4, 5, 37):
        step, hits = stride(bound), np.unique(rng.integers(0, 500, 9))
        want = [k for k in range(502) if ((hits >= k * step) & (hits < k * step + bound + step)).any()]
        assert D.windows(hits, bound).tolist() == want


def test_cases(spark):
    item = "the quick brown fox jumps over the lazy dog today"
    docs = spark.createDataFrame([(None, item, 1), (None, item, 1), (7, "x " + item, 2), (7, "clean", 3), (8, None, 4)], "doc_id long, text string, row int")
    items = spark.createDataFrame([("a", item), ("a", item), ("b", "clean"), (None, None)], "item_id string, text string")
    got = sorted(((r["doc_id"] or 0, r["item_id"]) for r in D.find_contaminated(docs, items).collect()))
    assert got == [(0, "a")] * 4 + [(7, "a")] * 2 + [(7, "b")]
    assert [tuple(r) for r in D.remove_contaminated(docs, items).collect()] == [(8, None, 4)]
    none = items.limit(0)
    assert D.find_contaminated(docs, none).collect() == [] and D.remove_contaminated(docs, none).count() == 5
    assert D.find_contaminated(docs.limit(0), items).collect() == [] and D.remove_contaminated(docs.limit(0), items).columns == docs.columns
