"""Packing: ids against the tokenizer, plans against bounds, places without gaps."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import packing as P

tokenizers = pytest.importorskip("tokenizers")
PATH = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
TEXTS = [
    None, "", "  ", "One two.", "ÉLAN élan, Ünder! it's don't IT'S x'll, a.b.c ...a. a!? 12.5, 3rd. éa. É.", "İstanbul ΣΑΣ. ς 日本語。 ok　wide", "a\x1cb \x85 c\xa0d",
    "<|endoftext|> x<|endoftext|>y. <|startoftext|>.", "word|word, | p|q ©. ª. ǅ. Ǆ ß. ẞ ﬁ. ㎏.", "!?,.;: a,; b:!", "Ω Å K. ſ. ŉ.", "tab\tnew\nline\r\nend\x0b\x0c.", "x" * 3000 + ". " + "ab " * 9000,
]


def ids(text):
    return tokenizers.Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("part", [5, 2_000_000])
def test_ids_are_those_of_the_whole_text(part):
    words = P.WordIds(PATH)
    words.MOST, words.PART = 5, part  # words are forgotten and texts cut all the time
    got = [[1] for _ in TEXTS]
    for row, own in words.encode(pa.array(TEXTS)):
        got[row][-1:] = [*own.tolist(), 1]
    assert got == [ids(t) for t in TEXTS]


def optimum(items, capacity):
    """Fewest bins by trying every bin for every item."""
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            go(i + 1, bins[:k] + [bins[k] + items[i]] + bins[k + 1 :])
        go(i + 1, bins + [items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best


def test_search_is_exact_within_its_budget():
    rng = random.Random(3)
    cases = [(60, [8, 10, 12, 13, 14, 20, 23, 25, 27, 28, 29, 29]), (100, [21, 24, 25, 28, 29, 31, 37, 38, 39, 40, 40, 44, 45, 48])]
    cases += [(c, [rng.randint(c // 12 + 1, c // 2 + 3) for _ in range(rng.randint(6, 13))]) for c in rng.choices([30, 60, 100], k=1500)]
    branched = 0
    for capacity, items in cases:
        hist = dict(Counter(items))
        branched += sum(n for _, n in P.best_fit(hist, capacity)) > P.lower_bound(hist, capacity)
        plan, proven = P.search(hist, capacity, 100_000)
        assert proven and sum(n for _, n in plan) == optimum(items, capacity) == sum(n for _, n in P.complete(hist, capacity, 100_000)), (capacity, items)
    assert branched > 50


def test_a_spent_budget_is_told():
    plan, proven = P.search(dict(Counter(range(21, 49))), 100, 1)
    assert sum(n for _, n in plan) >= P.lower_bound(dict(Counter(range(21, 49))), 100) and not proven


@pytest.mark.parametrize("seed", range(6))
def test_plan_fits_and_is_complete(seed):
    rng = np.random.default_rng(seed)
    lengths, n = np.unique(rng.integers(1, 60, 40 + 30 * seed), return_counts=True)
    hist = dict(zip(lengths.tolist(), n.tolist()))
    plan = P.complete(hist, 60)
    used = {}
    for pattern, times in plan:
        assert sum(s * c for s, c in pattern) <= 60
        for s, c in pattern:
            used[s] = used.get(s, 0) + c * times
    assert used == hist
    assert P.lower_bound(hist, 60) <= sum(t for _, t in plan) <= sum(t for _, t in P.best_fit(hist, 60))


def test_pack(spark):
    rows = [(i, t, "de", 5) for i, t in enumerate(TEXTS)] + [(None, "no id", None, None), (3, TEXTS[3], "x", 0), (3, TEXTS[3], "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset string, piece int")
    got = P.pack(docs, PATH).toPandas()
    for i, t in enumerate(TEXTS):
        own = got[got.doc_id == i].drop_duplicates("piece").sort_values("piece")
        want = ids(t)
        cut = [want[k : k + 4096] for k in range(0, len(want), 4096)]
        assert own.length.tolist() == [len(c) for c in cut]
        assert own.start.tolist() == list(range(0, len(want), 4096))
        assert own.ids_crc32.tolist() == [zlib.crc32(np.array(c, "<u4").tobytes()) for c in cut]
    assert (got.doc_id == 3).sum() == 3 and got.doc_id.isna().sum() == 1
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    assert got.groupby("sequence_id").length.sum().max() <= 4096


def test_one_length_of_many_rows_is_ranked_in_parts(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "'same words' AS text")
    got = P.pack(docs, PATH).toPandas().sort_values(["sequence_id", "offset"])
    assert (got.offset == got.groupby("sequence_id").length.cumsum() - got.length).all()
    assert got.doc_id.nunique() == 5000 and got.sequence_id.nunique() == -(-5000 // (4096 // got.length.iloc[0]))


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
