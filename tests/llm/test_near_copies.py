"""Near copies against brute force over all pairs."""

import numpy as np

from tidemark.llm import near_copies as N
from tidemark.llm import simhash as S


def jaccard(a, b):
    x, y = (set(N.shingle_set(t).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def brute(texts):
    """The first text of each component of pairs within three bits or of similarity 0.8 or more."""
    comp = list(range(len(texts)))
    fps = [S.fingerprint(S.shingle_hashes(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if comp[i] != comp[j] and ((fps[i] ^ fps[j]).bit_count() <= 3 or jaccard(texts[i], texts[j]) >= 0.8):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return sorted(set(comp))


def test_near_copies_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(2000)]
    texts = []
    for k in range(12):
        base = list(rng.choice(vocab, 80))
        for edits in (0, 1, 2, 4):
            copy = list(base)
            for at in rng.choice(80, edits, replace=False):
                copy[at] = f"edit{k}x{edits}"
            texts.append(" ".join(copy))
    texts += ["", None, "one", "one two", "One two", texts[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    got = sorted(r["doc_id"] for r in N.keep_one(docs).collect())
    assert got == brute(texts)
    assert len(got) < S.keep_one(docs).count()


def test_the_stage_drops_a_copy_beyond_three_bits(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:30] + ["edited"] + words[31:])]
    bits = [S.fingerprint(S.shingle_hashes(t)) for t in texts]
    assert jaccard(*texts) >= 0.8 and (bits[0] ^ bits[1]).bit_count() > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()] == [0]


def edited(rng, base, n, edits):
    """``n`` copies of a text, each with ``edits`` words of its own."""
    out = []
    for k in range(n):
        copy = list(base)
        for at in rng.choice(len(base), edits, replace=False):
            copy[at] = f"own{k}x{at}"
        out.append(" ".join(copy))
    return out


def test_forest_matches_all_pairs():
    rng = np.random.default_rng(8)
    texts = [t for edits in (1, 2, 3, 4) for t in edited(rng, [f"w{i}" for i in range(60)], 12, edits)]
    sets = [N.shingle_set(t) for t in texts]
    label = np.arange(len(sets))
    links = N.forest(sets, label, np.ones(len(sets), bool))
    assert all(jaccard(texts[i], texts[j]) >= 0.8 for i, j in links)
    want = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    assert len(links) == len(sets) - len(set(want)) and 1 < len(set(want)) < len(sets)
    assert len(set(zip(want, label.tolist()))) == len(set(want)) == len(set(label.tolist()))


def test_forest_of_long_sets():
    near = [np.arange(k, 8000 + k, dtype=np.uint64) for k in range(0, 8000, 50)]  # shifted by 50: neighbours alone are near
    far = [np.arange(10**6 + k, 10**6 + 8000 + k, dtype=np.uint64) for k in range(0, 16000, 4000)]
    label = np.arange(len(near) + len(far))
    N.forest(near + far, label, np.ones(len(label), bool))
    assert len(set(label[: len(near)].tolist())) == 1 and len(set(label.tolist())) == 1 + len(far)


def test_a_long_bucket_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(N, "NODES", 4)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(60)]
    texts = [t for edits in (1, 2, 3) for t in edited(rng, base, 10, edits)] + edited(rng, base[:40], 9, 0) + edited(rng, [f"v{i}" for i in range(60)], 8, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in N.keep_one(docs).collect()) == brute(texts)


def test_a_group_of_near_copies_below_the_limit_ships_no_pairs(spark):
    from tests.llm.test_pipeline import plain_copies

    n = 400
    texts = edited(np.random.default_rng(10), [f"w{i}" for i in range(200)], n, 8)  # similarity mostly below 0.8: most pairs share a bucket, few link
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sc = spark.sparkContext
    sc.setJobGroup("ships no pairs", "")
    assert sorted(r["doc_id"] for r in N.keep_one(docs).collect()) == plain_copies(texts)
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("ships no pairs") for s in sc.statusTracker().getJobInfo(j).stageIds}
    store = sc._jsc.sc().statusStore()
    written = [store.lastStageAttempt(s).shuffleWriteRecords() for s in stages]
    assert max(written) < n * 60  # a node has 24 bands and some 40 SimHash keys; there are n * n / 2 pairs


def test_empty_table(spark):
    assert N.keep_one(spark.createDataFrame([], "doc_id long, text string")).collect() == []
