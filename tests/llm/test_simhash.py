"""SimHash: keys, links and components against brute force."""

import numpy as np
import xxhash

from tidemark.llm import simhash as S


def test_golay_code_is_perfect():
    words = np.random.default_rng(1).integers(0, 1 << 23, 5000)
    index = S.decode(words)
    code = (index.astype(np.uint32) << 11) | S.HIGH[index]
    assert (np.bitwise_count(code ^ words.astype(np.uint32)) <= 3).all()
    assert (S.ERROR[1:] > 0).all()


def test_any_pair_within_three_bits_shares_a_key():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    flips = np.zeros(4000, np.uint64)
    for i in range(4000):
        for bit in rng.choice(64, i % 4, replace=False):
            flips[i] |= np.uint64(1) << np.uint64(bit)
    (ra, ka), (rb, kb) = S.fuzzy_keys(a), S.fuzzy_keys(a ^ flips)
    assert all(set(ka[ra == i]) & set(kb[rb == i]) for i in range(4000))


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", t) if x]
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(ids, fps):
    comp = list(range(len(ids)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                comp[root(i)] = root(j)
    low = {}
    for i, d in enumerate(ids):
        low[root(i)] = min(low.get(root(i), d), d)
    return [low[root(i)] for i in range(len(ids))]


def test_components_match_brute_force(spark):
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(8):
        base = list(rng.choice(vocab, 150))
        for _ in range(6):
            copy = list(base)
            copy[rng.integers(150)] = "Changed"
            texts.append(" ".join(copy))
    texts += ["", None, "   ", "one", "One two", "one two three", texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r["doc_id"]: r for r in S.near_duplicates(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == brute_components(list(range(len(texts))), fps)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).collect() == []


def test_long_text_is_read_whole():
    words = " ".join(str(i) for i in range(70000))
    assert S.fingerprint(S.shingle_hashes(words)) == S.fingerprint(np.array([xxhash.xxh64_intdigest(" ".join(words.split()[i : i + 3]), 42) for i in range(69998)], np.uint64))


def test_a_long_bucket_is_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 5)
    rng = np.random.default_rng(7)
    centre = rng.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.unique(np.array([centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, rng.integers(1, 4)).astype(np.uint64)) for _ in range(200)]))
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    from tidemark.llm.graph import components

    got = {r["node"]: r["component"] for r in components(S.links(frame)).collect()}
    want = brute_components(fps.view(np.int64).tolist(), [int(f) for f in fps])
    assert [got.get(f, f) for f in fps.view(np.int64).tolist()] == want


def test_null_ids_and_repeats(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(None, text, "x"), (5, text, "x"), (5, text, "x"), (5, "other words here now", "x"), (None, "alone in the dark", "x")], "doc_id long, text string, low string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"]) for r in S.near_duplicates(docs).collect() if r["component_id"] is not None)
    assert got == [(False, 5, 5)] * 3 + [(True, 0, 5)]
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] or 0, r["text"]) for r in kept.collect()) == [(0, "alone in the dark"), (5, text), (5, "other words here now")]
