"""License scans: guarantees of the bands, edge cases, and matches against brute force."""

import random
import re

from tidemark.llm import licenses as L


def split(text):
    return re.sub(r"[\W_]+", " ", (text or "").lower()).strip().split(" ")


def brute(rows, templates):
    out = {}
    for doc, text in rows:
        w = split(text)
        own = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        for name, t in templates.items():
            tw = split(t)
            ts = {tuple(tw[i : i + 5]) for i in range(len(tw) - 4)}
            if not ts:
                continue
            bound = next(b for b in L.bounds(10_000) if len(ts) <= b)
            step = L.stride(bound)
            for start in range(0, len(own), step):
                share = len(ts & set(own[start : start + bound + step])) / len(ts)
                if share >= 0.8:
                    best, first = out.get((doc, name), (0, start))
                    out[doc, name] = max(best, share), min(first, start)
    return {(d, n, c, f) for (d, n), (c, f) in out.items()}


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = "other"
    return " ".join(w)


def test_matches_brute_force(spark):
    rng = random.Random(4)
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "license", "the", "software", "x1", "ÉTÉ"]) for _ in range(n))
    rows = [(None, "Released under the MIT License."), (1, None), (2, ""), (3, "the MIT License"), (4, noise(20_000))]
    for i, t in enumerate(list(L.TEMPLATES.values()) * 4):
        rows.append((100 + i, noise(rng.randrange(60)) + "\n" + changed(rng, t, i // len(L.TEMPLATES)).upper() + ". " + noise(rng.randrange(60))))
    rows.append((4, noise(9000) + " " + L.TEMPLATES["mpl-2.0"]))
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows + rows[-3:]], "doc_id long, text string, license string, containment double")
    want = brute(rows, L.TEMPLATES)
    got = {tuple(r) for r in L.find_licenses(docs).collect()}
    assert got == want
    assert len({g[1] for g in got}) == len(L.TEMPLATES) and (None, "mit", 1.0, 0) in got


def test_the_bands_alone_retrieve(spark):
    rng = random.Random(9)
    noise = lambda n: " ".join(rng.choice(["lorem", "ipsum", "license", "the", "software"]) for _ in range(n))
    few = {k: L.TEMPLATES[k] for k in ("mit", "isc", "apache-2.0", "cc-by-4.0")}
    rows = [(i, noise(rng.randrange(40)) + " " + changed(rng, t, i % 3) + " " + noise(rng.randrange(40))) for i, t in enumerate(list(few.values()) * 4)] + [(90, ""), (91, None), (92, noise(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(list(few.items()), "license string, text string")
    plain, inlined = (L.find_licenses(docs, table, inline=n) for n in (0, 10**6))
    assert {tuple(r) for r in plain.collect()} == {tuple(r) for r in inlined.collect()} == brute(rows, few)


def test_bands_guarantee_collisions():
    for bound, smallest in zip(L.bounds(500)[1:], [b + 1 for b in L.bounds(500)]):
        s = L.least_jaccard(smallest, bound)
        assert 0 < s <= 1 and (1 - s**L.ROWS) ** L.bands(smallest, bound) <= L.MISS


def test_probe_words_lose_nothing():
    ws = [split(t) for t in L.TEMPLATES.values()]
    probes = set(L.probe_words(ws))
    for w in ws:
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert sum(not probes & set(s) for s in own) < L.needed(len(own))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.find_licenses(docs).collect() == [] and L.find_licenses(docs, {"short": "MIT"}).collect() == [] and L.find_licenses(docs, spark.createDataFrame([], "license string, text string")).columns == ["doc_id", "license", "containment", "first_word"]
