"""Every stage of the pipeline on what the one before it kept, held against a plain version."""

from collections import Counter

import numpy as np

import corpus_pipeline as C
from tests.llm.test_decontamination import brute as contaminated
from tests.llm.test_line_templates import brute as plain_lines
from tidemark.llm import near_copies, quality, simhash
from tidemark.llm.common import table


def plain_copies(texts):
    """The first text of each component of pairs within three bits or of similarity 0.8 or more; every pair is looked at."""
    sets = [near_copies.shingle_set(t).tolist() for t in texts]
    fps = np.array([simhash.fingerprint(simhash.shingle_hashes(t)) for t in texts], np.uint64)
    comp, having = np.arange(len(texts)), {}
    for i, own in enumerate(sets):
        shared = Counter(j for s in own for j in having.get(s, ()))
        near = {j for j, n in shared.items() if n >= 0.8 * (len(own) + len(sets[j]) - n)} | set(np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3).tolist())
        for j in near:
            low, high = sorted((comp[i], comp[j]))
            comp[comp == high] = low
        for s in own:
            having.setdefault(s, []).append(i)
    return sorted(set(comp.tolist()))


def test_stages(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(C.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = before.collect(), docs.collect()
        assert k == len(C.STAGES) - 1 or docs.columns == columns
    texts = lambda rows: sorted(((r["doc_id"], r["text"]) for r in rows), key=lambda r: (r[0], r[1] is None, r[1] or ""))

    before, after = seen["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf_dir, "labels").collect()}
    kept = {r["doc_id"] for r in after}
    right = [(d in kept) == bool(q) for d, q in labels.items() if q is not None]
    assert kept < {r["doc_id"] for r in before} and np.mean(right) > 0.97

    before, after = seen["line_dedup"]
    assert texts(after) == plain_lines([(r["doc_id"], r["text"]) for r in before])
    assert all(r["n_chars"] == len(r["text"]) for r in after if r["text"] is not None and r["n_chars"] is not None)

    before, after = seen["simhash_dedup"]
    order = sorted(before, key=lambda r: r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == [order[i]["doc_id"] for i in plain_copies([r["text"] for r in order])]
    assert len(after) < len(before)

    before, after = seen["benchmark_decontamination"]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").select("item_id", "text").collect()]
    must, may = contaminated([(r["doc_id"], r["text"]) for r in before], items)
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert {d for d, _ in must} <= gone <= {d for d, _ in may} and gone

    before, after = seen["best_fit_packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    used = {}
    for r in sorted(after, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, frame in {"labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}.items():
        spark.createDataFrame([], frame).write.parquet(str(tmp_path / f"{name}.parquet"))
    for _, stage in C.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
    assert quality.Model().text is None
