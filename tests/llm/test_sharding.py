"""Sharding: the law, slots, and overflow against a walk of single rows round the ring."""

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, cell int"


def brute(cells, shards):
    """Shard counts if home rows come first, in ring order, and the rest go on clockwise one by one."""
    nodes = S.ring(shards)
    at = [c for c, _ in nodes]
    total = len(cells)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out, over = [], []
    for c in sorted(cells):
        i = bisect_left(at, c) % len(nodes)
        if room[nodes[i][1]]:
            room[nodes[i][1]] -= 1
            out.append((c, nodes[i][1]))
        else:
            over.append((c, i))
    for c, i in over:
        while not room[nodes[i % len(nodes)][1]]:
            i += 1
        room[nodes[i % len(nodes)][1]] -= 1
        out.append((c, nodes[i % len(nodes)][1]))
    return Counter(out)


def cell_of(spark, ids):
    frame = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    return [r[0] for r in frame.select(F.pmod(F.xxhash64(F.lit("ring"), "doc_id"), F.lit(16384)).cast("int")).collect()]


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_rows_overflow_clockwise(spark, shards):
    ids = [*range(1500), *[77] * 800, None, None]
    docs = spark.createDataFrame([(i, f"text é {i}", "x", 3) for i in ids], SCHEMA)
    got = S.assign_shards(docs, shards).collect()
    cells = cell_of(spark, ids)
    cell = dict(zip(ids, cells))
    assert Counter((cell[r["doc_id"]], r["shard"]) for r in got) == brute(cells, shards)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        text = f"text é {r['doc_id']}".encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == shards


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    home = lambda n: {r["doc_id"]: r["shard"] for r in S.assign_shards(docs, n).collect()}
    a, b = home(40), home(41)
    moved = sum(a[i] != b[i] for i in a) / len(a)
    print("moved from 40 to 41 shards", moved)
    assert moved < 0.12


def test_the_query(spark, sf_dir):
    from tidemark.llm.common import table
    from tidemark.llm.queries import op1_sharding

    got = op1_sharding(spark, sf_dir).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32(r["text"].encode()) if r["text"] is not None else None) for r in table(spark, sf_dir, "documents").collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    n = Counter(r["shard"] for r in got)
    assert set(n) == set(range(40)) and max(n.values()) - min(n.values()) <= 1
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((s, i) for s in n for i in range(n[s]))


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (1, None, "x", 1), (None, "", "x", 1), (2, "y" * 1_000_000, None, None)], SCHEMA)
    got = sorted((r["doc_id"] or 0, r["size"], r["text_crc32"], r["slot"]) for r in S.assign_shards(docs, 4).collect())
    assert got == [(0, 16, 0, 0), (1, 16, None, 0), (1, 16, None, 0), (2, 1_000_016, zlib.crc32(b"y" * 1_000_000), 0)]
    assert S.assign_shards(docs.limit(0)).collect() == []
