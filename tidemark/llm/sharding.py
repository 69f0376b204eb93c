"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``cells`` positions. Every shard has ``vnodes`` virtual nodes on it; a row's home is
the shard of the first virtual node at or after the cell of its hashed key. A shard holds at most
its capacity: the row counts of all shards differ by one at most. A shard keeps its home rows, in
ring order, up to its capacity; the others go on clockwise to the next shard with room. So only
rows beyond a capacity leave their home, which is the least that any balanced layout can move.

Two passes over a narrow table that is written once: counts by cell (bounded by ``cells``, so the
walk round the ring runs on the driver), then ranks within cells, which the walk's intervals map
to shards and slots. A cell with far more rows than others, as when one key repeats, is ranked in
``SALTS`` parts.

Cases: a null key has one cell; repeated rows are placed one by one; null text has 16 bytes and
a null checksum; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut

SALTS = 16


def ring(shards: int, vnodes: int = 100, cells: int = 16384) -> list[tuple[int, int]]:
    """(cell, shard) of each virtual node, clockwise. A shard's nodes don't depend on the number of shards."""
    at = lambda s, v: hashlib.md5(f"{s}/{v}".encode()).digest()
    nodes = sorted((int.from_bytes(h[:8], "big") % cells, h, s) for s in range(shards) for v in range(vnodes) for h in [at(s, v)])
    return [(c, s) for c, _, s in nodes]


def walk(counts: dict[int, int], shards: int, vnodes: int = 100, cells: int = 16384) -> list[tuple[int, int, int, int, int]]:
    """Intervals (cell, lo, hi, shard, slot of lo) of ranks within cells."""
    nodes = ring(shards, vnodes, cells)
    places = [c for c, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out, over = [], []

    def put(cell: int, lo: int, n: int, shard: int) -> None:
        if n:
            out.append((cell, lo, lo + n, shard, used[shard]))
            used[shard] += n

    for cell in sorted(counts):
        i = bisect_left(places, cell) % len(nodes)
        home = nodes[i][1]
        keep = min(counts[cell], room[home] - used[home])
        put(cell, 0, keep, home)
        if keep < counts[cell]:
            over.append((cell, keep, i))
    for cell, lo, i in over:
        while lo < counts[cell]:
            shard = nodes[i % len(nodes)][1]
            n = min(counts[cell] - lo, room[shard] - used[shard])
            put(cell, lo, n, shard)
            lo, i = lo + n, i + 1
    return out


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", vnodes: int = 100, cells: int = 16384) -> DataFrame:
    """Each row's key, size, text_crc32, shard, slot (gapless from 0 in each shard) and home shard."""
    spark = docs.sparkSession
    keyed = cut(
        docs.select(
            F.col(key).alias("k"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16).alias("size"),
            F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
            F.pmod(F.xxhash64(F.lit("ring"), key), F.lit(cells)).cast("int").alias("cell"),
            F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"),
        )
    )
    found = keyed.groupBy("cell", "salt").count().collect()  # at most cells * SALTS rows
    counts: dict[int, int] = defaultdict(int)
    for r in found:
        counts[r["cell"]] += r["count"]
    usual = 4 * sum(counts.values()) / cells + 256
    hot = sorted(c for c, n in counts.items() if n > usual)
    base = {(c, 0): 0 for c in counts if c not in set(hot)}
    for c in hot:
        at = 0
        for r in sorted((r for r in found if r["cell"] == c), key=lambda r: r["salt"]):
            base[c, r["salt"]] = at
            at += r["count"]
    of_cell = defaultdict(list)
    for c, lo, hi, shard, slot in walk(counts, shards, vnodes, cells):
        of_cell[c].append((lo, hi, shard, slot))
    nodes = ring(shards, vnodes, cells)
    places = [c for c, _ in nodes]
    rows = [(c, s, b, lo, hi, shard, slot, nodes[bisect_left(places, c) % len(nodes)][1]) for (c, s), b in base.items() for lo, hi, shard, slot in of_cell[c]]
    # At most an interval for each cell or part of a hot cell, and one more for each filled shard and walk.
    plan = spark.createDataFrame(rows, "p_cell int, p_part int, base long, lo long, hi long, shard int, lo_slot long, home int")
    part = F.when(F.col("cell").isin(hot), F.col("salt")).otherwise(0) if hot else F.lit(0)
    ranked = keyed.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("cell", "part").orderBy("k", "text_crc32", "size")) - 1)
    at = F.col("rank") + F.col("base")
    placed = ranked.join(F.broadcast(plan), (F.col("cell") == F.col("p_cell")) & (F.col("part") == F.col("p_part")) & (at >= F.col("lo")) & (at < F.col("hi")))
    return placed.select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("lo_slot") + at - F.col("lo")).alias("slot"), "home")
