"""Memtable rotation (O13): a running size that starts anew once it reaches the threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import record_size


def rotate(log: DataFrame, threshold: int = 1024) -> DataFrame:
    """(seq, shard, bytes, memtable) of each operation, folded in seq order for each shard.

    Every append counts its whole record, also when it overwrites a key. A resetting sum isn't a
    window function; each task streams its shards in order and carries one number over, so memory
    doesn't grow with a shard.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, table, used = None, 0, 0
        for b in batches:
            shards, sizes = b["shard"].to_numpy(), b["bytes"].to_numpy()
            out = np.zeros(len(b), np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(b) else np.zeros(0, int)
            for lo, hi in zip(cuts, np.append(cuts[1:], len(b))):
                if shards[lo] != shard:
                    shard, table, used = shards[lo], 0, 0
                total = np.cumsum(sizes[lo:hi])
                at, base = 0, -used
                while at < hi - lo:  # one step a rotation
                    full = int(np.searchsorted(total, threshold + base))  # the row that fills the memtable
                    out[lo + at : lo + full + 1] = table
                    if full >= hi - lo:
                        break
                    at, base, table = full + 1, int(total[full]), table + 1
                used = int(total[-1]) - base
            yield b.assign(memtable=out)

    sized = log.select("seq", "shard", record_size(F.col("k"), F.col("vtype"), F.col("v")).cast("long").alias("bytes"))
    return sized.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(fold, "seq long, shard long, bytes long, memtable long")
