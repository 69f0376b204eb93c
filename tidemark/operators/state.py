"""Latest operation per key: the one aggregate behind reads, flushes and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, *by: str) -> DataFrame:
    """The operation of the greatest ``seq`` for each key (within ``by``). Two-phase: one row a key and task is shuffled."""
    last = F.max_by(F.struct("op", "vtype", "v", "seq"), "seq")
    return log.groupBy(*by, "k").agg(last.alias("last")).select(*by, "k", "last.*")


def live(log: DataFrame) -> DataFrame:
    return latest(log).where("op = 'INSERT'").drop("op")


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where("op = 'DELETE'").select("k", "seq")


def multi_get(keys: DataFrame, log: DataFrame) -> DataFrame:
    """(k, reply, found) for each row of ``keys``. A missing key reads ``null``, as does that string."""
    wanted = log.join(keys.select("k").distinct(), "k", "left_semi")  # before the aggregation; broadcast if Spark finds it small
    view = live(wanted).select(F.col("k").alias("live_k"), "v")
    return keys.join(view, F.col("k") == F.col("live_k"), "left").select("k", F.coalesce("v", F.lit("null")).alias("reply"), F.col("live_k").isNotNull().alias("found"))


def answering_tier(log: DataFrame) -> DataFrame:
    """Which tier holds the answer for each live key: the memtable (the newest batch ``seg``), the queued one, or a segment."""
    newest = log.agg(F.max("seg")).scalar()
    last = F.max_by(F.struct("op", "v", "seg"), "seq")
    seg = F.col("seg")
    tier = F.when(seg == newest, "memtable").when(seg == newest - 1, "immutable").otherwise("segment")
    return log.groupBy("k").agg(last.alias("last")).select("k", "last.*").where("op = 'INSERT'").select("k", "v", tier.alias("tier"))
