"""Floor lookup (O51): the greatest index key that is not above each probe; and the block it names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import last_known


def floor_lookup(probes: DataFrame, index: DataFrame, by: str, key: str, value: str, first: str) -> DataFrame:
    """Probes (by, key) with the ``value`` and ``first`` key of their floor entry, null below the first.

    One sorted pass over the union of both sides; no range join, and no task for a whole ``by``.
    """
    entry = F.struct(F.col(first), F.col(value))
    kind = index.select(entry.alias("e")).schema["e"].dataType
    both = index.select(by, F.col(first).alias(key), F.lit(0).alias("side"), entry.alias("entry")).unionByName(probes.select(by, key, F.lit(1).alias("side"), F.lit(None).cast(kind).alias("entry")))
    return last_known(both, by, (key, "side"), "entry", "at").where("side = 1").select(by, key, F.col("at")[value].alias(value), F.col("at")[first].alias(first))


def block_scan(floors: DataFrame, blocks: DataFrame, by: str = "seg", key: str = "k", block: str = "blk") -> DataFrame:
    """Each probe of ``floor_lookup`` with the row of its key, read from its own block alone; null if the block lacks it."""
    held = blocks.select(F.col(by).alias("b_by"), F.col(block).alias("b_block"), F.col(key).alias("b_key"), F.struct("op", "vtype", "v", "seq").alias("held"))
    on = (F.col(by) == F.col("b_by")) & (F.col(block) == F.col("b_block")) & (F.col(key) == F.col("b_key"))
    return floors.join(held, on, "left").select(by, key, block, "held.*")
