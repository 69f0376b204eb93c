"""Segment catalog and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.state import latest


def overlaps(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Closed ranges have a key in common."""
    return (lo_a <= hi_b) & (lo_b <= hi_a)


def overlap_pairs(manifest: DataFrame) -> DataFrame:
    """All pairs of segments of a level whose key ranges overlap. Only for catalogs, never for data rows."""
    a, b = manifest.alias("a"), manifest.alias("b")
    on = (F.col("a.level") == F.col("b.level")) & (F.col("a.seg") < F.col("b.seg")) & overlaps(F.col("a.min_key"), F.col("a.max_key"), F.col("b.min_key"), F.col("b.max_key"))
    return a.join(b, on).select(F.col("a.level").alias("level"), F.col("a.seg").alias("seg_a"), F.col("b.seg").alias("seg_b"))


def overlap_neighbours(manifest: DataFrame) -> DataFrame:
    """Pairs of neighbours by id within a level whose ranges overlap."""
    w = Window.partitionBy("level").orderBy("seg")
    nxt = manifest.select("level", F.col("seg").alias("seg_a"), "min_key", "max_key", F.lead(F.struct("seg", "min_key", "max_key")).over(w).alias("n"))
    return nxt.where(overlaps(F.col("min_key"), F.col("max_key"), F.col("n.min_key"), F.col("n.max_key"))).select("level", "seg_a", F.col("n.seg").alias("seg_b"))


def overlap_groups(manifest: DataFrame) -> DataFrame:
    """(level, seg, grp): segments of a level whose ranges chain together have one group, named by its least key.

    One pass over the catalog in key order with the greatest key so far; no pairs.
    """
    w = Window.partitionBy("level").orderBy("min_key", "seg")
    reach = F.max("max_key").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = manifest.withColumn("start", F.when(reach.isNull() | (reach < F.col("min_key")), F.col("min_key")))
    return starts.select("level", "seg", F.last("start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("grp"))


def merge(rows: DataFrame, level: int | Column, drop_tombstones: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One run of rows from several segments (for each ``by``): the latest per key. Tombstones may go only if every older row is here too."""
    out = latest(rows, *by)
    if drop_tombstones:
        out = out.where("op = 'INSERT'")
    return out.withColumn("level", level if isinstance(level, Column) else F.lit(level))


def swap(manifest: DataFrame, merged_ids: DataFrame, added: DataFrame) -> DataFrame:
    """The catalog after a merge: without its inputs, with its output."""
    return manifest.join(merged_ids.select("seg"), "seg", "left_anti").select(*manifest.columns).unionByName(added.select(*manifest.columns))
