"""Scans in key order within groups, without a task for a whole group.

Rows are range-partitioned by group and key and written to the checkpoint folder, so that parts stay
what they are. What a window over a whole group would give is made from a window over each part and
what the parts before it carry over: a row for each part and group, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.files import staged


def lay(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """``rows`` with ``part``: parts of a group are in the order of its keys."""
    return staged(rows.repartitionByRange(by, *order).withColumn("part", F.spark_partition_id()))


def _carried(laid: DataFrame, by: str, of_part: Column, so_far) -> DataFrame:
    """(c_by, c_part, carried) for each part: ``so_far`` over what ``of_part`` gives for the parts of the group before it."""
    parts = laid.groupBy(by, "part").agg(of_part.alias("own"))
    before = Window.partitionBy(by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(F.col(by).alias("c_by"), F.col("part").alias("c_part"), so_far(F.col("own")).over(before).alias("carried"))


def _with(laid: DataFrame, by: str, carried: DataFrame) -> DataFrame:
    return laid.join(carried, (F.col(by) == F.col("c_by")) & (F.col("part") == F.col("c_part"))).drop("c_by", "c_part")


def position(rows: DataFrame, by: str, key: str, name: str = "pos") -> DataFrame:
    """Rows with their position in key order in their group, from 0."""
    laid = lay(rows, by, key)
    nth = F.row_number().over(Window.partitionBy(by, "part").orderBy(key)) - 1
    out = _with(laid, by, _carried(laid, by, F.count("*"), F.sum))
    return out.withColumn(name, (nth + F.coalesce("carried", F.lit(0))).cast("long")).drop("part", "carried")


def previous(rows: DataFrame, by: str, key: str, name: str = "prev") -> DataFrame:
    """Rows with the key before theirs in their group, null for the first."""
    laid = lay(rows, by, key)
    own = F.lag(key).over(Window.partitionBy(by, "part").orderBy(key))
    return _with(laid, by, _carried(laid, by, F.max(key), F.max)).withColumn(name, F.coalesce(own, "carried")).drop("part", "carried")


def last_known(rows: DataFrame, by: str, order: tuple[str, ...], value: str, name: str) -> DataFrame:
    """Rows with the last value that isn't null at or before them in their group. Values must not decrease along ``order``."""
    laid = lay(rows, by, *order)
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(by, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return _with(laid, by, _carried(laid, by, F.max(value), F.max)).withColumn(name, F.coalesce(own, "carried")).drop("part", "carried")
