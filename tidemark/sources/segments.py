"""Segments: sorted Parquet files with Bloom filters and prefix encoding, and their catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import position
from tidemark.operators.state import latest

ROWS_A_BLOCK = 16


def flush(log: DataFrame) -> DataFrame:
    """What each flush batch writes: the latest operation per key, tombstones included."""
    return latest(log, "seg")


def manifest(rows: DataFrame, level: int = 0) -> DataFrame:
    """One catalog row for each segment, with its true key and seq ranges."""
    return rows.groupBy("seg").agg(F.lit(level).alias("level"), F.count("*").alias("n_rows"), F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq")).select("seg", "level", "n_rows", "min_key", "max_key", "min_seq", "max_seq")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with their position in key order in their segment, from 0."""
    return position(rows, "seg", "k")


def block_index(rows: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """The sparse index: the first key of each block of a segment."""
    return index_of(blocks(rows, rows_a_block))


def blocks(rows: DataFrame, rows_a_block: int = ROWS_A_BLOCK) -> DataFrame:
    """Rows with the number of their block in their segment."""
    return ordered(rows).withColumn("blk", F.floor(F.col("pos") / rows_a_block).cast("long")).drop("pos")


def index_of(blocked: DataFrame) -> DataFrame:
    return blocked.groupBy("seg", "blk").agg(F.min("k").alias("first_key"))


def write(rows: DataFrame, path: str, fpp: float = 0.1, files: int | None = None, block: int = 16 << 20, page: int = 64 << 10) -> None:
    """Write rows in key order, in files of disjoint ranges; without ``files`` as many as adaptive execution makes of their size.

    ``block`` and ``page`` are bytes of a row group and of a page; Bloom filters take the size that the keys of a file need.
    """
    laid = rows.repartitionByRange(files, "k") if files else rows.repartitionByRange("k")
    options = {"parquet.bloom.filter.enabled#k": "true", "parquet.bloom.filter.adaptive.enabled#k": "true", "parquet.bloom.filter.fpp#k": str(fpp), "parquet.writer.version": "v2", "parquet.block.size": str(block), "parquet.page.size": str(page)}
    laid.sortWithinPartitions("k").write.mode("overwrite").options(**options).parquet(path)


def newest_first(manifest: DataFrame) -> DataFrame:
    """The catalog with the place of each segment in a search, newest first; only for catalogs."""
    return manifest.withColumn("place", (F.row_number().over(Window.orderBy(F.desc("max_seq"), F.desc("seg"))) - 1).cast("long"))


def read(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def lookup(spark: SparkSession, keys: list[str], *paths: str) -> DataFrame:
    """Point reads: literal keys reach the scan, where file ranges and Bloom filters skip row groups."""
    return latest(read(spark, *paths).where(F.col("k").isin(keys)))
