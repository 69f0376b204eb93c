"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; make one only in local mode, where none is named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-checkpoints-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation
    and every later use sees the same rows in the same partitions."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def has_rows(df: DataFrame) -> bool:
    return bool(df.take(1))
