"""Session builder: what was submitted or is set already wins; the rest suits local runs."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession

#: Settings for local runs alone.
LOCAL = {"spark.sql.shuffle.partitions", "spark.driver.memory"}


def session(name: str = "tidemark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with UTC time and AQE; a local one with few shuffle partitions if no master was submitted."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    given = dict(SparkConf().getAll())
    builder = SparkSession.builder.appName(given.get("spark.app.name", name))
    if "spark.master" not in given:
        builder = builder.master(f"local[{cores}]")
    for k, v in settings.items():
        if k in conf or k not in given and (k not in LOCAL or "spark.master" not in given):
            builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
