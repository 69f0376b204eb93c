"""The command and changelog streams (O12-O14, O24-O28, O75): each micro-batch is flushed as one segment.

``foreachBatch`` may repeat a batch; a segment is named by its batch id and overwritten, so the
result is the same. A restart goes on from the stream's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.state import latest, live
from tidemark.sources import changelog, files
from tidemark.sources.segments import write


def flush_stream(log: DataFrame, out: str, checkpoint: str):
    """Start a query that writes the latest operation per key of each micro-batch to ``out``/s<batch>."""

    def flush(batch: DataFrame, batch_id: int) -> None:
        write(latest(batch).withColumn("seg", F.lit(batch_id).cast("long")), f"{out}/s{batch_id:09d}")

    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_flushed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(*[f"{out}/{n}" for n in files.names(spark, out)])


def stream_live_state(spark: SparkSession, folder: str, name: str, work: str) -> DataFrame:
    """The live view after every event of a table has gone through the stream."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).option("maxFilesPerTrigger", 1).parquet(folder)
    query = flush_stream(changelog.from_events(events), f"{work}/segments", f"{work}/state")
    query.awaitTermination()
    return live(read_flushed(spark, f"{work}/segments"))


def stream_commands(spark: SparkSession, folder: str, out: str, checkpoint: str):
    """Command files (text, one line each: ``id<TAB>command``) into changelog segments."""
    lines = spark.readStream.option("maxFilesPerTrigger", 1).text(folder)
    parts = F.split("value", "\t", 2)
    parsed = changelog.parse(lines.select(parts[0].cast("long").alias("id"), parts[1].alias("line")))
    return flush_stream(parsed.where("op IN ('INSERT', 'DELETE')").withColumn("seq", F.col("id")), out, checkpoint)
