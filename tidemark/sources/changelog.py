"""Changelogs: from events, from command lines, and the load generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.values import canonical, vtype


def from_events(events: DataFrame) -> DataFrame:
    """One operation for each event: errors delete the user's key, clicks store an integer, others a string."""
    kind = F.col("event_type")
    text = F.when(kind == "click", F.floor("value").cast("int").cast("string")).when(kind != "error", kind)
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("shard"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("_"), F.get_json_object("props", "$.k")).alias("k"),
        F.when(kind == "error", "DELETE").otherwise("INSERT").alias("op"),
        F.when(kind == "click", "INT").when(kind != "error", "STRING").alias("vtype"),
        text.alias("v"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("seg"),
    )


def tokens(line: Column) -> Column:
    return F.split(F.trim(line), " ", -1)


def parse(lines: DataFrame) -> DataFrame:
    """Command lines (id, line, and client if it is known) with their key, typed value, operation and the reply known from the text alone.

    ``reply`` is null for a well-formed get, whose answer depends on the state.
    """
    t = tokens(F.col("line"))
    n, verb = F.size(t), F.get(t, F.lit(0))
    raw = F.get(F.split(F.trim("line"), " ", 3), F.lit(2))
    is_set, is_get, is_del = (verb == "set") & (n > 2), (verb == "get") & (n == 2), (verb == "del") & (n == 2)
    return lines.select(
        *[c for c in ("id", "client", "line") if c in lines.columns],
        F.when(is_set | is_get | is_del, F.get(t, F.lit(1))).alias("k"),
        F.when(is_set, "INSERT").when(is_del, "DELETE").when(is_get, "GET").alias("op"),
        F.when(is_set, vtype(raw)).alias("vtype"),
        F.when(is_set, canonical(raw)).alias("v"),
        F.when(is_set | is_del, "success").when(is_get, F.lit(None)).when((verb == "set") & (n == 2), "rip").when(verb == "set", "failed").otherwise("ah?").alias("reply"),
    )


def replies(parsed: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(id, reply, found) of parsed commands run in id order over the live view ``base`` (k, v)."""
    keyed = parsed.where(F.col("op").isNotNull())
    before = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wrote = F.when(F.col("op") != "GET", F.struct("op", "v"))
    seen = keyed.withColumn("last", F.last(wrote, ignorenulls=True).over(before)).where("op = 'GET'")
    value = F.when(F.col("last.op") == "INSERT", F.col("last.v"))
    if base is not None:
        seen = seen.join(base.select(F.col("k").alias("b_k"), F.col("v").alias("b_v")), F.col("k") == F.col("b_k"), "left")
        value = F.when(F.col("last").isNull(), F.col("b_v")).otherwise(value)
    got = seen.select("id", F.coalesce(value, F.lit("null")).alias("reply"), value.isNotNull().alias("found"))
    rest = parsed.where(F.col("reply").isNotNull()).select("id", "reply", F.lit(None).cast("boolean").alias("found"))
    return got.unionByName(rest)


def workload(spark: SparkSession, clients: int, sets: int = 1001) -> DataFrame:
    """The load generator's lines: every client sets ``sets`` keys of its own."""
    n = spark.range(clients * sets)
    i, j = F.floor(F.col("id") / sets).cast("long"), F.col("id") % sets
    return n.select("id", F.format_string("set key_%d_%d %d", i, j, j).alias("line"))
