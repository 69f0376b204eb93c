"""A keyed store over Parquet: write-ahead log, segments, catalog versions and compaction.

    root/wal/b<seq>            appended operations
    root/segments/s<id>        sorted, latest per key
    root/catalog/v<n>          the segments in force, and the seq up to which the log is flushed

A catalog version is written whole and named last, so readers see either the old or the new set of
files; inputs of a merge are deleted only after the version without them is in place. One writer a
store; readers take a version once and are not disturbed.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import compaction, state
from tidemark.sources import changelog, files, segments

LOG = "seq long, k string, op string, vtype string, v string"
CATALOG = "seg long, level int, n_rows long, min_key string, max_key string, min_seq long, max_seq long, flushed long"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # --- catalog

    def _versions(self) -> list[int]:
        done = [n for n in files.names(self.spark, f"{self.root}/catalog") if n[0] == "v" and files.exists(self.spark, f"{self.root}/catalog/{n}/_SUCCESS")]
        return sorted(int(n[1:]) for n in done)

    def catalog(self) -> DataFrame:
        """Segments in force. A row with a null ``seg`` carries only the flushed seq."""
        v = self._versions()
        return self.spark.read.schema(CATALOG).parquet(f"{self.root}/catalog/v{v[-1]:09d}") if v else self.spark.createDataFrame([], CATALOG)

    def _publish(self, rows: DataFrame) -> None:
        v = self._versions()
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/catalog/v{(v[-1] + 1 if v else 1):09d}")

    def _flushed(self) -> int:
        return self.catalog().agg(F.max("flushed")).first()[0] or 0

    # --- data

    def _wal(self) -> DataFrame:
        """Logged operations that no segment holds yet."""
        done = self._flushed()
        names = [n for n in files.names(self.spark, f"{self.root}/wal") if n[0] == "b" and files.exists(self.spark, f"{self.root}/wal/{n}/_SUCCESS")]
        paths = [f"{self.root}/wal/{n}" for n in names if int(n[1:]) > done]
        return self.spark.read.schema(LOG).parquet(*paths) if paths else self.spark.createDataFrame([], LOG)

    def _segment(self, seg: int) -> str:
        return f"{self.root}/segments/s{seg:09d}"

    def _rows(self) -> DataFrame:
        ids = [r["seg"] for r in self.catalog().where("seg IS NOT NULL").select("seg").collect()]
        return self.spark.read.schema(LOG).parquet(*map(self._segment, ids)) if ids else self.spark.createDataFrame([], LOG)

    def log(self) -> DataFrame:
        return self._rows().unionByName(self._wal())

    def live(self) -> DataFrame:
        return state.live(self.log())

    def _next_seq(self) -> int:
        names = [int(n[1:]) for n in files.names(self.spark, f"{self.root}/wal") if n[0] == "b"]
        return max([self._flushed(), *names]) + 1

    def append(self, ops: DataFrame) -> None:
        """Log operations (id, k, op, vtype, v). Ids give their order; they needn't be dense."""
        base = self._next_seq()
        span = ops.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
        if span["lo"] is None:
            return
        last = base + span["hi"] - span["lo"]
        ops.select((F.col("id") - span["lo"] + base).alias("seq"), "k", "op", "vtype", "v").write.mode("overwrite").parquet(f"{self.root}/wal/b{last:018d}")

    # --- the engine's calls

    def execute(self, lines: DataFrame) -> DataFrame:
        """Run command lines (id, line) in id order; returns (id, reply, found). Reads see the writes before them.

        The replies are read from the files in force at the call, so take them before the next flush.
        """
        parsed = changelog.parse(lines)
        base = self.live().select("k", "v")
        out = changelog.replies(parsed, base)
        self.append(parsed.where("op IN ('INSERT', 'DELETE')").select("id", "k", "op", "vtype", "v"))
        return out

    def insert(self, key: str, value: int | str) -> None:
        """Typed as the command would be: a number of 32 bits is an integer, all else its text."""
        row = self.spark.createDataFrame([(0, key, str(value))], "id long, k string, raw string")
        self.append(row.select("id", "k", F.lit("INSERT").alias("op"), values.vtype(F.col("raw")).alias("vtype"), values.canonical(F.col("raw")).alias("v")))

    def delete(self, key: str) -> None:
        self.append(self.spark.createDataFrame([(0, key, "DELETE", None, None)], "id long, k string, op string, vtype string, v string"))

    def get(self, key: str) -> int | str | None:
        row = state.live(self.log().where(F.col("k") == key)).first()
        return None if row is None else int(row["v"]) if row["vtype"] == "INT" else row["v"]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return state.multi_get(keys, self.log())

    def flush(self, compact: bool = True) -> None:
        """Write the log as a level-0 segment, publish it, drop the log; then merge until nothing overlaps, if ``compact``."""
        wal = self._wal()
        top = wal.agg(F.max("seq")).first()[0]
        if top is None:
            return
        old = self.catalog()
        seg = (old.agg(F.max("seg")).first()[0] or 0) + 1
        segments.write(state.latest(wal).select("seq", "k", "op", "vtype", "v"), self._segment(seg))
        self._publish(old.where("seg IS NOT NULL").withColumn("flushed", F.lit(top).cast("long")).unionByName(self._entry(seg, 0, top)))
        for n in files.names(self.spark, f"{self.root}/wal"):
            if n[0] == "b" and n[1:].isdigit() and int(n[1:]) <= top:
                files.delete(self.spark, f"{self.root}/wal/{n}")
        if compact:
            self.compact_all()

    def _entry(self, seg: int, level: int, flushed: int) -> DataFrame:
        rows = self.spark.read.schema(LOG).parquet(self._segment(seg)).withColumn("seg", F.lit(seg).cast("long"))
        return segments.manifest(rows, level).withColumn("flushed", F.lit(flushed).cast("long"))

    def compact(self, full: bool = False) -> bool:
        """Merge overlapping segments of the lowest level that has some, or all of them; False if there is nothing to do.

        Only a full compaction drops tombstones, since every older row is then among its inputs.
        """
        catalog = self.catalog().where("seg IS NOT NULL")
        if full:
            ids = [r["seg"] for r in catalog.select("seg").collect()]
            level = (catalog.agg(F.max("level")).first()[0] or 0) + 1
        else:
            groups: dict[tuple, list[int]] = defaultdict(list)
            for r in compaction.overlap_groups(catalog).collect():  # a row for each segment in force
                groups[r["level"], r["grp"]].append(r["seg"])
            lowest, ids = min(((key[0], sorted(own)) for key, own in groups.items() if len(own) > 1), default=(None, []))
            level = None if lowest is None else lowest + 1
        if len(ids) < (1 if full else 2):
            return False
        flushed = self._flushed()
        seg = catalog.agg(F.max("seg")).first()[0] + 1
        rows = self.spark.read.schema(LOG).parquet(*map(self._segment, ids))
        segments.write(compaction.merge(rows, level, drop_tombstones=full).select("seq", "k", "op", "vtype", "v"), self._segment(seg))
        gone = self.spark.createDataFrame([(i,) for i in ids], "seg long")
        kept = compaction.swap(catalog, gone, self._entry(seg, level, flushed))
        self._publish(kept.unionByName(self.spark.createDataFrame([(None,) * 7 + (flushed,)], CATALOG)))
        for i in ids:
            files.delete(self.spark, self._segment(i))
        return True

    def compact_all(self) -> None:
        """Merge until no segments of a level overlap."""
        while self.compact():
            pass

    def segments(self) -> DataFrame:
        """Segments in force, newest first (column ``place``)."""
        return segments.newest_first(self.catalog().where("seg IS NOT NULL"))

    def cached(self) -> DataFrame:
        """The live view kept in executors for repeated reads; ``unpersist`` frees it. Not seen: later writes."""
        return self.live().persist()

    def close(self) -> None:
        self.flush()
