"""Registered queries over the driver's tables, with their DuckDB oracles."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import bloom, codec, values
from tidemark.operators import compaction, ordered, rotation, state
from tidemark.operators.floor import block_scan, floor_lookup
from tidemark.sources import changelog, files, segments
from tidemark.store import Store
from tidemark.streaming import engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.from_events(events(spark, sf_dir))


def flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.flush(log(spark, sf_dir))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.manifest(flushed(spark, sf_dir))


def work_dir(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints."""
    return f"{files.shared_folder(spark)}/{uuid.uuid4()}"


LOG = """
log AS (SELECT event_id AS seq, user_id AS shard, concat('u', user_id::VARCHAR, '_', json_extract_string(props, '$.k')) AS k,
  CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'INSERT' END AS op,
  CASE WHEN event_type = 'click' THEN 'INT' WHEN event_type = 'error' THEN NULL ELSE 'STRING' END AS vtype,
  CASE WHEN event_type = 'click' THEN floor(value)::INT::VARCHAR WHEN event_type = 'error' THEN NULL ELSE event_type END AS v,
  floor(event_id / 1000)::BIGINT AS seg FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
flushed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg, k ORDER BY seq DESC) AS rn FROM log) WHERE rn = 1),
catalog AS (SELECT seg, 0 AS level, count(*) AS n_rows, min(k) AS min_key, max(k) AS max_key, min(seq) AS min_seq, max(seq) AS max_seq FROM flushed GROUP BY seg)
"""


@query(f"WITH {LOG} SELECT k, vtype, v, seq FROM latest WHERE op = 'INSERT'")
def live_state(spark, sf_dir):
    """The table's live view."""
    return state.live(log(spark, sf_dir))


@query(f"WITH {LOG}, probes AS (SELECT concat('u', (i % 200)::VARCHAR, '_', (i % 97)::VARCHAR) AS k FROM range(2000) r(i)) SELECT p.k, coalesce(l.v, 'null') AS reply, l.k IS NOT NULL AS found FROM probes p LEFT JOIN (SELECT * FROM latest WHERE op = 'INSERT') l ON p.k = l.k")
def multi_get(spark, sf_dir):
    """A batch of reads, absent keys among them."""
    i = F.col("id")
    keys = spark.range(2000).select(F.concat(F.lit("u"), (i % 200).cast("string"), F.lit("_"), (i % 97).cast("string")).alias("k"))
    return state.multi_get(keys, log(spark, sf_dir))


def command_lines(spark, sf_dir):
    key = F.concat(F.lit("k"), (F.col("user_id") % 50).cast("string"))
    line = F.when(F.col("event_type") == "click", F.concat(F.lit("set "), key, F.lit(" 00"), F.floor("value").cast("int").cast("string"))).when(F.col("event_type") == "purchase", F.concat(F.lit("  set "), key, F.lit(" a  b"))).when(F.col("event_type") == "error", F.concat(F.lit("del "), key))
    line = line.when(F.col("event_id") % 7 == 0, F.concat(F.lit("get  "), key)).when(F.col("event_id") % 11 == 0, "set").when(F.col("event_id") % 13 == 0, "set k").when(F.col("event_id") % 17 == 0, "SET k v").when(F.col("event_id") % 19 == 0, "").otherwise(F.concat(F.lit("get "), key))
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), line.alias("line"))


_LINES = """
lines AS (SELECT event_id AS id, trim(CASE WHEN event_type = 'click' THEN concat('set k', (user_id % 50)::VARCHAR, ' 00', floor(value)::INT::VARCHAR) WHEN event_type = 'purchase' THEN concat('  set k', (user_id % 50)::VARCHAR, ' a  b')
  WHEN event_type = 'error' THEN concat('del k', (user_id % 50)::VARCHAR) WHEN event_id % 7 = 0 THEN concat('get  k', (user_id % 50)::VARCHAR) WHEN event_id % 11 = 0 THEN 'set' WHEN event_id % 13 = 0 THEN 'set k'
  WHEN event_id % 17 = 0 THEN 'SET k v' WHEN event_id % 19 = 0 THEN '' ELSE concat('get k', (user_id % 50)::VARCHAR) END, ' ') AS line FROM events),
words AS (SELECT *, string_split(line, ' ') AS t FROM lines),
cmd AS (SELECT *, CASE WHEN t[1] = 'set' AND len(t) > 2 THEN 'INSERT' WHEN t[1] = 'del' AND len(t) = 2 THEN 'DELETE' WHEN t[1] = 'get' AND len(t) = 2 THEN 'GET' END AS op, t[2] AS k, array_to_string(t[3:], ' ') AS raw FROM words),
cmds AS (SELECT *, coalesce(CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+$') THEN TRY_CAST(raw AS INT)::VARCHAR END, raw) AS v FROM cmd)
"""


@query(
    f"""WITH {_LINES},
g AS (SELECT c.id, c.k, (SELECT max(w.id) FROM cmds w WHERE w.k = c.k AND w.op IN ('INSERT', 'DELETE') AND w.id < c.id) AS wid FROM cmds c WHERE c.op = 'GET')
SELECT g.id, coalesce(CASE WHEN w.op = 'INSERT' THEN w.v END, 'null') AS reply, coalesce(w.op = 'INSERT', false) AS found FROM g LEFT JOIN cmds w ON w.id = g.wid
UNION ALL SELECT id, CASE WHEN op IN ('INSERT', 'DELETE') THEN 'success' WHEN t[1] = 'set' AND len(t) = 2 THEN 'rip' WHEN t[1] = 'set' THEN 'failed' ELSE 'ah?' END, NULL FROM cmds WHERE op IS NULL OR op <> 'GET'"""
)
def command_replies(spark, sf_dir):
    """A batch of command lines run in order, with the reply to each."""
    return changelog.replies(changelog.parse(command_lines(spark, sf_dir)))


_RAW = "CASE event_id % 8 WHEN 0 THEN '007' WHEN 1 THEN '+5' WHEN 2 THEN '-1' WHEN 3 THEN '2147483648' WHEN 4 THEN ' 5 ' WHEN 5 THEN '-' WHEN 6 THEN event_type ELSE floor(value)::INT::VARCHAR END"


@query(f"SELECT id, raw, CASE WHEN n IS NOT NULL THEN 'INT' ELSE 'STRING' END AS vtype, coalesce(n::VARCHAR, raw) AS v FROM (SELECT *, CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+$') THEN TRY_CAST(raw AS INT) END AS n FROM (SELECT event_id AS id, {_RAW} AS raw FROM events))")
def value_typing(spark, sf_dir):
    """Integers, numbers out of range and strings told apart."""
    m = F.col("event_id") % 8
    raw = F.when(m == 0, "007").when(m == 1, "+5").when(m == 2, "-1").when(m == 3, "2147483648").when(m == 4, " 5 ").when(m == 5, "-").when(m == 6, F.col("event_type")).otherwise(F.floor("value").cast("int").cast("string"))
    t = events(spark, sf_dir).select(F.col("event_id").alias("id"), raw.alias("raw"))
    return t.select("id", "raw", values.vtype(F.col("raw")).alias("vtype"), values.canonical(F.col("raw")).alias("v"))


@query(f"WITH {LOG} SELECT k, seq FROM latest WHERE op = 'DELETE'")
def tombstones(spark, sf_dir):
    """O3: keys whose last operation deletes them."""
    return state.tombstones(log(spark, sf_dir))


@query("SELECT i * 1001 + j AS id, concat('set key_', i::VARCHAR, '_', j::VARCHAR, ' ', j::VARCHAR) AS line FROM range(3) a(i), range(1001) b(j)")
def workload_generate(spark, sf_dir):
    """The load generator of three clients."""
    return changelog.workload(spark, 3)


@query(f"WITH {LOG} SELECT seg, k, op, vtype, v, seq FROM flushed")
def segment_flush(spark, sf_dir):
    """What each flush writes."""
    return flushed(spark, sf_dir)


@query(f"WITH {LOG} SELECT * FROM catalog")
def segment_manifest(spark, sf_dir):
    """The catalog of segments."""
    return catalog(spark, sf_dir)


@query(f"WITH {LOG} SELECT seg, k, op, seq, row_number() OVER (PARTITION BY seg ORDER BY k) - 1 AS pos FROM flushed")
def segment_ordered_scan(spark, sf_dir):
    """Every segment in key order."""
    return segments.ordered(flushed(spark, sf_dir)).select("seg", "k", "op", "seq", "pos")


_BLOCKS = "blocks AS (SELECT seg, pos // 16 AS blk, min(k) AS first_key FROM (SELECT seg, k, row_number() OVER (PARTITION BY seg ORDER BY k) - 1 AS pos FROM flushed) GROUP BY ALL)"


@query(f"WITH {LOG}, {_BLOCKS} SELECT seg, blk, first_key FROM blocks")
def block_index(spark, sf_dir):
    """The sparse index of every segment."""
    return segments.block_index(flushed(spark, sf_dir))


@query(f"WITH {LOG}, {_BLOCKS}, probes AS (SELECT seg - 1 AS seg, k FROM flushed WHERE seg > 0) SELECT p.seg, p.k, b.blk, b.first_key FROM probes p ASOF LEFT JOIN blocks b ON p.seg = b.seg AND p.k >= b.first_key")
def block_floor_lookup(spark, sf_dir):
    """The block of a segment that may hold each key of the next segment."""
    return _floors(files.staged(flushed(spark, sf_dir)))


def _floors(rows, blocked=None):
    probes = rows.where("seg > 0").select((F.col("seg") - 1).alias("seg"), "k")
    index = segments.block_index(rows) if blocked is None else segments.index_of(blocked)
    return floor_lookup(probes, index, "seg", "k", "blk", "first_key")


@query(f"""WITH {LOG}, {_BLOCKS}, probes AS (SELECT seg - 1 AS seg, k FROM flushed WHERE seg > 0), fl AS (SELECT p.seg, p.k, b.blk FROM probes p ASOF LEFT JOIN blocks b ON p.seg = b.seg AND p.k >= b.first_key)
SELECT fl.seg, fl.k, fl.blk, f.op, f.vtype, f.v, f.seq FROM fl LEFT JOIN flushed f ON f.seg = fl.seg AND f.k = fl.k""")
def block_bounded_read(spark, sf_dir):
    """Each key of the next segment read from the one block of a segment that may hold it."""
    rows = files.staged(flushed(spark, sf_dir))
    blocked = files.staged(segments.blocks(rows))
    return block_scan(_floors(rows, blocked), blocked)


@query(f"WITH {LOG} SELECT *, row_number() OVER (ORDER BY max_seq DESC) - 1 AS place FROM catalog")
def segment_listing(spark, sf_dir):
    """The catalog newest first."""
    return segments.newest_first(catalog(spark, sf_dir))


@query(f"""WITH {LOG}, r AS (SELECT *, max(max_key) OVER (PARTITION BY level ORDER BY min_key, seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM catalog)
SELECT level, seg, (SELECT max(s.min_key) FROM r s WHERE s.level = r.level AND (s.reach IS NULL OR s.reach < s.min_key) AND s.min_key <= r.min_key) AS grp FROM r""")
def overlap_groups(spark, sf_dir):
    """Segments that a compaction merges together."""
    return compaction.overlap_groups(catalog(spark, sf_dir))


@query(f"WITH {LOG} SELECT a.level, a.seg AS seg_a, b.seg AS seg_b FROM catalog a JOIN catalog b ON a.level = b.level AND a.seg < b.seg AND a.min_key <= b.max_key AND b.min_key <= a.max_key")
def overlap_pairs(spark, sf_dir):
    """Segments whose key ranges overlap."""
    return compaction.overlap_pairs(catalog(spark, sf_dir))


@query(f"WITH {LOG} SELECT level, seg AS seg_a, seg_b FROM (SELECT *, lead(seg) OVER w AS seg_b, lead(min_key) OVER w AS lo, lead(max_key) OVER w AS hi FROM catalog WINDOW w AS (PARTITION BY level ORDER BY seg)) WHERE min_key <= hi AND lo <= max_key")
def overlap_neighbours(spark, sf_dir):
    """Overlapping neighbours by segment id."""
    return compaction.overlap_neighbours(catalog(spark, sf_dir))


_PAIRS = "merged AS (SELECT * FROM (SELECT *, seg // 2 AS pair, row_number() OVER (PARTITION BY seg // 2, k ORDER BY seq DESC) AS r FROM flushed) WHERE r = 1)"


def merged_pairs(rows):
    """Segments 0 and 1, 2 and 3, and so on merged, all in one grouped pass."""
    return compaction.merge(rows.withColumn("pair", F.floor(F.col("seg") / 2).cast("long")), 1, by=("pair",))


@query(f"WITH {LOG}, {_PAIRS} SELECT pair, k, op, vtype, v, seq, 1 AS level FROM merged")
def compact_pair(spark, sf_dir):
    """All segments merged in twos, tombstones kept, one level up."""
    return merged_pairs(flushed(spark, sf_dir))


@query(f"WITH {LOG} SELECT k, op, vtype, v, seq, 1 AS level FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS r FROM flushed) WHERE r = 1 AND op = 'INSERT'")
def full_compaction(spark, sf_dir):
    """All segments merged, tombstones gone."""
    return compaction.merge(flushed(spark, sf_dir), 1, drop_tombstones=True)


_LIVE = f"WITH {LOG} SELECT k, vtype, v FROM latest WHERE op = 'INSERT'"


def appended(spark, sf_dir, store, parts, after):
    """The log appended in ``parts`` ranges of seq, with a call after each."""
    ops = log(spark, sf_dir).select(F.col("seq").alias("id"), "k", "op", "vtype", "v")
    top = ops.agg(F.max("id")).first()[0] or 0
    for i in range(parts):
        store.append(ops.where((F.col("id") >= top * i // parts + (i > 0)) & (F.col("id") <= top * (i + 1) // parts)))
        after(i)


@query(_LIVE)
def wal_replay(spark, sf_dir):
    """A store that is logged to, flushed in part, and opened again on its log files."""
    root = f"{work_dir(spark)}/store"
    store = Store(spark, root)
    appended(spark, sf_dir, store, 4, lambda i: store.flush(compact=False) if i == 1 else None)
    return Store(spark, root).live().select("k", "vtype", "v")


@query(_LIVE)
def store_compaction(spark, sf_dir):
    """A store whose flushes wake the compaction, which merges until nothing overlaps."""
    store = Store(spark, f"{work_dir(spark)}/store")
    appended(spark, sf_dir, store, 3, lambda i: store.flush())
    return store.live().select("k", "vtype", "v")


@query(f"""WITH {LOG}, {_PAIRS}, twos AS (SELECT seg // 2 AS pair FROM catalog GROUP BY pair HAVING count(*) = 2)
SELECT * FROM catalog WHERE seg // 2 NOT IN (FROM twos) UNION ALL
SELECT (SELECT max(seg) + 1 FROM catalog) + pair, 1, count(*), min(k), max(k), min(seq), max(seq) FROM merged WHERE pair IN (FROM twos) GROUP BY pair""")
def catalog_swap(spark, sf_dir):
    """The catalog after all segments have been merged in twos; one left over stays."""
    rows = flushed(spark, sf_dir)
    now = files.staged(segments.manifest(rows))
    two = now.groupBy(F.floor(F.col("seg") / 2).cast("long").alias("pair")).count().where("count = 2").select("pair")
    new_id = now.agg(F.max("seg") + 1).scalar() + F.col("seg")
    added = segments.manifest(merged_pairs(rows).join(two, "pair", "left_semi").withColumnRenamed("pair", "seg"), 1).withColumn("seg", new_id)
    gone = now.withColumn("pair", F.floor(F.col("seg") / 2).cast("long")).join(two, "pair", "left_semi")
    return compaction.swap(now, gone, added)


_SIZE = "(strlen(k) + CASE WHEN length(k) < 128 THEN 1 ELSE 2 END + CASE WHEN vtype = 'STRING' THEN strlen(v) + CASE WHEN length(v) < 128 THEN 1 ELSE 2 END WHEN vtype = 'INT' THEN {vint} ELSE 1 END)::BIGINT"
_VINT = "CASE WHEN v::INT < 0 THEN 5 WHEN v::INT < 128 THEN 1 WHEN v::INT < 16384 THEN 2 WHEN v::INT < 2097152 THEN 3 WHEN v::INT < 268435456 THEN 4 ELSE 5 END"


@query(f"""WITH RECURSIVE {LOG}, sized AS (SELECT seq, shard, {_SIZE.format(vint=_VINT)} AS bytes, row_number() OVER (PARTITION BY shard ORDER BY seq) AS n FROM log),
fold AS (SELECT seq, shard, bytes, n, 0::BIGINT AS memtable, CASE WHEN bytes >= 1024 THEN 1 ELSE 0 END AS full_, CASE WHEN bytes >= 1024 THEN 0 ELSE bytes END AS used FROM sized WHERE n = 1
UNION ALL SELECT s.seq, s.shard, s.bytes, s.n, f.memtable + f.full_, CASE WHEN f.used + s.bytes >= 1024 THEN 1 ELSE 0 END, CASE WHEN f.used + s.bytes >= 1024 THEN 0 ELSE f.used + s.bytes END FROM fold f JOIN sized s ON s.shard = f.shard AND s.n = f.n + 1)
SELECT seq, shard, bytes, memtable FROM fold""")
def memtable_rotation(spark, sf_dir):
    """Which memtable each operation of a user falls into."""
    return rotation.rotate(log(spark, sf_dir))


@query(f"""WITH {LOG}, o AS (SELECT seg, k, lag(k) OVER (PARTITION BY seg ORDER BY k) AS prev FROM flushed)
SELECT seg, k, CASE WHEN prev IS NULL THEN 0 ELSE len(list_filter(range(1, least(length(k), length(prev)) + 1), lambda i: left(k, i) = left(prev, i))) END::INT AS shared FROM o""")
def prefix_share(spark, sf_dir):
    """Characters that each key shares with the one before it in its segment."""
    rows = ordered.previous(flushed(spark, sf_dir).select("seg", "k"), "seg", "k")
    return rows.select("seg", "k", F.coalesce(codec.shared_prefix(F.col("k"), F.col("prev")), F.lit(0)).cast("int").alias("shared"))


@query(f"""WITH {LOG}, m AS (SELECT seq, op, v, (CASE WHEN op = 'DELETE' THEN 16 ELSE 32 END) + (CASE WHEN vtype = 'STRING' THEN 1 ELSE 0 END) AS meta FROM log), n AS (SELECT *, CASE WHEN meta = 32 THEN (seq % 5 - 2) * v::INT END AS number FROM m)
SELECT seq, number, CASE WHEN number IS NULL THEN NULL WHEN number < 0 THEN 10 ELSE greatest(1, (length(ltrim(bin(number), '0')) + 6) // 7) END::INT AS encoded_bytes, CASE WHEN meta & 240 = 16 THEN 'DELETE' ELSE 'INSERT' END AS op, CASE WHEN meta & 15 = 1 THEN 'STRING' ELSE 'INT' END AS vtype FROM n""")
def vint_codec(spark, sf_dir):
    """Bytes of each integer as written, negative ones too, and what the meta byte decodes to."""
    meta = log(spark, sf_dir).select("seq", "v", codec.meta_byte(F.col("op"), F.coalesce("vtype", F.lit(""))).alias("meta"))
    number = F.when(F.col("meta") == 32, (F.col("seq") % 5 - 2) * F.when(F.col("meta") == 32, F.col("v")).cast("int"))
    read = meta.select("seq", number.alias("number"), codec.meta_op(F.col("meta")).alias("op"), codec.meta_vtype(F.col("meta")).alias("vtype"))
    return read.withColumn("encoded_bytes", F.when(F.col("number").isNotNull(), codec.encoded_vint_size(F.col("number"))))


@query(f"""WITH {LOG} SELECT seq, CASE WHEN vtype = 'INT' THEN {_VINT} ELSE 1 END AS vint_bytes, {_SIZE.format(vint=_VINT)} AS record_bytes,
(CASE WHEN op = 'DELETE' THEN 16 ELSE 32 END) + (CASE WHEN vtype = 'STRING' THEN 1 ELSE 0 END) AS meta FROM log""")
def varint_size(spark, sf_dir):
    """Encoded sizes and meta byte of each operation."""
    number = F.when(F.col("vtype") == "INT", codec.vint_size(F.when(F.col("vtype") == "INT", F.col("v")).cast("int"))).otherwise(1)
    return log(spark, sf_dir).select("seq", number.alias("vint_bytes"), codec.record_size(F.col("k"), F.col("vtype"), F.when(F.col("vtype").isNotNull(), F.col("v"))).cast("long").alias("record_bytes"), codec.meta_byte(F.col("op"), F.coalesce("vtype", F.lit(""))).alias("meta"))


_HASHES = bloom.hashes_for(1000, bloom.bits_for(1000, 0.01))
_BITS = "[" + ", ".join(f"(list_sum(list_transform(string_split(k, ''), lambda c: ({a} * ascii(c) + {b}) % {bloom.MODULUS})) % {bloom.bits_for(1000, 0.01)})::BIGINT" for a, b in bloom.coefficients(_HASHES)) + "]"


@query(f"""WITH {LOG}, keys AS (SELECT DISTINCT seg, k, {_BITS} AS bits FROM flushed), held AS (SELECT DISTINCT unnest(bits) AS bit FROM keys WHERE seg = 0), probes AS (SELECT DISTINCT k, bits FROM keys), one AS (SELECT k, unnest(bits) AS bit FROM probes)
SELECT k, bool_and(bit IN (FROM held)) AS may_contain FROM one GROUP BY k""")
def bloom_restored(spark, sf_dir):
    """A filter of segment 0 with as many hashes as its size asks for, written, read back and probed with all keys."""
    m = bloom.bits_for(1000, 0.01)
    rows, out = flushed(spark, sf_dir).select("seg", "k"), f"{work_dir(spark)}/filter"
    bloom.build(rows.where("seg = 0"), "k", m, _HASHES).write.parquet(out)
    return bloom.may_contain(rows.select("k").distinct(), "k", spark.read.parquet(out), m, _HASHES)


_BIT = "(list_sum(list_transform(string_split(k, ''), lambda c: (48271 * ascii(c) + 16807) % 1635947)) % 4800)::BIGINT"


@query(f"WITH {LOG} SELECT DISTINCT k, {_BIT} AS bit FROM log")
def bloom_bits(spark, sf_dir):
    """The bit of each key in an explicit filter of one hash."""
    return log(spark, sf_dir).select("k").distinct().select("k", bloom.bit(F.col("k"), bloom.bits_for(1000)).alias("bit"))


@query(f"""WITH {LOG}, keys AS (SELECT DISTINCT seg, k, {_BIT} AS bit FROM flushed), bits AS (SELECT DISTINCT bit FROM keys WHERE seg = 0), probes AS (SELECT DISTINCT k, bit FROM keys WHERE seg > 0)
SELECT p.k, p.bit IN (SELECT bit FROM bits) AS may_contain, p.k IN (SELECT k FROM keys WHERE seg = 0) AS contains FROM probes p""")
def bloom_probe(spark, sf_dir):
    """Keys of the other segments against the filter of segment 0."""
    bits = bloom.bits_for(1000)
    rows = flushed(spark, sf_dir).select("seg", "k")
    own = rows.where("seg = 0").select("k")
    probes = rows.where("seg > 0").select("k").distinct().withColumn("bit", bloom.bit(F.col("k"), bits))
    filled = own.select(bloom.bit(F.col("k"), bits).alias("bit")).distinct().withColumn("hit", F.lit(True))  # ``bits`` rows at most
    held = own.distinct().withColumn("held", F.lit(True))
    return probes.join(F.broadcast(filled), "bit", "left").join(held, "k", "left").select("k", F.coalesce("hit", F.lit(False)).alias("may_contain"), F.coalesce("held", F.lit(False)).alias("contains"))


@query(f"""WITH {LOG}, m AS (SELECT max(seg) AS newest FROM log) SELECT k, v, CASE WHEN seg = newest THEN 'memtable' WHEN seg = newest - 1 THEN 'immutable' ELSE 'segment' END AS tier FROM latest, m WHERE op = 'INSERT'""")
def answering_tier(spark, sf_dir):
    """Where a read of each live key finds its answer."""
    return state.answering_tier(log(spark, sf_dir))


@query(f"WITH {LOG} SELECT k, vtype, v, seq FROM latest WHERE op = 'INSERT'")
def stream_live_state(spark, sf_dir):
    """The events as a stream, flushed batch by batch, then read."""
    return engine.stream_live_state(spark, sf_dir, "events.parquet", work_dir(spark))


_WRITES = "writes AS (SELECT *, CASE WHEN op = 'INSERT' THEN CASE WHEN regexp_matches(raw, '^[+-]?[0-9]+$') AND TRY_CAST(raw AS INT) IS NOT NULL THEN 'INT' ELSE 'STRING' END END AS vtype, row_number() OVER (PARTITION BY k ORDER BY id DESC) AS r FROM cmds WHERE op IN ('INSERT', 'DELETE'))"


@query(f"WITH {_LINES}, {_WRITES} SELECT k, vtype, v, id AS seq FROM writes WHERE r = 1 AND op = 'INSERT'")
def stream_commands(spark, sf_dir):
    """Command files as a stream, a file a batch; stopped, given more files, and started again from its checkpoint."""
    work = work_dir(spark)
    lines = command_lines(spark, sf_dir).select(F.concat_ws("\t", "id", "line").alias("value"), (F.col("id") % 2).alias("half"))
    for half in (1, 0):
        lines.where(F.col("half") == half).select("value").repartition(3).write.text(f"{work}/commands/{half}")
        engine.stream_commands(spark, f"{work}/commands/*", f"{work}/segments", f"{work}/state").awaitTermination()
    return state.live(engine.read_flushed(spark, f"{work}/segments"))


@query(f"WITH {_LINES} SELECT concat('c', (event_id % 4)::VARCHAR) AS client, count(*) AS commands, count(op) AS understood, count(CASE WHEN op IN ('INSERT', 'DELETE') THEN 1 END) AS writes FROM cmds JOIN events ON event_id = id GROUP BY 1")
def client_activity(spark, sf_dir):
    """The client of each command kept through parsing, with what it sent."""
    lines = command_lines(spark, sf_dir).withColumn("client", F.concat(F.lit("c"), (F.col("id") % 4).cast("string")))
    wrote = F.when(F.col("op").isin("INSERT", "DELETE"), 1)
    return changelog.parse(lines).groupBy("client").agg(F.count("*").alias("commands"), F.count("op").alias("understood"), F.count(wrote).alias("writes"))


@query(f"WITH {LOG} SELECT k, op, vtype, v, seq FROM latest WHERE k IN ('u1_1', 'u2_2', 'u3_3', 'u7_42', 'u50_7', 'none')")
def point_lookup(spark, sf_dir):
    """A few literal keys against written segments, found by file ranges and Bloom filters."""
    out = f"{work_dir(spark)}/segments"
    segments.write(flushed(spark, sf_dir), out, files=4)
    return segments.lookup(spark, ["u1_1", "u2_2", "u3_3", "u7_42", "u50_7", "none"], out)


@query(f"WITH {LOG} SELECT k, v FROM latest WHERE op = 'INSERT' AND vtype = 'INT' AND v::INT >= 50")
def typed_filter(spark, sf_dir):
    """O5, O10 (extension): a predicate on the typed view of values."""
    number = F.when(F.col("vtype") == "INT", F.col("v")).try_cast("int")
    return state.live(log(spark, sf_dir)).where(number >= 50).select("k", "v")
