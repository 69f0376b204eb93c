"""The store, the command stream and the scans on the awkward cases: -1, non-ASCII keys, prefixes, retyped values, restarts."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bloom
from tidemark.operators import compaction, ordered, rotation
from tidemark.operators.floor import floor_lookup
from tidemark.sources import segments
from tidemark.store import Store
from tidemark.streaming import engine

#: (command, reply) in order; FIXTURES.md, section 2.
SCRIPT = [
    ("set language kotlin", "success"), ("get language", "kotlin"), ("del language", "success"), ("get language", "null"), ("get missing", "null"), ("del missing", "success"),
    ("set", "failed"), ("set k", "rip"), ("get a b", "ah?"), ("get  k", "ah?"), ("", "ah?"), ("ping", "ah?"), ("SET k v", "ah?"), ("set k a b  c", "success"), ("get k", "a b  c"),
    ("set n 007", "success"), ("get n", "7"), ("set big 2147483648", "success"), ("get big", "2147483648"), ("set m -1", "success"), ("get m", "-1"), ("set k 1", "success"), ("set k x", "success"), ("get k", "x"),
    ("del k", "success"), ("set k y", "success"), ("get k", "y"), ("set ab 1", "success"), ("set a 2", "success"), ("get a", "2"), ("set none null", "success"), ("get none", "null"),
    ("set é世\U0001f600 界", "success"), ("get é世\U0001f600", "界"), ("set  k v", "success"),
]
LIVE = {"k": ("STRING", "y"), "n": ("INT", "7"), "big": ("STRING", "2147483648"), "m": ("INT", "-1"), "ab": ("INT", "1"), "a": ("INT", "2"), "none": ("STRING", "null"), "é世\U0001f600": ("STRING", "界"), "": ("STRING", "k v")}


def view(frame):
    return {r["k"]: (r["vtype"], r["v"]) for r in frame.collect()}


def lines(spark, commands):
    return spark.createDataFrame(list(enumerate(commands)), "id long, line string")


@pytest.mark.parametrize("step", [5, 12, 100])
def test_replies_and_live_view_survive_flushes_compactions_and_restarts(spark, tmp_path, step):
    root = str(tmp_path)
    for at in range(0, len(SCRIPT), step):
        part = SCRIPT[at : at + step]
        store = Store(spark, root)  # a restart before every part
        got = {r["id"]: r["reply"] for r in store.execute(lines(spark, [c for c, _ in part])).collect()}
        assert [got[i] for i in range(len(part))] == [r for _, r in part]
        if at // step % 2 == 0:
            store.flush()
    assert view(Store(spark, root).live()) == LIVE
    store.close()
    store.compact(full=True)
    assert view(store.live()) == LIVE and store.segments().count() == 1


def test_calls(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for key, value, read in [("a", True, "True"), ("a", 2**31, str(2**31)), ("b", -1, -1), ("c", "007", 7), ("d", "x", "x")]:
        store.insert(key, value)
        assert store.get(key) == read
    (tmp_path / "wal" / "stray").mkdir()
    store.flush(compact=False)
    store.delete("b")
    store.flush(compact=False)
    assert store.get("b") is None and store.segments().select("place", "seg").collect() == [(0, 2), (1, 1)]
    assert store.compact() and not store.compact() and store.get("b") is None
    held = store.cached()
    assert view(held) == {"a": ("STRING", str(2**31)), "c": ("INT", "7"), "d": ("STRING", "x")}
    held.unpersist()
    assert [(r["k"], r["reply"], r["found"]) for r in store.multi_get(spark.createDataFrame([("c",), ("zz",)], "k string")).orderBy("k").collect()] == [("c", "7", True), ("zz", "null", False)]


def test_a_command_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for base, part in ((0, SCRIPT[:20]), (20, SCRIPT[20:]), (99, [])):
        if part:
            spark.createDataFrame([(f"{base + i}\t{c}",) for i, (c, _) in enumerate(part)], "value string").write.mode("append").text(folder)
        engine.stream_commands(spark, folder, out, state).awaitTermination()
    from tidemark.operators.state import live

    assert view(live(engine.read_flushed(spark, out))) == LIVE


def rows(spark, n=500):
    keys = sorted({f"k{i * 7919 % 1009:04d}" for i in range(n)} | {"", "é", "ab", "a"})
    return spark.createDataFrame([(s, k) for s in (0, 1) for k in keys[s * 3 :]], "seg long, k string"), {s: keys[s * 3 :] for s in (0, 1)}


def test_scans_in_order_over_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame, keys = rows(spark)
        assert ordered.lay(frame, "seg", "k").select("seg", "part").distinct().where("seg = 0").count() > 1
        got = sorted((r["seg"], r["pos"], r["k"]) for r in ordered.position(frame, "seg", "k").collect())
        assert got == [(s, i, k) for s in (0, 1) for i, k in enumerate(keys[s])]
        prev = {(r["seg"], r["k"]): r["prev"] for r in ordered.previous(frame, "seg", "k").collect()}
        assert prev == {(s, k): keys[s][i - 1] if i else None for s in (0, 1) for i, k in enumerate(keys[s])}
        probes = spark.createDataFrame([(s, k) for s in (0, 1, 2) for k in ("", "A", "k0500x", "zz")], "seg long, k string")
        found = {(r["seg"], r["k"]): r["first_key"] for r in floor_lookup(probes, segments.block_index(frame), "seg", "k", "blk", "first_key").collect()}
        firsts = {s: keys[s][::16] for s in (0, 1)} | {2: []}
        assert found == {(s, k): max((f for f in firsts[s] if f <= k), default=None) for s, k in found}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_overlap_groups_chain(spark):
    ranges = [(1, 0, "a", "c"), (2, 0, "b", "d"), (3, 0, "d", "e"), (4, 0, "f", "f"), (5, 0, "g", "z"), (6, 0, "h", "i"), (7, 0, "j", "k"), (8, 1, "a", "z")]
    frame = spark.createDataFrame(ranges, "seg long, level int, min_key string, max_key string")
    got = {r["seg"]: (r["level"], r["grp"]) for r in compaction.overlap_groups(frame).collect()}
    assert got == {1: (0, "a"), 2: (0, "a"), 3: (0, "a"), 4: (0, "f"), 5: (0, "g"), 6: (0, "g"), 7: (0, "g"), 8: (1, "a")}


def test_rotation_is_the_fold(spark):
    log = [(i, i % 3, "k" * (i % 50 + 1), "STRING", "v" * (i * 37 % 400)) for i in range(400)] + [(1000, 7, "x", "STRING", "y" * 5000), (1001, 7, "x", None, None)]
    got = {r["seq"]: (r["bytes"], r["memtable"]) for r in rotation.rotate(spark.createDataFrame(log, "seq long, shard long, k string, vtype string, v string")).collect()}
    for shard in (0, 1, 2, 7):
        table = used = 0
        for seq in sorted(s for s, h, *_ in log if h == shard):
            assert got[seq][1] == table
            used += got[seq][0]
            if used >= 1024:
                table, used = table + 1, 0


def test_a_restored_filter_has_no_false_negatives(spark, tmp_path):
    m = bloom.bits_for(300, 0.01)
    k = bloom.hashes_for(300, m)
    keys = spark.range(300).select(F.concat(F.lit("ék"), "id").alias("k"))
    bloom.build(keys, "k", m, k).write.parquet(str(tmp_path / "f"))
    restored = spark.read.parquet(str(tmp_path / "f"))
    assert k > 1 and bloom.may_contain(keys, "k", restored, m, k).where("NOT may_contain").count() == 0
    assert bloom.may_contain(spark.createDataFrame([("zzzzzzzzzzzz",)], "k string"), "k", restored.limit(0), m, k).first()["may_contain"] is False


def test_point_reads_skip_files(spark, tmp_path):
    frame = spark.range(20_000).selectExpr("id AS seq", "format_string('k%05d', id) AS k", "'INSERT' AS op", "'INT' AS vtype", "cast(id AS string) AS v")
    segments.write(frame, str(tmp_path / "s"), files=8)
    plan = segments.lookup(spark, ["k00007"], str(tmp_path / "s"))
    assert [r["v"] for r in plan.collect()] == ["7"]
    ranges = spark.read.parquet(str(tmp_path / "s")).groupBy(F.input_file_name()).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("lo").collect()
    assert len(ranges) == 8 and all(a["hi"] < b["lo"] for a, b in zip(ranges, ranges[1:]))
    assert "EqualTo(k,k00007)]" in plan._jdf.queryExecution().executedPlan().toString()
