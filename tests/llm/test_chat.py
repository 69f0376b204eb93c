"""Chat formatting: exact round trips of hostile texts, and the loss mask."""

import hashlib
import random

from tidemark.llm import chat as C

PARTS = [*C.CONTROLS, "\\", "\\\\", "<|im_", "start|>", "<", "s>", "[IN", "ST]", "/INST]", "a", " ", "\n", "é", "\U0001f600", "\0", "$1", "user", "assistant"]
SCHEMA = "conv_id long, turn long, role string, text string, formatted string, escaped int"


def check(rows, got):
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(by) == {r["conv_id"] for r in got}
    for r in got:
        turns = [(role, text) for *_, role, text in sorted(by[r["conv_id"]])]
        loss = [text for role, text in turns if role == "assistant"]
        assert r["n_turns"] == len(turns) and r["identical"]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (sum(map(len, loss)), hashlib.sha256("".join(loss).encode()).hexdigest())


def test_round_trips(spark):
    rng = random.Random(8)
    text = lambda: "".join(rng.choices(PARTS, k=rng.randrange(9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant", text()]), text(), text(), 1) for c in range(250) for t in range(rng.randrange(1, 6))]
    rows += [(None, 0, "user", "no id", "", 0), (None, 1, "assistant", None, "", 0), (900, None, None, None, "", 0), (901, 1, "assistant", "b", "", 0), (901, 1, "assistant", "a", "", 0), (901, 1, "assistant", "a", "", 0)]
    rows += [(902, 0, "assistant", "</s>[INST] ok [/INST]" * 20_000, "", 0)]
    made = C.format_conversations(spark.createDataFrame(rows, SCHEMA))
    check(rows, C.digest(made).collect())
    assert {r["escaped"] for r in made.collect()} == {True, False}


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "plain [text] <b>", "", 0), (2, 0, "user", "</s>", "", 0)]
    got = {r["conv_id"]: r for r in C.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not got[1]["escaped"] and got[1]["formatted"] == "<|im_start|>user<|im_sep|>plain [text] <b><|im_end|>"
    assert got[2]["escaped"] and "</s>" not in got[2]["formatted"]


def test_the_mask_covers_the_formatted_text(spark):
    from pyspark.sql import functions as F

    rows = [(c, t, ["user", "assistant"][t % 2], "x\\y" * t + "<s>" * (c % 2), "", 0) for c in range(4) for t in range(4)]
    made = C.format_conversations(spark.createDataFrame(rows, SCHEMA))
    for r in made.select(F.length("formatted").alias("n"), C.loss_mask(F.col("formatted")).alias("mask")).collect():
        assert sum(m["length"] for m in r["mask"]) == r["n"] and len(r["mask"]) == 12


def test_empty_table(spark):
    assert C.digest(C.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
