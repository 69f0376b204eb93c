"""Line dedup: leaves of the template tree against brute force, and the cases."""

import random
import re

from tidemark.llm import line_templates as L

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def kept(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in L.drop_recurring_lines(docs).orderBy("doc_id").collect()]


def brute_leaves(line):
    t = re.sub(r"[^ ]*[0-9][^ ]*", "<*>", " ".join(line.lower().split()))
    w = t.split(" ")
    n, size = len(w), max(1, len(w) // 5)
    if n < 5 and len(t) < 24:
        return t, t if re.search(r"[^\W\d_]", t.replace("<*>", "")) else None, True
    if n <= 5:
        return t, [t], False
    return t, [(n, i, tuple(w[: 3 + i * size]), tuple(w[3 + (i + 1) * size :])) for i in range((n - 4) // size + 1)], False


def brute(rows):
    first, docs_of = {}, {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            _, leaves, short = brute_leaves(line)
            for leaf in [leaves] if short else leaves:
                first[leaf] = min(first.get(leaf, doc), doc)
                docs_of.setdefault(leaf, set()).add(doc)
    out = []
    for doc, text in rows:
        stay = []
        for line in (text or "").split("\n"):
            _, leaves, short = brute_leaves(line)
            go = leaves is not None and len(docs_of[leaves]) >= 10 and first[leaves] < doc if short else any(first[x] < doc for x in leaves)
            stay += [] if go else [line]
        out.append((doc, text and "\n".join(stay)))
    return sorted(out, key=lambda r: (r[0], r[1] is None, r[1] or ""))


def test_matches_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{c}" for c in "abcdefghij"] + ["x1", "22"]
    pool = [" ".join(rng.choices(words, k=rng.randint(0, 14))) for _ in range(60)]

    def line():
        w = rng.choice(pool).split(" ")
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(words)
        return rng.choice([" ", "  ", "\t"]).join(w)

    rows = [(rng.randrange(60), "\n".join(line() for _ in range(rng.randint(1, 8)))) for _ in range(80)] + [(5, None), (6, ""), (61, "\n".join(pool))]
    rows += rows[:5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in L.drop_recurring_lines(docs).collect()), key=lambda r: (r[0], r[1] is None, r[1] or ""))
    assert got == brute(rows)


def test_one_changed_word_is_a_variable_field(spark):
    other = LONG.replace("theta", "CHANGED")
    far = " ".join(["alpha beta gamma"] + [f"w{chr(97 + i)}" for i in range(9)])
    assert kept(spark, [LONG + "\nown text", other, far, LONG.replace("alpha", "first")]) == [LONG + "\nown text", "", far, LONG.replace("alpha", "first")]


def test_a_name_in_many_documents_keeps_one_line(spark):
    names = ["ann", "bob", "cyd", "dan", "eve", "fay"]
    got = kept(spark, [f"we all say welcome to dear {n} of this house today" for n in names])
    assert got == ["we all say welcome to dear ann of this house today"] + [""] * 5


def test_five_tokens_leave_no_field(spark):
    assert kept(spark, ["one two three four five", "one two three four six"]) == ["one two three four five", "one two three four six"]


def test_lines_of_one_document_stay(spark):
    assert kept(spark, [LONG + "\n" + LONG.replace("mu", "nu")]) == [LONG + "\n" + LONG.replace("mu", "nu")]


def test_short_lines_go_if_they_stand_in_many_documents(spark):
    few, many = "see below", "All rights reserved."
    texts = [f"{many}\n\n---\n{i}" + (f"\n{few}" if i < 9 else "") for i in range(12)]
    got = kept(spark, texts)
    assert got == [texts[0]] + [t.replace(many + "\n", "") for t in texts[1:]]


def test_a_line_without_spaces_is_long_by_its_characters(spark):
    line = "この文章は空白なしで" * 3
    assert kept(spark, [line, "x\n" + line, line[:8], line[:8]]) == [line, "x", line[:8], line[:8]]


def test_cases(spark):
    wide = "\n".join(f"{LONG} tail{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} end" for i in range(5000))
    rows = [(None, LONG, 1, "a"), (None, LONG, 1, "b"), (3, LONG + "\nown", 5, "c"), (4, None, None, "d"), (5, "", 0, None), (3, LONG + "\nown", 5, "c"), (9, wide, 7, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, leaf string")
    got = {(r["leaf"]): r for r in L.drop_recurring_lines(docs).collect()}
    assert L.drop_recurring_lines(docs).count() == 7 and L.drop_recurring_lines(docs).columns == docs.columns
    assert got["a"]["text"] == got["b"]["text"] == LONG and (got["c"]["text"], got["c"]["n_chars"]) == ("own", 3)
    assert got["d"]["text"] is None and got["d"]["n_chars"] is None and got[None]["text"] == "" and got["w"]["text"] == wide
    assert L.drop_recurring_lines(docs.limit(0)).collect() == []
