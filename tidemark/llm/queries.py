"""The registered queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontamination, embeddings, licenses, line_templates, packing, quality, sharding, simhash, toxicity
from tidemark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a ring of 40 shards with bounded loads; the law is that row counts differ by one at most."""
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by fingerprints within three bits."""
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and license notice that it holds."""
    return licenses.find_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learnt from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    texts, ys = toxicity.sample(docs, table(spark, sf_dir, "labels"), lambda c: ~toxicity.held_out(c))
    scored = toxicity.score(docs, toxicity.train(texts, ys))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by two views; those under one half are rejected."""
    docs = table(spark, sf_dir, "documents")
    made = quality.features(docs)
    scored = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels"), made=made), made)
    return scored.withColumn("kept", F.col("score") >= 0.5)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and its containment."""
    return decontamination.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings by cosine of 0.9 or more."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose templates recur, with counts of the lines before and after."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = lambda c: (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = line_templates.drop_recurring_lines(docs.withColumn("lines_before", lines(F.col("text"))))
    return out.select("doc_id", "lines_before", F.when(F.col("text") == "", F.lit(0).cast("long")).otherwise(lines(F.col("text"))).alias("lines_after"), "text")


#: A conversation of control strings, added to the table.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings, formatted, and read back from the output."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(probe))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_COUNT = " + ".join(f"(length(x) - length(replace(x, '{c}', ''))) // {len(c)}" for c in chat.CONTROLS)
OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {PROBE_ID}, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '{PROBE_TEXT}' FROM range(2) r(i)),
u AS (
  SELECT *, role || chr(10) || text || chr(10) AS whole, role || chr(0) || text AS x FROM t),
v AS (
  SELECT *, {_COUNT} AS controls, length(x) - length(replace(x, '\\', '')) AS slashes, regexp_matches(x, '(?s)\\\\[^\\x00]') AS changes FROM u)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(whole, '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  (sum(length(role) + length(text) + {len(chat.START + chat.SEP + chat.END)})
   + CASE WHEN max(controls) > 0 OR bool_or(changes) THEN sum(controls + slashes) ELSE 0 END)::BIGINT AS formatted_chars
FROM v GROUP BY conv_id
"""

QUERIES: dict[str, Query] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_license_scan": op3_license_scan,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_decontamination": op6_decontamination,
    "op7_packing": op7_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_line_dedup": op10_line_dedup,
}
OP10_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
t AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS template FROM l),
w AS (SELECT *, string_split(template, ' ') AS w, len(string_split(template, ' ')) AS n FROM t),
s AS (SELECT *, n < {line_templates.MIN_TOKENS} AND length(template) < {line_templates.MIN_CHARS} AS short, greatest(1, n // 5) AS size FROM w),
often AS (SELECT template FROM s WHERE short AND regexp_matches(replace(template, '<*>', ''), '\p{{L}}') GROUP BY template
  HAVING count(DISTINCT doc_id) >= greatest({line_templates.SHORT_DOCS}, {line_templates.SHORT_SHARE} * (SELECT count(*) FROM documents))),
k AS (SELECT r, doc_id, pos, template AS leaf FROM s WHERE (NOT short AND n <= {line_templates.MIN_TOKENS}) OR (short AND template IN (FROM often))
  UNION ALL SELECT r, doc_id, pos, concat(n, ':', i, ':', array_to_string(w[:{line_templates.DEPTH} + i * size], ' '), ' <field> ', array_to_string(w[{line_templates.DEPTH} + (i + 1) * size + 1:], ' ')) AS leaf
  FROM (SELECT *, unnest(range(0, (n - {line_templates.DEPTH} - 1) // size + 1)) AS i FROM s WHERE n > {line_templates.MIN_TOKENS})),
f AS (SELECT leaf, min(doc_id) AS first FROM k GROUP BY leaf HAVING count(DISTINCT doc_id) > 1),
g AS (SELECT DISTINCT r, pos FROM k JOIN f USING (leaf) WHERE doc_id <> first),
o AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) AS kept FROM l ANTI JOIN g USING (r, pos) GROUP BY r)
SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines_before,
  CASE WHEN text IS NULL THEN NULL WHEN coalesce(kept, '') = '' THEN 0 ELSE length(kept) - length(replace(kept, chr(10), '')) + 1 END AS lines_after,
  CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text
FROM d LEFT JOIN o USING (r)
"""

_NOTICES = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in licenses.TEMPLATES.items())
_BOUNDS = ", ".join(f"({b})" for b in licenses.bounds(200))
_SHINGLES = r"string_split(trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"
OP3_SQL = f"""
WITH given(license, text) AS (VALUES {_NOTICES}), limits(b) AS (VALUES {_BOUNDS}),
tw AS (SELECT license, {_SHINGLES} AS w FROM given),
ts AS (SELECT DISTINCT license, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM tw)),
t AS (SELECT license, n, (SELECT min(b) FROM limits WHERE b >= n) AS bound FROM (SELECT license, count(*) AS n FROM ts GROUP BY license)),
dw AS (SELECT doc_id, row_number() OVER () AS r, {_SHINGLES} AS w FROM documents),
ds AS (SELECT doc_id, r, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, r, w, unnest(range(1, len(w) - 3)) AS i FROM dw)),
hits AS (SELECT doc_id, r, pos, s, license, n, bound, greatest(1, bound // 4) AS step FROM ds JOIN ts USING (s) JOIN t USING (license)),
wins AS (SELECT *, unnest(range(greatest(0, (pos - bound) // step), pos // step + 1)) AS k FROM hits),
held AS (SELECT doc_id, license, n, k * step AS start, count(DISTINCT s) AS own FROM wins WHERE pos >= k * step AND pos < k * step + bound + step GROUP BY doc_id, r, license, n, k, step)
SELECT doc_id, license, max(own::DOUBLE / n) AS containment, min(start)::INT AS first_word FROM held WHERE own::DOUBLE / n >= {licenses.THRESHOLD} GROUP BY doc_id, license
"""

ORACLES: dict[str, str] = {"op3_license_scan": OP3_SQL, "op8_chat_formatting": OP8_SQL, "op10_line_dedup": OP10_SQL}
