"""Line dedup by a log-template tree of fixed depth, in DataFrame functions only.

A line in lower case, with tokens that hold a digit as ``<*>``, goes down the tree by its number of
tokens n, then by its ``depth`` leading tokens. Its other tokens are cut into blocks of a fifth of n (of
one token at least). In its node a line has a leaf for each block: the template with that block
as a variable field, ``<*>``, and all else constant. Lines of a leaf agree but for that field, so names
and words vary as numbers do. A line of fewer than ``min_tokens`` + 1 tokens leaves no field, and its leaf is
its own template. Leaves are equal or not, so templates need no pairs and don't depend on the order of lines.

A line is dropped from its document if one of its leaves also holds a line of a document of smaller id, where
its content lives on: copies lose what they repeat, and no content is lost to the corpus.

A template of fewer than ``min_tokens`` tokens and ``MIN_CHARS`` characters is short: it recurs by chance,
the more so the larger the corpus, and goes only if it stands in ``SHORT_DOCS`` documents and in
``SHORT_SHARE`` of all; without a letter outside its fields (a blank line, a rule, a number) it stays.
Length in characters serves scripts without spaces.

Only hashes are shuffled for the search: a leaf needs the smallest and the largest document that it
holds, which combines before the shuffle, so a line in a third of all documents is one row a task.
Texts are shuffled once, with the positions of the lines to drop.

Cases: a null or empty text stays as it is; rows of one doc_id are one document, so they don't drop
each other's lines, and lines of one document don't; rows without a doc_id are one document, and come
first; line ends are ``\\n``; case and white space between tokens don't count; a document all of whose lines
recur becomes an empty text; an empty table gives no rows; every input column is kept, whatever its
name. A very long text is one row in memory, once as its lines. A variable field among the leading tokens
is found only if it has a digit, and one in other places only if it lies in one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

MIN_TOKENS = 5
DEPTH = 3
MIN_CHARS = 24
#: Documents that a short template stands in when that is no chance: at least so many, and such a share.
SHORT_DOCS, SHORT_SHARE = 10, 1e-4


def template(line: Column) -> Column:
    """Tokens of a line in lower case, variable fields as ``<*>``."""
    spaced = F.trim(F.regexp_replace(F.lower(line), r"\s{2,}|[^\S ]", " "))
    return F.regexp_replace(spaced, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*", "<*>")


def leaves(template: Column, min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> Column:
    """Hashes of the leaves of a template: its number of tokens, leading tokens and all blocks but one; or of itself."""
    own = F.array(F.xxhash64(F.lit(-1), template))

    def of(words: Column) -> Column:
        n = F.size(words)
        size = F.greatest(F.lit(1), F.floor(n / 5).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - depth - 1) / size).cast("int")), lambda i: F.xxhash64(i, F.slice(words, depth + 1 + i * size, size)))
        node = F.xxhash64(n, F.slice(words, 1, depth))
        but_one = lambda hs: F.transform(hs, lambda h, i: F.xxhash64(i, F.aggregate(hs, node, lambda a, x: a.bitwiseXOR(x)).bitwiseXOR(h)))
        return F.when(n > F.greatest(F.lit(min_tokens), F.lit(depth)), F.get(F.transform(F.array(blocks), but_one), F.lit(0))).otherwise(own)

    return F.get(F.transform(F.array(F.split(template, " ")), of), F.lit(0))


def doc_key(doc_id: str, text: str) -> list[Column]:
    """A document's id, the smallest long if it has none, and a hash that tells texts of one id apart."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("key_id"), F.xxhash64(text).alias("key_text")]


def recurring(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> DataFrame:
    """(key_id, key_text, positions): for each document the sorted positions of its lines to drop, from 0."""

    def line(t: Column) -> Column:
        tokens = F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1
        short = (tokens < min_tokens) & (F.length(t) < MIN_CHARS)
        return F.struct(short.alias("short"), (~short | F.replace(t, F.lit("<*>"), F.lit("")).rlike(r"\p{L}")).alias("telling"), leaves(t, min_tokens, depth).alias("leaves"))

    # Templates are bound by lambdas below a generator, so that no filter makes Spark work them out again.
    templates = F.transform(F.transform(F.split(text, "\n", -1), template), line)
    own = docs.select(*doc_key(doc_id, text), F.posexplode(templates).alias("pos", "line"))
    lines = cut(own.where("line.telling").select("key_id", "key_text", "pos", "line.short", "line.leaves"))
    leaf = F.get("leaves", F.lit(0)).alias("leaf")
    in_docs = lines.where("short").select(leaf, "key_id").distinct().groupBy("leaf").count()
    chance = F.greatest(F.lit(SHORT_DOCS), SHORT_SHARE * F.lit(docs.count()))
    often = cut(in_docs.where(F.col("count") >= chance).select("leaf"))
    rows = lines.where("NOT short").select("key_id", "key_text", "pos", F.explode("leaves").alias("leaf"))
    rows = rows.unionByName(lines.where("short").select("key_id", "key_text", "pos", leaf).join(often, "leaf", "left_semi").select(*rows.columns))
    first = cut(rows.groupBy("leaf").agg(F.min("key_id").alias("first"), F.max("key_id").alias("last")).where("first <> last").select(F.col("leaf").alias("of_leaf"), "first"))
    gone = rows.join(first, F.col("leaf") == F.col("of_leaf")).where("key_id <> first")
    return gone.groupBy("key_id", "key_text").agg(F.sort_array(F.collect_set("pos")).alias("positions"))


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_tokens: int = MIN_TOKENS, depth: int = DEPTH) -> DataFrame:
    """``docs`` with the same rows and columns; the lines that ``recurring`` gives are gone from ``text``, and n_chars follows if it is a column."""
    cols = docs.columns
    gone = recurring(docs, doc_id, text, min_tokens, depth)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), *doc_key(doc_id, text))
    joined = packed.join(gone, ["key_id", "key_text"], "left")
    old = F.col("row").getField(text)
    rest = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("positions")), lambda i: F.get(lines, i))
    kept = F.get(F.transform(F.array(F.split(old, "\n", -1)), rest), 0)
    new = F.when(F.col("positions").isNull(), old).otherwise(F.array_join(kept, "\n"))
    out = []
    for c in cols:
        if c == text:
            out.append(new.alias(c))
        elif c == "n_chars":
            out.append(F.when(F.col("positions").isNull(), F.col("row").getField(c)).otherwise(F.length(F.array_join(kept, "\n")).cast("long")).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return joined.select(*out)
