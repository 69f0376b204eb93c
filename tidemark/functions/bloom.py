"""Bloom filters: sizing, an explicit bit-set form, and Spark's own filter."""

from __future__ import annotations

from math import ceil, floor, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the prime of the hash.
MODULUS = 1635947
#: Coefficients of the hash functions, in order; more come from a linear congruential generator.
FIRST_HASH = (48271, 16807)


def coefficients(n: int) -> list[tuple[int, int]]:
    out = [FIRST_HASH]
    while len(out) < n:
        a, b = out[-1]
        out.append((a * 48271 % MODULUS, (b * 16807 + 1) % MODULUS))
    return out


def bits_for(n: int, fpp: float = 0.1) -> int:
    """Bits for ``n`` keys at a false positive rate, in whole 64-bit words."""
    return 64 * ceil(floor(n * log(fpp) / log(1 / 2 ** log(2))) / 64)


def hashes_for(n: int, bits: int) -> int:
    return max(1, int(bits / n * log(2)))


def char_sum(k: Column, a: int, b: int) -> Column:
    """Sum over characters of (a * code + b) mod a prime; keys with the same characters collide."""
    chars = F.filter(F.split(k, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0).cast("long"), lambda s, c: s + (F.lit(a).cast("long") * F.ascii(c) + b) % MODULUS)


def bit(k: Column, bits: int, a: int = 48271, b: int = 16807) -> Column:
    return F.pmod(char_sum(k, a, b), F.lit(bits))


def bits(k: Column, m: int, hashes: int) -> Column:
    """The bits of a key under each hash function."""
    return F.array(*[bit(k, m, a, b) for a, b in coefficients(hashes)])


def build(keys: DataFrame, k: str, m: int, hashes: int) -> DataFrame:
    """(word, mask): the 64-bit words of a filter that have a bit set; ``m`` / 64 rows at most, ready to be written."""
    one = keys.select(F.explode(bits(F.col(k), m, hashes)).alias("bit"))
    return one.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("mask"))


def may_contain(probes: DataFrame, k: str, restored: DataFrame, m: int, hashes: int) -> DataFrame:
    """``probes`` with ``may_contain``, by a filter read back from where ``build`` was written."""
    at = probes.select("*", F.posexplode(bits(F.col(k), m, hashes)).alias("nth", "bit")).withColumn("word", F.floor(F.col("bit") / 64).cast("long"))
    on = F.broadcast(restored) if m <= 1 << 26 else restored  # 16 bytes a word
    hit = F.coalesce(F.call_function("getbit", F.col("mask"), (F.col("bit") % 64).cast("int")) == 1, F.lit(False))
    return at.join(on, "word", "left").groupBy(*probes.columns).agg(F.every(hit).alias("may_contain"))


def library_filter(df: DataFrame, column: str, n: int, fpp: float):
    """Spark's Bloom filter of a column, as a JVM object with ``mightContainString`` (classic mode only)."""
    return df._jdf.stat().bloomFilter(column, n, fpp)
