"""Encoded sizes and key prefixes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vint_size(n: Column) -> Column:
    """Bytes of a 7-bits-a-byte integer as memtables budget it; a negative one takes five."""
    return F.when(n < 0, 5).when(n < 1 << 7, 1).when(n < 1 << 14, 2).when(n < 1 << 21, 3).when(n < 1 << 28, 4).otherwise(5)


def encoded_vint_size(n: Column) -> Column:
    """Bytes as written to a file, where a negative integer is sign-extended to ten."""
    return F.when(n < 0, 10).otherwise(vint_size(n))


def string_size(s: Column) -> Column:
    return F.octet_length(s) + vint_size(F.length(s))


def record_size(k: Column, vtype: Column, v: Column) -> Column:
    """Budgeted bytes of a record; a tombstone holds the integer 0."""
    return string_size(k) + F.when(vtype == "STRING", string_size(v)).when(vtype == "INT", vint_size(v.cast("int"))).otherwise(1)


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings have in common at their start; null counts as no string."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.when(n > 0, F.size(same)).otherwise(0)


def meta_byte(op: Column, vtype: Column) -> Column:
    """The operation in the high nibble, the value's type in the low one."""
    return F.when(op == "DELETE", 0x10).otherwise(0x20).bitwiseOR(F.when(vtype == "STRING", 1).otherwise(0))


def meta_op(meta: Column) -> Column:
    return F.when(meta.bitwiseAND(0xF0) == 0x10, "DELETE").otherwise("INSERT")


def meta_vtype(meta: Column) -> Column:
    return F.when(meta.bitwiseAND(0x0F) == 1, "STRING").otherwise("INT")
