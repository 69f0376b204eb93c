"""Typing of raw values (O5): a signed decimal 32-bit integer if it parses as one, else a string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_int(raw: Column) -> Column:
    """The integer that ``raw`` spells, or null. The pattern keeps out the blanks that a cast would trim."""
    return F.when(raw.rlike("^[+-]?[0-9]+$"), raw.try_cast("int"))


def vtype(raw: Column) -> Column:
    return F.when(as_int(raw).isNotNull(), "INT").when(raw.isNotNull(), "STRING")


def canonical(raw: Column) -> Column:
    """The text that a read gives back: ``007`` is stored as 7."""
    return F.coalesce(as_int(raw).cast("string"), raw)
