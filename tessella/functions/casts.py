"""Casts: strict ones that raise, and lenient ones that read what they can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.strings import col


def cast(a, target: str) -> Column:
    """What doesn't fit raises."""
    return col(a).cast(target)


def try_cast(a, target: str) -> Column:
    """What doesn't fit is null."""
    return col(a).try_cast(target)


def exact_int(a) -> Column:
    """A real as a long, null unless it is one exactly."""
    a = col(a)
    whole = a.try_cast("long")
    return F.when(whole.cast("double") == a, whole)


def text_to_bool(s) -> Column:
    """By the first letter, t or f in either case; others are null."""
    first = F.lower(F.substring(col(s), 1, 1))
    return F.when(first == "t", F.lit(True)).when(first == "f", F.lit(False))


def text_to_int(s) -> Column:
    """The number that the text starts with, null if there is none or it doesn't fit."""
    return F.nullif(F.regexp_extract(col(s), r"^-?\d+", 0), F.lit("")).try_cast("long")


def text_to_real(s) -> Column:
    return col(s).try_cast("double")


def text_to_date(s) -> Column:
    return col(s).try_cast("date")


def text_to_timestamp(s) -> Column:
    return col(s).try_cast("timestamp_ntz")


def bool_to_int(b) -> Column:
    return col(b).cast("int")


def int_to_real(i) -> Column:
    return col(i).cast("double")


def to_text(a) -> Column:
    return col(a).cast("string")
