"""Comparisons, null tests, connectives and CASE, with three-valued logic."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.strings import col, num


def eq(a, b) -> Column:
    return col(a) == num(b)


def ne(a, b) -> Column:
    return col(a) != num(b)


def lt(a, b) -> Column:
    return col(a) < num(b)


def le(a, b) -> Column:
    return col(a) <= num(b)


def gt(a, b) -> Column:
    return col(a) > num(b)


def ge(a, b) -> Column:
    return col(a) >= num(b)


def between(a, low, high, low_inclusive: bool = True, high_inclusive: bool = True) -> Column:
    a = col(a)
    return (ge(a, low) if low_inclusive else gt(a, low)) & (le(a, high) if high_inclusive else lt(a, high))


def is_in(a, *values) -> Column:
    return col(a).isin(*values)


def is_null(a) -> Column:
    return col(a).isNull()


def is_not_null(a) -> Column:
    return col(a).isNotNull()


def all_of(*terms: Column) -> Column:
    return reduce(lambda a, b: a & b, terms)


def any_of(*terms: Column) -> Column:
    return reduce(lambda a, b: a | b, terms)


def negation(a: Column) -> Column:
    return ~a


def case(whens: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first condition that is true; a null condition isn't; null without a default."""
    out = F.when(whens[0][0], num(whens[0][1]))
    for condition, value in whens[1:]:
        out = out.when(condition, num(value))
    return out if otherwise is None else out.otherwise(num(otherwise))


def hashed(*columns, fast: bool = True) -> Column:
    """A 64-bit (or 32-bit Murmur) hash of columns in their order; a null is a value of its own, wherever it stands."""
    return (F.xxhash64 if fast else F.hash)(*[x for c in columns for x in (col(c).isNull(), col(c))])
