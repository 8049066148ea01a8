"""Parts of dates and timestamps (without a time zone), and their making."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.strings import col, num


def _long(c: Column) -> Column:
    return c.cast("long")


def year(t) -> Column:
    return _long(F.year(col(t)))


def quarter(t) -> Column:
    return _long(F.quarter(col(t)))


def month(t) -> Column:
    return _long(F.month(col(t)))


def day(t) -> Column:
    return _long(F.dayofmonth(col(t)))


def hour(t) -> Column:
    return _long(F.hour(col(t)))


def minute(t) -> Column:
    return _long(F.minute(col(t)))


def second(t) -> Column:
    return _long(F.second(col(t)))


def century(t) -> Column:
    """1900 is in the 19th century, 1901 in the 20th."""
    return _long(F.floor((F.year(col(t)) + 99) / 100))


def decade(t) -> Column:
    return _long(F.floor(F.year(col(t)) / 10))


def day_of_week(t) -> Column:
    """0 is Sunday."""
    return _long(F.dayofweek(col(t)) - 1)


def day_of_year(t) -> Column:
    """From 1."""
    return _long(F.dayofyear(col(t)))


def _micros(t) -> Column:
    return F.unix_micros(col(t).cast("timestamp")) % 60_000_000


def millisecond(t) -> Column:
    """With the seconds: 1000 times these, and whole milliseconds."""
    return _long(F.floor(F.pmod(_micros(t), F.lit(60_000_000)) / 1000))


def microseconds(t) -> Column:
    """With the seconds."""
    return _long(F.pmod(_micros(t), F.lit(60_000_000)))


def to_date(s) -> Column:
    """From year-month-day; blanks at the ends don't count, other text raises."""
    return F.to_date(F.trim(col(s)), "y-M-d")


def make_date(y, m, d) -> Column:
    return F.make_date(num(y), num(m), num(d))


def make_timestamp(y, mo, d, h, mi, s) -> Column:
    """24:00:00 is the next day's start, and second 60 the next minute's."""
    h, mi, s = num(h).cast("int"), num(mi).cast("int"), num(s).cast("decimal(16,6)")
    late = (h == 24) & (mi == 0) & (s == 0)
    t = F.make_timestamp_ntz(num(y), num(mo), num(d), F.when(late, 0).otherwise(h), mi, s)
    return F.when(late, t + F.expr("INTERVAL '1' DAY")).otherwise(t)


def to_text(t) -> Column:
    return col(t).cast("string")


def as_timestamp(d) -> Column:
    """Midnight of a date."""
    return col(d).cast("timestamp_ntz")


def as_date(t) -> Column:
    return col(t).cast("date")
