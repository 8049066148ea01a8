"""String functions. Positions and lengths count characters, from 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def text(x) -> Column:
    """A pattern, pad or delimiter: a plain string is a literal."""
    return x if isinstance(x, Column) else F.lit(x)


def concat(*parts: ColumnOrName) -> Column:
    """Parts in a row; nulls are skipped, so no part at all gives ''."""
    return F.concat_ws("", *[col(p) for p in parts])


def char_length(s: ColumnOrName) -> Column:
    return F.length(col(s)).cast("long")


def octet_length(s: ColumnOrName) -> Column:
    return F.octet_length(col(s)).cast("long")


def substring(s: ColumnOrName, pos, length=None) -> Column:
    """The characters from pos to pos + length, as far as they exist: a window that starts before 1 is clipped, not counted from the end. A negative length gives null."""
    s, pos = col(s), num(pos)
    if length is None:
        return F.substring(s, F.greatest(pos, F.lit(1)), F.length(s) + 1)
    length = num(length)
    # a length beyond the text's own adds nothing, and can't overflow
    end = pos + F.least(F.length(s), length)
    start = F.greatest(pos, F.lit(1))
    return F.when(length < 0, F.lit(None)).when(end <= start, F.lit("")).otherwise(F.substring(s, start, end - start))


def split_part(s: ColumnOrName, delimiter, n) -> Column:
    """Part n of s. '' beyond the parts or for 0, null for a negative n, all of s for an empty delimiter."""
    s, d, n = col(s), text(delimiter), num(n)
    part = F.split_part(s, d, F.when(n > 0, n).otherwise(1))
    return F.when(s.isNull() | d.isNull() | (n < 0), F.lit(None)).when(d == "", s).when(n == 0, F.lit("")).otherwise(part)


def repeat(s: ColumnOrName, n) -> Column:
    """'' for n below 1."""
    return F.repeat(col(s), num(n))


def _pad(how, s: ColumnOrName, length, pad) -> Column:
    length = num(length)
    return F.when(length >= 0, how(col(s), length, text(pad)))


def lpad(s: ColumnOrName, length, pad=" ") -> Column:
    """Cut or filled up on the left to a length; null for a negative one. An empty pad fills nothing."""
    return _pad(F.lpad, s, length, pad)


def rpad(s: ColumnOrName, length, pad=" ") -> Column:
    return _pad(F.rpad, s, length, pad)


def lower(s: ColumnOrName) -> Column:
    """By Unicode's rules; ASCII letters alone change with translate()."""
    return F.lower(col(s))


def upper(s: ColumnOrName) -> Column:
    """By Unicode's rules, so that a text may grow (one sharp s gives SS)."""
    return F.upper(col(s))


def reverse(s: ColumnOrName) -> Column:
    return F.reverse(col(s))


def trim(s: ColumnOrName, chars=" ") -> Column:
    """Without any of the given characters at either end."""
    return F.btrim(col(s), text(chars))


def ltrim(s: ColumnOrName, chars=" ") -> Column:
    return F.ltrim(col(s), text(chars))


def rtrim(s: ColumnOrName, chars=" ") -> Column:
    return F.rtrim(col(s), text(chars))


def left(s: ColumnOrName, n) -> Column:
    """The first n characters; for a negative n all but the last -n."""
    s, n = col(s), num(n)
    return F.substring(s, F.lit(1), F.when(n < 0, F.greatest(F.length(s) + n, F.lit(0))).otherwise(n))


def right(s: ColumnOrName, n) -> Column:
    """The last n characters; for n <= 0 all but the first -n, so 0 gives the whole text."""
    s, n = col(s), num(n)
    return F.when(n > 0, F.right(s, n)).otherwise(F.substring(s, -n + 1, F.length(s)))


def like(s: ColumnOrName, pattern, escape: str = "\\") -> Column:
    """SQL LIKE: % is any text, also none, and _ is one character."""
    return F.like(col(s), text(pattern), F.lit(escape))


def not_like(s: ColumnOrName, pattern, escape: str = "\\") -> Column:
    return ~like(s, pattern, escape)
