"""Numeric functions. Integers are longs, reals doubles; overflow raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.strings import col, num


def add(a, b) -> Column:
    return num(a) + num(b)


def subtract(a, b) -> Column:
    return num(a) - num(b)


def multiply(a, b) -> Column:
    return num(a) * num(b)


def checked(op: str, a, b) -> Column:
    """add, subtract or multiply, with null where the result doesn't fit."""
    return {"add": F.try_add, "subtract": F.try_subtract, "multiply": F.try_multiply}[op](num(a), num(b))


def divide(a, b) -> Column:
    """Division of reals; null by zero."""
    return F.try_divide(num(a).cast("double"), num(b).cast("double"))


def int_divide(a, b) -> Column:
    """Division of integers, rounded toward zero; null by zero."""
    return F.call_function("div", num(a).cast("long"), F.nullif(num(b).cast("long"), F.lit(0).cast("long")))


def modulo(a, b) -> Column:
    """The remainder, with the sign of the dividend; null by zero."""
    return F.try_mod(num(a), num(b))


def negate(a) -> Column:
    return -num(a)


def absolute(a) -> Column:
    return F.abs(num(a))


def pi() -> Column:
    return F.pi()


def e() -> Column:
    return F.e()


def _strict(f, a, strict: bool) -> Column:
    a = col(a)
    return F.when((a < -1) | (a > 1), F.raise_error(F.lit("outside [-1, 1]")).cast("double")).otherwise(f(a)) if strict else f(a)


def acos(a, strict: bool = False) -> Column:
    """NaN outside [-1, 1], or an error if strict."""
    return _strict(F.acos, a, strict)


def asin(a, strict: bool = False) -> Column:
    return _strict(F.asin, a, strict)


def atan(a) -> Column:
    return F.atan(col(a))


def atan2(a, b) -> Column:
    return F.atan2(col(a), col(b))


def cos(a) -> Column:
    return F.cos(col(a))


def cosh(a) -> Column:
    return F.cosh(col(a))


def cot(a) -> Column:
    return F.cot(col(a))


def sin(a) -> Column:
    return F.sin(col(a))


def sinh(a) -> Column:
    return F.sinh(col(a))


def tan(a) -> Column:
    return F.tan(col(a))


def tanh(a) -> Column:
    return F.tanh(col(a))


def cbrt(a) -> Column:
    return F.cbrt(col(a))


def sqrt(a) -> Column:
    return F.sqrt(col(a))


def ceil(a) -> Column:
    """A double, as floor() is."""
    return F.ceil(col(a)).cast("double")


def floor(a) -> Column:
    return F.floor(col(a)).cast("double")


def exp(a) -> Column:
    return F.exp(col(a))


def sign(a) -> Column:
    return F.signum(col(a))


def degrees(a) -> Column:
    return F.degrees(col(a))


def radians(a) -> Column:
    return F.radians(col(a))


def ln(a) -> Column:
    """Null for what has no logarithm; so are log2, log10 and log."""
    return F.ln(col(a))


def log2(a) -> Column:
    return F.log2(col(a))


def log10(a) -> Column:
    return F.log10(col(a))


def log(base, a) -> Column:
    return F.ln(num(a)) / F.ln(num(base))


def power(a, b) -> Column:
    return F.pow(num(a), num(b))


def round_half_up(a, digits: int = 0) -> Column:
    """Halves go away from zero."""
    return F.round(col(a), digits)


def truncate(a) -> Column:
    """Toward zero, as a double."""
    a = col(a)
    return F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a)).cast("double")


def round_up_to(a, digits) -> Column:
    """Toward zero at so many decimal digits; none for a negative number of them."""
    a, scale = col(a), F.pow(F.lit(10.0), F.greatest(num(digits), F.lit(0)))
    return truncate(a * scale) / scale


def bit_and(a, b) -> Column:
    return num(a).bitwiseAND(num(b))


def bit_or(a, b) -> Column:
    return num(a).bitwiseOR(num(b))


def bit_xor(a, b) -> Column:
    return num(a).bitwiseXOR(num(b))


def shift_left(a, n: int) -> Column:
    return F.shiftleft(col(a), n)


def shift_right(a, n: int) -> Column:
    return F.shiftright(col(a), n)


def leading_zeros(a) -> Column:
    """Of the 64 bits of a long; 64 for 0."""
    a = col(a).cast("long")
    return F.when(a == 0, 64).when(a < 0, 0).otherwise(64 - F.length(F.bin(a)))


def trailing_zeros(a) -> Column:
    a = col(a).cast("long")
    return F.when(a == 0, 64).otherwise(F.length(F.bin(a)) - F.length(F.rtrim(F.bin(a), F.lit("0"))))
