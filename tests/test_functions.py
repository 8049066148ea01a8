"""Values and edge cases of scalar functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import casts as C
from tessella.functions import datetime as D
from tessella.functions import numeric as N
from tessella.functions import predicates as P
from tessella.functions import strings as S


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda *cs: list(one.select(*[c.alias(f"c{i}") for i, c in enumerate(cs)]).first())


def s(x):
    return F.lit(x).cast("string")


def i(x):
    return F.lit(x).cast("long")


def r(x):
    return F.lit(x).cast("double")


def test_concat(value):
    assert value(S.concat(s("a"), s(None), s("b")), S.concat(s(None)), S.concat(s(""))) == ["ab", "", ""]


@pytest.mark.parametrize(
    ("pos", "n", "want"),
    [(1, 4, "hell"), (2, 100, "ello world"), (0, 3, "he"), (-3, 2, ""), (-3, 6, "he"), (12, 3, ""), (5, 0, ""), (5, -1, None), (1, 2**62, "hello world"), (100, 5, "")],
)
def test_substring(value, pos, n, want):
    assert value(S.substring(s("hello world"), pos, i(n))) == [want]


def test_substring_open_and_null(value):
    assert value(S.substring(s("hello"), 3), S.substring(s("hello"), -5), S.substring(s(None), 1, 2), S.substring(s("a"), F.lit(None).cast("int"), 1)) == ["llo", "hello", None, None]


@pytest.mark.parametrize(("n", "want"), [(-1, None), (0, ""), (1, "one"), (3, "three"), (4, "")])
def test_split_part(value, n, want):
    assert value(S.split_part(s("one,two,three"), ",", n)) == [want]


def test_split_part_edges(value):
    assert value(S.split_part(s("a,b"), "", 5), S.split_part(s(None), ",", 1), S.split_part(s("a.b"), ".", 2), S.split_part(s("a"), s(None), 1)) == ["a,b", None, "b", None]


def test_repeat_and_pads(value):
    assert value(S.repeat(s("ab"), 3), S.repeat(s("ab"), 0), S.repeat(s("ab"), -2), S.repeat(s(None), 2)) == ["ababab", "", "", None]
    assert value(S.lpad(s("hi"), 5, "xy"), S.lpad(s("hello"), 2, "x"), S.lpad(s("hi"), -1, "x"), S.lpad(s("hi"), 5, ""), S.rpad(s("hi"), 5, "xy"), S.rpad(s("hi"), 0, "x")) == ["xyxhi", "he", None, "hi", "hixyx", ""]


def test_trims(value):
    assert value(S.trim(s("  a ")), S.trim(s("xxaxyx"), "xy"), S.ltrim(s("xya"), "yx"), S.rtrim(s("ayx"), "yx"), S.trim(s(None))) == ["a", "a", "a", "a", None]


@pytest.mark.parametrize(("n", "left", "right"), [(2, "ab", "de"), (0, "", "abcde"), (-2, "abc", "cde"), (9, "abcde", "abcde"), (-9, "", "")])
def test_left_right(value, n, left, right):
    assert value(S.left(s("abcde"), n), S.right(s("abcde"), n)) == [left, right]


@pytest.mark.parametrize(
    ("text", "pattern", "want"),
    [("abc", "abc%", True), ("", "%", True), ("abc", "a_c", True), ("abc", "a_", False), ("a%c", "a\\%c", True), ("abc", "a\\%c", False), ("forbes \\avenue", "forb%\\\\avenue", True), ("x_y", "%\\_y", True), ("xzy", "%\\_y", False)],
)
def test_like(value, text, pattern, want):
    assert value(S.like(s(text), pattern), S.not_like(s(text), pattern)) == [want, not want]


def test_other_strings(value):
    assert value(S.lower(s("AbC")), S.upper(s("AbC")), S.reverse(s("abc")), S.char_length(s("é")), S.octet_length(s("é"))) == ["abc", "ABC", "cba", 1, 2]


def test_division(value):
    assert value(N.int_divide(i(7), i(2)), N.int_divide(i(-7), i(2)), N.int_divide(i(7), i(0)), N.divide(i(1), i(2)), N.divide(r(1), r(0)), N.modulo(i(-7), i(3)), N.modulo(i(7), i(0)), N.modulo(r(7.5), r(2))) == [3, -3, None, 0.5, None, -1, None, 1.5]


def test_overflow(value):
    assert value(N.checked("add", i(2**63 - 1), i(1)), N.checked("multiply", i(2**62), i(4)), N.checked("subtract", i(5), i(3))) == [None, None, 2]
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        value(N.add(i(2**63 - 1), i(1)))


def test_rounding(value):
    assert value(N.round_half_up(r(2.5)), N.round_half_up(r(-2.5)), N.truncate(r(-2.9)), N.truncate(r(2.9)), N.round_up_to(r(1.239), 2), N.round_up_to(r(-1.239), 2), N.round_up_to(r(7.9), -3), N.ceil(r(1.2)), N.floor(r(-1.2))) == [3, -3, -2, 2, 1.23, -1.23, 7, 2.0, -2.0]


def test_logs_and_trig(value):
    got = value(N.log(2, r(8)), N.ln(r(0)), N.log10(r(-1)), N.cot(r(1)), N.atan2(r(1), r(1)), N.acos(r(2)))
    assert got[0] == pytest.approx(3) and got[1:3] == [None, None] and got[3] == pytest.approx(1 / math.tan(1)) and got[4] == pytest.approx(math.pi / 4) and math.isnan(got[5])
    with pytest.raises(Exception, match="outside"):
        value(N.asin(r(2), strict=True))


def test_bits(value):
    assert value(N.bit_and(i(12), i(10)), N.bit_or(i(12), i(10)), N.bit_xor(i(12), i(10)), N.shift_left(i(1), 5), N.shift_right(i(32), 5), N.leading_zeros(i(1)), N.leading_zeros(i(-1)), N.leading_zeros(i(0)), N.trailing_zeros(i(8)), N.trailing_zeros(i(0))) == [8, 14, 6, 32, 1, 63, 0, 64, 3, 64]


def test_parts_of_timestamps(value):
    t = F.lit("2001-02-03 04:05:06.789012").cast("timestamp_ntz")
    got = value(*[getattr(D, f)(t) for f in ("year", "quarter", "month", "day", "hour", "minute", "second", "century", "decade", "day_of_week", "day_of_year", "millisecond", "microseconds")])
    assert got == [2001, 1, 2, 3, 4, 5, 6, 21, 200, 6, 34, 6789, 6789012]
    assert value(D.century(F.lit("1900-01-01").cast("date")), D.day_of_week(F.lit("2001-02-04").cast("date")), D.year(F.lit(None).cast("date"))) == [19, 0, None]


def test_making_dates(value):
    assert value(D.to_date(s(" 1998-9-2 ")), D.make_date(1998, 9, 2), D.make_timestamp(1998, 12, 31, 24, 0, 0), D.make_timestamp(1998, 1, 1, 0, 0, 60), D.to_text(D.make_date(1998, 9, 2))) == [dt.date(1998, 9, 2), dt.date(1998, 9, 2), dt.datetime(1999, 1, 1), dt.datetime(1998, 1, 1, 0, 1), "1998-09-02"]
    with pytest.raises(Exception):
        value(D.make_date(1998, 2, 30))


def test_casts(value):
    assert value(C.text_to_int(s("12abc")), C.text_to_int(s("abc")), C.text_to_int(s("-5")), C.text_to_int(s("99999999999999999999")), C.text_to_bool(s("Tea")), C.text_to_bool(s("f")), C.text_to_bool(s("x")), C.text_to_bool(s(""))) == [12, None, -5, None, True, False, None, None]
    assert value(C.exact_int(r(2.0)), C.exact_int(r(2.9)), C.text_to_real(s("1e3")), C.text_to_real(s("x")), C.text_to_date(s("1998-02-30")), C.text_to_timestamp(s("1998-02-03 04:05:06")), C.bool_to_int(F.lit(True)), C.int_to_real(i(3))) == [2, None, 1000.0, None, None, dt.datetime(1998, 2, 3, 4, 5, 6), 1, 3.0]
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        value(C.cast(i(300), "tinyint"))
    assert value(C.try_cast(i(300), "tinyint")) == [None]


def test_logic(value):
    n = F.lit(None).cast("boolean")
    t = F.lit(True)
    assert value(P.all_of(n, t), P.any_of(n, t), P.negation(n), P.all_of(n, ~t), P.case([(n, 1), (t, 2)]), P.case([(n, 1)]), P.case([(n, 1)], 5)) == [None, True, None, False, 2, None, 5]
    assert value(P.between(i(5), 5, 7), P.between(i(5), 5, 7, False), P.is_in(i(5), 1, 5), P.is_null(i(None)), P.is_not_null(i(None)), P.eq(i(None), 5)) == [True, False, True, True, False, None]
