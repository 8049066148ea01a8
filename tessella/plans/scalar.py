"""One query for each scalar function, over a table's columns, with edge cases in its arguments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import casts as C
from tessella.functions import datetime as D
from tessella.functions import numeric as N
from tessella.functions import predicates as P
from tessella.functions import strings as S
from tessella.plans.registry import Tables, query


def over(table: str, key: str, name: str, columns: dict[str, tuple]) -> None:
    """Registers a query over a table: key, and for each column (expression, SQL)."""

    def build(spark, d):
        return getattr(Tables(spark, d), table).select(key, *[c().alias(k) for k, (c, _) in columns.items()])

    query(f"SELECT {key}, " + ", ".join(f"{sql} AS {k}" for k, (_, sql) in columns.items()) + f" FROM {table}", name)(build)


def part(name: str, **columns: tuple) -> None:
    over("part", "p_partkey", f"fn_{name}", columns)


def sub_sql(s: str, pos: str, n: str) -> str:
    return f"CASE WHEN {n} < 0 THEN NULL WHEN {pos} + least(length({s}), {n}) <= greatest({pos}, 1) THEN '' ELSE substr({s}, greatest({pos}, 1), {pos} + least(length({s}), {n}) - greatest({pos}, 1)) END"


def size():
    return F.col("p_size")


part("concat", a=(lambda: S.concat("p_name", F.lit("-"), "p_type"), "concat(p_name, '-', p_type)"), b=(lambda: S.concat(F.nullif("p_type", F.lit("PROMO")), F.lit("x")), "concat(nullif(p_type, 'PROMO'), 'x')"), c=(lambda: S.concat(F.lit(None).cast("string")), "concat(CAST(NULL AS VARCHAR), '')"))
part("length", a=(lambda: S.char_length("p_name"), "CAST(length(p_name) AS BIGINT)"), b=(lambda: S.octet_length(F.concat("p_name", F.lit("é"))), "CAST(strlen(p_name || 'é') AS BIGINT)"))
part(
    "substring",
    a=(lambda: S.substring("p_name", 3, 4), sub_sql("p_name", "3", "4")),
    b=(lambda: S.substring("p_name", -2, 5), sub_sql("p_name", "-2", "5")),
    c=(lambda: S.substring("p_name", size() - 10, size() % 7 - 1), sub_sql("p_name", "(p_size - 10)", "(p_size % 7 - 1)")),
    d=(lambda: S.substring("p_name", 5), "substr(p_name, 5)"),
)
part(
    "split_part",
    a=(lambda: S.split_part("p_name", " ", 1), "split_part(p_name, ' ', 1)"),
    b=(lambda: S.split_part("p_name", " ", 2), "split_part(p_name, ' ', 2)"),
    c=(lambda: S.split_part("p_name", "", 3), "p_name"),
    d=(lambda: S.split_part("p_name", "a", size() % 4 - 1), "CASE WHEN p_size % 4 - 1 < 0 THEN NULL WHEN p_size % 4 - 1 = 0 THEN '' ELSE split_part(p_name, 'a', p_size % 4 - 1) END"),
)
part("repeat", a=(lambda: S.repeat("p_type", size() % 5 - 1), "CASE WHEN p_size % 5 - 1 <= 0 THEN '' ELSE repeat(p_type, p_size % 5 - 1) END"), b=(lambda: S.repeat(F.lit(""), 3), "repeat('', 3)"))
part("lpad", a=(lambda: S.lpad("p_type", 12, "*-"), "lpad(p_type, 12, '*-')"), b=(lambda: S.lpad("p_type", 3, "*"), "lpad(p_type, 3, '*')"), c=(lambda: S.lpad("p_type", -1, "*"), "CAST(NULL AS VARCHAR)"))
part("rpad", a=(lambda: S.rpad("p_type", 12, "*-"), "rpad(p_type, 12, '*-')"), b=(lambda: S.rpad("p_type", 3, "*"), "rpad(p_type, 3, '*')"), c=(lambda: S.rpad("p_type", -1, "*"), "CAST(NULL AS VARCHAR)"))
part("lower_upper", a=(lambda: S.lower("p_type"), "lower(p_type)"), b=(lambda: S.upper("p_name"), "upper(p_name)"))
part("reverse", a=(lambda: S.reverse("p_name"), "reverse(p_name)"))
part(
    "trim",
    a=(lambda: S.trim(F.concat(F.lit("  "), "p_name", F.lit("  "))), "trim('  ' || p_name || '  ')"),
    b=(lambda: S.trim("p_type", "SOE"), "trim(p_type, 'SOE')"),
    c=(lambda: S.ltrim("p_type", "SPE"), "ltrim(p_type, 'SPE')"),
    d=(lambda: S.rtrim("p_type", "LYO"), "rtrim(p_type, 'LYO')"),
    e=(lambda: S.ltrim(F.concat(F.lit("  "), "p_name")), "ltrim('  ' || p_name)"),
    f=(lambda: S.rtrim(F.concat("p_name", F.lit("  "))), "rtrim(p_name || '  ')"),
)
part(
    "left_right",
    a=(lambda: S.left("p_name", 3), "left(p_name, 3)"),
    b=(lambda: S.left("p_name", -2), "substr(p_name, 1, greatest(length(p_name) - 2, 0))"),
    c=(lambda: S.right("p_name", 3), "right(p_name, 3)"),
    d=(lambda: S.right("p_name", 0), "p_name"),
    e=(lambda: S.right("p_name", -2), "substr(p_name, 3)"),
    f=(lambda: S.left("p_name", size() % 9 - 4), "CASE WHEN p_size % 9 - 4 < 0 THEN substr(p_name, 1, greatest(length(p_name) + p_size % 9 - 4, 0)) ELSE left(p_name, p_size % 9 - 4) END"),
)
part("like", a=(lambda: S.like("p_type", "%O%"), "p_type LIKE '%O%'"), b=(lambda: S.like("p_type", "S_ALL%"), "p_type LIKE 'S_ALL%'"), c=(lambda: S.like("p_type", "PROMO%"), "p_type LIKE 'PROMO%'"), d=(lambda: S.not_like("p_name", "%\\%%"), "p_name NOT LIKE '%\\%%' ESCAPE '\\'"))


def line(name: str, **columns: tuple) -> None:
    over("supplier", "s_suppkey", f"fn_{name}", columns)


def bal():
    return F.col("s_acctbal")


def unit():
    return F.col("s_acctbal") / 20000


for _f in ("cos", "sin", "tan", "atan"):
    line(_f, a=(lambda f=_f: F.round(getattr(N, f)(unit()), 9), f"round({_f}(s_acctbal / 20000), 9)"))
for _f in ("acos", "asin"):
    line(_f, a=(lambda f=_f: F.round(getattr(N, f)(unit()), 9), f"round({_f}(s_acctbal / 20000), 9)"))
for _f in ("cosh", "sinh", "tanh"):
    line(_f, a=(lambda f=_f: F.round(getattr(N, f)(unit()), 9), f"round({_f}(s_acctbal / 20000), 9)"))
line("cot", a=(lambda: F.round(N.cot(F.col("s_suppkey") / 7.0), 6), "round(cot(s_suppkey / 7.0), 6)"))
line("atan2", a=(lambda: F.round(N.atan2(bal(), F.col("s_suppkey")), 9), "round(atan2(s_acctbal, s_suppkey), 9)"))
line("pi_e", a=(lambda: F.round(N.pi() * F.col("s_suppkey"), 6), "round(pi() * s_suppkey, 6)"), b=(lambda: F.round(N.e(), 9), "round(exp(1.0), 9)"))
line("abs_sign_neg", a=(lambda: N.absolute(bal()), "abs(s_acctbal)"), b=(lambda: N.sign(bal()).cast("long"), "CAST(sign(s_acctbal) AS BIGINT)"), c=(lambda: N.negate(bal()), "-s_acctbal"))
line("ceil_floor", a=(lambda: N.ceil(bal()), "ceil(s_acctbal)"), b=(lambda: N.floor(bal()), "floor(s_acctbal)"))
line("roots", a=(lambda: F.round(N.sqrt(N.absolute(bal())), 6), "round(sqrt(abs(s_acctbal)), 6)"), b=(lambda: F.round(N.cbrt(bal()), 6), "round(cbrt(s_acctbal), 6)"))
line("exp_power", a=(lambda: F.round(N.exp(unit()), 9), "round(exp(s_acctbal / 20000), 9)"), b=(lambda: F.round(N.power(unit(), 2), 9), "round(pow(s_acctbal / 20000, 2), 9)"))
line("degrees_radians", a=(lambda: F.round(N.degrees(unit()), 6), "round(degrees(s_acctbal / 20000), 6)"), b=(lambda: F.round(N.radians(bal()), 6), "round(radians(s_acctbal), 6)"))
_pos = lambda f: f"CASE WHEN s_acctbal > 0 THEN round({f}, 9) END"
line(
    "logarithms",
    a=(lambda: F.round(N.ln(bal()), 9), _pos("ln(greatest(s_acctbal, 0.01))")),
    b=(lambda: F.round(N.log2(bal()), 9), _pos("log2(greatest(s_acctbal, 0.01))")),
    c=(lambda: F.round(N.log10(bal()), 9), _pos("log10(greatest(s_acctbal, 0.01))")),
    d=(lambda: F.round(N.log(3.0, bal()), 9), _pos("ln(greatest(s_acctbal, 0.01)) / ln(3.0)")),
)
line("round_truncate", a=(lambda: N.round_half_up(bal()), "round(s_acctbal)"), b=(lambda: N.truncate(bal()), "trunc(s_acctbal)"), c=(lambda: F.round(N.round_up_to(bal(), 1), 4), "round(trunc(s_acctbal * 10) / 10, 4)"))
line(
    "bits",
    a=(lambda: N.bit_and(F.col("s_suppkey"), F.lit(6).cast("long")), "s_suppkey & 6"),
    b=(lambda: N.bit_or(F.col("s_suppkey"), F.lit(9).cast("long")), "s_suppkey | 9"),
    c=(lambda: N.shift_left("s_suppkey", 3), "s_suppkey << 3"),
    d=(lambda: N.shift_right("s_suppkey", 1), "s_suppkey >> 1"),
    e=(lambda: N.bit_xor(F.col("s_suppkey"), F.lit(5).cast("long")), "xor(s_suppkey, 5)"),
)
line("int_ops", a=(lambda: N.int_divide(F.col("s_suppkey") - 50, F.lit(7)), "CAST(trunc((s_suppkey - 50) / 7.0) AS BIGINT)"), b=(lambda: N.modulo(F.col("s_suppkey") - 50, F.lit(7).cast("long")), "(s_suppkey - 50) % 7"), c=(lambda: N.modulo(bal(), F.lit(0.0)), "CAST(NULL AS DOUBLE)"))
line("checked", a=(lambda: N.checked("add", F.lit(2**63 - 50), F.col("s_suppkey")), "CASE WHEN s_suppkey < 50 THEN 9223372036854775758 + s_suppkey END"))
line("zero_bits", a=(lambda: N.leading_zeros("s_suppkey").cast("long"), "CAST(64 - length(ltrim(bin(s_suppkey), '0')) AS BIGINT)"), b=(lambda: N.trailing_zeros("s_suppkey").cast("long"), "CAST(CASE WHEN s_suppkey = 0 THEN 64 ELSE length(bin(s_suppkey)) - length(rtrim(bin(s_suppkey), '0')) END AS BIGINT)"))
line(
    "hash",
    a=(lambda: P.hashed(F.col("s_nationkey").cast("long"), "s_suppkey") == P.hashed("s_suppkey", F.col("s_nationkey").cast("long")), "s_nationkey = s_suppkey"),
    b=(lambda: P.hashed(F.nullif("s_nationkey", F.lit(1))) == P.hashed(F.lit(None).cast("int")), "s_nationkey = 1"),
    c=(lambda: P.hashed(F.lit(None).cast("int"), "s_nationkey", fast=False) == P.hashed("s_nationkey", F.lit(None).cast("int"), fast=False), "false"),
)


def event(name: str, **columns: tuple) -> None:
    over("events", "event_id", f"fn_{name}", columns)


_int = lambda e: f"CAST({e} AS BIGINT)"
for _f, _sql in {
    "year": "year(ts)", "quarter": "quarter(ts)", "month": "month(ts)", "day": "day(ts)", "hour": "hour(ts)", "minute": "minute(ts)", "second": "second(ts)", "century": "(year(ts) + 99) // 100", "decade": "year(ts) // 10",
    "day_of_week": "dayofweek(ts)", "day_of_year": "dayofyear(ts)", "millisecond": "millisecond(ts)", "microseconds": "microsecond(ts)",
}.items():
    event(_f, a=(lambda f=_f: getattr(D, f)("ts"), _int(_sql)))
event(
    "make_date_time",
    a=(lambda: D.to_text(D.make_date(F.year("ts"), F.month("ts"), F.dayofmonth("ts"))), "CAST(make_date(year(ts), month(ts), day(ts)) AS VARCHAR)"),
    b=(lambda: D.make_timestamp(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.minute("ts"), F.lit(0)), "date_trunc('minute', ts)"),
    c=(lambda: D.as_timestamp(D.as_date("ts")), "CAST(CAST(ts AS DATE) AS TIMESTAMP)"),
    d=(lambda: D.make_timestamp(F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.lit(24), F.lit(0), F.lit(0)), "CAST(CAST(ts AS DATE) AS TIMESTAMP) + INTERVAL 1 DAY"),
)
event("date_text", a=(lambda: D.to_text(D.as_date("ts")), "CAST(CAST(ts AS DATE) AS VARCHAR)"), b=(lambda: D.to_text(D.to_date(F.lit(" 1998-9-2 "))), "'1998-09-02'"))
event(
    "casts",
    a=(lambda: C.bool_to_int(F.col("value") > 50), "CAST(value > 50 AS INTEGER)"),
    b=(lambda: C.int_to_real("user_id"), "CAST(user_id AS DOUBLE)"),
    c=(lambda: C.to_text("user_id"), "CAST(user_id AS VARCHAR)"),
    d=(lambda: C.try_cast("event_type", "long"), "TRY_CAST(event_type AS BIGINT)"),
    e=(lambda: C.exact_int(F.col("user_id") / 2), "CASE WHEN user_id % 2 = 0 THEN user_id // 2 END"),
    f=(lambda: C.cast("event_id", "int"), "CAST(event_id AS INTEGER)"),
)
event(
    "casts_from_text",
    a=(lambda: C.text_to_int(F.concat("user_id", F.lit("abc"))), "user_id"),
    b=(lambda: C.text_to_bool("event_type").isNull(), "true"),
    c=(lambda: C.text_to_real(F.concat("user_id", F.lit(".5"))), "user_id + CAST(0.5 AS DOUBLE)"),
    d=(lambda: C.text_to_timestamp(D.to_text("ts")), "ts"),
    e=(lambda: C.text_to_date(F.lit("1997-02-29")).isNull(), "true"),
    f=(lambda: C.text_to_bool(F.concat(F.lit("True"), "event_type")), "true"),
)
