"""Star schema queries on a star that is derived from orders and line items.

Revenue is price times (1 - discount); cost is 60 % of the part's retail price times quantity. Part brands give
manufacturer, category and brand; nations have cities by the last digit of a key; years and weeks come from the
order date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import relational as R
from tessella.plans.registry import Tables, query


def part(t: Tables) -> DataFrame:
    k = F.regexp_replace("p_brand", "Brand#", "").cast("int") - 1
    category = F.concat(F.lit("MFGR#"), (F.floor(k / 5) + 1).cast("string"), (k % 5 + 1).cast("string"))
    return t.part.select(
        F.col("p_partkey").alias("d_partkey"),
        "p_retailprice",
        F.concat(F.lit("MFGR#"), (F.floor(k / 5) + 1).cast("string")).alias("p_mfgr"),
        category.alias("p_category"),
        F.concat(category, F.lpad((F.col("p_partkey") % 40 + 1).cast("string"), 2, "0")).alias("p_brand1"),
    )


def place(t: Tables, table: DataFrame, key: str, nation: str, x: str) -> DataFrame:
    """Key, nation, region and city of customers or suppliers."""
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return table.join(nations, F.col(nation) == F.col("n_nationkey")).select(
        F.col(key).alias(f"{x}_key"), F.col("n_name").alias(f"{x}_nation"), F.col("r_name").alias(f"{x}_region"), F.concat("n_name", F.lit("_"), (F.col(key) % 10).cast("string")).alias(f"{x}_city")
    )


def customer(t: Tables) -> DataFrame:
    return place(t, t.customer, "c_custkey", "c_nationkey", "c")


def supplier(t: Tables) -> DataFrame:
    return place(t, t.supplier, "s_suppkey", "s_nationkey", "s")


def lineorder(t: Tables, *dimensions: tuple[DataFrame, str, str], days: tuple[str, str] | None = None, discount: tuple[int, int] | None = None) -> DataFrame:
    """Line items with their orders' customer and date. Dimensions of the line item are joined before its order: they are small, and selective.

    ``days`` (from, before) and ``discount`` (per cent, both included) are ranges on the columns as they are stored, which a scan can use.
    """
    day = F.col("o_orderdate")
    stored, orders = t.lineitem, t.orders
    if discount:
        stored = stored.where(F.col("l_discount").between(discount[0] / 100 - 0.004, discount[1] / 100 + 0.004))
    if days:
        orders = orders.where((day >= F.expr(f"TIMESTAMP_NTZ'{days[0]} 00:00:00'")) & (day < F.expr(f"TIMESTAMP_NTZ'{days[1]} 00:00:00'")))
    lines = stored.select(
        "l_orderkey",
        F.col("l_partkey").alias("lo_partkey"),
        F.col("l_suppkey").alias("lo_suppkey"),
        F.col("l_quantity").alias("lo_quantity"),
        F.round(F.col("l_discount") * 100).cast("int").alias("lo_discount"),
        F.col("l_extendedprice").alias("lo_extendedprice"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("lo_revenue"),
    )
    orders = orders.select(
        "o_orderkey",
        F.col("o_custkey").alias("lo_custkey"),
        F.year(day).cast("long").alias("d_year"),
        (F.year(day) * 100 + F.month(day)).cast("long").alias("d_yearmonthnum"),
        (F.floor((F.dayofyear(day) - 1) / 7) + 1).cast("long").alias("d_weeknuminyear"),
    )
    return R.star_join(lines, *dimensions).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


STAR = """WITH lo AS (SELECT o_custkey AS lo_custkey, l_partkey AS lo_partkey, l_suppkey AS lo_suppkey, l_quantity AS lo_quantity, CAST(round(l_discount * 100) AS INTEGER) AS lo_discount, l_extendedprice AS lo_extendedprice, l_extendedprice * (1 - l_discount) AS lo_revenue,
  CAST(year(o_orderdate) AS BIGINT) AS d_year, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS d_yearmonthnum, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS BIGINT) AS d_weeknuminyear FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
b AS (SELECT *, CAST(replace(p_brand, 'Brand#', '') AS INTEGER) - 1 AS k FROM part),
p AS (SELECT p_partkey, p_retailprice, 'MFGR#' || (k // 5 + 1) AS p_mfgr, 'MFGR#' || (k // 5 + 1) || (k % 5 + 1) AS p_category, 'MFGR#' || (k // 5 + 1) || (k % 5 + 1) || lpad(CAST(p_partkey % 40 + 1 AS VARCHAR), 2, '0') AS p_brand1 FROM b),
c AS (SELECT c_custkey, n_name AS c_nation, r_name AS c_region, n_name || '_' || (c_custkey % 10) AS c_city FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT s_suppkey, n_name AS s_nation, r_name AS s_region, n_name || '_' || (s_suppkey % 10) AS s_city FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
DATE = {
    "1": ("d_year = 1997", ("1997-01-01", "1998-01-01"), 1, 3, "lo_quantity < 25"),
    "2": ("d_yearmonthnum = 199701", ("1997-01-01", "1997-02-01"), 4, 6, "lo_quantity BETWEEN 26 AND 35"),
    "3": ("d_weeknuminyear = 6 AND d_year = 1997", ("1997-02-01", "1997-03-01"), 5, 7, "lo_quantity BETWEEN 26 AND 35"),
}


def _flight1(dates, days, low, high, quantity):
    def build(spark, d):
        rows = lineorder(Tables(spark, d), days=days, discount=(low, high)).where(dates).where(F.col("lo_discount").between(low, high)).where(quantity)
        return R.aggregate(rows, [], [F.round(F.sum(F.col("lo_extendedprice") * F.col("lo_discount")), 2).alias("revenue")])

    return build


for _n, (_dates, _days, _low, _high, _quantity) in DATE.items():
    query(f"{STAR} SELECT round(sum(lo_extendedprice * lo_discount), 2) AS revenue FROM lo WHERE {_dates} AND lo_discount BETWEEN {_low} AND {_high} AND {_quantity}", f"ssb_q1_{_n}")(_flight1(_dates, _days, _low, _high, _quantity))


def _star(keys, where, order, profit=False, use="pcs", days=None):
    """A flight over the dimensions named in ``use``: groups by keys the revenue, or profit, of rows that meet all predicates; ``days`` is the range of dates that these leave."""
    value = "lo_revenue - 0.6 * p_retailprice * lo_quantity" if profit else "lo_revenue"
    name = "profit" if profit else "revenue"

    def build(spark, d):
        t = Tables(spark, d)
        dims = {"p": (part, "lo_partkey", "d_partkey"), "c": (customer, "lo_custkey", "c_key"), "s": (supplier, "lo_suppkey", "s_key")}
        sides = {x: (dims[x][0](t), *dims[x][1:]) for x in use}
        joined = R.star_join(lineorder(t, *[sides[x] for x in use if x != "c"], days=days), *[sides[x] for x in use if x == "c"])
        for w in where:
            joined = joined.where(w)
        out = R.aggregate(joined, keys, [F.round(F.sum(F.expr(value)), 2).alias(name)])
        return out.orderBy(*[F.desc(k.removesuffix(" DESC")) if k.endswith(" DESC") else k for k in order])

    sql_joins = {"p": "JOIN p ON lo_partkey = p_partkey", "c": "JOIN c ON lo_custkey = c_custkey", "s": "JOIN s ON lo_suppkey = s_suppkey"}
    sql = f"{STAR} SELECT {', '.join(keys)}, round(sum({value}), 2) AS {name} FROM lo {' '.join(sql_joins[x] for x in use)} WHERE {' AND '.join(f'({w})' for w in where)} GROUP BY ALL ORDER BY {', '.join(order)}"
    return build, sql


_years, _by_year = "d_year BETWEEN 1995 AND 2000", ["d_year", "revenue DESC"]
_cities = "c_city IN ('NATION_6_1', 'NATION_6_5')", "s_city IN ('NATION_6_1', 'NATION_6_5')"
FLIGHTS = {
    "2_1": _star(["d_year", "p_brand1"], ["p_category = 'MFGR#12'", "s_region = 'AMERICA'"], ["d_year", "p_brand1"], use="ps"),
    "2_2": _star(["d_year", "p_brand1"], ["p_brand1 BETWEEN 'MFGR#2221' AND 'MFGR#2228'", "s_region = 'ASIA'"], ["d_year", "p_brand1"], use="ps"),
    "2_3": _star(["d_year", "p_brand1"], ["p_brand1 = 'MFGR#2221'", "s_region = 'EUROPE'"], ["d_year", "p_brand1"], use="ps"),
    "3_1": _star(["c_nation", "s_nation", "d_year"], [_years, "c_region = 'ASIA'", "s_region = 'ASIA'"], _by_year, use="cs", days=("1995-01-01", "2001-01-01")),
    "3_2": _star(["c_city", "s_city", "d_year"], [_years, "c_nation = 'NATION_6'", "s_nation = 'NATION_6'"], _by_year, use="cs", days=("1995-01-01", "2001-01-01")),
    "3_3": _star(["c_city", "s_city", "d_year"], [_years, *_cities], _by_year, use="cs", days=("1995-01-01", "2001-01-01")),
    "3_4": _star(["c_city", "s_city", "d_year"], ["d_yearmonthnum BETWEEN 199701 AND 199712", *_cities], _by_year, use="cs", days=("1997-01-01", "1998-01-01")),
    "4_1": _star(["d_year", "c_nation"], ["c_region = 'AMERICA'", "s_region = 'AMERICA'", "p_mfgr IN ('MFGR#1', 'MFGR#2')"], ["d_year", "c_nation"], True),
    "4_2": _star(["d_year", "s_nation", "p_category"], ["d_year IN (1997, 1998)", "c_region = 'AMERICA'", "s_region = 'AMERICA'", "p_mfgr IN ('MFGR#1', 'MFGR#2')"], ["d_year", "s_nation", "p_category"], True, days=("1997-01-01", "1999-01-01")),
    "4_3": _star(["d_year", "s_city", "p_brand1"], ["d_year IN (1997, 1998)", "c_region = 'AMERICA'", "s_nation = 'NATION_6'", "p_category = 'MFGR#14'"], ["d_year", "s_city", "p_brand1"], True, days=("1997-01-01", "1999-01-01")),
}
for _n, (_build, _sql) in FLIGHTS.items():
    query(_sql, f"ssb_q{_n}")(_build)
