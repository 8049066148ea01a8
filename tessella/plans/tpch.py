"""TPC-H queries on the tables at hand.

Columns and tables that these lack are derived from keys: part suppliers from the pairs that line items hold,
commit and receipt dates, ship modes and instructions, containers, nations by their numbers. Dates are moved into
the range of the data, so that each query has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import relational as R
from tessella.plans.registry import Tables, query

MODES = ("AIR", "AIR REG", "FOB", "MAIL", "RAIL", "SHIP", "TRUCK")
INSTRUCTIONS = ("COLLECT COD", "DELIVER IN PERSON", "NONE", "TAKE BACK RETURN")
CONTAINERS = ("SM CASE", "MED BAG", "LG BOX", "JUMBO PKG")


def ts(day: str):
    return F.expr(f"TIMESTAMP_NTZ'{day} 00:00:00'")


def pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values)).cast("int") + 1)


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def total(c, name: str):
    return F.round(F.sum(c), 2).alias(name)


def lines(t: Tables) -> DataFrame:
    days = lambda n: F.make_dt_interval(n)
    return t.lineitem.withColumns(
        {
            "l_commitdate": F.col("l_shipdate") + days((F.col("l_orderkey") % 61 - 30).cast("int")),
            "l_receiptdate": F.col("l_shipdate") + days((1 + F.col("l_linenumber") * 5 % 30).cast("int")),
            "l_shipmode": pick(MODES, F.col("l_orderkey") + F.col("l_linenumber")),
            "l_shipinstruct": pick(INSTRUCTIONS, F.col("l_partkey")),
        }
    )


def part_suppliers(rows: DataFrame) -> DataFrame:
    """The part suppliers that some line items hold; give only those of the parts or suppliers that matter."""
    pairs = rows.select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
    return pairs.withColumns(
        {"ps_availqty": 1 + (F.col("ps_partkey") * 31 + F.col("ps_suppkey") * 17) % 9999, "ps_supplycost": 1 + (F.col("ps_partkey") * F.col("ps_suppkey") % 100000) / 100.0}
    )


LINES_SQL = """lines AS (SELECT *, l_shipdate + to_days(CAST(l_orderkey % 61 - 30 AS INTEGER)) AS l_commitdate, l_shipdate + to_days(CAST(1 + l_linenumber * 5 % 30 AS INTEGER)) AS l_receiptdate,
  (['AIR','AIR REG','FOB','MAIL','RAIL','SHIP','TRUCK'])[(l_orderkey + l_linenumber) % 7 + 1] AS l_shipmode, (['COLLECT COD','DELIVER IN PERSON','NONE','TAKE BACK RETURN'])[l_partkey % 4 + 1] AS l_shipinstruct FROM lineitem)"""
PARTSUPP_SQL = """partsupp AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, 1 + (l_partkey * 31 + l_suppkey * 17) % 9999 AS ps_availqty, 1 + (l_partkey * l_suppkey % 100000) / 100.0 AS ps_supplycost FROM lineitem)"""


@query(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
  round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL ORDER BY 1, 2"""
)
def tpch_q1(spark, d):
    t = Tables(spark, d)
    rows = R.scan(t.lineitem, where=F.col("l_shipdate") <= ts("1998-09-02"))
    aggregates = [
        total("l_quantity", "sum_qty"), total("l_extendedprice", "sum_base_price"), total(revenue(), "sum_disc_price"), total(revenue() * (1 + F.col("l_tax")), "sum_charge"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"),
    ]
    return R.aggregate(rows, ["l_returnflag", "l_linestatus"], aggregates).orderBy("l_returnflag", "l_linestatus")


@query(
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10"""
)
def tpch_q3(spark, d):
    t = Tables(spark, d)
    day = ts("1997-03-15")
    orders = t.orders.where(F.col("o_orderdate") < day).join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    joined = R.hash_join(orders, t.lineitem.where(F.col("l_shipdate") > day), F.col("l_orderkey") == F.col("o_orderkey"))
    return R.top_k(R.aggregate(joined, ["l_orderkey", "o_orderdate"], [total(revenue(), "revenue")]), [F.desc("revenue"), "o_orderdate", "l_orderkey"], 10)


@query(
    f"""WITH {LINES_SQL} SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1997-07-01' AND o_orderdate < TIMESTAMP '1997-10-01'
AND EXISTS (SELECT 1 FROM lines WHERE l_orderkey = o_orderkey AND l_commitdate < l_receiptdate) GROUP BY 1 ORDER BY 1"""
)
def tpch_q4(spark, d):
    t = Tables(spark, d)
    orders = t.orders.where((F.col("o_orderdate") >= ts("1997-07-01")) & (F.col("o_orderdate") < ts("1997-10-01")))
    late = lines(t).where(F.col("l_commitdate") < F.col("l_receiptdate"))
    return R.aggregate(R.hash_join(orders, late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi"), ["o_orderpriority"], [F.count("*").alias("order_count")]).orderBy("o_orderpriority")


@query(
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY revenue DESC"""
)
def tpch_q5(spark, d):
    t = Tables(spark, d)
    orders = t.orders.where((F.col("o_orderdate") >= ts("1997-01-01")) & (F.col("o_orderdate") < ts("1998-01-01")))
    nations = t.nation.join(t.region.where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    joined = R.star_join(t.lineitem, (orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"))
    joined = joined.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return R.aggregate(joined.join(nations, F.col("s_nationkey") == F.col("n_nationkey")), ["n_name"], [total(revenue(), "revenue")]).orderBy(F.desc("revenue"))


@query("SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def tpch_q6(spark, d):
    day = F.col("l_shipdate")
    rows = Tables(spark, d).lineitem.where((day >= ts("1997-01-01")) & (day < ts("1998-01-01")) & F.col("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return R.aggregate(rows, [], [total(F.col("l_extendedprice") * F.col("l_discount"), "revenue")])


@query(
    """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1, 2, 3 ORDER BY 1, 2, 3"""
)
def tpch_q7(spark, d):
    t = Tables(spark, d)
    n1, n2 = (t.nation.select(F.col("n_nationkey").alias(f"{x}_key"), F.col("n_name").alias(f"{x}_nation")) for x in ("supp", "cust"))
    a, b = F.col("supp_nation"), F.col("cust_nation")
    pairs = R.nested_loop_join(n1, n2, ((a == "NATION_6") & (b == "NATION_7")) | ((a == "NATION_7") & (b == "NATION_6")))
    rows = t.lineitem.where(F.col("l_shipdate").between(ts("1995-01-01"), ts("1996-12-31")))
    joined = R.star_join(rows, (t.supplier, "l_suppkey", "s_suppkey"), (t.orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"))
    joined = joined.join(pairs, (F.col("s_nationkey") == F.col("supp_key")) & (F.col("c_nationkey") == F.col("cust_key")))
    keys = ["supp_nation", "cust_nation", F.year("l_shipdate").cast("long").alias("l_year")]
    return R.aggregate(joined, keys, [total(revenue(), "revenue")]).orderBy("supp_nation", "cust_nation", "l_year")


@query(
    f"""WITH {PARTSUPP_SQL} SELECT n_name, CAST(year(o_orderdate) AS BIGINT) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS sum_profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN partsupp ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%red%' GROUP BY 1, 2 ORDER BY 1, 2 DESC"""
)
def tpch_q9(spark, d):
    t = Tables(spark, d)
    rows = t.lineitem.join(t.part.where("p_name LIKE '%red%'"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    joined = R.star_join(rows, (t.supplier, "l_suppkey", "s_suppkey"), (t.orders, "l_orderkey", "o_orderkey"), (t.nation, "s_nationkey", "n_nationkey"))
    joined = joined.join(part_suppliers(rows), (F.col("ps_suppkey") == F.col("l_suppkey")) & (F.col("ps_partkey") == F.col("l_partkey")))
    profit = revenue() - F.col("ps_supplycost") * F.col("l_quantity")
    return R.aggregate(joined, ["n_name", F.year("o_orderdate").cast("long").alias("o_year")], [total(profit, "sum_profit")]).orderBy("n_name", F.desc("o_year"))


@query(
    """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1997-10-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20"""
)
def tpch_q10(spark, d):
    t = Tables(spark, d)
    orders = t.orders.where((F.col("o_orderdate") >= ts("1997-10-01")) & (F.col("o_orderdate") < ts("1998-01-01")))
    joined = R.star_join(t.lineitem.where("l_returnflag = 'R'"), (orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"))
    return R.top_k(R.aggregate(joined, ["c_custkey", "c_name", "c_acctbal", "n_name"], [total(revenue(), "revenue")]), [F.desc("revenue"), "c_custkey"], 20)


@query(
    f"""WITH {PARTSUPP_SQL}, g AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM partsupp JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_7')
SELECT ps_partkey, round(sum(v), 2) AS value FROM g GROUP BY 1 HAVING sum(v) > (SELECT 0.002 * sum(v) FROM g) ORDER BY 2 DESC, 1"""
)
def tpch_q11(spark, d):
    t = Tables(spark, d)
    supplier = t.supplier.join(t.nation.where("n_name = 'NATION_7'"), F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    g = part_suppliers(t.lineitem.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")).withColumn("v", F.col("ps_supplycost") * F.col("ps_availqty"))
    per = R.aggregate(g, ["ps_partkey"], [F.sum("v").alias("v")])
    least = R.aggregate(per, [], [(F.sum("v") * 0.002).alias("least")])
    return R.nested_loop_join(per, least, F.col("v") > F.col("least")).select("ps_partkey", F.round("v", 2).alias("value")).orderBy(F.desc("value"), "ps_partkey")


@query(
    f"""WITH {LINES_SQL} SELECT l_shipmode, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lines ON o_orderkey = l_orderkey WHERE l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate AND l_shipdate < l_commitdate AND l_receiptdate >= TIMESTAMP '1997-01-01' AND l_receiptdate < TIMESTAMP '1998-01-01' GROUP BY 1 ORDER BY 1"""
)
def tpch_q12(spark, d):
    t = Tables(spark, d)
    c = F.col
    rows = lines(t).where(c("l_shipmode").isin("MAIL", "SHIP") & (c("l_commitdate") < c("l_receiptdate")) & (c("l_shipdate") < c("l_commitdate")) & (c("l_receiptdate") >= ts("1997-01-01")) & (c("l_receiptdate") < ts("1998-01-01")))
    high = c("o_orderpriority").isin("1-URGENT", "2-HIGH")
    counts = [F.sum(F.when(high, 1).otherwise(0)).alias("high_line_count"), F.sum(F.when(~high, 1).otherwise(0)).alias("low_line_count")]
    return R.aggregate(R.hash_join(t.orders, rows, c("o_orderkey") == c("l_orderkey")), ["l_shipmode"], counts).orderBy("l_shipmode")


@query(
    """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-09-01' AND l_shipdate < TIMESTAMP '1995-10-01'"""
)
def tpch_q14(spark, d):
    t = Tables(spark, d)
    rows = t.lineitem.where((F.col("l_shipdate") >= ts("1995-09-01")) & (F.col("l_shipdate") < ts("1995-10-01")))
    joined = R.hash_join(rows, t.part, F.col("l_partkey") == F.col("p_partkey"))
    promo = F.sum(F.when(F.col("p_type").like("PROMO%"), revenue()).otherwise(0.0))
    return R.aggregate(joined, [], [F.round(100.0 * promo / F.sum(revenue()), 6).alias("promo_revenue")])


@query(
    f"""WITH {PARTSUPP_SQL} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0) GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3"""
)
def tpch_q16(spark, d):
    """Suppliers with complaints are those whose number ends in 0."""
    t = Tables(spark, d)
    parts = t.part.where((F.col("p_brand") != "Brand#5") & ~F.col("p_type").like("MEDIUM%") & F.col("p_size").isin(49, 14, 23, 45, 19, 3, 36, 9))
    rows = t.lineitem.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    joined = R.hash_join(part_suppliers(rows), parts, F.col("ps_partkey") == F.col("p_partkey"))
    joined = R.hash_join(t.supplier.where("s_suppkey % 10 = 0"), joined, F.col("s_suppkey") == F.col("ps_suppkey"), "right_anti")
    return R.aggregate(joined, ["p_brand", "p_type", "p_size"], [F.count_distinct("ps_suppkey").alias("supplier_cnt")]).orderBy(F.desc("supplier_cnt"), "p_brand", "p_type", "p_size")


@query(
    """SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS sum_qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 300) GROUP BY ALL ORDER BY o_totalprice DESC, 4, o_orderkey"""
)
def tpch_q18(spark, d):
    t = Tables(spark, d)
    large = R.aggregate(t.lineitem, ["l_orderkey"], [F.sum("l_quantity").alias("q")], F.col("q") > 300).select(F.col("l_orderkey").alias("k"))
    orders = R.hash_join(large, t.orders, F.col("k") == F.col("o_orderkey"), "right_semi")
    joined = R.star_join(t.lineitem, (orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"))
    keys = ["c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_totalprice"]
    return R.aggregate(joined, keys, [total("l_quantity", "sum_qty")]).orderBy(F.desc("o_totalprice"), "o_orderdate", "o_orderkey")


@query(
    f"""WITH {LINES_SQL}, parts AS (SELECT *, (['SM CASE','MED BAG','LG BOX','JUMBO PKG'])[p_partkey % 4 + 1] AS p_container FROM part)
SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lines JOIN parts ON p_partkey = l_partkey WHERE l_shipmode IN ('AIR', 'AIR REG') AND l_shipinstruct = 'DELIVER IN PERSON' AND
((p_brand IN ('Brand#12', 'Brand#13') AND p_container = 'MED BAG' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25) OR (p_brand = 'Brand#23' AND p_container = 'MED BAG' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 40)
 OR (p_brand IN ('Brand#4', 'Brand#5') AND p_container = 'MED BAG' AND l_quantity BETWEEN 20 AND 40 AND p_size BETWEEN 1 AND 45))"""
)
def tpch_q19(spark, d):
    t = Tables(spark, d)
    c = F.col
    parts = t.part.withColumn("p_container", pick(CONTAINERS, c("p_partkey")))
    rows = lines(t).where(c("l_shipmode").isin("AIR", "AIR REG") & (c("l_shipinstruct") == "DELIVER IN PERSON"))

    def branch(brands, low, size):
        return c("p_brand").isin(*brands) & (c("p_container") == "MED BAG") & c("l_quantity").between(low, low + 20) & c("p_size").between(1, size)

    on = (c("p_partkey") == c("l_partkey")) & (branch(["Brand#12", "Brand#13"], 1, 25) | branch(["Brand#23"], 10, 40) | branch(["Brand#4", "Brand#5"], 20, 45))
    return R.aggregate(R.hash_join(rows, parts, on), [], [total(revenue(), "revenue")])
