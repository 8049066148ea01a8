"""One query for each operator: scans, projections, predicates, joins, aggregates, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import numeric as N
from tessella.functions import predicates as P
from tessella.operators import relational as R
from tessella.plans.registry import Tables, query


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled, l_quantity >= 10 * l_linenumber AS large FROM lineitem WHERE l_quantity < 20 AND l_linenumber >= 2")
def scan_filter(spark, d):
    t = Tables(spark, d)
    q = F.col("l_quantity")
    return R.scan(t.lineitem, ["l_orderkey", "l_linenumber", (q * 2).alias("doubled"), (q >= F.col("l_linenumber") * 10).alias("large")], P.all_of(P.lt("l_quantity", 20), P.ge("l_linenumber", 2)))


@query("SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000 WHERE c_custkey IS NULL")
def scan_null_check(spark, d):
    t = Tables(spark, d)
    return R.hash_join(t.orders, t.customer, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("c_acctbal") > 5000), "left").where(P.is_null("c_custkey")).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity < 5 AND l_discount > 0.05) OR (l_extendedprice > 90000 AND l_tax < 0.02) OR l_linenumber * l_quantity = 42")
def scan_complex_predicate(spark, d):
    t = Tables(spark, d)
    return R.scan(
        t.lineitem,
        ["l_orderkey", "l_linenumber"],
        P.any_of(
            P.all_of(P.lt("l_quantity", 5), P.gt("l_discount", 0.05)), P.all_of(P.gt("l_extendedprice", 90000), P.lt("l_tax", 0.02)), F.col("l_linenumber") * F.col("l_quantity") == 42
        ),
    )


@query("SELECT * FROM supplier WHERE s_acctbal > 0")
def scan_all_columns(spark, d):
    return R.scan(Tables(spark, d).supplier, where=P.gt("s_acctbal", 0))


@query("SELECT round(cos(1.0), 9) AS c, round(sin(90), 9) AS s, CAST(1 + 2 AS INTEGER) AS i, CAST(4.0 * 5.0 AS DOUBLE) AS r")
def projection_constants(spark, d):
    return R.constants(spark, c=F.round(F.cos(F.lit(1.0)), 9), s=F.round(F.sin(F.lit(90.0)), 9), i=F.lit(1) + F.lit(2), r=F.lit(4.0) * F.lit(5.0))


@query("SELECT true AS b, CAST(7 AS INTEGER) AS i, CAST(2.5 AS DOUBLE) AS r, CAST(DATE '1998-09-02' AS VARCHAR) AS dt, 'text' AS s, CAST(CAST(NULL AS INTEGER) IS NULL AS BOOLEAN) AS n")
def constants_of_all_types(spark, d):
    return R.constants(spark, b=True, i=7, r=2.5, dt=F.make_date(F.lit(1998), F.lit(9), F.lit(2)).cast("string"), s="text", n=F.lit(None).cast("int").isNull())


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS class, CASE WHEN o_orderstatus = 'F' THEN 1 END AS done FROM orders")
def case_when(spark, d):
    kind = P.case([(P.gt("o_totalprice", 300000), "high"), (P.gt("o_totalprice", 100000), "mid")], "low")
    return Tables(spark, d).orders.select("o_orderkey", kind.alias("class"), P.case([(P.eq("o_orderstatus", "F"), 1)]).alias("done"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'S%'")
def like_not_like(spark, d):
    from tessella.functions import strings as S

    return Tables(spark, d).part.where(S.like("p_name", "%a_e%") & S.not_like("p_type", "S%")).select("p_partkey", "p_name")


@query(
    """SELECT p_partkey, p_size = 10 AS eq, p_size <> 10 AS ne, p_size < 10 AS lt, p_size <= 10 AS le, p_size > 10 AS gt, p_size >= 10 AS ge,
  p_size BETWEEN 5 AND 10 AS b11, (p_size > 5 AND p_size <= 10) AS b01, (p_size >= 5 AND p_size < 10) AS b10, (p_size > 5 AND p_size < 10) AS b00, p_size IN (1, 5, 9) AS isin, NOT (p_size = 10) AS neg FROM part"""
)
def comparisons(spark, d):
    s = "p_size"
    return Tables(spark, d).part.select(
        "p_partkey", P.eq(s, 10).alias("eq"), P.ne(s, 10).alias("ne"), P.lt(s, 10).alias("lt"), P.le(s, 10).alias("le"), P.gt(s, 10).alias("gt"), P.ge(s, 10).alias("ge"),
        P.between(s, 5, 10).alias("b11"), P.between(s, 5, 10, False, True).alias("b01"), P.between(s, 5, 10, True, False).alias("b10"), P.between(s, 5, 10, False, False).alias("b00"),
        P.is_in(s, 1, 5, 9).alias("isin"), P.negation(P.eq(s, 10)).alias("neg"),
    )


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, nullif(l_linenumber, 3) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST((k > 2) AND (l_orderkey % 2 = 0) AS INTEGER) AS a, CAST((k > 2) OR (l_orderkey % 2 = 0) AS INTEGER) AS o, CAST(NOT (k > 2) AS INTEGER) AS n, k IS NULL AS isnull, k IS NOT NULL AS isnotnull FROM x"""
)
def three_valued_logic(spark, d):
    x = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", F.nullif("l_linenumber", F.lit(3)).alias("k"))
    big, even = P.gt("k", 2), F.col("l_orderkey") % 2 == 0
    return x.select("l_orderkey", "l_linenumber", P.all_of(big, even).cast("int").alias("a"), P.any_of(big, even).cast("int").alias("o"), P.negation(big).cast("int").alias("n"), P.is_null("k").alias("isnull"), P.is_not_null("k").alias("isnotnull"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS a, l_quantity - l_tax AS s, round(l_quantity * l_discount, 6) AS m, -l_quantity AS n FROM lineitem")
def arithmetic(spark, d):
    q, x = F.col("l_quantity"), F.col("l_tax")
    return Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", N.add(q, x).alias("a"), N.subtract(q, x).alias("s"), F.round(N.multiply(q, F.col("l_discount")), 6).alias("m"), N.negate(q).alias("n"))


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE (o_orderkey // nullif(o_custkey % 7, 0)) END AS q, CASE WHEN o_custkey % 7 <> 0 THEN o_orderkey % nullif(o_custkey % 7, 0) END AS r,
  CASE WHEN o_custkey % 7 <> 0 THEN round(o_totalprice / (o_custkey % 7), 6) END AS x FROM orders"""
)
def division_by_zero(spark, d):
    k, by = F.col("o_orderkey"), F.col("o_custkey") % 7
    return Tables(spark, d).orders.select("o_orderkey", N.int_divide(k, by).alias("q"), N.modulo(k, by).alias("r"), F.round(N.divide(F.col("o_totalprice"), by), 6).alias("x"))


@query("SELECT l_linenumber, CAST(sum(l_orderkey) AS BIGINT) AS total FROM lineitem GROUP BY l_linenumber")
def hash_aggregate(spark, d):
    return R.aggregate(Tables(spark, d).lineitem, ["l_linenumber"], [F.sum("l_orderkey").alias("total")])


@query(
    """SELECT l_returnflag, count(*) AS n, count(nullif(l_linenumber, 1)) AS n_some, round(sum(l_quantity), 2) AS total, min(l_discount) AS lo, max(l_extendedprice) AS hi, round(avg(l_tax), 6) AS mean,
  CAST(min(l_shipdate) AS VARCHAR) AS first, CAST(max(l_shipdate) AS VARCHAR) AS last, min(l_linestatus) AS s0, max(l_linestatus) AS s1 FROM lineitem GROUP BY l_returnflag"""
)
def all_aggregates(spark, d):
    return R.aggregate(
        Tables(spark, d).lineitem,
        ["l_returnflag"],
        [
            F.count("*").alias("n"), F.count(F.nullif("l_linenumber", F.lit(1))).alias("n_some"), F.round(F.sum("l_quantity"), 2).alias("total"), F.min("l_discount").alias("lo"), F.max("l_extendedprice").alias("hi"),
            F.round(F.avg("l_tax"), 6).alias("mean"), F.min("l_shipdate").cast("string").alias("first"), F.max("l_shipdate").cast("string").alias("last"), F.min("l_linestatus").alias("s0"), F.max("l_linestatus").alias("s1"),
        ],
    )


@query("SELECT CAST(l_orderkey % 10 AS BIGINT) AS k, CAST(year(l_shipdate) AS BIGINT) AS y, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 5")
def aggregate_expressions_having(spark, d):
    t = Tables(spark, d).lineitem
    return R.aggregate(t, [(F.col("l_orderkey") % 10).alias("k"), F.year("l_shipdate").cast("long").alias("y")], [F.count("*").alias("n")], F.col("n") > 5)


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def static_aggregate(spark, d):
    return R.aggregate(Tables(spark, d).orders, [], [F.count("*").alias("n"), F.sum("o_custkey").alias("total")])


@query("SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total, max(o_totalprice) AS hi FROM orders WHERE o_orderkey < 0")
def static_aggregate_empty_input(spark, d):
    return R.aggregate(Tables(spark, d).orders.where("o_orderkey < 0"), [], [F.count("*").alias("n"), F.sum("o_custkey").alias("total"), F.max("o_totalprice").alias("hi")])


@query("SELECT count(*) AS n FROM orders HAVING count(*) < 0")
def static_aggregate_having(spark, d):
    return R.aggregate(Tables(spark, d).orders, [], [F.count("*").alias("n")], F.col("n") < 0)


@query("SELECT p_brand, count(DISTINCT p_type) AS types, CAST(sum(DISTINCT p_size) AS BIGINT) AS sizes, count(*) AS n FROM part GROUP BY p_brand")
def distinct_aggregates(spark, d):
    return R.aggregate(Tables(spark, d).part, ["p_brand"], [F.count_distinct("p_type").alias("types"), F.sum_distinct("p_size").alias("sizes"), F.count("*").alias("n")])


@query("SELECT nullif(l_linenumber, 2) AS k, count(*) AS n FROM lineitem GROUP BY 1")
def group_by_null_key(spark, d):
    return R.aggregate(Tables(spark, d).lineitem, [F.nullif("l_linenumber", F.lit(2)).alias("k")], [F.count("*").alias("n")])


@query("SELECT o_orderkey, l_linenumber, o_totalprice, o_orderkey + l_linenumber AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_totalprice > 200000")
def hash_join_inner(spark, d):
    t = Tables(spark, d)
    return R.hash_join(t.orders.where("o_totalprice > 200000"), t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "o_totalprice", (F.col("o_orderkey") + F.col("l_linenumber")).alias("s"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def hash_join_left_semi(spark, d):
    t = Tables(spark, d)
    return R.hash_join(t.customer, t.orders.where("o_totalprice > 250000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE o_custkey = c_custkey AND c_mktsegment = 'BUILDING')")
def hash_join_right_semi(spark, d):
    t = Tables(spark, d)
    return R.hash_join(t.customer.where("c_mktsegment = 'BUILDING'"), t.orders, F.col("o_custkey") == F.col("c_custkey"), "right_semi").select("o_orderkey")


@query("SELECT o_orderkey, nullif(o_custkey % 5, 0) AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = nullif(o_custkey % 5, 0) AND n_nationkey < 3)")
def hash_join_right_anti(spark, d):
    t = Tables(spark, d)
    orders = t.orders.select("o_orderkey", F.nullif(F.col("o_custkey") % 5, F.lit(0).cast("long")).alias("k"))
    return R.hash_join(t.nation.where("n_nationkey < 3"), orders, F.col("n_nationkey") == F.col("k"), "right_anti")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def hash_join_left_anti(spark, d):
    t = Tables(spark, d)
    return R.hash_join(t.customer, t.orders.where("o_totalprice > 250000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


def _outer(how):
    def build(spark, d):
        t = Tables(spark, d)
        left = t.customer.where("c_acctbal > 0").select("c_custkey")
        right = t.orders.where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
        return R.hash_join(left, right, F.col("c_custkey") == F.col("o_custkey"), how)

    return build


for _how in ("left", "right", "full"):
    query(
        f"SELECT c_custkey, o_orderkey, o_custkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) {_how} JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey",
        f"hash_join_{_how}_outer",
    )(_outer(_how))


@query(
    """SELECT count(*) AS n, CAST(sum(a.l_linenumber) AS BIGINT) AS s FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_quantity < b.l_quantity"""
)
def hash_join_multi_key_residual(spark, d):
    t = Tables(spark, d)
    a = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")
    b = t.lineitem.select(F.col("l_orderkey").alias("b_orderkey"), F.col("l_suppkey").alias("b_suppkey"), F.col("l_quantity").alias("b_quantity"))
    return R.aggregate(R.hash_join(a, b, R.keys_equal(a, b, [("l_orderkey", "b_orderkey"), ("l_suppkey", "b_suppkey")], a["l_quantity"] < b["b_quantity"])), [], [F.count("*").alias("n"), F.sum("l_linenumber").alias("s")])


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey")
def nested_loop_join(spark, d):
    t = Tables(spark, d)
    return R.nested_loop_join(t.nation, t.region, F.col("n_regionkey") < F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT n_name, r_name FROM nation, region")
def nested_loop_cross_join(spark, d):
    t = Tables(spark, d)
    return R.nested_loop_join(t.nation, t.region).select("n_name", "r_name")


@query(
    """SELECT r_name, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""
)
def multi_way_join(spark, d):
    t = Tables(spark, d)
    joined = R.star_join(t.lineitem, (t.orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"), (t.region, "n_regionkey", "r_regionkey"))
    return R.aggregate(joined, ["r_name"], [F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")])


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal ASC NULLS FIRST, c_custkey ASC")
def order_by(spark, d):
    return R.order_by(Tables(spark, d).customer.select("c_custkey", "c_acctbal"), F.col("c_acctbal").asc_nulls_first(), F.col("c_custkey").asc())


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem ORDER BY l_suppkey ASC, l_orderkey - l_linenumber DESC, l_orderkey, l_linenumber")
def order_by_expressions(spark, d):
    t = Tables(spark, d).lineitem.select("l_orderkey", "l_linenumber", "l_suppkey")
    return R.order_by(t, F.col("l_suppkey").asc(), (F.col("l_orderkey") - F.col("l_linenumber")).desc(), "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def top_k_offset(spark, d):
    return R.top_k(Tables(spark, d).orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], 25, 10)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def order_by_offset(spark, d):
    return R.skip(Tables(spark, d).customer.select("c_custkey"), [("c_custkey", True)], 100)


@query("SELECT count(*) AS n FROM (SELECT * FROM part OFFSET 5 LIMIT 17)")
def limit_offset(spark, d):
    return R.aggregate(R.limit(Tables(spark, d).part, 17, 5), [], [F.count("*").alias("n")])


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def select_distinct(spark, d):
    return R.distinct(Tables(spark, d).lineitem, "l_returnflag", "l_linestatus")


def _set(kind):
    def build(spark, d):
        t = Tables(spark, d)
        a, b = t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.where("s_acctbal > 3000").select(F.col("s_nationkey").alias("k"))
        return R.set_operation(a, b, kind)

    return build


for _kind in R.SET_OPERATIONS:
    query(f"SELECT c_nationkey AS k FROM customer {_kind.replace('_', ' ')} SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 3000", f"set_{_kind}")(_set(_kind))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return R.grouping_sets(Tables(spark, d).lineitem, ["l_returnflag", "l_linestatus"], [F.count("*").alias("n")])


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(spark, d):
    return R.grouping_sets(Tables(spark, d).orders, ["o_orderstatus", "o_orderpriority"], [F.count("*").alias("n")], "cube")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def window_functions(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return Tables(spark, d).orders.select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("rn"), F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("SELECT l_linenumber, count(DISTINCT l_orderkey) AS exact, true AS near FROM lineitem GROUP BY 1")
def approx_count_distinct(spark, d):
    """Beside the exact counts whether each group's estimate is within four of its standard errors (2 %): estimates themselves are this engine's own."""
    t = Tables(spark, d).lineitem.groupBy("l_linenumber").agg(F.count_distinct("l_orderkey").alias("exact"), F.approx_count_distinct("l_orderkey", 0.02).alias("about"))
    return t.select("l_linenumber", "exact", (F.abs(F.col("about") / F.col("exact") - 1) < 0.08).alias("near"))


@query("SELECT count(*) AS n, CAST(sum(colA) AS BIGINT) AS s, CAST(10 AS BIGINT) AS groups FROM (SELECT unnest(range(20000)) AS colA)")
def generated_table(spark, d):
    from tessella.sources.generators import built_in

    return built_in(spark, "test_1").agg(F.count("*").alias("n"), F.sum("colA").alias("s"), F.count_distinct("colB").alias("groups"))


@query("SELECT 1000 AS n, CAST(0 AS BIGINT) AS odd")
def generated_all_types(spark, d):
    from tessella.sources.generators import built_in

    t = built_in(spark, "all_types").where("a")
    return t.agg(F.count("*").cast("int").alias("n"), F.count_if(~F.col("b").between(-100, 100) | ~F.col("g").between(-7777.77, 7777.77) | ~F.col("c").between(-1000, 1000)).alias("odd"))


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def events_tumbling_window(spark, d):
    from tessella.streaming.events import tumbling

    return tumbling(Tables(spark, d).events).withColumn("total", F.round("total", 2))


@query("SELECT window_start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS window_start FROM events) GROUP BY 1")
def events_sliding_window(spark, d):
    from tessella.streaming.events import sliding

    return sliding(Tables(spark, d).events)


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_sessions(spark, d):
    from tessella.streaming.events import sessions

    return sessions(Tables(spark, d).events)


@query("SELECT p_partkey, p_name || ', \"' || p_type AS label, p_retailprice, CASE WHEN p_size % 5 <> 0 THEN p_size END AS p_size FROM part")
def csv_cells(spark, d):
    """Rows written as CSV cells and parsed again, with delimiters and quotes inside cells, and nulls."""
    from tessella.sources.csv import from_text, to_text

    t = Tables(spark, d).part.select("p_partkey", F.concat("p_name", F.lit(', "'), "p_type").alias("label"), "p_retailprice", F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("p_size"))
    return from_text(t.select(to_text(*t.columns).alias("line")), "line", "p_partkey long, label string, p_retailprice double, p_size int")


@query("SELECT CAST(10 + 3 * i AS BIGINT) AS series, CAST(7 AS INTEGER) AS filled, CAST(NULL AS INTEGER) IS NULL AS nothing FROM unnest(range(1000)) AS t(i)")
def generate_and_fill(spark, d):
    from tessella.sources import generators as G

    return G.generate(spark, 1000, [("series", "long", G.serial(10, 3)), ("filled", "int", G.fixed(7)), ("nothing", "boolean", F.lit(None).cast("int").isNull())])


@query("SELECT nullif(l_linenumber, 2) AS a, nullif(l_linenumber % 3, 1) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2")
def hash_combined(spark, d):
    """Groups by a combined hash are the groups by value: order counts, and a null is a value of its own."""
    t = Tables(spark, d).lineitem.select(F.nullif("l_linenumber", F.lit(2)).alias("a"), F.nullif(F.col("l_linenumber") % 3, F.lit(1)).alias("b"))
    return R.aggregate(t, [P.hashed("a", "b").alias("h")], [F.min("a").alias("a"), F.min("b").alias("b"), F.count("*").alias("n")]).drop("h")


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey) AS keys FROM lineitem")
def hash_distribution(spark, d):
    """Equal keys hash alike, and no two of these keys share a 64-bit hash."""
    t = Tables(spark, d).lineitem
    return R.aggregate(t, [], [F.count("*").alias("n"), F.count_distinct(P.hashed("l_orderkey")).alias("keys")])


@query("SELECT a.l_orderkey, a.l_linenumber, b.o_custkey FROM lineitem a JOIN orders b ON a.l_orderkey = b.o_orderkey WHERE a.l_quantity > 49 AND b.o_totalprice > 200000")
def gather_by_key(spark, d):
    """Values looked up by key among all keys, and only where they meet a predicate on values."""
    t = Tables(spark, d)
    return R.hash_join(t.lineitem.where("l_quantity > 49"), t.orders.where("o_totalprice > 200000"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey")


@query("SELECT e1.event_type, count(*) AS n FROM events e1 GROUP BY e1.event_type HAVING avg(value) > (SELECT avg(value) * 0.5 FROM events)")
def scalar_subquery(spark, d):
    t = Tables(spark, d).events
    mean = t.agg((F.avg("value") * 0.5).alias("m"))
    return R.nested_loop_join(R.aggregate(t, ["event_type"], [F.count("*").alias("n"), F.avg("value").alias("v")]), mean, F.col("v") > F.col("m")).select("event_type", "n")


@query("SELECT p_partkey, p_name, p_retailprice, CASE WHEN p_size > 5 THEN p_size END AS p_size FROM part")
def csv_file_scan(spark, d):
    """A table written as CSV files and scanned again, with nulls."""
    from tessella.sources.csv import read_csv, write_csv
    from tessella.sources.tables import fresh_path

    path = fresh_path(spark, "part.csv")
    write_csv(Tables(spark, d).part.select("p_partkey", "p_name", "p_retailprice", F.when(F.col("p_size") > 5, F.col("p_size")).alias("p_size")), path)
    return read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double, p_size int")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer")
def bulk_loaded(spark, d):
    r"""A table in the form of bulk loaders: cells between ``|``, and ``\N`` for null."""
    from tessella.catalog import SCHEMAS
    from tessella.sources.csv import bulk_load, write_csv
    from tessella.sources.tables import fresh_path

    folder = fresh_path(spark, "bulk")
    write_csv(Tables(spark, d).customer.withColumn("c_acctbal", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), f"{folder}/customer.csv", delimiter="|", null_string="\\N")
    return bulk_load(spark, folder, "customer", SCHEMAS["customer"])


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def appended_table(spark, d):
    """A table that is written in two appends, one by predicate and one of the rest."""
    from tessella.sources import tables as S

    path, t = S.fresh_path(spark, "orders"), Tables(spark, d).orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    large = F.col("o_totalprice") > 200000
    S.append(t.where(large), path)
    S.append(t.where(~large), path)
    return S.read(spark, path, t.schema)


@query("SELECT n_nationkey, n_name FROM nation")
def consumed_rows(spark, d):
    """Rows handed to a consumer one after another."""
    from tessella.sources.tables import consume

    got = []
    consume(Tables(spark, d).nation.select("n_nationkey", "n_name"), got.append)
    return spark.createDataFrame(got, "n_nationkey int, n_name string")
