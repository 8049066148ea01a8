"""Operators by themselves over generated rows: aggregation by group count, selection by selectivity, chains of joins, conjunctions, hashes.

Values are a fixed scramble of the row number, so that another engine can make the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import relational as R
from tessella.plans.registry import query

AGGREGATE_ROWS, FILTER_ROWS, JOIN_ROWS = 10_000_000, 3_000_000, 2_000_000
STEP = 48_271


def scrambled(row: str, below: int, shift: int = 0) -> str:
    """SQL, for either engine, of a number below ``below``."""
    return f"((({row} + {shift}) * {STEP}) % 2147483647) % {below}"


def rows(spark: SparkSession, n: int, **below: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), *[F.expr(scrambled("id", b, shift)).alias(name) for shift, (name, b) in enumerate(below.items())])


def rows_sql(n: int, **below: int) -> str:
    return f"(SELECT i, {', '.join(f'{scrambled("i", b, shift)} AS {name}' for shift, (name, b) in enumerate(below.items()))} FROM range({n}) AS t(i))"


def _aggregate(groups: int):
    return lambda spark, d: R.aggregate(rows(spark, AGGREGATE_ROWS, k=groups), ["k"], [F.count("*").alias("n"), F.sum("i").alias("s")])


for _n in (1, 1 << 10, 1 << 20):
    query(f"SELECT k, count(*) AS n, CAST(sum(i) AS BIGINT) AS s FROM {rows_sql(AGGREGATE_ROWS, k=_n)} GROUP BY k", f"micro_aggregate_{_n}")(_aggregate(_n))


def _select(percent: int):
    return lambda spark, d: R.aggregate(R.scan(rows(spark, FILTER_ROWS, v=100), where=F.col("v") < percent), [], [F.count("*").alias("n"), F.sum("i").alias("s")])


for _n in (0, 50, 100):
    query(f"SELECT count(*) AS n, CAST(sum(i) AS BIGINT) AS s FROM {rows_sql(FILTER_ROWS, v=100)} WHERE v < {_n}", f"micro_selection_{_n}")(_select(_n))


@query(f"SELECT count(*) AS n FROM {rows_sql(FILTER_ROWS, a=1000, b=1000, c=1000)} WHERE a < 500 AND b < 100 AND c < 10")
def micro_conjunction(spark, d):
    return R.aggregate(rows(spark, FILTER_ROWS, a=1000, b=1000, c=1000).where("a < 500 AND b < 100 AND c < 10"), [], [F.count("*").alias("n")])


def _joins(n: int):
    def build(spark, d):
        fact = rows(spark, JOIN_ROWS, **{f"k{j}": 1000 * (j + 1) for j in range(n)})
        dims = [(spark.range(1000 * (j + 1)).where(f"id % {j + 2} <> 0").select(F.col("id").alias(f"d{j}")), f"k{j}", f"d{j}") for j in range(n)]
        return R.aggregate(R.star_join(fact, *dims), [], [F.count("*").alias("n"), F.sum("i").alias("s")])

    return build


for _n in (1, 3, 5):
    _on = " ".join(f"JOIN (SELECT d{j} FROM range({1000 * (j + 1)}) AS t(d{j}) WHERE d{j} % {j + 2} <> 0) ON k{j} = d{j}" for j in range(_n))
    query(f"SELECT count(*) AS n, CAST(sum(i) AS BIGINT) AS s FROM {rows_sql(JOIN_ROWS, **{f'k{j}': 1000 * (j + 1) for j in range(_n)})} {_on}", f"micro_joins_{_n}")(_joins(_n))


@query(f"SELECT count(*) AS n, count(DISTINCT (a, b, c, e)) AS keys FROM {rows_sql(FILTER_ROWS, a=10, b=20, c=30, e=40)}")
def micro_hash_four_keys(spark, d):
    """As many hashes as different keys."""
    return R.aggregate(rows(spark, FILTER_ROWS, a=10, b=20, c=30, e=40), [], [F.count("*").alias("n"), F.count_distinct(F.xxhash64("a", "b", "c", "e")).alias("keys")])


@query(f"SELECT count(*) AS n, CAST(sum(a.k) AS BIGINT) AS s FROM {rows_sql(JOIN_ROWS, k=1 << 21)} a JOIN {rows_sql(JOIN_ROWS, k=1 << 21)} b ON a.i = b.k")
def micro_join_build(spark, d):
    """A join of two sides of the same size, neither of them cut before."""
    a, b = rows(spark, JOIN_ROWS, k=1 << 21), rows(spark, JOIN_ROWS, k=1 << 21).select(F.col("k").alias("b_k"))
    return R.aggregate(R.hash_join(a, b, F.col("i") == F.col("b_k")), [], [F.count("*").alias("n"), F.sum("k").alias("s")])
