"""Scan, projection, filter, joins, aggregation, sort, limit and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Columns = Sequence[Column | str]

JOINS = ("inner", "left_semi", "right_semi", "left_anti", "right_anti", "left", "right", "full")
#: Rows that one side of a join without any condition may have.
SIDE = 100_000
SET_OPERATIONS = ("union", "union_all", "intersect", "intersect_all", "except", "except_all")


def scan(df: DataFrame, columns: Columns | None = None, where: Column | None = None) -> DataFrame:
    """Rows that meet a predicate, and some columns of them; both reach a Parquet scan."""
    out = df if where is None else df.where(where)
    return out if columns is None else out.select(*columns)


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    return df.select(*columns)


def constants(spark: SparkSession, **values: Any) -> DataFrame:
    """One row of constant expressions: a projection without an input."""
    return spark.range(1).select(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()])


def keys_equal(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], residual: Column | None = None) -> Column:
    terms = [left[a] == right[b] for a, b in keys] + ([residual] if residual is not None else [])
    return reduce(lambda a, b: a & b, terms)


def hash_join(left: DataFrame, right: DataFrame, on: Column | str | Sequence[str], how: str = "inner") -> DataFrame:
    """An equi-join, with any further condition in ``on``. Null keys match nothing, so an anti join returns them.

    The right_ forms return rows of the right side. Whether a side is broadcast is left to the planner, which
    knows the sizes.
    """
    if how not in JOINS:
        raise ValueError(f"join type {how}; known are {', '.join(JOINS)}")
    if how in ("right_semi", "right_anti"):
        return right.join(left, on, how.replace("right", "left"))
    return left.join(right, on, how)


def nested_loop_join(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """All pairs that meet any condition; all pairs without one, for which the right side may have SIDE rows at most."""
    if condition is not None:
        return left.join(right, condition)
    if right.limit(SIDE + 1).count() > SIDE:
        raise ValueError(f"the right side of all pairs has over {SIDE} rows")
    return left.crossJoin(right)


def aggregate(df: DataFrame, keys: Columns, aggregates: Sequence[Column], having: Column | None = None) -> DataFrame:
    """A row for each group (nulls are one group), or for the whole input without keys, even an empty one."""
    out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
    return out if having is None else out.where(having)


def grouping_sets(df: DataFrame, keys: Columns, aggregates: Sequence[Column], kind: str = "rollup") -> DataFrame:
    return getattr(df, kind)(*keys).agg(*aggregates)


def order_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """n rows after the first offset ones; all of these without n."""
    out = df.offset(offset) if offset else df
    return out if n is None else out.limit(n)


def top_k(df: DataFrame, keys: Columns, n: int, offset: int = 0) -> DataFrame:
    """The n first rows after offset in an order. Give keys that leave no ties for a result that is always the same."""
    return limit(df.orderBy(*keys), n, offset)


def skip(df: DataFrame, keys: Sequence[tuple[str, bool]], offset: int) -> DataFrame:
    """All rows after the first ``offset`` in the order of keys (column, ascending; nulls first ascending, last descending), in that order.

    Only the first rows are gathered, as a top-k: the others are those that come after the last of them, and the
    rest of its ties. So no task sees all rows, as it would if they were counted off.
    """
    order = [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys]
    back = [F.col(c).desc_nulls_last() if up else F.col(c).asc_nulls_first() for c, up in keys]
    if offset <= 0:
        return df.orderBy(*order)
    first = df.orderBy(*order).limit(offset)
    n = first.count()
    if n < offset:
        return df.limit(0)
    edge = first.select(*[c for c, _ in keys]).orderBy(*back).first()
    after, tied = F.lit(False), F.lit(True)
    for c, up in keys:
        v = edge[c]
        beyond = (F.col(c).isNotNull() if v is None else F.col(c) > v) if up else (F.lit(False) if v is None else F.col(c).isNull() | (F.col(c) < v))
        after = after | (tied & F.coalesce(beyond, F.lit(False)))
        tied = tied & F.col(c).eqNullSafe(F.lit(v))
    return df.where(after).unionAll(df.where(tied).exceptAll(first.where(tied))).orderBy(*order)


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def set_operation(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """By position, as SQL has it; without ``_all`` the result has no repeats."""
    if kind not in SET_OPERATIONS:
        raise ValueError(f"set operation {kind}; known are {', '.join(SET_OPERATIONS)}")
    if kind in ("union", "union_all"):
        out = left.unionAll(right)
        return out if kind == "union_all" else out.distinct()
    return {"intersect": left.intersect, "intersect_all": left.intersectAll, "except": left.subtract, "except_all": left.exceptAll}[kind](right)


def star_join(fact: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """A fact table joined with (dimension, fact key, dimension key) after another; their order is the planner's."""
    return reduce(lambda f, d: f.join(d[0], f[d[1]] == d[0][d[2]]), dimensions, fact)
