"""Synthetic tables: serial, fixed and uniform columns, seeded, so that reruns and all machines agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def serial(start: int = 0, step: int = 1) -> Column:
    return F.col("id") * step + start


def fixed(value) -> Column:
    return F.lit(value)


def uniform(low, high, seed: int) -> Column:
    """Whole numbers from low to high, both included, or reals between them if either is a float. A draw depends on row and seed alone."""
    h = F.xxhash64(F.lit(seed), F.col("id"))
    if isinstance(low, float) or isinstance(high, float):
        return F.lit(low) + F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53) * (high - low)
    return F.pmod(h, F.lit(high - low + 1)) + low


def generate(spark: SparkSession, rows: int, columns: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(name, type, values) for each column."""
    return spark.range(rows).select(*[c.cast(kind).alias(name) for name, kind, c in columns])


#: Built-in tables: rows, and (column, type, distribution).
BUILT_IN = {
    "empty_table": (0, [("colA", "int", ("serial",))]),
    "test_1": (20_000, [("colA", "int", ("serial",)), ("colB", "int", ("uniform", 0, 9)), ("colC", "int", ("uniform", 0, 9999)), ("colD", "int", ("uniform", 0, 99_999))]),
    "test_2": (20_000, [("col1", "int", ("uniform", 0, 100)), ("col2", "int", ("serial",))]),
    "all_types": (
        2_000,
        [
            ("a", "boolean", ("half",)),
            ("b", "tinyint", ("uniform", -100, 100)),
            ("c", "smallint", ("uniform", -1000, 1000)),
            ("d", "int", ("uniform", -10_000, 10_000)),
            ("e", "bigint", ("uniform", -1_000_000, 1_000_000)),
            ("f", "float", ("uniform", -4444.44, 4444.44)),
            ("g", "double", ("uniform", -7777.77, 7777.77)),
        ],
    ),
    "small_1": (200, [("col1", "int", ("uniform", 0, 100)), ("col2", "int", ("serial",))]),
}


def built_in(spark: SparkSession, name: str, seed: int = 42) -> DataFrame:
    rows, columns = BUILT_IN[name]
    make = {"serial": lambda i, *a: serial(*a), "uniform": lambda i, a, b: uniform(a, b, seed + i), "half": lambda i: F.col("id") >= rows // 2}
    return generate(spark, rows, [(c, kind, make[d[0]](i, *d[1:])) for i, (c, kind, d) in enumerate(columns)])
