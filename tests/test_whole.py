"""Queries over whole tables: no row is left out before the operator."""

import numpy as np
import pytest

import tessella.plans.basics  # noqa: F401
from tessella.plans import micro
from tessella.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name, table, key",
    [
        ("order_by", "customer", lambda r: (r.c_acctbal is not None, r.c_acctbal, r.c_custkey)),
        ("order_by_expressions", "lineitem", lambda r: (r.l_suppkey, r.l_linenumber - r.l_orderkey, r.l_orderkey, r.l_linenumber)),
    ],
)
def test_whole_table_is_sorted(spark, name, table, key):
    got = QUERIES[name](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/{table}.parquet").count()
    assert [key(r) for r in got] == sorted(key(r) for r in got)


def test_outer_joins_use_all_ids(spark):
    left, right, full = ({tuple(r) for r in QUERIES[f"hash_join_{how}_outer"](spark, DATA).collect()} for how in ("left", "right", "full"))
    assert {c % 3 for c, o, _ in left if o is not None} == {0, 1, 2}
    assert any(o is None for _, o, _ in left) and any(c is None for c, _, _ in right) and full == left | right


def test_gather_uses_all_ids(spark):
    assert {r.o_custkey % 2 for r in QUERIES["gather_by_key"](spark, DATA).collect()} == {0, 1}


def test_join_build_uses_all_rows(spark):
    i = np.arange(micro.JOIN_ROWS, dtype=np.int64)
    k = i * micro.STEP % 2147483647 % (1 << 21)
    met = k[k < micro.JOIN_ROWS]
    assert [tuple(r) for r in QUERIES["micro_join_build"](spark, DATA).collect()] == [(len(met), int(k[met].sum()))]
