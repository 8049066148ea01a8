"""The benchmark queries on small tables of the full schemas, loaded from files, against DuckDB."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from tessella.catalog import STAR, TPCH
from tessella.plans import benchmarks as B

#: Values of columns; other columns get keys, numbers, days or texts by their types.
VALUES = {
    "c_mktsegment": ["BUILDING", "MACHINERY"],
    "p_name": ["green lace", "red lace"],
    "p_brand": ["Brand#12", "Brand#23", "Brand#34", "Brand#45"],
    "p_container": ["SM CASE", "MED BAG", "LG BOX"],
    "p_type": ["PROMO TIN", "MEDIUM POLISHED TIN", "SMALL TIN"],
    "p_size": [3, 9, 14, 2],
    "s_comment": ["fine", "the Customer has Complaints"],
    "o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM"],
    "l_returnflag": ["R", "N", "A"],
    "l_shipmode": ["MAIL", "SHIP", "AIR", "AIR REG"],
    "l_shipinstruct": ["DELIVER IN PERSON", "NONE"],
    "l_discount": [0.0, 0.04, 0.05, 0.06, 0.07, 0.08],
    "p_mfgr": ["MFGR#1", "MFGR#2", "MFGR#3"],
    "p_category": ["MFGR#12", "MFGR#14"],
    "p_brand1": ["MFGR#2221", "MFGR#2225", "MFGR#2239"],
    **{f"{x}_{k}": v for x in "cs" for k, v in {"city": ["UNITED KI1", "UNITED KI5", "UNITED ST0"], "nation": ["UNITED STATES", "CHINA"], "region": ["AMERICA", "ASIA", "EUROPE"]}.items()},
    "lo_discount": list(range(9)),
    "lo_quantity": list(range(1, 51)),
}
ROWS = {"customer": 60, "part": 60, "supplier": 30, "orders": 400, "lineitem": 5000, "nation": 4, "region": 2, "lineorder": 9000}
KEYS = {"custkey": "customer", "partkey": "part", "suppkey": "supplier", "nationkey": "nation", "regionkey": "region", "orderkey": "orders"}


def made(schemas):
    rng = np.random.default_rng(7)
    days = pd.date_range("1992-01-01", "1998-12-31")
    tables = {}
    for name, schema in schemas.items():
        n, columns = ROWS.get(name, 0), {}
        for i, column in enumerate(schema.split(", ")):
            c, kind = column.split()
            of = KEYS.get(c.split("_", 1)[1])
            if c in VALUES:
                columns[c] = rng.choice(VALUES[c], n)
            elif of and of in schemas and not (i == 0 and of == name):
                columns[c] = rng.integers(1, ROWS[of] + 1, n)
            elif i == 0:
                columns[c] = np.arange(1, n + 1)
            elif kind == "date":
                columns[c] = rng.choice(pd.date_range("1993-07-01", "1996-12-31").strftime("%Y-%m-%d"), n)
            elif kind == "string":
                columns[c] = [f"{c} {k}" for k in range(n)]
            else:
                columns[c] = rng.integers(1, 51, n) if kind == "int" else rng.integers(1, 201, n) / 4
        tables[name] = pd.DataFrame(columns)
    if "nation" in tables:
        tables["nation"]["n_name"] = ["FRANCE", "GERMANY", "CHINA", "PERU"]
        tables["nation"]["n_regionkey"] = [1, 1, 2, 2]
        tables["region"]["r_name"] = ["EUROPE", "ASIA"]
        pairs = [(p, s) for p in range(1, 61) for s in range(1, 31)]
        tables["partsupp"] = pd.DataFrame({"ps_partkey": [p for p, _ in pairs], "ps_suppkey": [s for _, s in pairs], "ps_availqty": rng.integers(1, 99, 1800), "ps_supplycost": rng.integers(1, 999, 1800) / 100, "ps_comment": "x"})
    else:
        d = pd.DataFrame({c.split()[0]: ["x" if c.endswith("string") else 0] * len(days) for c in schemas["date"].split(", ")})
        d["d_datekey"], d["d_year"], d["d_yearmonthnum"] = days.strftime("%Y%m%d").astype(int), days.year, days.strftime("%Y%m").astype(int)
        d["d_yearmonth"], d["d_weeknuminyear"] = days.strftime("%b%Y"), (days.dayofyear - 1) // 7 + 1
        tables["date"] = d
        some = d.d_datekey[d.d_yearmonthnum.isin([199401, 199402, 199712])]
        tables["lineorder"]["lo_orderdate"] = np.where(rng.random(9000) < 0.5, rng.choice(some, 9000), rng.choice(d.d_datekey, 9000))
    return {name: tables[name] for name in schemas}


@pytest.fixture(scope="module", params=["tpch", "star"])
def corpus(request, spark, tmp_path_factory):
    schemas, queries, run = (TPCH, B.TPCH_SQL, B.tpch) if request.param == "tpch" else (STAR, B.STAR_SQL, B.star)
    folder = tmp_path_factory.mktemp(request.param)
    db = duckdb.connect()
    for name, frame in made(schemas).items():
        frame.to_csv(folder / f"{name}.csv", sep="|", header=False, index=False)
        types = {c.split()[0]: {"int": "INTEGER", "float": "DOUBLE", "date": "DATE", "string": "VARCHAR"}[c.split()[1]] for c in schemas[name].split(", ")}
        db.execute(f"""CREATE TABLE "{name}" AS SELECT * FROM read_csv('{folder}/{name}.csv', delim='|', header=false, columns={types})""")
    return B.load(spark, str(folder), schemas), schemas, queries, run, db


def test_queries_on_the_full_schemas(corpus):
    tables, schemas, queries, run, db = corpus
    for name, text in queries.items():
        got = [tuple(r) for r in run(name, tables).collect()]
        want = db.execute(text.format(fraction=0.00001, **{t: f'"{t}"' for t in schemas})).fetchall()
        assert want and len(got) == len(want) and got[0][0] is not None, name
        for a, b in zip(sorted(got, key=str), sorted(want, key=str), strict=True):
            assert [pytest.approx(float(x), rel=1e-9) if isinstance(x, float) else x for x in b] == [float(x) if isinstance(y, float) else x for x, y in zip(a, b, strict=True)], name


def test_queries_of_empty_tables(spark):
    empty = {kind: {name: spark.createDataFrame([], schema) for name, schema in schemas.items()} for kind, schemas in (("tpch", TPCH), ("star", STAR))}
    assert B.tpch("q1", empty["tpch"]).count() == 0 and B.star("q2_1", empty["star"]).count() == 0
    assert B.tpch("q6", empty["tpch"]).first()[0] is None and B.star("q1_1", empty["star"]).first()[0] is None
