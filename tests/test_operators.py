"""Operators on small tables: nulls, repeated keys, empty inputs, and the plans that Spark makes."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessella.catalog import register, table
from tessella.operators import relational as R
from tessella.sources import csv, generators, tables
from tessella.streaming import events as E

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "k int, x string")
    right = spark.createDataFrame([(1, "p"), (1, "q"), (3, "r"), (None, "m")], "j int, y string")
    return left, right


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_joins(sides):
    left, right = sides
    on = left.k == right.j
    assert len(got(R.hash_join(left, right, on))) == 4
    assert got(R.hash_join(left, right, on, "left_semi")) == [(1, "a"), (1, "b")]
    assert got(R.hash_join(left, right, on, "right_semi")) == [(1, "p"), (1, "q")]
    assert got(R.hash_join(left, right, on, "left_anti")) == [(2, "c"), (None, "n")]
    assert got(R.hash_join(left, right, on, "right_anti")) == [(3, "r"), (None, "m")]
    assert len(got(R.hash_join(left, right, on, "left"))) == 6
    assert len(got(R.hash_join(left, right, on, "right"))) == 6
    assert len(got(R.hash_join(left, right, on, "full"))) == 8
    assert got(R.hash_join(left, right, on & (right.y != "p"))) == [(1, "a", 1, "q"), (1, "b", 1, "q")]
    with pytest.raises(ValueError):
        R.hash_join(left, right, on, "outer_space")


def test_nested_loop(sides):
    left, right = sides
    assert R.nested_loop_join(left, right).count() == 16
    assert got(R.nested_loop_join(left, right, left.k < right.j)) == [(1, "a", 3, "r"), (1, "b", 3, "r"), (2, "c", 3, "r")]


def test_aggregates(sides):
    left, _ = sides
    assert got(R.aggregate(left, ["k"], [F.count("*").alias("n")])) == [(1, 2), (2, 1), (None, 1)]
    none = left.where("false")
    assert got(R.aggregate(none, [], [F.count("*"), F.sum("k"), F.min("x"), F.max("k"), F.avg("k")])) == [(0, None, None, None, None)]
    assert got(R.aggregate(none, ["k"], [F.count("*")])) == []
    assert got(R.aggregate(left, [], [F.count("*").alias("n")], F.col("n") > 9)) == []


def test_max_of_negative_reals(spark):
    df = spark.createDataFrame([(-2.5,), (-1.5,)], "v double")
    assert got(R.aggregate(df, [], [F.max("v"), F.min("v")])) == [(-1.5, -2.5)]


def test_limits(spark):
    df = spark.range(10).repartition(3)
    assert [r.id for r in R.top_k(df, [F.desc("id")], 3, 2).collect()] == [7, 6, 5]
    assert R.limit(df, 4, 8).count() == 2
    assert R.limit(df, offset=7).count() == 3
    assert R.limit(df, 0).count() == 0
    assert "TakeOrderedAndProject" in plan(R.top_k(df, ["id"], 3, 2))


def test_sort_places_nulls(sides):
    left, _ = sides
    assert [r.k for r in R.order_by(left, F.col("k").asc(), F.col("x").asc()).collect()] == [None, 1, 1, 2]
    assert [r.k for r in R.order_by(left, F.col("k").desc(), F.col("x").asc()).collect()] == [2, 1, 1, None]


def test_set_operations(spark):
    a, b = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ([1, 1, 2, None, None], [1, 3, None]))
    want = {"union": [1, 2, 3, None], "union_all": [1, 1, 1, 2, 3, None, None, None], "intersect": [1, None], "intersect_all": [1, None], "except": [2], "except_all": [1, 2, None]}
    for kind, rows in want.items():
        assert sorted((r.k for r in R.set_operation(a, b, kind).collect()), key=repr) == sorted(rows, key=repr), kind


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_pushes_down(spark):
    q = R.scan(table(spark, DATA, "lineitem"), ["l_orderkey"], F.col("l_quantity") < 5)
    assert "LessThan(l_quantity,5.0)" in plan(q) and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan(q)


def test_register(spark):
    register(spark, DATA, "region")
    assert spark.sql("SELECT count(*) FROM region").first()[0] == 5


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('1,2,3,4,5.0,"six"\n7,8,9,10,11.12,"thir,""teen"')
    df = csv.read_csv(spark, str(tmp_path / "t.csv"), "a tinyint, b smallint, c int, d bigint, e float, f string")
    assert [r.f for r in df.orderBy("a").collect()] == ["six", 'thir,"teen']
    (tmp_path / "u.csv").write_text("1|\\N|x\n2|5|\\N\n")
    assert got(csv.bulk_load(spark, str(tmp_path), "u", "a int, b int, c string")) == [(1, None, "x"), (2, 5, None)]
    (tmp_path / "bad.csv").write_text("x,2\n")
    with pytest.raises(Exception):
        csv.read_csv(spark, str(tmp_path / "bad.csv"), "a int, b int").collect()
    csv.write_csv(df, str(tmp_path / "out"))
    assert csv.read_csv(spark, str(tmp_path / "out"), df.schema).count() == 2


def test_generators(spark):
    t = generators.built_in(spark, "test_1")
    assert t.count() == 20_000 and t.where("colA < 500").count() == 500 and t.select("colB").distinct().count() == 10
    assert generators.built_in(spark, "small_1").agg(F.sum("col2")).first()[0] == 19_900
    assert generators.built_in(spark, "all_types").where("a").count() == 1000
    assert generators.built_in(spark, "empty_table").count() == 0
    assert got(generators.built_in(spark, "test_2").limit(0)) == []
    assert t.exceptAll(generators.built_in(spark, "test_1").repartition(7)).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, True, None)], "a int, b boolean, c string")
    assert list(tables.printed(df)) == ["1,true,NULL"]
    seen: list[Row] = []
    assert tables.consume(df, seen.append) == 1 and seen[0].a == 1
    tables.write(df, str(tmp_path / "p"))
    tables.append(df, str(tmp_path / "p"))
    assert tables.read(spark, str(tmp_path / "p"), df.schema, F.col("a") == 1, ["b"]).count() == 2


def test_stream_matches_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batch = table(spark, DATA, "events")
    batch.repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    stream = E.read_events(spark, str(tmp_path / "in"), 1)
    E.start(E.tumbling(stream), "windows", str(tmp_path / "cp"), "complete").awaitTermination()
    a = spark.table("windows").select("window_start", "event_type", "n")
    b = E.tumbling(batch).select("window_start", "event_type", "n")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_sessions(spark):
    rows = [(1, "2020-01-01 00:00:00"), (1, "2020-01-01 00:29:00"), (1, "2020-01-01 01:00:00"), (2, "2020-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "user_id int, t string").select("user_id", F.col("t").cast("timestamp_ntz").alias("ts"))
    assert sorted((r.user_id, r.n) for r in E.sessions(df).collect()) == [(1, 1), (1, 2), (2, 1)]


@pytest.mark.parametrize("up", [True, False])
@pytest.mark.parametrize("offset", [0, 1, 3, 4, 7, 9, 10, 30])
def test_skip_counts_off_the_first_rows(spark, up, offset):
    rows = [(1, "a"), (2, "b"), (2, "c"), (2, "c"), (None, "n"), (None, "m"), (5, "z"), (7, None), (7, "y"), (9, "x")]
    df = spark.createDataFrame(rows, "k int, v string").repartition(3)
    got = [r.k for r in R.skip(df, [("k", up)], offset).collect()]
    order = sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0), reverse=not up)
    assert got == order[offset:]
    both = R.skip(df, [("k", up), ("v", True)], offset).collect()
    assert len(both) == max(0, len(rows) - offset) and [r.k for r in both] == order[offset:]


def test_all_pairs_need_a_small_side(spark, monkeypatch):
    monkeypatch.setattr(R, "SIDE", 3)
    assert R.nested_loop_join(spark.range(5), spark.range(3)).count() == 15
    with pytest.raises(ValueError):
        R.nested_loop_join(spark.range(5), spark.range(4))


def test_sessions_of_a_stream_close(spark, tmp_path):
    from tessella.streaming import events as E

    def add(rows):
        start = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"
        df = spark.createDataFrame(rows, "event_id long, m int, user_id long").selectExpr("event_id", f"{start} + make_dt_interval(0, 0, m) AS ts", "user_id", "'x' AS event_type", "1.0D AS value", "'' AS props")
        df.write.mode("append").parquet(str(tmp_path / "events"))
        E.start(E.sessions(E.read_events(spark, str(tmp_path / "events")), late="10 minutes"), "closed", str(tmp_path / "state"), sink="noop").awaitTermination()

    add([(1, 0, 1), (2, 5, 1), (3, 100, 1), (4, 0, 2)])
    add([(5, 500, 3)])  # without a watermark the append mode isn't allowed at all
    with pytest.raises(Exception, match="(?i)watermark"):
        E.start(E.sessions(E.read_events(spark, str(tmp_path / "events"))), "open", str(tmp_path / "other"), sink="noop").awaitTermination()


def test_benchmark_files_load(spark, tmp_path):
    from tessella.catalog import STAR, TPCH
    from tessella.sources.csv import load_all

    for kind, schemas in (("tpch", TPCH), ("star", STAR)):
        folder = tmp_path / kind
        folder.mkdir()
        for name, schema in schemas.items():
            types = [c.split()[1] for c in schema.split(", ")]
            value = {"int": "7", "float": "2.5", "date": "1998-09-02", "string": "text"}
            (folder / f"{name}.csv").write_text("|".join(value[t] for t in types) + "\n" + "|".join("\\N" for _ in types))
        for name, df in load_all(spark, str(folder), schemas).items():
            one, none = sorted(df.collect(), key=lambda r: r[0] is None)
            assert len(one) == len(schemas[name].split(", ")) and all(v is not None for v in one) and all(v is None for v in none)
