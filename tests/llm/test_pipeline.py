"""The corpus pipeline: its stages by brute force, and the queries of the subpackage against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from tessella.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402
from tests.llm.test_llm import SCHEMA, brute_classes, brute_contamination, brute_repeats, hard, words  # noqa: E402, F401

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_queries_cover_all_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


def test_stages_by_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_copies", "substrings", "decontaminated", "mix"]
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = stages["quality"](spark, docs, DATA).cache()
    known = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good, bad = ({k for k, q in known.items() if q == x} for x in (1, 0))
    assert len(good & set(text(kept))) >= 0.98 * len(good) and len(bad & set(text(kept))) <= 0.1 * len(bad)

    one = stages["near_copies"](spark, kept, DATA).cache()
    classes = brute_classes(text(kept))
    assert set(text(one)) == {k for k, c in classes.items() if k == c}

    cut = stages["substrings"](spark, one, DATA).cache()
    want = brute_repeats(list(text(one).items()))
    assert {k: words(t) for k, t in text(cut).items()} == {k: w for k, w in want.items() if w or not words(text(one)[k])}

    clean = stages["decontaminated"](spark, cut, DATA).cache()
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert set(text(clean)) == {k for k, t in text(cut).items() if not brute_contamination(t, items)[1]}

    mixed = stages["mix"](spark, clean, DATA).collect()
    largest = {}  # of all documents of a source: a source of few documents may miss its target by one that isn't taken
    for r in clean.collect():
        largest[r.source] = max(largest.get(r.source, 0), len(words(r.text)))
    for s in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= largest[s]
    assert {r.doc_id: r.text for r in mixed}.items() <= text(clean).items()
    for df in (kept, one, cut, clean):
        assert df.columns == docs.columns


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 50 and out.where("copies < 1").count() == 0


def test_near_copies_keeps_texts_that_share_an_id(spark):
    x, y, z, v, w, u = (" ".join(f"{c}{i * 7 % 101}" for i in range(100)) for c in "xyzvwu")
    near = w + " more"
    rows = [(3, x), (5, x), (5, y), (8, z), (8, z), (2, w), (9, near), (9, v), (7, None), (7, ""), (7, None), (None, y), (None, x + " more"), (None, u), (None, u), (None, u + " more")]
    docs = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in rows], SCHEMA)
    got = corpus_pipeline.near_copies(spark, docs, DATA).collect()
    one = next(r.text for r in got if r.doc_id is None)  # of copies without ids one stays
    assert one in (u, u + " more")
    assert sorted(((r.doc_id, r.text) for r in got), key=repr) == sorted([(3, x), (5, y), (8, z), (2, w), (9, v), (7, None), (7, ""), (None, one)], key=repr)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_hard_input(spark, hard, k):  # noqa: F811
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, hard, DATA)
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    assert out.columns[:5] == columns
    n = out.count()
    assert 0 < n <= hard.count()
    assert name == "mix" or out.where("doc_id IS NULL").count() == 2  # rows without an id stay
    assert stage(spark, hard.limit(0), DATA).count() == 0
