"""What the small tables don't reach: hostile and very long texts, hot keys, many languages and sources, workers without the package; and the queries by name."""

import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.llm import contamination, langid, mixing, nearcopies, ngrams, quality, repeats, shared, textkit, tokens, urls
from tessella.llm.queries import QUERIES
from tests.llm.test_llm import SCHEMA, brute_bits, brute_classes, brute_contamination, brute_rules, by_id, hard, spread, words  # noqa: F401

DATA = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def thue_morse(n, a, b):
    return [b if bin(i).count("1") % 2 else a for i in range(n)]


# textkit


def test_patterns_do_not_cancel_out():
    """Two sequences that any polynomial modulo 2 ** 64 gives one hash, of letters in a word and of words in a text."""
    x, y = ("".join(thue_morse(4096, *ab)) for ab in ("ab", "ba"))
    w = textkit.Texts(pa.array([x, y])).words()
    assert w.hashes()[0] != w.hashes()[1] and w.hashes(1)[0] != w.hashes(1)[1]
    v = textkit.Texts(pa.array([" ".join(x), " ".join(y)])).words()
    h = v.hashes()
    assert textkit.windows(h[:4096], 4096)[0] != textkit.windows(h[4096:], 4096)[0]
    a, b = v.contents()
    assert a[0] != a[1] and b[0] != b[1]


def test_contents_are_word_sequences():
    a, b = textkit.Texts(pa.array(["x y", " x\n\ty ", "xy", "x  y z", None, "", "y x"])).words().contents()
    assert a[0] == a[1] and a[4] == a[5] and len(set(zip(a.tolist(), b.tolist()))) == 5


@pytest.mark.parametrize("piece", [3, 17, 1 << 20])
def test_pieces_make_no_difference(piece, monkeypatch):
    rng = random.Random(2)
    data = ["".join(rng.choice("aé 日\n\tXy9") for _ in range(rng.randint(0, 400))) for _ in range(20)] + ["z" * 700 + " " + "z" * 701]
    column = pa.array(data)
    whole = textkit.Texts(column).words()
    ratio = ngrams.Ratio(np.random.default_rng(0).normal(size=ngrams.BUCKETS))
    want = whole.start.tolist(), whole.hashes().tolist(), ratio.totals(column), langid.folded(textkit.Texts(column))
    grams = langid.fours(*want[3], 0, len(want[3][0])).tolist()
    monkeypatch.setattr(textkit, "PIECE", piece)
    monkeypatch.setattr(textkit, "SPANS", piece)
    monkeypatch.setattr(ngrams, "AT_ONCE", piece)
    now = textkit.Texts(column).words()
    assert now.start.tolist() == want[0] and now.hashes().tolist() == want[1]
    n, total = ratio.totals(column)
    assert n.tolist() == want[2][0].tolist() and np.allclose(total, want[2][1])
    codes, at = want[3]
    assert [x for i in range(0, len(codes), piece) for x in langid.fours(codes, at, i, min(i + piece, len(codes))).tolist()] == grams
    assert textkit.Texts(column).count(langid._WIDE).tolist() == [sum(b >= 0x80 for b in t.encode()) for t in data]


def test_signatures_by_pieces(monkeypatch):
    _, _, text, shingle, weight = nearcopies.bags(pa.array(["a b c d e f g h " * 30, "k l m n o " * 9, "q"]))
    want = nearcopies.signatures(3, text, shingle, weight)
    monkeypatch.setattr(nearcopies, "UNITS", 4)
    assert (nearcopies.signatures(3, text, shingle, weight) == want).all()


# 1 and 2


def test_draw_follows_weights(spark):
    """Over many seeds: more weight, more often drawn, and no plain threshold; as often as a draw without replacement has it."""
    log = [0.0, 0.5, 1.0, 1.5, 2.0, 3.0]
    n, k, hits = 400, 3, Counter()
    base = spark.createDataFrame(list(enumerate(log)), "doc_id long, w double")
    draws = base.crossJoin(spark.range(n).withColumnRenamed("id", "seed")).withColumn("key", F.col("w") + quality.gumbel(5, F.col("doc_id"), F.col("seed"))).collect()
    for seed in range(n):
        mine = sorted((r for r in draws if r.seed == seed), key=lambda r: -r.key)
        hits.update(r.doc_id for r in mine[:k])
    rng = np.random.default_rng(1)
    p = np.exp(log) / np.exp(log).sum()
    want = np.bincount(np.concatenate([rng.choice(6, k, False, p) for _ in range(20_000)]), minlength=6) / 20_000
    got = np.array([hits[i] / n for i in range(6)])
    assert np.abs(got - want).max() < 0.09 and got[0] > 0.05 and got[5] < 1


def test_quality_query_is_a_draw_by_weight(spark):
    """op1_quality end to end by brute force: weights, keys, and the share that is kept; another seed keeps others."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = by_id(QUERIES["op1_quality"](spark, DATA), "n_grams", "log_weight", "aversion", "key", "kept")
    rows = docs.select("doc_id", "text").collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    parts = {r.doc_id: next(iter(ngrams.features(pa.array([r.text], pa.string()))), (np.zeros(0, int), None))[0] for r in rows}
    raw, target = (np.bincount(np.concatenate([b for k, b in parts.items() if k in some]), minlength=ngrams.BUCKETS) for some in (parts.keys(), good))
    log = np.log((target + ngrams.PRIOR) / (raw * target.sum() / raw.sum() + ngrams.PRIOR))
    for k, b in parts.items():
        assert got[k][0] == len(b) and got[k][1] == pytest.approx(log[b].sum() * min(1, quality.PASSAGE / max(1, len(b))), abs=1e-6)
    keys = sorted((v[3] for v in got.values()), reverse=True)
    least = keys[round(quality.SHARE * len(keys)) - 1]
    assert {k for k, v in got.items() if v[4]} == {k for k, v in got.items() if v[3] >= least}
    weighed = shared.written(quality.weigh(docs.select("doc_id", "text"), ngrams.fit(docs, labels), 2), "again")
    other = {r.doc_id for r in quality.draw(weighed, share=quality.SHARE).where("weight.kept").collect()}
    mine = {k for k, v in got.items() if v[4]}
    by_weight = {k for k in sorted(got, key=lambda k: -got[k][1])[: len(mine)]}
    assert mine != other and mine != by_weight


def test_rules_query_by_brute_force(spark):
    got = by_id(QUERIES["op2_rules"](spark, DATA), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "mean_ratio", "aversion")
    weights = by_id(QUERIES["op1_quality"](spark, DATA), "n_grams", "log_weight")
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        *base, failed, kept, mean, aversion = got[r.doc_id]
        assert tuple(base) == brute_rules(r.text)
        assert failed == (base[0] < 20 or 100 * base[4] > 30 * base[0])
        assert kept == (not failed and mean >= quality.THRESHOLD and aversion < quality.AVERSION)
        n, weight = weights[r.doc_id]
        assert mean == pytest.approx(weight / max(1, min(n, quality.PASSAGE)), abs=1e-6)


# 3


def test_mixing_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    size = {r[0]: r[1:] for r in con.execute(r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, sum(n) OVER (PARTITION BY source) FROM documents").fetchall()}
    got = by_id(QUERIES["op3_mixing"](spark, DATA), "size", "source_size", "target", "taken", "source")
    assert {k: v[:2] for k, v in got.items()} == size
    names = sorted({v[4] for v in got.values()})
    per = {v[4]: v[1] for v in got.values()}
    want = dict(zip(names, mixing.targets([per[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])))
    assert all(v[2] == pytest.approx(want[v[4]]) and v[3] <= 2 * v[0] for v in got.values())


def test_targets_of_many_sources(spark):
    rng = random.Random(4)
    sizes = {f"s{i}": rng.choice([0, 1, rng.randint(1, 10**6)]) for i in range(3000)} | {None: 77}
    per = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, n long").repartition(7)
    got = {r.source: r.target for r in mixing.with_targets(per, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.targets([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    assert [got[s] for s in names] == pytest.approx(want)
    everything = mixing.with_targets(per.limit(1), (1.0,), 9.0, 2.0).first()
    assert everything.target == 2 * everything.source_size


def test_equal_rows_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 100)
    same = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("a").alias("source"), F.col("id").cast("string").alias("size"))
    rest = spark.range(300).select("id", F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")), F.lit("a"), F.lit(None).cast("string"))
    docs = same.unionAll(rest).repartition(6)
    units = mixing.mix_units(docs)
    assert units.count() <= 301
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == 5300
    mine = [r.copies for r in rows if r.doc_id is None]
    assert len(mine) == 5000 and max(mine) - min(mine) <= 1 and abs(sum(r.taken for r in rows) - rows[0].target) <= 49
    taken = mixing.mixed(docs)
    assert taken.columns == ["doc_id", "text", "source", "size", "source_size", "target", "copies", "taken"]
    assert taken.count() == sum(r.copies > 0 for r in rows) and taken.agg(F.sum("taken")).first()[0] == sum(r.taken for r in rows)


# 4


def test_join_rules_out_what_the_filter_lets_through(spark, monkeypatch):
    """A filter of one block is full: it lets everything through, and the join still finds the list's pages alone."""
    monkeypatch.setattr(urls, "FILTER_BYTES", 64)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("https://www.site"), F.col("id") % 40, F.lit(".net/x/"), "id", F.lit("?q=1")).alias("url"))
    listed = spark.range(0, 4000, 3).select(F.concat(F.lit("http://site"), F.col("id") % 40, F.lit(".net/x/"), "id", F.lit("/")).alias("url"))
    out = urls.filter_urls(pages, listed)
    assert {r.page_id for r in out.where("listed").collect()} == set(range(0, 400, 3))
    assert out.where("(verdict = 'block') <> listed").count() == 0


# 5


def test_unlike_texts_with_one_pattern_stay_apart(spark):
    x, y = (" ".join(f"f{i}" if i % 5 else m for i, m in enumerate(thue_morse(20_480, *ab))) for ab in ("AB", "BA"))
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert by_id(nearcopies.near_duplicates(docs), "class_id", "kept") == {1: (1, True), 2: (2, True)}


def test_near_copies_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = by_id(QUERIES["op5_nearcopies"](spark, DATA), "class_id", "kept")
    want = brute_classes(docs)
    assert {k: v[0] for k, v in got.items() if words(docs[k])} == {k: c for k, c in want.items() if words(docs[k])} and all(v[1] == (v[0] == k) for k, v in got.items())


# 6


def test_equal_rows_of_long_texts_keep_the_first(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 1)
    monkeypatch.setattr(textkit, "GROUP_BYTES", 1)
    text = " ".join(f"w{i}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text + " more")], "doc_id long, text string").repartition(3)
    out = sorted((r.doc_id, r.repeats.n_removed) for r in repeats.remove_repeats(docs).collect())
    assert out == [(1, 0), (1, 0), (2, 3000)]


def test_workers_get_the_package(tmp_path):
    """From another folder, without PYTHONPATH: Python stages of every kind find the package."""
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path / "shared")!r}).getOrCreate()
from tessella.llm import repeats, langid, nearcopies
docs = spark.createDataFrame([(i, "w " * 30, "en") for i in range(3)], "doc_id long, text string, lang string")
print("removed", sorted(r.repeats.n_removed for r in repeats.remove_repeats(docs).collect()))
print("classes", sorted(r.class_id for r in nearcopies.near_duplicates(docs).collect()))
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    if "local-cluster" in got.stderr and "removed" not in got.stdout:
        pytest.skip("no cluster of processes here")
    assert "removed [29, 30, 30]" in got.stdout and "classes [0, 0, 0]" in got.stdout, got.stderr[-2000:]


# 7


def test_code_lengths_of_several_scripts(spark):
    train = {"en": ["the cat sat"], "ru": ["кот сидел на окне"], "zh": ["猫坐在窗户上面"], "el": ["η γάτα κάθισε"], "ja": ["ねこはまどのうえ"]}
    docs = spark.createDataFrame([(i, t, l) for i, (l, ts) in enumerate(train.items()) for t in ts], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    data = ["кот the 猫", "ねこ", "γάτα на", "窗户, 猫!", "zzz"]
    got = model.bits(textkit.Texts(pa.array(data)))
    for i, t in enumerate(data):
        for j, l in enumerate(model.languages):
            assert got[i, j] == pytest.approx(brute_bits(train[l], t), abs=1e-2), (t, l)
    assert [r["lang"] for r in [langid.predictions(model, pa.array([t])) for t in ("猫坐", "окне", "the")]] == [["zh"], ["ru"], ["en"]]


def test_hundreds_of_languages(spark):
    rng = random.Random(3)
    vocabulary = {f"l{i:03}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñø") for _ in range(5)) for _ in range(12)] for i in range(300)}
    text = lambda l: " ".join(rng.choice(vocabulary[l]) for _ in range(40))
    docs = spark.createDataFrame([(i, text(l), l) for i, l in enumerate(vocabulary)], "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == 300
    got = langid.predictions(model, pa.array([text(l) for l in vocabulary]))["lang"]
    assert np.mean([a == b for a, b in zip(got, vocabulary)]) > 0.97
    small = langid.learn(docs, model_bytes=300 * langid.GRAM_BYTES * 20)
    assert max(sum(len(t.grams) for t in trees[langid.ORDER :]) for trees in small.blocks) <= 20 * langid.TOGETHER


# 8


def test_token_query_against_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    got = by_id(QUERIES["op8_tokens"](spark, DATA), "n_bytes", "n_tokens", "over_limit")
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        assert got[r.doc_id] == (len((r.text or "").encode()), n, n > 512)


def test_token_counts_some_at_a_time(monkeypatch):
    rng = random.Random(1)
    path = tokens.tokenizer_path()
    data = ["".join(rng.choice([" ", "  ", "\n", "a", "b'll", "12", "<|endoftext|>", "é", "日", "<|end"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    want = [len(e.ids) for e in tokens.loaded(path)[0].encode_batch(data, add_special_tokens=False)]
    monkeypatch.setattr(tokens, "AT_ONCE", 7)
    assert tokens.lengths(data, {}, path) == want


# 10


def test_contamination_by_join_on_hard_input(spark, hard, monkeypatch):  # noqa: F811
    monkeypatch.setattr(contamination, "BLOCK_BYTES", 0)
    for c in ("w", "items", "row", "hit", "may", "runs"):
        hard = hard.withColumn(c, F.lit("mine"))
    bench = spark.createDataFrame([(1, "one two"), (2, None), (None, "日本語"), (1, "one two"), (3, "x " * 30)], "item_id long, text string")
    out = contamination.find_contamination(hard, bench)
    assert out.columns == [*hard.drop("found").columns, "found"] and out.count() == hard.count() and out.where("w <> 'mine' OR may <> 'mine'").count() == 0
    items = [("1", "one two"), ("", "日本語"), ("3", "x " * 30)]
    text = {r.doc_id: r.text for r in hard.collect()}
    got = {r.doc_id: spread(r.found) for r in out.collect() if r.doc_id is not None}
    assert got == {k: brute_contamination(text[k], items) for k in got}


def test_many_items_of_one_window(spark):
    """Two thousand items of one word against one long text: pairs of text and set, not of places and items."""
    found = contamination.Fingerprints([str(i) for i in range(2000)], ["yes"] * 2000, 10, 5).match(pa.array(["yes no " * 20_000, "no"]))
    assert [len(x) for x in found["items"].to_pylist()] == [2000, 0] and len(found["hit_start"][0]) == 20_000


# house


def test_no_folder_of_one_machine_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_scratch_tables_go(spark):
    with shared.scratch(spark) as kept:
        gone = shared.written(spark.range(3), "gone")
        stays = kept(shared.written(spark.range(4), "stays"))
    assert stays.count() == 4
    with pytest.raises(Exception):
        gone.count()


@pytest.mark.parametrize("name", ["score", "key_doc_id", "key_rows", "key_id", "part", "at"])
def test_clashing_names_pass(spark, hard, name):  # noqa: F811
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    docs = hard.drop(name).withColumn(name, F.lit("mine"))
    for out in (quality.resample(docs, labels), mixing.mixed(docs.drop("size", "target", "copies"))):
        assert out.where(f"{name} <> 'mine' OR {name} IS NULL").count() == 0
