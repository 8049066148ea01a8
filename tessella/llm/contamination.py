"""Benchmark decontamination by winnowing.

Of every ``n - k + 1`` consecutive k-grams the smallest hash is kept, in documents and in benchmark items.
Any shared span of n words holds the same kept hash in both, so joining the kept hashes misses none. Hits are
extended to the whole window of n words.

A benchmark of up to BLOCK_BYTES is broadcast, and the join is a lookup beside the texts. A larger one is joined by a
shuffle: one pass over the documents keeps windows whose fingerprint passes a Bloom filter of bounded size, and
these alone move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import spare, written
from tessella.llm.textkit import ALNUM, U64, Lookup, Texts, Words, lists, map_texts, mix, runs, text_udf, whole, windows
from tessella.llm.workers import ready

#: Bytes of benchmark text that are broadcast at most, and of the Bloom filter that is made of a larger benchmark.
BLOCK_BYTES, FILTER_BYTES = 32 << 20, 32 << 20
BITS, LANES = 16, 8


def kept_hashes(grams: np.ndarray, w: int) -> np.ndarray:
    """The smallest of w consecutive hashes, from each place on."""
    m = len(grams) - w + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = grams[:m].copy()
    for i in range(1, w):
        np.minimum(out, grams[i : i + m], out=out)
    return out


class Fingerprints:
    """What a benchmark is found by: for each size of window the windows, and the set of items that hold each."""

    def __init__(self, ids: list[str], texts: list[str | None], n: int, k: int):
        self.n, self.k, self.names = n, k, sorted(set(ids))
        index = {x: i for i, x in enumerate(self.names)}
        words = Texts(pa.array(texts, pa.large_string())).words(ALNUM, lower=True)
        self.hashes = words.hashes()
        item = np.array([index[x] for x in ids], np.int64)
        self.by_length: dict[int, tuple[Lookup, np.ndarray, np.ndarray]] = {}
        self.sets: list[np.ndarray] = []
        known: dict[bytes, int] = {}
        for size in sorted({*np.minimum(words.n, n).tolist()} - {0}):
            chosen = words.n >= n if size == n else words.n == size
            start = np.concatenate([np.arange(words.at[i], words.at[i + 1] - size + 1) for i in np.flatnonzero(chosen)])
            owner = np.repeat(item[chosen], words.n[chosen] - size + 1)
            h = windows(self.hashes, size)[start]
            order = np.lexsort((owner, h))
            h, owner, start = h[order], owner[order], start[order]
            lookup = Lookup(h)
            at = np.searchsorted(h, lookup.values)
            of = np.empty(len(at), np.int64)
            for i, held in enumerate(np.split(owner, at[1:])):
                held = np.unique(held)
                of[i] = known.setdefault(held.tobytes(), len(known))
                if of[i] == len(self.sets):
                    self.sets.append(held)
            self.by_length[size] = lookup, start[at], of
        self.kept = None
        if n in self.by_length:
            grams = windows(self.hashes, k)
            self.kept = Lookup(kept_hashes(grams, n - k + 1)[whole(words.at, n, len(self.hashes))])

    def match(self, texts: pa.Array) -> dict:
        """n_words; starts and ends of hit runs of words; names of the items found."""
        words = Texts(texts).words(ALNUM, lower=True)
        h, n = words.hashes(), self.n
        mark = np.zeros(len(h) + 1, np.int32)
        text_of = words.text_of()
        pairs = []
        for size, (lookup, start, of) in self.by_length.items():
            inside = whole(words.at, size, len(h))
            if size == n:
                at, _ = self.kept.find(kept_hashes(windows(h, self.k), n - self.k + 1))
                at = at[inside[at]]
            else:
                at = np.flatnonzero(inside)
            found, i = lookup.find(windows(h, size)[at])
            at = at[found]
            same = np.ones(len(at), bool)
            for j in range(size):
                same &= h[at + j] == self.hashes[start[i] + j]
            at, i = at[same], i[same]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + size, -1)
            pairs.append(np.unique(text_of[at] * np.int64(len(self.sets)) + of[i]))
        first, end, at = runs(np.cumsum(mark[:-1]) > 0, words.at)
        pair = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        of, which = np.divmod(pair, max(1, len(self.sets)))
        cut = np.searchsorted(of, np.arange(words.texts.n + 1))
        items = [np.unique(np.concatenate([self.sets[i] for i in which[a:b]])) if b > a else np.zeros(0, np.int64) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
        names = pa.array(self.names, pa.string()).take(pa.array(np.concatenate([*items, np.zeros(0, np.int64)])))
        return {
            "n_words": words.n,
            "hit_start": lists(pa.array(first, pa.int32()), at),
            "hit_end": lists(pa.array(end, pa.int32()), at),
            "items": lists(names, np.concatenate(([0], np.cumsum([len(x) for x in items]))).astype(np.int64)),
        }


FOUND = "n_words long, hit_start array<int>, hit_end array<int>, items array<string>"


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, k: int = 5, text_column: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with a struct column ``found``: n_words, hit_start and hit_end (runs of words inside an occurring window), items (sorted, distinct).

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is n consecutive words
    of an item; an item of fewer words, but not none, is one window. Null texts have no words. Every row gives a
    row, repeated ones too; repeated items count once by their id, a null id is the empty string; an item that is
    found in several ways is named once. Columns of docs pass through, one named ``found`` is replaced. Either table
    may be empty. A very long text is handled alone, by a worker that holds some ten times its size.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0) > BLOCK_BYTES:
        return joined(docs.drop("found"), items, n, k, text_column)
    got = items.toArrow()
    held = docs.sparkSession.sparkContext.broadcast(Fingerprints(got["id"].to_pylist(), got["text"].to_pylist(), n, k))
    return docs.drop("found").withColumn("found", text_udf(lambda texts: held.value.match(texts), FOUND)(F.col(text_column)))


def spans(words: Words, size: int, n: int, k: int) -> tuple[np.ndarray, ...]:
    """The windows of ``size`` words of some texts: places, fingerprints, and two hashes of the whole window."""
    h = words.hashes()
    at = np.flatnonzero(whole(words.at, size, len(h)))
    a, b = windows(h, size)[at], windows(mix(words.hashes(1)), size)[at]
    return at, (kept_hashes(windows(h, k), n - k + 1)[at] if size == n else a), a, b


def bloom(fingerprints: DataFrame, count: int) -> np.ndarray:
    """A blocked Bloom filter of the column fp, of FILTER_BYTES at most."""
    blocks = int(max(1, min(FILTER_BYTES // (8 * LANES), -(-count * BITS // (64 * LANES)))))
    bits = [F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {6 * i}) & 63 as int))")).alias(f"w{i}") for i in range(LANES)]
    got = fingerprints.groupBy((F.shiftrightunsigned("fp", 40) % blocks).alias("block")).agg(*bits).toArrow()
    table = np.zeros((blocks, LANES), np.uint64)
    if got.num_rows:
        table[got["block"].to_numpy()] = np.stack([got[f"w{i}"].to_numpy() for i in range(LANES)], axis=1).view(np.uint64)
    return table


def passes(table: np.ndarray, fp: np.ndarray) -> np.ndarray:
    rows = ((fp >> U64(40)) % U64(len(table))).astype(np.int64)
    ok = np.ones(len(fp), bool)
    for i in range(LANES):
        ok &= (table[rows, i] >> ((fp >> U64(6 * i)) & U64(63))) & U64(1) == 1
    return ok


def joined(docs: DataFrame, items: DataFrame, n: int, k: int, text_column: str) -> DataFrame:
    """find_contamination() by a join of fingerprints: documents and items meet by (fingerprint, hashes of the window)."""
    spark = docs.sparkSession

    def of_items(batch: pa.RecordBatch) -> dict:
        words = Texts(batch.column("text")).words(ALNUM, lower=True)
        found = []
        for size in sorted({*np.minimum(words.n, n).tolist()} - {0}):
            at, *rest = spans(words, size, n, k)
            own = words.text_of()[at]
            mine = (words.n[own] >= n) if size == n else (words.n[own] == size)
            found.append((own[mine], np.full(mine.sum(), size), *(x[mine].view(np.int64) for x in rest)))
        own, size, fp, a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
        return {"fp": fp, "a": a, "b": b, "size": size, "id": batch.column("id").take(pa.array(own))}

    held = written(map_texts(items, of_items, "fp long, a long, b long, size int, id string").distinct(), "items")
    ids = held.groupBy("fp", "a", "b").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    owned = written(ids.withColumn("of", F.xxhash64("ids")), "windows")
    sizes = sorted(r["size"] for r in held.select("size").distinct().collect())
    fps = held.select("fp").distinct()
    table = spark.sparkContext.broadcast(bloom(fps, fps.count()))

    def candidates(texts: pa.Array) -> dict:
        words = Texts(texts).words(ALNUM, lower=True)
        found = []
        for size in sizes:
            at, fp, a, b = spans(words, size, n, k)
            some = passes(table.value, fp)
            found.append((at[some], np.full(some.sum(), size), *(x[some].view(np.int64) for x in (fp, a, b))))
        at, size, fp, a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 5
        order = np.argsort(at, kind="stable")
        at, size, fp, a, b = (x[order] for x in (at, size, fp, a, b))
        cut = np.searchsorted(at, words.at)
        at = at - np.repeat(words.at[:-1], np.diff(cut))
        kinds = {"start": at, "size": size, "fp": fp, "a": a, "b": b}
        return {"n_words": words.n} | {c: lists(pa.array(x, pa.int64()), cut) for c, x in kinds.items()}

    row, may = spare(docs, "row"), spare(docs, "may")
    seen = text_udf(candidates, "n_words long, start array<long>, size array<long>, fp array<long>, a array<long>, b array<long>")
    own = written(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(may, seen(F.col(text_column))), "candidates")
    each = own.select(F.col(row).alias("row"), F.explode(F.arrays_zip(*[f"{may}.{c}" for c in ("start", "size", "fp", "a", "b")])).alias("c")).select("row", "c.*")
    hits = written(each.join(owned.select("fp", "a", "b", "of"), ["fp", "a", "b"]).select("row", "start", "size", "of"), "hits")
    sets = owned.groupBy("of").agg(F.first("ids").alias("ids"))
    named = hits.select("row", "of").distinct().join(sets, "of").select("row", F.explode("ids").alias("id")).groupBy("row").agg(F.array_sort(F.collect_set("id")).alias("items"))
    # runs of hit words: a window that starts after all those before it have ended opens one
    marked = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    spread = marked.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("w"))
    hit = spare(own, "hit")
    found = spread.join(named, "row").select(F.col("row").alias(row), F.struct(run_udf()(F.col("w")).alias("runs"), "items").alias(hit))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    runs_ = [F.coalesce(F.col(f"{hit}.runs.{c}"), none("int")).alias(c) for c in ("hit_start", "hit_end")]
    whole_ = F.struct(F.col(f"{may}.n_words").alias("n_words"), *runs_, F.coalesce(F.col(f"{hit}.items"), none("string")).alias("items"))
    return own.join(found, row, "left").select(*docs.columns, whole_.alias("found"))


def run_udf():
    """Runs of places in sorted windows (start, end)."""
    ready()

    @F.arrow_udf("hit_start array<int>, hit_end array<int>")
    def merge(spread: pa.Array) -> pa.Array:
        starts, ends, cut = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0]
        for one in spread:
            s, e = one.values.field("start").to_numpy(), np.maximum.accumulate(one.values.field("end").to_numpy())
            new = np.concatenate(([True], s[1:] > e[:-1]))
            starts.append(s[new])
            ends.append(e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)])
            cut.append(cut[-1] + len(starts[-1]))
        fields = [lists(pa.array(np.concatenate(x), pa.int32()), np.array(cut)) for x in (starts, ends)]
        return pa.StructArray.from_arrays(fields, ["hit_start", "hit_end"])

    return merge


def op10_contamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate(F.zip_with("found.hit_start", "found.hit_end", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(
        "doc_id",
        "found.n_words",
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.size("found.hit_start") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT r, i, sizes.n AS n, array_to_string(w[i : i + sizes.n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - sizes.n + 2)) AS t(i)
), hits AS (SELECT r, i, dw.n AS n, item_id FROM dw JOIN bw USING (n, win)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hits), unnest(range(i, i + n)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)
"""
