"""Quality: importance resampling by Gumbel top-k, and rules with a length-normalised likelihood ratio."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import ngrams
from tessella.llm.shared import spare, written
from tessella.llm.textkit import SPACED, Texts, covered, mix, span_hashes, sums, text_udf, whole, windows

#: N-grams of the passage that a document's weight is for: a longer document has the weight of a passage of its kind.
PASSAGE = 64
#: Left to itself, a sample is as large as rejection sampling with weights cut off at exp(-MARGIN) would make it.
MARGIN = 8.0
#: Share of the rows that the query draws.
SHARE = 0.75
#: Mean log ratio per n-gram that a document must reach.
THRESHOLD = -0.5
#: Log odds of averse words within a window (see ngrams) from which on a document is ruled out.
AVERSION = 5.0


def gumbel(seed: int, *key: Column) -> Column:
    """Gumbel noise that depends on the key alone."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratio: ngrams.Ratio, seed: int, aversion: float = AVERSION, id_column: str = "doc_id", text_column: str = "text", passage: int = PASSAGE) -> DataFrame:
    """docs with a struct column ``weight``: n_grams, log_weight, aversion, and key = log_weight + Gumbel noise; minus infinity from ``aversion`` on."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(texts: pa.Array) -> dict:
        n, total = held.value.totals(texts)
        return {"n_grams": n, "log_weight": total * np.minimum(1, passage / np.maximum(n, 1)), "aversion": held.value.aversion(texts)}

    name = spare(docs, "score")
    scored = docs.drop("weight").withColumn(name, text_udf(score, "n_grams long, log_weight double, aversion double")(F.col(text_column)))
    got = {c: F.col(f"{name}.{c}") for c in ("n_grams", "log_weight", "aversion")}
    key = F.when(got["aversion"] >= aversion, float("-inf")).otherwise(got["log_weight"] + gumbel(seed, F.col(id_column), F.xxhash64(text_column)))
    return scored.withColumn("weight", F.struct(*got.values(), key.alias("key"))).drop(name)


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096, few: int = 4096) -> float:
    """The k-th largest value, exactly: histograms of ``bins`` cells narrow down a range until it holds few rows or one value."""
    own = values.select(F.col(column).alias("v"))
    lo, hi = own.agg(F.min("v"), F.max("v")).first()
    while True:
        inside = own.where(F.col("v").between(lo, hi))
        if lo == hi:
            return lo
        cell = F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
        counts = sorted(inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(), key=lambda r: -r["lo"])
        for r in counts:
            if k <= r["n"]:
                break
            k -= r["n"]
        if r["n"] <= few:
            return sorted((x for (x,) in own.where(F.col("v").between(r["lo"], r["hi"])).collect()), reverse=True)[k - 1]
        lo, hi = r["lo"], r["hi"]


def draw(weighed: DataFrame, k: int | None = None, share: float | None = None, margin: float = MARGIN) -> DataFrame:
    """A written table from weigh() with ``kept`` in its column ``weight``: the k rows with the largest keys; see resample()."""
    n, size = weighed.where("weight.key > double('-inf')").agg(F.count("*"), F.sum(F.exp(F.least(F.col("weight.log_weight") + margin, F.lit(0.0))))).first()
    k = min(n, round(share * weighed.count() if share is not None else size or 0) if k is None else k)
    keys = weighed.select("weight.key").where("key > double('-inf')")
    least = kth_largest(keys, "key", k) if k else float("inf")
    return weighed.withColumn("weight", F.struct("weight.*", (F.col("weight.key") >= least).alias("kept")))


def resample(
    docs: DataFrame,
    labels: DataFrame,
    k: int | None = None,
    share: float | None = None,
    seed: int = 1,
    max_labels: int = ngrams.MAX_LABELS,
    id_column: str = "doc_id",
    text_column: str = "text",
    aversion: float = AVERSION,
    passage: int = PASSAGE,
    margin: float = MARGIN,
) -> DataFrame:
    """docs with a struct column ``weight`` (n_grams, log_weight, aversion, key, kept): importance resampling without replacement.

    The weight of a document is P(passage | target) / P(passage | raw) under hashed n-gram multinomials, where the
    passage is the document or, if it has more than ``passage`` n-grams, as many of its kind: weights of whole long
    texts differ by hundreds of orders of magnitude, so that a draw by them would be a plain threshold. Kept are
    the k documents with the largest log weight plus Gumbel noise, which is a draw of k without replacement in
    proportion to the weights. Instead of k a ``share`` of all rows may be given. With neither, k is the sum of
    min(1, weight * exp(margin)): what rejection sampling with weights cut off at exp(-margin) would keep on average,
    that is, what the target's model doesn't rule out.

    A document with a window of 64 words whose averse words reach ``aversion`` is ruled out whatever the rest of it
    says: its key is minus infinity, and it is never kept nor counted. Rows with keys equal to the k-th stand or
    fall together, so repeated rows share a fate. Other columns pass through, one named ``weight`` is replaced. A
    null or empty text has weight 1 (log 0). Null ids are ids like any other. An empty table gives an empty result;
    without trusted labels all weights are 1. A very long text is read alone, some words at a time, by a worker that
    holds some ten times its size.
    """
    ratio = ngrams.fit(docs, labels, max_labels, id_column, text_column)
    return draw(written(weigh(docs, ratio, seed, aversion, id_column, text_column, passage), "weighed"), k, share, margin)


def op1_quality(spark, sf_dir: str, share: float = SHARE) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weighed = weigh(docs, ngrams.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), 1).select("doc_id", "weight")
    return draw(written(weighed, "weighed"), share=share).select("doc_id", "weight.*")


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
#: Bytes that go on with a code point; they are in words alone.
_FOLLOWS = (np.arange(256) & 0xC0) == 0x80
RULES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated(key: np.ndarray) -> np.ndarray:
    """Which values are found twice or more."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def measure(texts: pa.Array, window: int = 8) -> dict:
    """The counts that the rules judge by."""
    t = Texts(texts)
    words = t.words(SPACED)
    buf = t.buf
    h = words.hashes()
    n = len(h)
    word_bytes = sums(words.end - words.start, words.at)
    # lines; the last one of a text ends at its separator
    stop = np.flatnonzero(buf == 10)
    start = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else np.zeros(0, np.int64)
    line_words = np.searchsorted(words.start, stop) - np.searchsorted(words.start, start)
    line_text = np.searchsorted(t.end, stop)
    some = np.flatnonzero(line_words > 0)
    lines = span_hashes(t.padded, start[some], stop[some]) + mix(line_text[some].astype(np.uint64))
    order = np.argsort(lines, kind="stable")
    again = np.zeros(len(some), bool)
    again[order[1:]] = lines[order[1:]] == lines[order[:-1]]
    dup = np.bincount(line_text[some][again], minlength=t.n)
    # windows of words
    text_of = words.text_of()
    at = np.flatnonzero(whole(words.at, window, n))
    key = windows(h, window)[at]
    if t.n > 1:
        key += mix(text_of[at].astype(np.uint64))
    hit = at[repeated(key)] if len(at) else at
    return {
        "n_words": words.n,
        "word_chars": word_bytes - t.count(_FOLLOWS),
        "n_symbols": t.count(_SYMBOL),
        "n_dup_lines": dup,
        "n_repeat_words": sums(covered(hit, window, n).astype(np.int64), words.at),
    }


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labels: int = ngrams.MAX_LABELS, id_column: str = "doc_id", text_column: str = "text", aversion: float = AVERSION) -> DataFrame:
    """docs with a struct column ``rules``: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, mean_ratio, aversion.

    A document fails the base rules if it has under 20 words, or if over 30 % of its words are in windows of 8
    words that it holds twice. Others are kept if the mean log ratio of their n-grams under the trusted target
    and the raw corpus reaches the threshold, and if no window of 64 words has averse words of ``aversion`` or more. A null text has no words, so it fails. Repeated rows get the same
    verdict; null ids can't be labelled; other columns pass through, one named ``rules`` is replaced; an empty
    table gives no rows; without trusted labels all ratios are 0. A very long text is read alone, by a worker that
    holds some ten times its size.
    """
    held = docs.sparkSession.sparkContext.broadcast(ngrams.fit(docs, labels, max_labels, id_column, text_column))

    def score(texts: pa.Array) -> dict:
        n, total = held.value.totals(texts)
        return measure(texts) | {"mean_ratio": total / np.maximum(n, 1), "aversion": held.value.aversion(texts)}

    scored = docs.drop("rules").withColumn("rules", text_udf(score, f"{RULES}, mean_ratio double, aversion double")(F.col(text_column)))
    failed = (F.col("rules.n_words") < 20) | (100 * F.col("rules.n_repeat_words") > 30 * F.col("rules.n_words"))
    base = [F.col(f"rules.{x.split()[0]}") for x in RULES.split(", ")]
    return scored.withColumn("rules", F.struct(*base, failed.alias("base_failed"), (~failed & (F.col("rules.mean_ratio") >= threshold) & (F.col("rules.aversion") < aversion)).alias("kept"), F.col("rules.mean_ratio"), F.col("rules.aversion")))


def op2_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "rules.*")
