"""Hashed n-gram multinomials of a trusted target and of the raw corpus, fitted in one pass without moving any text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import written
from tessella.llm.textkit import ALNUM, SPACED, U64, Lookup, Texts, give_back, groups, mix, span_hashes
from tessella.llm.workers import ready

#: Buckets of the model, and labelled rows that the target is fitted on at most: both bound what is collected and broadcast.
BUCKETS, MAX_LABELS = 1 << 16, 200_000
#: Words whose n-grams are made at once.
AT_ONCE = 1 << 17
#: Weight of the raw corpus in a bucket's target estimate, in n-grams.
PRIOR = 5.0
#: Averse words: how many at most, the log odds that toxic texts hold one rather than trusted texts, the evidence for it (nats of a likelihood ratio), and the words that are looked at together.
AVERSE, ODDS, EVIDENCE, WINDOW = 100_000, 3.0, 12.0, 64

_CLASS = np.full(256, 64, np.uint8)
_CLASS[0x61:0x7B] = 1
_CLASS[0x41:0x5B] = 2
_CLASS[0x30:0x3A] = 4
_CLASS[[ord(c) for c in "#*$%&|<>@^~_=+\\/"]] = 8
_CLASS[[ord(c) for c in "!?"]] = 16
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 32
_CLASS[0x80:] = 128


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all n-grams of the texts, and the text that each belongs to, for some words at a time.

    Words give 1-grams and 2-grams of their hashes, and 1-, 2- and 3-grams of their make: the kinds of
    characters in them and whether the word stood one, two, three or four words before. The second kind is
    what carries over to words never seen.
    """
    words = Texts(texts).words(SPACED)
    total = len(words.start)
    for i in range(0, total, AT_ONCE):
        j = min(i + AT_ONCE, total)
        lo, hi = max(0, i - 4), min(total, j + 2)  # what the make of the first and the 3-gram of the last look at
        start, end = words.start[lo:hi], words.end[lo:hi]
        h = span_hashes(words.padded, start, end)
        text_of = np.searchsorted(words.at, np.arange(lo, hi), side="right") - 1
        ends = np.empty(2 * len(h), np.int64)
        ends[0::2], ends[1::2] = start - start[0], end - start[0]
        make = np.bitwise_or.reduceat(_CLASS[words.buf[start[0] : end[-1] + 1]], ends)[0::2].astype(np.uint64)
        for back in (4, 3, 2, 1):
            if len(h) > back:
                again = np.flatnonzero((h[back:] == h[:-back]) & (text_of[back:] == text_of[:-back])) + back
                make[again] = (make[again] & U64(255)) | U64(back << 8)
        out, own = [], []

        def add(values: np.ndarray, salt: int, n: int) -> None:
            """The n-grams from the words i to j that stay within a text."""
            of = text_of[i - lo : min(j - lo, len(values))]
            keep = of == text_of[n - 1 :][i - lo : i - lo + len(of)]
            out.append((mix(values[i - lo : i - lo + len(of)][keep] + U64(salt)) >> U64(48)).astype(np.int64) & (BUCKETS - 1))
            own.append(of[keep])

        add(h, 1, 1)
        add(h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:], 2, 2)
        add(make, 3, 1)
        add(make[:-1] * U64(2048) + make[1:], 4, 2)
        add((make[:-2] * U64(2048) + make[1:-1]) * U64(2048) + make[2:], 5, 3)
        yield np.concatenate(out), np.concatenate(own)


@dataclass
class Ratio:
    """log P(bucket | target) - log P(bucket | raw), for each bucket; and words that toxic texts hold and trusted ones don't, with their log odds."""

    log: np.ndarray
    averse: Lookup = field(default_factory=lambda: Lookup(np.zeros(0, np.uint64)))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def totals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text its n-grams, and the sum of their log ratios."""
        n, total = np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for bucket, own in features(texts):
            n += np.bincount(own, minlength=len(texts))
            total += np.bincount(own, weights=self.log[bucket], minlength=len(texts))
        return n, total

    def aversion(self, texts: pa.Array) -> np.ndarray:
        """For each text the largest sum of the log odds of averse words over WINDOW words in a row, however long the text is."""
        out = np.zeros(len(texts))
        if not len(self.odds):
            return out
        words = Texts(texts).words(ALNUM, lower=True)
        at, which = self.averse.find(words.hashes())
        if len(at):
            own = words.text_of()[at]
            total = np.concatenate(([0.0], np.cumsum(self.odds[which])))
            stop = np.searchsorted(at, np.minimum(at + WINDOW, words.at[own + 1]))
            np.maximum.at(out, own, total[stop] - total[:-1])
        return out


def held_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text, each once, and the text that each belongs to."""
    words = Texts(texts).words(ALNUM, lower=True)
    h, own = words.hashes(), words.text_of()
    order = np.lexsort((own, h))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[new], own[new]


def target_ids(labels: DataFrame, limit: int = MAX_LABELS, toxic: int = 0) -> np.ndarray:
    """Ids that the labels trust (quality 1, not toxic; or those of that quality that are toxic), at most ``limit`` of them, the same ones on each run."""
    good = labels.where(f"quality = 1 AND coalesce(toxic, 0) = {toxic} AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    got = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).toArrow()
    return np.sort(got["doc_id"].to_numpy().astype(np.int64))


def averse_words(counts: DataFrame, n_toxic: int, n_trusted: int) -> tuple[Lookup, np.ndarray]:
    """Words (key; raw and target: toxic and trusted texts that hold it) that tell toxic from trusted texts, and their log odds."""
    share = n_toxic / (n_toxic + n_trusted)
    a, b = F.col("raw").cast("double"), F.col("target").cast("double")
    evidence = a * F.log(a / (a + b) / share) + F.when(b > 0, b * F.log(b / (a + b) / (1 - share))).otherwise(0.0)
    odds = F.log((a + 0.5) / (n_toxic + 1)) - F.log((b + 0.5) / (n_trusted + 1))
    found = counts.select("key", odds.alias("odds"), evidence.alias("evidence")).where((F.col("odds") >= ODDS) & (F.col("evidence") >= EVIDENCE))
    got = found.orderBy(F.desc("evidence"), "key").limit(AVERSE).toArrow()
    key = got["key"].to_numpy().astype(np.int64).view(np.uint64)
    return Lookup(key), got["odds"].to_numpy()[np.argsort(key)]


#: What a row of counts is about: a bucket (n-grams of all and of trusted texts), a word (toxic and trusted texts that hold it), all texts (toxic and trusted ones).
OF_BUCKET, OF_WORD, OF_TEXTS = 0, 1, 2


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELS, id_column: str = "doc_id", text_column: str = "text") -> Ratio:
    """The ratio of the target's model (texts of up to ``limit`` trusted ids) to the raw corpus's (all texts).

    Averse words come from the texts of up to ``limit`` ids of quality 1 that are toxic, against the trusted ones.
    Without any trusted text all ratios are 0; without trusted or toxic ones no word is averse. Null texts hold no n-grams.
    """
    ready()
    ids = docs.sparkSession.sparkContext.broadcast((target_ids(labels, limit), target_ids(labels, limit, 1)))

    def rows(kind: int, key: np.ndarray, raw: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind), pa.int32()), pa.array(key.astype(np.int64)), pa.array(raw, pa.int64()), pa.array(target, pa.int64())], ["kind", "key", "raw", "target"])

    def merged(held: list) -> tuple[np.ndarray, ...]:
        key, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        return key, *(np.bincount(at, weights=np.concatenate([x[i] for x in held]), minlength=len(key)).astype(np.int64) for i in (1, 2))

    def count(batches):
        trusted, toxic = ids.value
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        texts, held, size = np.zeros(2, np.int64), [], 0
        for batch in batches:
            for part in groups(batch, "text"):
                doc = part.column("doc_id").fill_null(-(2**63)).to_numpy()
                chosen, bad = np.isin(doc, trusted), np.isin(doc, toxic)
                for bucket, own in features(part.column("text")):
                    raw += np.bincount(bucket, minlength=BUCKETS)
                    target += np.bincount(bucket[chosen[own]], minlength=BUCKETS)
                known = chosen | bad
                if len(toxic) and known.any():
                    h, of = held_words(part.column("text").filter(pa.array(known)))
                    held.append((h.view(np.int64), bad[known][of].astype(np.int64), chosen[known][of].astype(np.int64)))
                    texts += [bad.sum(), chosen.sum()]
                    size += len(h)
                    if size > 1 << 20:
                        yield rows(OF_WORD, *merged(held))
                        held, size = [], 0
            give_back()
        some = np.flatnonzero(raw)
        yield rows(OF_BUCKET, some, raw[some], target[some])
        if held:
            yield rows(OF_WORD, *merged(held))
        yield rows(OF_TEXTS, np.zeros(1), texts[:1], texts[1:])

    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sums = own.mapInArrow(count, "kind int, key long, raw long, target long").groupBy("kind", "key").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    counts = written(sums.where((F.col("kind") != OF_WORD) | (F.col("raw") > 1)), "counts")
    got = counts.where(F.col("kind") == OF_BUCKET).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = got["key"].to_numpy()
    raw[at], target[at] = got["raw"].to_numpy(), got["target"].to_numpy()
    if not target.sum():
        return Ratio(np.zeros(BUCKETS))
    log = np.log((target + PRIOR) / (raw * (target.sum() / raw.sum()) + PRIOR))
    n_toxic, n_trusted = counts.where(F.col("kind") == OF_TEXTS).agg(F.sum("raw"), F.sum("target")).first()
    return Ratio(log, *averse_words(counts.where(F.col("kind") == OF_WORD), n_toxic, n_trusted)) if n_toxic and n_trusted else Ratio(log)
