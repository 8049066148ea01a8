"""Language identification by partial matching: per-language byte context trees of order 3, with frozen counts.

Text is coded byte by byte after folding: ASCII letters in lower case, every run of other ASCII as one blank, all
other bytes as they are. A byte costs -log2 of its share in the longest context that was seen; where it wasn't seen
there, an escape is paid and the next shorter context is asked (method C: distinct / (total + distinct)), down to a
uniform code of eight bits. The trees are kept as tables of the contexts that were seen, order by order, with all
costs worked out, so that most bytes take one lookup for some languages at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import written
from tessella.llm.textkit import PIECE, Texts, give_back, groups, text_udf
from tessella.llm.workers import ready

#: Labelled texts learned from for each language at most; bytes that the model may have in a worker, which bound the contexts of each language.
MAX_TEXTS, MODEL_BYTES = 3000, 128 << 20
#: Bits of a symbol, symbols before it that are looked at, and languages that share a table.
BITS, ORDER, TOGETHER = 8, 3, 4
#: Bytes that one 4-gram of one language may take, lookup tables and shorter contexts included.
GRAM_BYTES = 64
#: Parts that equally frequent 4-grams are kept or left out by.
TIERS = 64
#: Bytes of text that are scored at once.
SLICE = 1 << 17

_FOLD = np.full(256, 32, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_LETTER = (_FOLD >= 0x61) & (_FOLD <= 0x7A)
_WIDE = np.arange(256) >= 0x80


def folded(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of all texts, and where each text starts and ends in them. Blanks at a text's start are gone, its last one is kept."""
    if not texts.n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    b = _FOLD[texts.buf]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32)
    keep[texts.start] &= b[texts.start] != 32
    return b[keep], np.concatenate(([0], np.cumsum(np.add.reduceat(keep, texts.start, dtype=np.int64))))


def fours(codes: np.ndarray, at: np.ndarray, i: int, j: int) -> np.ndarray:
    """Each symbol from place i to j, with the three before it in its text (blanks before the first)."""
    out = codes[i:j].astype(np.uint32)
    first = at[:-1][at[1:] > at[:-1]]
    first = first[np.searchsorted(first, i - ORDER) : np.searchsorted(first, j)]
    for back in range(1, ORDER + 1):
        before = np.full(j - i, 32, np.uint32)
        from_ = max(i, back)
        before[from_ - i :] = codes[from_ - back : max(0, j - back)] if j > from_ else before[from_ - i :]
        for d in range(back):
            place = first + d
            end = at[np.searchsorted(at, first, side="right")] if len(first) else first
            place = place[(place >= i) & (place < j) & (place < end)]
            before[place - i] = 32
        out |= before << np.uint32(BITS * back)
    return out


class Index:
    """Where keys are among some sorted ones: open addressing, tables of twice to four times their number."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint32(32 - bits), (1 << bits) - 1
        self.key, self.row = np.zeros(1 << bits, np.uint32), np.full(1 << bits, -1, np.int32)
        todo, slot = np.arange(len(keys)), self.slots(keys)
        while len(todo):
            free = self.row[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.row[slot[won]], self.key[slot[won]] = todo[won], keys[todo[won]]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        slot = self.slots(keys)
        out = self.row[slot]
        todo = np.flatnonzero((self.key[slot] != keys) & (out >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            out[todo] = row = self.row[slot]
            more = (row >= 0) & (self.key[slot] != keys[todo])
            todo, slot = todo[more], slot[more]
        return out


@dataclass
class Tree:
    """For one order and some languages: the costs in bits of the grams that any of them holds, and the escapes of their contexts."""

    grams: np.ndarray
    cost: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray
    index: Index | None = field(default=None, repr=False)
    above: Index | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"index": None, "above": None}


def shorter(grams: np.ndarray, order: int) -> np.ndarray:
    """The grams without their first symbol of order + 1."""
    return grams & np.uint32((1 << BITS * order) - 1)


def costs(trees: list[Tree], order: int, grams: np.ndarray) -> np.ndarray:
    """Bits of each gram of order + 1 symbols under each language of the trees (by order)."""
    if order < 0:
        return np.full((len(grams), 1), BITS, np.float32)
    tree = trees[order]
    if tree.index is None:
        tree.index, tree.above = Index(tree.grams), Index(tree.contexts)
    row = tree.index.find(grams)
    out = tree.cost[row]
    missed = np.flatnonzero(row < 0)
    if len(missed):
        context = tree.above.find(grams[missed] >> np.uint32(BITS))
        paid = tree.escape[context]
        paid[context < 0] = 0
        out[missed] = paid + costs(trees, order - 1, shorter(grams[missed], order))
    return out


@dataclass
class Model:
    """The languages by name, and their trees by order, some languages at a time."""

    languages: list[str]
    blocks: list[list[Tree]]

    def bits(self, texts: Texts) -> np.ndarray:
        """Code length of each text under each language."""
        codes, at = folded(texts)
        out = np.zeros((texts.n, len(self.languages)))
        for i in range(0, len(codes), SLICE):
            j = min(i + SLICE, len(codes))
            grams = fours(codes, at, i, j)
            a, b = np.searchsorted(at, i, side="right") - 1, np.searchsorted(at, j)
            some = a + np.flatnonzero(np.minimum(at[a + 1 : b + 1], j) > np.maximum(at[a:b], i))
            start = np.maximum(at[some], i) - i
            column = 0
            for trees in self.blocks:
                held = costs(trees, ORDER, grams)
                out[some, column : column + held.shape[1]] += np.add.reduceat(held, start, axis=0, dtype=np.float64)
                column += held.shape[1]
        return out


def plant(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, languages: int) -> list[Tree]:
    """The trees, by order, of counted 4-grams of some languages (numbered from 0)."""
    trees: list[Tree] = []
    gram = gram.astype(np.uint32)
    for order in range(ORDER + 1):
        keys, at = np.unique(shorter(gram, order + 1) if order < ORDER else gram, return_inverse=True)
        count = np.zeros((len(keys), languages))
        np.add.at(count, (at, lang), n)
        contexts, of = np.unique(keys >> np.uint32(BITS), return_inverse=True)
        total, distinct = np.zeros((len(contexts), languages)), np.zeros((len(contexts), languages))
        np.add.at(total, of, count)
        np.add.at(distinct, of, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
            seen = -np.log2(count / (total + distinct)[of])
        missed = escape[of] + costs(trees, order - 1, shorter(keys, order))
        trees.append(Tree(keys, np.where(count > 0, seen, missed).astype(np.float32), contexts, escape.astype(np.float32)))
    return trees


def build(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """The model of counted 4-grams of folded bytes."""
    blocks = []
    for i in range(0, len(languages), TOGETHER):
        mine = (lang >= i) & (lang < i + TOGETHER)
        blocks.append(plant(lang[mine] - i, gram[mine], n[mine], min(TOGETHER, len(languages) - i)))
    return Model(languages, blocks)


def learn(docs: DataFrame, max_texts: int = MAX_TEXTS, model_bytes: int = MODEL_BYTES) -> Model | None:
    """The model of up to about ``max_texts`` texts of each language (those with the smallest id hashes): docs has doc_id, text, lang (not null).

    There may be any number of languages: the most frequent 4-grams of each are kept, as many as have room in
    ``model_bytes``. Null and empty texts teach nothing; repeated rows count as often as they are there; equally
    frequent grams go in parts, by their hashes. Without any text there is no model.
    """
    ready()
    per = sorted(docs.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    if not per:
        return None
    plan = docs.sparkSession.createDataFrame([(r["lang"], i, min(1.0, max_texts / r["count"])) for i, r in enumerate(per)], "lang string, number int, share double")
    u = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 11).cast("double") / float(1 << 53)
    sample = docs.join(F.broadcast(plan), "lang").where(u < F.col("share")).select(F.col("number").alias("lang"), "text")

    def count(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def shrink() -> None:
            if held:
                keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
                held[:] = [(keys, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64))]

        for batch in batches:
            for part in groups(batch, "text"):
                b, at = folded(Texts(part.column("text")))
                number = part.column("lang").to_numpy().astype(np.uint64)
                for i in range(0, len(b), PIECE):
                    j = min(i + PIECE, len(b))
                    lang = number[np.searchsorted(at, np.arange(i, j), side="right") - 1]
                    held.append(np.unique(fours(b, at, i, j).astype(np.uint64) | lang << np.uint64(32), return_counts=True))
                    if len(held) > 16:
                        shrink()
            give_back()
        shrink()
        for keys, n in held:
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array((keys & np.uint64(2**32 - 1)).astype(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    grams = sample.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = written(grams.withColumn("tier", F.pmod(F.xxhash64("gram"), F.lit(TIERS))), "grams")
    most = max(1, model_bytes // (GRAM_BYTES * len(per)))
    tiers = grams.groupBy("lang", "n", "tier").count()  # few rows for each language
    held = F.sum("count").over(Window.partitionBy("lang").orderBy(F.desc("n"), "tier"))
    room = tiers.withColumn("held", held).where(F.col("held") <= most).select("lang", "n", "tier")
    got = grams.join(room, ["lang", "n", "tier"], "left_semi").select("lang", "gram", "n").toArrow()
    if not got.num_rows:
        return None
    return build([r["lang"] for r in per], got["lang"].to_numpy().astype(np.int64), got["gram"].to_numpy(), got["n"].to_numpy().astype(float))


def predictions(model: Model | None, texts: pa.Array) -> dict:
    """lang and score of each text."""
    t = Texts(texts)
    letters, wide = t.count(_LETTER) > 0, t.count(_WIDE) > 0
    for i in np.flatnonzero(wide & ~letters):
        letters[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    if model is None:
        return {"lang": ["und"] * t.n, "score": np.zeros(t.n)}
    bits = model.bits(t)
    best = np.argmin(bits, axis=1)
    score = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
    return {
        "lang": [model.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist(), strict=True)],
        "score": np.where(letters, score, 0.0),
    }


def identify(docs: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """docs with a struct column ``language``: lang, and score, its share of the likelihoods of all languages.

    ``und`` with score 0 if the text is null or has no letters, or if there is no model. Of equally likely
    languages the first by name. Repeated rows get the same answer, null ids one like any other; an empty table gives
    no rows. Other columns pass through, one named ``language`` is replaced. A very long text is scored piece by
    piece, by a worker that holds some five times its size.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    return docs.drop("language").withColumn("language", text_udf(lambda t: predictions(held.value, t), "lang string, score double")(F.col(text_column)))


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Learned from labelled documents outside the held-out quarter; a null id is in neither."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = learn(docs.where((fold != 2) & F.col("lang").isNotNull()))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score")
    )
