"""Near-duplicate documents: BagMinHash signatures, bands, and exact verification of multiset overlap.

The bag of a document is the multiset of its shingles of five words. Its signature comes from Poisson processes
over shingle x weight: the weight axis is cut into the dyadic levels [0, 1), [1, 2), [2, 4), ..., each with a
process of its own, whose points fall on a component and on a place in the level; a document of weight w sees
the points below w, and keeps the first of each component. Two documents agree in a component with a probability
that equals the weighted Jaccard similarity of their bags.

Documents that agree in all components of a band are candidates. Candidates that hang together are brought into
one place, where every link is verified by the exact overlap of bags; what leaves it is a spanning forest of the
links, not their pairs. Many candidates go to several places first, each with the group's smallest document beside
them. What is linked by then needs no comparison any more: texts of one class are put in blocks of their own, and
only blocks that could link two classes are compared, so a large group of copies of one text takes no second round.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.graph import components
from tessella.llm.repeats import packed, unpacked
from tessella.llm.shared import written
from tessella.llm.textkit import SPACED, U64, Texts, give_back, groups, mix, text_udf, whole, windows
from tessella.llm.workers import ready

SHINGLE, THRESHOLD = 5, 0.8
#: Rows in a band and bands: a pair of similarity 0.8 shares no band with a probability of 2e-5.
ROWS, BANDS = 6, 36
#: Documents of one group of candidates that are compared in one task; larger groups are compared block by block.
BLOCK = 2048
#: Documents whose signatures are worked out at once: each takes some thousand points.
AT_ONCE = 128
#: Shingles whose points are worked out at once.
UNITS = 1 << 17
#: Texts that a verification task gets about.
TASK = 1000


def bags(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contents of the texts (128 bits of a digest of their words, as two numbers), and shingles: text, hash, weight; sorted by text. A text of under k words, but not none, has one shingle."""
    words = Texts(texts).words(SPACED)
    a, b = words.contents()
    h = words.hashes()
    at = np.flatnonzero(whole(words.at, k, len(h)))
    text, shingle = words.text_of()[at], windows(h, k)[at]
    for n in range(1, k):
        few = np.flatnonzero(words.n == n)
        text = np.concatenate([text, few.astype(text.dtype)])
        shingle = np.concatenate([shingle, windows(h, n)[words.at[few]]])
    if len(texts) == 1:
        shingle.sort()
    else:
        order = np.lexsort((shingle, text))
        text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    return a, b, text[first], shingle[first], np.diff(np.append(first, len(text)))


def signatures(n: int, text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, m: int = ROWS * BANDS) -> np.ndarray:
    """BagMinHash signatures (n x m) of n bags given by their shingles and integer weights; rows of empty bags are 0."""
    out = np.zeros((n, m), np.uint64)
    total = np.bincount(text, weights=weight, minlength=n)
    todo, slack = total > 0, 4.0
    while todo.any():
        best, value = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
        limit = (np.log(m) + slack) / np.maximum(total, 1)
        for i in range(0, len(text), UNITS):
            some = slice(i, i + UNITS)
            cell, t, v = points(text[some], shingle[some], weight[some], limit, todo, m)
            np.minimum.at(best, cell, t)
            win = t == best[cell]
            value[cell[win]] = v[win]
        full = todo & np.isfinite(best.reshape(n, m)).all(axis=1)
        out[full] = value.reshape(n, m)[full]
        todo, slack = todo & ~full, slack * 2
    return out


def points(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, limit: np.ndarray, todo: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of the processes of some shingles up to their text's limit: cell (text * m + component), time and value."""
    # levels: 0 is [0, 1), and level j > 0 is [2 ** (j - 1), 2 ** j)
    levels = np.where(todo[text], 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64), 0)
    unit = np.repeat(np.arange(len(text)), levels)
    level = np.arange(len(unit)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    length = np.maximum(low, 1)
    seed = mix(shingle[unit] + level.astype(np.uint64) * U64(0xA24BAED4963EE407))
    own, most = text[unit].astype(np.int64), weight[unit] - low
    live = np.arange(len(unit))
    time, count, step = np.zeros(len(live)), 0, 1
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64))]
    while len(live):
        draw = mix(seed[live, None] + np.arange(count + 1, count + step + 1, dtype=np.uint64)[None, :] * U64(0x9E3779B97F4A7C15))
        gap = -np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = time[:, None] + np.cumsum(gap, axis=1) / (m * length[live])[:, None]
        i, j = np.nonzero(times <= limit[own[live]][:, None])
        at = live[i]
        second = mix(draw[i, j] ^ U64(0xD1342543DE82EF95))
        inside = (second & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * length[at] < most[at]
        at, second, t = at[inside], second[inside], times[i, j][inside]
        found.append((own[at] * m + ((second >> U64(32)) % U64(m)).astype(np.int64), t, second))
        stay = times[:, -1] <= limit[own[live]]
        live, time = live[stay], times[stay, -1]
        count, step = count + step, min(64, step * 4)
    cell, t, v = (np.concatenate(x) for x in zip(*found, strict=True))
    return cell, t, v


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each signature."""
    n, m = signature.shape
    parts = signature.reshape(n, m // rows, rows)
    out = np.zeros((n, m // rows), np.uint64) + np.arange(1, m // rows + 1, dtype=np.uint64)[None, :]
    for i in range(rows):
        out = mix(out * U64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return out


def sketch(texts: pa.Array) -> dict:
    a, b, text, shingle, weight = bags(texts)
    n = len(texts)
    some = np.bincount(text, minlength=n) > 0
    h = np.zeros((n, BANDS), np.int64)
    for i in range(0, n, AT_ONCE):
        k = slice(*np.searchsorted(text, [i, i + AT_ONCE]))
        h[i : i + AT_ONCE] = bands(signatures(min(AT_ONCE, n - i), text[k] - i, shingle[k], weight[k])).view(np.int64)
    none = pa.array(~some)
    held = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h.shape[1], pa.int32()), pa.array(h.ravel()))
    null = lambda x: pa.array(x.view(np.int64), pa.int64(), mask=~some)
    return {"a": null(a), "b": null(b), "bands": pa.ListArray.from_arrays(held.offsets, held.values, mask=none)}


def tokens(texts: pa.Array) -> list[np.ndarray]:
    """The bag of each text as a sorted set: copy i of a shingle is a token of its own."""
    _, _, text, shingle, weight = bags(texts)
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    all_ = mix(np.repeat(shingle, weight) + copy.astype(np.uint64) * U64(0xC2B2AE3D27D4EB4F))
    return np.split(all_, np.cumsum(np.bincount(text, weights=weight, minlength=len(texts)).astype(np.int64))[:-1])


def forest(node: np.ndarray, side: np.ndarray, at: np.ndarray, token: np.ndarray, threshold: float, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of all pairs of documents with a Jaccard similarity of threshold or more.

    Document i has node[i] and the tokens token[at[i]:at[i + 1]]. With two sides only pairs across them count.
    Documents that are ``known`` to be of one class aren't compared.
    Exact: a pair must share one of the rarest tokens of both (prefix filter); what is left of these tokens
    bounds the overlap (positional filter); then the overlap is counted.
    """
    n, size = len(node), np.diff(at)
    two = side.min() != side.max()
    ids, inv = np.unique(token, return_inverse=True)
    freq = np.bincount(inv)
    owner = np.repeat(np.arange(n), size)
    order = np.lexsort((inv, freq[inv], owner))
    place = np.arange(len(inv)) - np.repeat(at[:-1], size)
    need = np.ceil(threshold * size - 1e-9).astype(np.int64)
    keep = (place <= (size - need)[owner]) & (freq[inv[order]] > 1)
    p_token, p_owner, p_place = inv[order][keep], owner[keep], place[keep]
    by = np.argsort(p_token, kind="stable")
    post_owner, post_place = p_owner[by], p_place[by]
    start = np.searchsorted(p_token[by], np.arange(len(ids) + 1))
    mine = np.searchsorted(p_owner, np.arange(n + 1))
    root = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    rank = np.argsort(np.argsort(size, kind="stable"), kind="stable")
    marked = np.zeros(len(ids), bool)
    share = threshold / (1 + threshold)
    edges: list[tuple[int, int]] = []
    for x in np.argsort(size, kind="stable").tolist():
        t, i = p_token[mine[x] : mine[x + 1]], p_place[mine[x] : mine[x + 1]]
        many = start[t + 1] - start[t]
        if not many.sum():
            continue
        all_ = np.repeat(start[t], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        y = post_owner[all_]
        ok = (rank[y] < rank[x]) & (root[y] != root[x]) & (size[y] >= threshold * size[x] - 1e-9)
        if two:
            ok &= side[y] != side[x]
        y, left = y[ok], np.minimum(size[x] - np.repeat(i, many)[ok], (size[y] - post_place[all_])[ok])
        y = np.unique(y[left >= share * (size[x] + size[y]) - 1e-9])
        own = inv[at[x] : at[x + 1]]
        marked[own] = True
        while len(y):
            now, y = y[:64], y[64:]
            count = np.add.reduceat(marked[np.concatenate([inv[at[k] : at[k + 1]] for k in now])].astype(np.int64), np.cumsum(size[now]) - size[now])
            for k in now[count >= share * (size[x] + size[now]) - 1e-9].tolist():
                if root[k] != root[x]:
                    edges.append((int(node[x]), int(node[k])))
                    root[root == root[k]] = root[x]
            y = y[root[y] != root[x]]
        marked[own] = False
    return edges


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def links(placed: DataFrame, n: int, threshold: float) -> DataFrame:
    """The links (u, v) in each place (component, i, j) of rows with side, label (of the class that is known), node and packed text."""
    ready()

    def verify(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        found = [t for b in rows.to_batches() for part in groups(pa.RecordBatch.from_arrays([unpacked(b.column("packed"))], ["text"]), "text") for t in tokens(part.column(0))]
        at = np.concatenate(([0], np.cumsum([len(t) for t in found])))
        edges = forest(rows["node"].to_numpy(), rows["side"].to_numpy(), at, np.concatenate(found), threshold, rows["label"].to_numpy())
        give_back()
        return pa.Table.from_pydict({"u": [a for a, _ in edges], "v": [b for _, b in edges]}, schema=LINKS)

    return placed.repartition(max(1, -(-n // TASK)), "component", "i", "j").groupBy("component", "i", "j").applyInArrow(verify, "u long, v long")


def across(members: DataFrame, found: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The links between classes of the links found so far: members (component, node) of components beyond a block."""
    classes = components(found.join(members.select(F.col("node").alias("u")), "u", "left_semi"), "classes")
    labelled = written(members.join(classes.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    sizes = labelled.groupBy("component", "label").agg(F.count("*").alias("size"))
    small = F.col("size") < BLOCK // 2
    rest = sizes.groupBy("component").agg(F.sum(F.when(small, F.col("size")).otherwise(0)).alias("rest"), F.count("*").alias("labels")).where("labels > 1")
    # a class of some size has blocks of its own, the others share blocks
    sizes = sizes.join(rest, "component").select("component", "label", small.alias("small"), F.greatest(F.lit(1), F.ceil(F.when(small, F.col("rest")).otherwise(F.col("size")) / BLOCK)).alias("blocks"))
    own = F.when(F.col("small"), F.concat(F.lit("-/"), F.pmod(F.xxhash64("label"), F.col("blocks")))).otherwise(F.concat(F.col("label"), F.lit("/"), F.pmod(F.xxhash64("node"), F.col("blocks"))))
    blocked = written(labelled.join(sizes, ["component", "label"]).withColumn("block", own).select("component", "label", "node", "block"), "blocked")
    blocks = blocked.select("component", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "i").join(blocks.withColumnRenamed("block", "j"), "component").where("i <= j")
    pairs = pairs.where("substring_index(i, '/', 1) <> substring_index(j, '/', 1) OR i LIKE '-/%'")
    sides = F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side")))))
    sent = pairs.withColumn("s", sides).select("component", "i", "j", "s.*").join(blocked, ["component", "block"])
    n = sent.count()
    return links(sent.join(texts.hint("merge"), "node").select("component", "i", "j", "side", "label", "node", "packed"), n, threshold)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, class_id (the smallest id of its class), kept (whether it is that document).

    A class is a connected set of links; two documents are linked if the weighted Jaccard similarity of their bags
    is at least the threshold. Equal word sequences are one document to the search, so copies cost nothing. A
    text without words is in a class of its own. Null ids are larger than all others: a class of nothing else has a
    null class_id. Of different texts of a class that share its smallest id, that with the smallest text_hash
    (xxhash64 of the text) is kept; of rows that agree in id and text, all or none. Other columns are ignored; an
    empty table gives no rows. A very long text is handled alone, by a worker that holds some
    twelve times its size.
    """
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    own = own.withColumns({"mid": F.monotonically_increasing_id(), "text_hash": F.xxhash64("text"), "packed": packed(F.col("text"))})
    sketches = written(own.withColumn("s", text_udf(sketch, "a long, b long, bands array<long>")("text")).select("mid", "doc_id", "text_hash", "packed", "s.*"), "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    some = sketches.where("a IS NOT NULL").groupBy("a", "b").agg(F.min(F.struct(order.alias("first"), "mid")).alias("m"), F.first("bands").alias("bands"))
    contents = written(some.select(F.col("m.mid").alias("node"), "a", "b", F.col("m.first").alias("first"), "bands"), "contents")

    banded = contents.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("v"), F.max("node").alias("w")).where("v < w").select("band", "v")
    candidates = components(banded.join(least.hint("merge"), "band").where("node <> v").select(F.col("node").alias("u"), "v"), "candidates")
    members = candidates.unionByName(candidates.select(F.col("component").alias("node"), "component").distinct())
    parts = members.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    members = written(members.join(parts, "component"), "members")
    mine = F.array(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = members.withColumn("i", F.explode(F.when(F.col("node") == F.col("component"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(mine)))
    texts = sketches.select(F.col("mid").alias("node"), "packed")
    sent = texts.join(placed.hint("merge"), "node").select("component", "i", F.col("i").alias("j"), F.lit(0).alias("side"), F.col("node").alias("label"), "node", "packed")
    found = written(links(sent, members.count(), threshold), "links")
    large = members.where("parts > 1").select("component", "node")
    if not large.isEmpty():
        found = found.unionByName(written(across(large, found, texts, threshold), "links"))

    classes = components(found, "classes")
    of = classes.unionByName(classes.select(F.col("component").alias("node"), "component").distinct())
    firsts = contents.select("node", "first").join(of, "node").groupBy("component").agg(F.min("first").alias("least"))
    # a table, so that the planner can split a text that many documents have
    named = contents.select("a", "b", "node", "first").join(of, "node", "left").join(firsts, "component", "left")
    named = written(named.select("a", "b", F.coalesce("least", "first").alias("least")), "named")
    out = sketches.select("doc_id", "text_hash", "a", "b").join(named, ["a", "b"], "left")
    alone = F.col("least").isNull()
    return out.select(
        "doc_id",
        "text_hash",
        F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash")))).alias("kept"),
    )


def op5_nearcopies(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text_hash")
