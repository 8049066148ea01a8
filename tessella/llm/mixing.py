"""Mixing sources to target weights: water-filled targets, and cube-method balanced sampling to meet them.

A document of a source with target t and size s is taken floor(t / s) times for sure, and once more with
probability frac(t / s). The cube method draws these: it moves the probabilities of three documents at a time
along the null space of the two balancing constraints (tokens, documents) until one of them is 0 or 1. Blocks of
a source do so on their own; what is left of them, two documents a block at most, goes to the next round, and
the few of the last block are landed.

Rows that agree in id, text and source are one unit of the flight: n of them are taken n * t / s times in all, and
the fraction of that is what the cube method settles. So repeated rows cost one row, and never meet in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.shared import spare, written
from tessella.llm.textkit import SPACED, Texts, text_udf

#: Documents of a source that are handled in one block, and repeated rows that a task makes at once.
BLOCK, ROWS = 256, 1 << 16
WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2.0


def targets(sizes: Sequence[int], weights: Sequence[float], share: float = SHARE, cap: float = CAP) -> list[float]:
    """What each source gets of ``share`` times all sizes, by weight; none gets over ``cap`` times its own, and what that leaves goes to the others by weight."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit > cap * sizes[i]]
        for i in full or open_:
            out[i] = cap * sizes[i] if full else weights[i] * unit
        if not full:
            break
        left -= sum(out[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return out


def flight(p: np.ndarray, size: np.ndarray, u: np.ndarray, land: bool) -> np.ndarray:
    """The probabilities after the flight phase, in which sums of p and of p * size stay as they are; at most two are left between 0 and 1.

    With ``land`` these are settled too: first along the token constraint alone, then the last by itself. u: uniform
    draws, as many as documents: each move settles one document at least, and takes the next draw.
    """
    p, size, draws = p.tolist(), size.tolist(), iter(u.tolist())
    held: list[int] = []
    i, n, eps = 0, len(p), 1e-9

    def move(units: list[int], by: list[float]) -> None:
        up = min((1 - p[k]) / b if b > 0 else -p[k] / b for k, b in zip(units, by) if b)
        down = min(p[k] / b if b > 0 else (p[k] - 1) / b for k, b in zip(units, by) if b)
        step = up if next(draws) * (up + down) < down else -down
        for k, b in zip(units, by):
            x = p[k] + step * b
            p[k] = 0.0 if x < eps else 1.0 if x > 1 - eps else x

    while True:
        while len(held) < 3 and i < n:
            if 0 < p[i] < 1:
                held.append(i)
            i += 1
        if len(held) < 3:
            break
        a, b, c = (size[k] for k in held)
        by = [float(b - c), float(c - a), float(a - b)]
        if not any(by):
            by = [1.0, -1.0, 0.0]
        top = max(map(abs, by))
        move(held, [x / top for x in by])
        held = [k for k in held if 0 < p[k] < 1]
    if land:
        while held:
            if len(held) == 2 and size[held[0]] and size[held[1]]:
                a, b = size[held[0]], size[held[1]]
                move(held, [b / max(a, b), -a / max(a, b)])
            else:
                p[held[-1]] = 1.0 if next(draws) < p[held[-1]] else 0.0
            held = [k for k in held if 0 < p[k] < 1]
    return np.array(p)


def drawn(*key: Column, seed: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11).cast("double") + 0.5) / float(1 << 53)


def flier(level: int, last: bool):
    """The flight of one block, in an order and with draws that depend on its rows alone: large documents first, so that those left for the landing are small."""

    def fly(block: pa.Table) -> pa.Table:
        u, ids = block["u"].to_numpy(), block["doc_id"].fill_null(0).to_numpy()
        order = np.lexsort((ids, block["text_hash"].to_numpy(), u, -block["size"].to_numpy()))
        block = block.take(pa.array(order))
        draws = np.modf(u[order] * float((1 << 20) * (level + 1)))[0]
        p = flight(block["p"].to_numpy(), block["size"].to_numpy(), draws, last)
        return block.set_column(block.schema.get_field_index("p"), "p", pa.array(p)).drop_columns(["part"])

    return fly


def word_counts(texts: pa.Array) -> dict:
    return {"size": Texts(texts).words(SPACED).n}


def numbered(table: DataFrame, *by: Column) -> DataFrame:
    """A table with ``number``: the place of each row, from 0, in the order given. Ranges of rows are counted, no task sees them all."""
    parts = written(table.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    counts = parts.groupBy(part.alias("part")).count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))  # a row for each partition
    place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.withColumn("part", part).join(F.broadcast(before), "part").withColumn("number", place).drop("part", "before", "at")


def with_targets(per: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Sources (source, source_size, n) with their ``target``: targets() for any number of sources."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    per = written(numbered(per, F.col("source").asc_nulls_last()).withColumn("weight", F.get(table, (F.col("number") % len(weights)).cast("int"))), "sources")
    total, unit, full = per.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        above = F.col("weight") * unit > cap * F.col("source_size")
        size, some, weight = per.where("source_size > 0").agg(F.sum(F.when(above, F.col("source_size"))), F.count_if(above), F.sum(F.when(~above, F.col("weight")))).first()
        if weight is None or some == full:
            break
        unit, full = (share * total - cap * (size or 0)) / weight, some
    return per.withColumn("target", F.least(cap * F.col("source_size"), F.col("weight") * unit) if weight is not None else cap * F.col("source_size"))


KEY = ["doc_id", "text_hash", "source"]


def mix_units(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 1, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row for each (doc_id, text_hash, source) of docs: size, source_size, target, rows, and the copies that the mix takes of all these rows."""
    size = text_udf(word_counts, "size long")(F.col(text_column))
    sized = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_hash"), F.col(source_column).alias("source"), size["size"].alias("size"))
    units = written(sized.groupBy(*KEY, "size").agg(F.count("*").alias("rows")), "units")
    per = with_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n")), weights, share, cap)
    plan = per.select(F.col("source").alias("key"), "source_size", "target", "n")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    state = units.join(plan, F.col("source").eqNullSafe(F.col("key")), "left").withColumn("all", rate * F.col("rows")).withColumn("u", drawn(F.col("doc_id"), F.col("text_hash"), seed=seed))
    state = state.withColumn("sure", F.floor("all")).withColumn("p", F.col("all") - F.col("sure")).withColumn("m", F.col("n"))
    schema = "doc_id long, text_hash long, source string, size long, rows long, u double, source_size long, target double, sure long, p double, m long"
    state = state.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in schema.split(", ")])
    most, level, done = per.agg(F.max("n")).first()[0] or 0, 0, []
    while True:
        last = most <= BLOCK
        parts = F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(1))
        place = F.pmod(F.xxhash64(F.lit(level), "doc_id", "text_hash"), parts)

        fixed = state.where("p = 0 OR p = 1")
        moved = state.where("p > 0 AND p < 1").withColumn("part", place).groupBy("source", "part").applyInArrow(flier(level, last), schema)
        if last:
            done += [fixed, moved]
            break
        state = written(fixed.unionByName(moved), f"flight-{level}")
        done.append(state.where("p = 0 OR p = 1"))
        state = state.where("p > 0 AND p < 1").withColumn("m", 2 * F.greatest(F.ceil(F.col("m") / BLOCK), F.lit(1)))
        most, level = 2 * -(-most // BLOCK), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(*KEY, "size", "source_size", "target", "rows", (F.col("sure") + F.col("p").cast("long")).cast("long").alias("copies"))


def share_of(number: Column, rows: Column) -> Column:
    """The copies of one of a unit's rows: they share the unit's, the first of them what is left over."""
    base = F.floor(F.col("copies") / rows)
    return (base + (number < F.col("copies") - base * rows).cast("long")).cast("long")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, source, size, source_size, target, copies, taken. Options: weights, share, cap, seed, id_column, text_column, source_column.

    Sources in the order of their code points, null last, have the weights in turn, and share ``share`` times all
    words, none over ``cap`` times its own. ``copies`` says how often the mix takes a document, ``taken`` is
    copies * size. A document's draw depends on its id and text, so reruns agree. A null text has size 0;
    documents of size 0 are drawn with their source like others. Repeated rows are documents of their own, whose
    copies differ by one at most. Null ids are ids like any other. Other columns are ignored; an empty table gives
    no rows. There may be any number of sources. A very long text is counted alone, by a worker that holds some
    five times its size.
    """
    units = written(mix_units(docs, **options), "mix")
    once = units.where("rows = 1").withColumn("n", F.lit(0).cast("long"))
    many = units.where("rows > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / ROWS)))).repartition(*KEY, "block")
    each = F.sequence(F.col("block") * ROWS, F.least(F.col("rows"), (F.col("block") + 1) * ROWS) - 1)
    rows = once.unionByName(many.withColumn("n", F.explode(each)).drop("block")).withColumn("copies", share_of(F.col("n"), F.col("rows")))
    return rows.select(*KEY, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", **options) -> DataFrame:
    """The rows of docs that the mix takes, with size, source_size, target, copies and taken from mix_sources(), whose options it has.

    Rows that agree in id, text and source are numbered where the mix takes some of them more often than others.
    Columns of docs that have the name of an added one are replaced.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    plan = written(mix_units(docs, id_column=id_column, text_column=text_column, source_column=source_column, **options), "mix")
    own = docs.drop(*added)
    names = [spare(own, f"key_{c}") for c in (*KEY, "rows", "at")]
    key = names[:3]
    keyed = own.withColumns(dict(zip(key, (F.col(id_column).cast("long"), F.xxhash64(text_column), F.col(source_column)))))
    theirs = plan.where("copies > 0").select(*[F.col(c).alias(f"{k}_plan") for c, k in zip(KEY, key)], "size", "source_size", "target", "copies", F.col("rows").alias(names[3]))

    def found(units: DataFrame) -> DataFrame:
        on = [F.col(k).eqNullSafe(F.col(f"{k}_plan")) for k in key]
        return keyed.join(units, on[0] & on[1] & on[2]).drop(*[f"{k}_plan" for k in key])

    out = [*own.columns, *added]
    taken = (F.col("copies") * F.col("size")).alias("taken")
    one = found(theirs.where(F.col(names[3]) == 1)).select(*own.columns, *added[:4], taken)
    if theirs.where(F.col(names[3]) > 1).isEmpty():
        return one
    many = written(found(theirs.where(F.col(names[3]) > 1)).withColumn(names[4], F.monotonically_increasing_id()), "repeated")
    part = spare(many, "part")
    many = many.withColumn(part, F.shiftright(names[4], 33))
    before = many.groupBy(*key, part).agg(F.count("*").alias("held"))
    before = before.select(*[F.col(c).alias(f"{c}_before") for c in (*key, part)], (F.sum("held").over(Window.partitionBy(*key).orderBy(part)) - F.col("held")).alias("before"))
    on = [F.col(k).eqNullSafe(F.col(f"{k}_before")) for k in (*key, part)]
    local = F.row_number().over(Window.partitionBy(*key, part).orderBy(names[4])) - 1
    rows = many.withColumn(names[4], local).join(before, on[0] & on[1] & on[2] & on[3])
    rows = rows.withColumn("copies", share_of(F.col("before") + F.col(names[4]), F.col(names[3]))).where("copies > 0")
    return one.unionByName(rows.select(*own.columns, *added[:4], taken)).select(*out)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")
