"""Substring dedup by fixed-block anchors.

Every document's words are cut into non-overlapping reference blocks of ``block`` words. All rolling windows of
as many words are probed against them; any repeat of ``window >= 2 * block - 1`` words holds a whole reference
block of its first occurrence, so it is hit. Hits are extended to all windows of ``window`` words around them;
of these the first occurrence in the corpus stays and the others go, which is the same as removing the later
copies of all maximal exact repeats.

What is shuffled is packed: a worker gathers a chunk of texts and sends, to each of many cells of the hash space,
a few bytes for each distinct window in the chunk. So a window that is everywhere costs a cell one entry for
each chunk. Cells answer by chunk, chunks by document; no pairs are ever made. Where there are more cells than a chunk
has messages for, the cells form groups: a chunk sends to groups, and merges of many chunks' messages to one group
send to its cells. So a chunk has a bounded number of messages, and none holds only a few windows, at any size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import written
from tessella.llm.textkit import SPACED, U64, Texts, Words, covered, give_back, groups, lists, runs, whole, windows
from tessella.llm.workers import ready

#: Bytes of text in a chunk, and entries that a cell of the hash space has about.
CHUNK_BYTES, CELL = 4 << 20, 1 << 20
#: Messages of a chunk at most: more cells than that are reached by way of merges, of about MERGE entries each.
GROUPS, MERGE = 8192, 4 << 20
MESSAGE = pa.schema(
    [("cell", pa.int32()), ("chunk", pa.int64()), ("first", pa.int64()), ("gaps", pa.binary()), ("wide", pa.binary()), ("hash", pa.binary()), ("ids", pa.binary()), ("flags", pa.binary()), ("base", pa.int64()), ("table", pa.binary()), ("offsets", pa.binary())]
)
MESSAGE_DDL = "cell int, chunk long, first long, gaps binary, wide binary, hash binary, ids binary, flags binary, base long, table binary, offsets binary"
NO_ID = -(2**63)


def packed(text: Column) -> Column:
    """Texts as zstd frames, for a shuffle."""
    ready()

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        return pa.array([None if t is None else c.compress(t) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())

    return pack(text)


def unpacked(column: pa.Array) -> pa.Array:
    import zstandard

    d = zstandard.ZstdDecompressor()
    return pa.array([None if z is None else d.decompress(z) for z in column.to_pylist()], pa.binary()).cast(pa.string())


def close(at: np.ndarray) -> tuple[int, bytes, bytes]:
    """Rising numbers as the first, one byte for each step, and the steps of 255 or more."""
    steps = np.diff(at)
    wide = steps[steps >= 255]
    return int(at[0]), np.minimum(steps, 255).astype(np.uint8).tobytes(), wide.astype(np.uint32).tobytes()


def opened(first: int, gaps: bytes, wide: bytes) -> np.ndarray:
    steps = np.frombuffer(gaps, np.uint8).astype(np.int64)
    steps[steps == 255] = np.frombuffer(wide, np.uint32)
    return first + np.concatenate(([0], np.cumsum(steps)))


class Rows:
    """Rows of a schema, gathered by name."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.held = schema, {name: [] for name in schema.names}

    def add(self, **values) -> None:
        for k, held in self.held.items():
            held.append(values.get(k))

    def table(self) -> pa.Table:
        return pa.Table.from_pydict(self.held, schema=self.schema)


def send_cells(rows: Rows, chunk: int, ordered: bool, cell: np.ndarray, place: np.ndarray, h: np.ndarray, *rest: np.ndarray, low: np.ndarray | None = None) -> None:
    """Adds a message of entries (place and what read() gives) to each cell; sorted by cell and place. low: 16 more bits of the hash, for the cells of a group."""
    cuts = np.flatnonzero(np.diff(cell)) + 1 if len(cell) else np.zeros(0, np.int64)
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True) if len(cell) else ():
        start, gaps, wide = close(place[a:b])
        if ordered:
            more, own = (x[a:b] for x in rest)
            base = int(own.min())
            apart = own.astype(np.uint64) - np.array(base).astype(np.uint64)
            extra = {"base": base, "ids": apart.astype(np.uint32 if int(apart.max()) < 2**32 else np.uint64).tobytes(), "hash": h[a:b].tobytes() + more.tobytes()}
        else:
            extra = {"flags": np.packbits(np.concatenate([x[a:b] for x in rest])).tobytes(), "hash": h[a:b].astype(np.uint32).tobytes() + (b"" if low is None else low[a:b].tobytes())}
        rows.add(cell=int(cell[a]), chunk=chunk, first=start, gaps=gaps, wide=wide, **extra)


def read(message: dict, ordered: bool) -> tuple[np.ndarray, ...]:
    """The entries of a message: hash, second hash, id (ordered), or hash, whether it is a reference block, and whether the chunk holds it twice."""
    n = len(message["gaps"]) + 1
    if ordered:
        h, more = np.frombuffer(message["hash"], np.uint64).reshape(2, n)
        return h, more, np.frombuffer(message["ids"], np.uint32 if len(message["ids"]) == 4 * n else np.uint64).astype(np.int64) + message["base"]
    bits = np.unpackbits(np.frombuffer(message["flags"], np.uint8), count=2 * n).astype(bool)
    return np.frombuffer(message["hash"], np.uint32, n), bits[:n], bits[n:]


def place_of(h: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each hash, and 16 bits that tell the cells of the group."""
    high = (h >> U64(32)) * U64(groups)
    return (high >> U64(32)).astype(np.int64), ((high & U64(0xFFFFFFFF)) >> U64(16)).astype(np.uint16)


class Chunk:
    """What a worker has gathered of some texts: the windows to send, by hash, place, and the id that orders their texts.

    ``name`` tells chunks of one job apart: equal texts may well make equal chunks. Windows that are ordered have
    two hashes of their own, 128 bits in all: what is equal there goes without another look.
    """

    def __init__(self, cells: int, ordered: bool, name: str, grouped: bool = False):
        self.cells, self.ordered, self.name, self.grouped = cells, ordered, name, grouped
        self.ids: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words = self.bytes = 0

    def add(self, ids: np.ndarray, keys: np.ndarray, words: Words, place: np.ndarray, hashes: np.ndarray, more: np.ndarray) -> None:
        """place: windows' places among all words of the call; more: their second hashes, or (not ordered) which are reference blocks."""
        self.parts.append((hashes, place + self.words, more, np.repeat(ids, np.diff(np.searchsorted(place, words.at)))))
        self.ids.append(ids)
        self.keys.append(keys)
        self.n.append(words.n)
        self.words += int(words.n.sum())
        self.bytes += len(words.buf)

    def messages(self) -> Iterator[pa.RecordBatch]:
        if not self.ids:
            return
        ids, keys, n = (np.concatenate(x) for x in (self.ids, self.keys, self.n))
        table, offsets = np.concatenate([ids, keys]).tobytes(), np.concatenate(([0], np.cumsum(n))).astype(np.int64).tobytes()
        chunk = int.from_bytes(hashlib.blake2b(table + offsets + self.name.encode(), digest_size=8).digest(), "little") >> 1
        h, place, more, own = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((place, own, more, h)) if self.ordered else np.argsort(h, kind="stable")
        h, place, more, own = h[order], place[order], more[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        if self.ordered:
            new[1:] |= more[1:] != more[:-1]
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(h))) > 1
        # the answer that needs no cell: later copies (in order), or all copies
        known = ~new if self.ordered else np.repeat(many, np.diff(np.append(first, len(h))))
        self_hits = np.sort(place[known])
        more = more[first] if self.ordered or not len(first) else np.logical_or.reduceat(more, first)
        h, place, own = h[first], place[first], own[first]
        cell, low = place_of(h, self.cells)
        order = np.lexsort((place, cell))
        h, place, own, cell, more, many, low = (x[order] for x in (h, place, own, cell, more, many, low))
        rows = Rows(MESSAGE)
        send_cells(rows, chunk, self.ordered, cell, place, h, more, own if self.ordered else many, low=low if self.grouped else None)
        start, gaps, wide = close(self_hits) if len(self_hits) else (None, None, None)
        rows.add(cell=-1 - chunk % self.cells, chunk=chunk, first=start, gaps=gaps, wide=wide, table=table, offsets=offsets)
        yield from rows.table().to_batches(512)


def send(df: DataFrame, gather: Callable[[Chunk, pa.RecordBatch], None], cells: int, ordered: bool, column: str, grouped: bool = False) -> DataFrame:
    """Messages of chunks of df's rows: gather(chunk, rows) adds some rows to a chunk."""
    ready()

    def run(batches):
        from pyspark import TaskContext

        part_of, n = TaskContext.get().partitionId(), 0
        chunk = Chunk(cells, ordered, f"{part_of}/{n}", grouped)
        for batch in batches:
            for part in groups(batch, column):
                gather(chunk, part)
                if chunk.bytes >= CHUNK_BYTES:
                    yield from chunk.messages()
                    n += 1
                    chunk = Chunk(cells, ordered, f"{part_of}/{n}", grouped)
                    give_back()
        yield from chunk.messages()
        give_back()

    return df.mapInArrow(run, MESSAGE_DDL)


ANSWER = pa.schema([("chunk", pa.int64()), ("first", pa.int64()), ("gaps", pa.binary()), ("wide", pa.binary()), ("table", pa.binary()), ("offsets", pa.binary())])
ANSWER_DDL = "chunk long, first long, gaps binary, wide binary, table binary, offsets binary"


def judge_cells(messages: DataFrame, ordered: bool) -> DataFrame:
    """Answers of cells to chunks. Not ordered: windows found twice or more and at least once as a reference block. Ordered: all but the first occurrence."""
    ready()

    def judge(messages: pa.Table) -> pa.Table:
        rows = messages.to_pylist()
        if rows[0]["cell"] < 0:
            return messages.select(ANSWER.names).cast(ANSWER)
        rows.sort(key=lambda r: r["chunk"])
        parts = [read(r, ordered) for r in rows]
        n = np.array([len(x[0]) for x in parts])
        (h, *rest), row = [np.concatenate(x) for x in zip(*parts, strict=True)], np.repeat(np.arange(len(rows)), n)
        if ordered:
            more, own = rest
            order = np.lexsort((row, own, more, h))
            hit = np.zeros(len(h), bool)
            hit[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (more[order[1:]] == more[order[:-1]])
        else:
            flag, many = rest
            order = np.argsort(h, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], h[order[1:]] != h[order[:-1]])))
            sizes = np.diff(np.append(first, len(h)))
            good = ((sizes > 1) | np.logical_or.reduceat(many[order], first)) & np.logical_or.reduceat(flag[order], first)
            hit = np.zeros(len(h), bool)
            hit[order] = np.repeat(good, sizes)
            hit &= ~many
        out, at = Rows(ANSWER), np.concatenate(([0], np.cumsum(n)))
        for i, r in enumerate(rows):
            mine = hit[at[i] : at[i + 1]]
            if mine.any():
                first, gaps, wide = close(opened(r["first"], r["gaps"], r["wide"])[mine])
                out.add(chunk=r["chunk"], first=first, gaps=gaps, wide=wide)
        give_back()
        return out.table()

    return messages.groupBy("cell").applyInArrow(judge, ANSWER_DDL)


def split(messages: DataFrame, fine: int, slices: int, ordered: bool) -> DataFrame:
    """Messages to groups as messages to the ``fine`` cells of each group, from merges: ``slices`` for each group, by chunk.

    A merge is to the cells what a chunk is: its places are its entries, in the order of chunks. It has a negative
    name, and sends itself the places of its chunks' messages, by way of cells below 0, as chunks do their tables.
    """
    ready()

    def merge(messages: pa.Table) -> pa.Table:
        rows = messages.to_pylist()
        group = rows[0]["cell"]
        if group < 0:
            return messages.select(MESSAGE.names).cast(MESSAGE)
        rows.sort(key=lambda r: r["chunk"])
        name = -1 - (group * slices + rows[0]["chunk"] % slices)
        parts = [read(r, ordered) for r in rows]
        at = np.concatenate(([0], np.cumsum([len(x[0]) for x in parts])))
        h, *rest = (np.concatenate(x) for x in zip(*parts, strict=True))
        if ordered:
            low = place_of(h, groups)[1]
        else:
            low = np.concatenate([np.frombuffer(r["hash"], np.uint16, offset=4 * len(x[0])) for r, x in zip(rows, parts, strict=True)])
        cell = group * fine + (low.astype(np.int64) * fine >> 16)
        order = np.argsort(cell, kind="stable")
        out = Rows(MESSAGE)
        send_cells(out, name, ordered, cell[order], order, h[order], *(x[order] for x in rest))
        for r, start in zip(rows, at.tolist()):
            out.add(cell=-1 - (-1 - name) % groups, chunk=name, first=r["first"], gaps=r["gaps"], wide=r["wide"], table=np.array([r["chunk"], start]).tobytes())
        give_back()
        return out.table()

    groups = GROUPS
    return messages.withColumn("slice", F.pmod("chunk", F.lit(slices))).groupBy("cell", "slice").applyInArrow(merge, MESSAGE_DDL)


def joined_answers(answers: DataFrame) -> DataFrame:
    """Answers to merges as answers to their chunks; those to chunks as they are."""
    ready()

    def part(answers: pa.Table) -> pa.Table:
        rows = answers.to_pylist()
        if rows[0]["chunk"] >= 0:
            return answers.select(ANSWER.names).cast(ANSWER)
        found = [opened(r["first"], r["gaps"], r["wide"]) for r in rows if r["table"] is None]
        sent = sorted(((*np.frombuffer(r["table"], np.int64).tolist(), r) for r in rows if r["table"] is not None), key=lambda x: x[1])
        out = Rows(ANSWER)
        if found:
            if not sent:
                raise RuntimeError("a merge's table is missing: the documents must be a table, or come in the same order on each run")
            found = np.sort(np.concatenate(found))
            cut = np.searchsorted(found, [*(start for _, start, _ in sent), sent[-1][1] + len(sent[-1][2]["gaps"]) + 1])
            for (chunk, start, r), a, b in zip(sent, cut[:-1].tolist(), cut[1:].tolist()):
                if b > a:
                    first, gaps, wide = close(opened(r["first"], r["gaps"], r["wide"])[found[a:b] - start])
                    out.add(chunk=chunk, first=first, gaps=gaps, wide=wide)
        give_back()
        return out.table()

    return answers.groupBy("chunk").applyInArrow(part, ANSWER_DDL)


def ask(df: DataFrame, gather: Callable[[Chunk, pa.RecordBatch], None], cells: int, ordered: bool, column: str) -> DataFrame:
    """Answers to the chunks of df's rows; see send() and judge_cells()."""
    if cells <= GROUPS:
        return judge_cells(send(df, gather, cells, ordered, column), ordered)
    fine = -(-cells // GROUPS)
    messages = split(send(df, gather, GROUPS, ordered, column, True), fine, -(-fine * CELL // MERGE), ordered)
    return joined_answers(judge_cells(messages, ordered))


def answered(answers: DataFrame, name: str) -> DataFrame:
    """doc_id, text_hash, and a list ``name`` of the hit places in the document (also an empty one)."""
    ready()
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), (name, pa.list_(pa.int32()))])

    def gather(answers: pa.Table) -> pa.Table:
        rows = answers.to_pylist()
        table = next((r for r in rows if r["table"] is not None), None)
        if table is None:
            raise RuntimeError("a chunk's table is missing: the documents must be a table, or come in the same order on each run")
        places = [opened(r["first"], r["gaps"], r["wide"]) for r in rows if r["first"] is not None]
        at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
        ids, keys = np.frombuffer(table["table"], np.int64).reshape(2, -1)
        offsets = np.frombuffer(table["offsets"], np.int64)
        cut = np.searchsorted(at, offsets)
        return pa.Table.from_arrays([pa.array(ids), pa.array(keys), lists(pa.array(at - np.repeat(offsets[:-1], np.diff(cut)), pa.int32()), cut)], schema=schema)

    return answers.groupBy("chunk").applyInArrow(gather, f"doc_id long, text_hash long, {name} array<int>")


def row_key(id_column: str, text_column: str) -> list[Column]:
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash")]


def find_repeats(docs: DataFrame, window: int = 20, block: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_hash, removed: the starts of windows of the document that also start earlier. Documents without a removed window may be absent.

    Earlier is a smaller id, or the same document and a smaller place. Null ids come first. Rows that agree in id
    and text are one document; of rows that agree in id alone and share a window, one counts as the first.
    """
    if window < 2 * block - 1:
        raise ValueError("a window must hold a whole block wherever it starts")
    own = docs.select(*row_key(id_column, text_column), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells = max(1, -(-total // (6 * CELL)))

    def probe(chunk: Chunk, rows: pa.RecordBatch) -> None:
        words = Texts(rows.column("text")).words(SPACED)
        h = words.hashes()
        place = np.flatnonzero(whole(words.at, block, len(h)))
        reference = (place - np.repeat(words.at[:-1], np.diff(np.searchsorted(place, words.at)))) % block == 0
        chunk.add(rows.column("doc_id").to_numpy(), rows.column("text_hash").to_numpy(), words, place, windows(h, block)[place], reference)

    hits = answered(ask(own, probe, cells, False, "text"), "hits").where(F.size("hits") > 0)
    hits = written(hits.groupBy("doc_id", "text_hash").agg(F.first("hits").alias("hits")), "anchors")

    def extend(chunk: Chunk, rows: pa.RecordBatch) -> None:
        texts = unpacked(rows.column("packed"))
        for part in groups(pa.RecordBatch.from_arrays([texts, rows.column("doc_id"), rows.column("text_hash"), rows.column("hits")], ["text", "doc_id", "text_hash", "hits"]), "text"):
            words = Texts(part.column("text")).words(SPACED)
            h = words.hashes()
            near = np.zeros(len(h) + 1, np.int64)
            for a, b, hit in zip(words.at[:-1].tolist(), words.at[1:].tolist(), part.column("hits"), strict=True):
                at = hit.values.to_numpy() + a
                np.add.at(near, np.maximum(at - (window - block), a), 1)
                np.add.at(near, at + 1, -1)
            place = np.flatnonzero((np.cumsum(near)[: max(0, len(h) - window + 1)] > 0) & whole(words.at, window, len(h)))
            chunk.add(part.column("doc_id").to_numpy(), part.column("text_hash").to_numpy(), words, place, windows(h, window)[place], windows(words.hashes(1), window)[place])

    sent = own.select("doc_id", "text_hash", packed(F.col("text")).alias("packed")).join(hits.hint("merge"), ["doc_id", "text_hash"]).sortWithinPartitions("doc_id", "text_hash")
    removed = answered(ask(sent, extend, cells, True, "packed"), "removed")
    return removed.groupBy("doc_id", "text_hash").agg(F.min_by("removed", F.size("removed")).alias("removed")).where(F.size("removed") > 0)


def cut(texts: pa.Array, removed: pa.Array, window: int, joined: bool) -> dict:
    """n_words, n_removed, and what is kept: all kept words joined by a blank, or the text without the removed words (and the blanks before them)."""
    words = Texts(texts).words(SPACED)
    sizes = np.diff(removed.offsets.to_numpy())
    starts = removed.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.at[:-1], sizes)
    gone = covered(starts, window, len(words.start))
    raw = words.texts.buf.tobytes()
    kept = []
    for i in range(words.texts.n):
        a, b = words.at[i], words.at[i + 1]
        left = np.flatnonzero(~gone[a:b]) + a
        if joined:
            kept.append(b" ".join([raw[s:e] for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)]))
        elif len(left) == b - a:
            kept.append(raw[words.texts.start[i] : words.texts.end[i]])
        else:
            first, end, _ = runs(~gone[a:b], np.array([0, b - a]))
            pieces = [raw[words.start[a + s] : words.end[a + e - 1]] for s, e in zip(first.tolist(), end.tolist(), strict=True)]
            kept.append(b" ".join(pieces))
    d = np.concatenate(([0], np.cumsum(gone)))
    return {"n_words": words.n, "n_removed": d[words.at[1:]] - d[words.at[:-1]], "kept": kept}


def cut_udf(schema: str, window: int, joined: bool, finish: Callable[[list[bytes]], pa.Array]):
    """A column function of (packed text, removed): n_words, n_removed, and ``finish`` of what is kept. Texts are unpacked some at a time."""
    ready()

    @F.arrow_udf(schema)
    def run(texts: pa.Array, removed: pa.Array) -> pa.Array:
        parts = []
        for part in groups(pa.RecordBatch.from_arrays([texts, removed], ["packed", "removed"]), "packed"):
            got = cut(unpacked(part.column("packed")), part.column("removed"), window, joined)
            parts.append(pa.StructArray.from_arrays([pa.array(got["n_words"], pa.int64()), pa.array(got["n_removed"], pa.int64()), finish(got["kept"])], [c.split()[0] for c in schema.split(", ")]))
        give_back()
        return pa.concat_arrays(parts)

    return run


def with_repeats(docs: DataFrame, window: int, block: int, id_column: str, text_column: str) -> DataFrame:
    """docs with ``__packed_text`` in place of the text, and ``__removed``."""
    found = find_repeats(docs, window, block, id_column, text_column).withColumnsRenamed({"doc_id": "__key_id", "text_hash": "__key_hash", "removed": "__removed"})
    key = row_key(id_column, text_column)
    keyed = docs.withColumns({"__key_id": key[0], "__key_hash": key[1], "__packed_text": packed(F.col(text_column))}).drop(text_column)
    return keyed.join(found, ["__key_id", "__key_hash"], "left").withColumn("__removed", F.coalesce("__removed", F.array().cast("array<int>"))).drop("__key_id", "__key_hash")


def remove_repeats(docs: DataFrame, window: int = 20, block: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs with each text cut: words of windows that also start earlier are gone; and a struct column ``repeats``: n_words, n_removed.

    A text that loses nothing stays as it is, one that loses words keeps the white space inside its kept runs,
    with one blank where words went. Null texts come out as null, and lose nothing. Other columns pass through,
    one named ``repeats`` is replaced. An empty table gives no rows. Rows that agree in id and text are one document:
    each keeps what the first keeps. A very long text is a chunk of its own, whose worker holds about thirty times its size.
    """
    own = docs.drop("repeats")

    run = cut_udf("n_words long, n_removed long, kept string", window, False, lambda kept: pa.array(kept, pa.binary()).cast(pa.string()))
    out = with_repeats(own, window, block, id_column, text_column).withColumn("__cut", run("__packed_text", "__removed"))
    out = out.withColumn(text_column, F.when(F.col("__packed_text").isNotNull(), F.col("__cut.kept"))).withColumn("repeats", F.struct("__cut.n_words", "__cut.n_removed"))
    return out.select(*own.columns, "repeats")


def op6_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    digest = cut_udf("n_words long, n_removed long, kept_sha256 string", 20, True, lambda kept: pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
    return with_repeats(docs, 20, 10, "doc_id", "text").select("doc_id", digest("__packed_text", "__removed").alias("d")).select("doc_id", "d.*")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM win),
gone AS (SELECT DISTINCT doc_id, p FROM ranked, unnest(range(i, i + 20)) AS t(p) WHERE k > 1),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
