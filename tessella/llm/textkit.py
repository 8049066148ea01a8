"""Vectorised text primitives: words, word hashes and window hashes over Arrow batches.

A batch of texts is laid out as one byte buffer with a separator between texts. A hash of bytes chains a
multiply-xorshift step over eight bytes at a time (long spans go through BLAKE2b); a window hash chains the like
over word hashes, by doubling. Neither is a polynomial, so no fixed pattern of words cancels out.

Beside the buffer, memory goes by words (about 24 bytes each), not by bytes: temporaries are made for some
words at a time, so that one very long text costs a small multiple of its size.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessella.llm.workers import ready

U64 = np.uint64
_LIBC = ctypes.CDLL(None) if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim") else None
#: Texts are handled in groups of about this many bytes, so that temporaries stay small.
GROUP_BYTES = 400_000
#: Bytes that are searched for words at once, spans that are hashed at once, and bytes from which on a span goes through BLAKE2b.
PIECE, SPANS, LONG = 1 << 20, 1 << 16, 256
_STEP, _PAIR = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
#: Bytes of a lane that belong to a span with so many bytes left.
_LANE = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def spaced_table() -> np.ndarray:
    """True for bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def alnum_table() -> np.ndarray:
    """True for bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = True
    t[0x80:] = True
    return t


def lower_table() -> np.ndarray:
    """Byte map that lower-cases A-Z alone."""
    t = np.arange(256, dtype=np.uint8)
    t[0x41:0x5B] += 32
    return t


SPACED, ALNUM, LOWER = spaced_table(), alnum_table(), lower_table()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def span_hashes(padded: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of a buffer that goes on for 8 bytes after the last one."""
    out = np.empty(len(start), np.uint64)
    lanes = np.ndarray((max(0, len(padded) - 7),), np.uint64, padded, strides=(1,))
    salt = mix(np.array([seed + 1], np.uint64))[0]
    for i in range(0, len(start), SPANS):
        s, size = start[i : i + SPANS], end[i : i + SPANS] - start[i : i + SPANS]
        h = size.astype(np.uint64) * _PAIR ^ salt
        live, at, left, lane = None, s, size, h.copy()
        short = size < LONG
        if not short.all():
            live = np.flatnonzero(short)
            at, left, lane = s[live], size[live], h[live]
        while len(left):
            x = lanes[at]
            x &= _LANE[np.minimum(left, 8)]
            x ^= lane
            x *= _STEP
            x ^= x >> U64(32)
            if live is None:
                h = x
            else:
                h[live] = x
            more = np.flatnonzero(left > 8)
            live = more if live is None else live[more]
            at, left, lane = at[more] + 8, left[more] - 8, x[more]
        for k in np.flatnonzero(~short).tolist():
            digest = hashlib.blake2b(padded[s[k] : s[k] + size[k]], digest_size=8, salt=seed.to_bytes(8, "little")).digest()
            h[k] = int.from_bytes(digest, "little")
        out[i : i + SPANS] = mix(h)
    return out


class Texts:
    """Some texts as one buffer: text i is buf[start[i]:end[i]]; each is followed by a newline."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column.cast(pa.large_string()), "")
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(column)], pa.int64()), column), pa.scalar("\n", pa.large_string()))
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) if len(column) else np.zeros(0, np.int64)
        raw = joined[0].as_buffer() if len(column) else pa.py_buffer(b"")
        self.padded = np.full(raw.size + 9, 10, np.uint8)
        self.padded[: raw.size] = np.frombuffer(raw, np.uint8)
        self.buf = self.padded[: raw.size + 1]
        self.end = np.cumsum(sizes + 1) - 1
        self.start = self.end - sizes
        self.n = len(column)

    def words(self, table: np.ndarray = SPACED, lower: bool = False) -> "Words":
        return Words(self, table, lower)

    def count(self, of: np.ndarray) -> np.ndarray:
        """For each text its bytes that the table ``of`` holds true for."""
        places = [np.flatnonzero(of[self.buf[i : i + PIECE]]) + i for i in range(0, len(self.buf), PIECE)]
        at = np.concatenate(places) if places else np.zeros(0, np.int64)
        return np.searchsorted(at, self.end) - np.searchsorted(at, self.start)


class Words:
    """The words of some texts: byte spans, and at[i]:at[i + 1] the words of text i."""

    def __init__(self, texts: Texts, table: np.ndarray, lower: bool):
        self.texts, self.table = texts, table
        self.padded = LOWER[texts.padded] if lower else texts.padded
        self.buf = self.padded[: len(texts.buf)]
        edges, before = [], False
        for i in range(0, len(self.buf), PIECE):
            inside = table[self.buf[i : i + PIECE]]
            change = inside.copy()
            change[1:] = inside[1:] != inside[:-1]
            change[0] = inside[0] != before
            edges.append(np.flatnonzero(change) + i)
            before = inside[-1]
        all_ = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.start, self.end = all_[0::2], all_[1::2]
        self.at = np.searchsorted(self.start, np.append(texts.start, len(texts.buf)))
        self.n = np.diff(self.at)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n, dtype=np.int32), self.n)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.padded, self.start, self.end, seed)

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of BLAKE2b of each text's sequence of words, as two numbers."""
        to = np.concatenate(([0], np.cumsum(self.end - self.start + 1)))
        keep = self.table[self.buf]
        keep[self.end] = True  # one byte after each word
        flat = self.buf[keep]
        flat[to[1:] - 1] = 32
        cut = to[self.at]
        digests = b"".join(hashlib.blake2b(flat[a:b], digest_size=16).digest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
        both = np.frombuffer(digests, np.int64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of k values from each place on, for the places that have as many after them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)

    def after(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * _STEP
        x += b
        x ^= x >> U64(32)
        return x

    out, size, run, width = None, 0, hashes, 1  # out[i] stands for size values from i on, run[i] for width values
    while True:
        if k & width:
            out = run if out is None else after(out[: len(run) - size], run[size:])
            size += width
        if size == k:
            return mix(out[:n] * _PAIR + U64(k))
        run = after(run[:-width], run[width:])
        width *= 2


def whole(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of the n - k + 1 places: does a window of k from there stay within one text of the offsets at?"""
    if n < k:
        return np.zeros(0, bool)
    ok = np.ones(n + 1, bool)
    for back in range(1, k):  # places too near to the end of their text
        ok[np.maximum(at[1:] - back, at[:-1])[at[1:] > at[:-1]]] = False
    return ok[: n - k + 1]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n places are in a window of k from one of the starts."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + k, n), -1)
    return np.cumsum(d[:-1], out=d[:-1]) > 0


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values over at[i]:at[i + 1]."""
    c = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=c[1:])
    return c[at[1:]] - c[at[:-1]]


def groups(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about GROUP_BYTES of text, a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > GROUP_BYTES:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield batch.slice(first)


def give_back() -> None:
    """Hands memory that is free in this worker back to the system: a worker lives on after its task, beside others."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def map_texts(df, fn, schema: str, column: str = "text"):
    """df.mapInArrow of fn, which takes a slice of a batch and gives a dict of columns (or None)."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    ready()
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for part in groups(batch, column):
                got = fn(part)
                if got is not None and len(next(iter(got.values()))):
                    yield pa.RecordBatch.from_arrays([got[f.name].cast(f.type) if isinstance(got[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(got[f.name], f.type) for f in arrow], schema=arrow)
            give_back()

    return df.mapInArrow(run, schema)


def runs(mask: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of true places in each text: first places, ends (both counted from the text's start), and offsets of the texts' runs."""
    n = len(mask)
    opens, closes = mask.copy(), mask.copy()
    if n:
        first = np.zeros(n + 1, bool)
        first[at[:-1]] = True
        opens[1:] &= ~mask[:-1] | first[1:n]
        closes[:-1] &= ~mask[1:] | first[1:n]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    offsets = np.searchsorted(start, at)
    base = np.repeat(at[:-1], np.diff(offsets))
    return start - base, end - base, offsets


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


class Lookup:
    """Which values are among some fixed ones, and where: a bit table first, then a binary search."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        bits = min(24, max(12, int(len(self.values) * 16).bit_length()))
        self.mask = U64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.values & self.mask).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in x of values that are there, and their indices in ``values``."""
        if not len(self.values) or not len(x):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(x & self.mask).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.values, x[at]), len(self.values) - 1)
        ok = self.values[i] == x[at]
        return at[ok], i[ok]


def text_udf(fn, schema: str):
    """A column function of texts: fn takes an Arrow array of texts (about GROUP_BYTES) and gives a dict of columns; the result is a struct."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ready()
    kind = StructType.fromDDL(schema)
    fields = list(to_arrow_schema(kind))

    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        parts = []
        for part in groups(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            got = fn(part.column(0))
            parts.append(pa.StructArray.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in fields], fields=fields))
        out = pa.concat_arrays(parts) if parts else pa.array([], pa.struct(fields))
        give_back()
        return out

    return run
