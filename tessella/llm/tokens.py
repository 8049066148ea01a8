"""Token counts by a two-tier lookup on the map side, without any shuffle of pre-tokens.

Tier one is a broadcast table of frequent pre-token lengths, gathered from a bounded sample of texts.
Tier two encodes what misses it, and keeps the lengths in a cache of the worker.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.textkit import map_texts

#: Most pre-tokens in the broadcast table (a few MB), texts in the sample that it is made from, bytes that such a text may have, and lengths that a worker keeps.
TABLE, SAMPLE, SAMPLE_BYTES, CACHE = 50_000, 1_000, 1 << 15, 400_000
#: Characters of the longest pre-token that the table or a cache holds, and pre-tokens that are looked up at once.
LONGEST, AT_ONCE = 64, 1 << 16

_tokenizers: dict[str, tuple] = {}
_cache: dict[str, dict[str, int]] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def loaded(path: str) -> tuple:
    """(tokenizer, pattern of pre-tokens, pattern of special strings or None), once for each worker."""
    if path not in _tokenizers:
        import json

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        spec = json.loads(t.to_str())
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or spec["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            raise ValueError(f"{path}: the two-tier lookup is for byte-level tokenizers that split by the pattern alone")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens must match as they stand")
        special = sorted((a["content"] for a in spec["added_tokens"]), key=len, reverse=True)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t, regex.compile(public_tokenizers.PATTERN), regex.compile("|".join(map(regex.escape, special))) if special else None
        _cache[path] = {}
    return _tokenizers[path]


def pre_tokens(text: str, path: str) -> Iterator[str | None]:
    """The pre-tokens of a text, and None for each special string between them, which is one token."""
    _, pattern, special = loaded(path)
    at = 0
    for found in special.finditer(text) if special is not None else ():
        yield from map(regex_text, pattern.finditer(text, at, found.start()))
        yield None
        at = found.end()
    yield from map(regex_text, pattern.finditer(text, at) if at else pattern.finditer(text))


def regex_text(found) -> str:
    return found.group()


def lengths(texts: list[str], frequent: dict[str, int], path: str) -> list[int]:
    """Tokens of each text. Of a long text some pre-tokens are looked up at a time."""
    tokenizer, pattern, special = loaded(path)
    cache = _cache[path]
    out = [0] * len(texts)
    held: list[tuple[int, list[str]]] = []
    n = 0

    def settle() -> None:
        if len(cache) > CACHE:
            cache.clear()
        seen: set[str] = set()
        for _, parts in held:
            seen.update(parts)
        known = {x: n for x in seen if (n := frequent.get(x) or cache.get(x))}
        if missed := [x for x in seen if x not in known]:
            for x, e in zip(missed, tokenizer.encode_batch(missed, add_special_tokens=False), strict=True):
                known[x] = len(e.ids)
                if len(x) <= LONGEST:
                    cache[x] = known[x]
        for i, parts in held:
            out[i] += sum(map(known.__getitem__, parts))
        held.clear()

    for i, text in enumerate(texts):
        if len(text) < AT_ONCE and (special is None or not special.search(text)):
            held.append((i, pattern.findall(text)))
            n += len(held[-1][1])
        else:
            rest = pre_tokens(text, path)
            while parts := list(islice(rest, AT_ONCE)):
                words = [x for x in parts if x is not None]
                out[i] += len(parts) - len(words)
                held.append((i, words))
                settle()
            n = 0
        if n >= AT_ONCE:
            settle()
            n = 0
    settle()
    return out


def frequent_lengths(own: DataFrame, path: str) -> dict[str, int]:
    """Lengths of up to TABLE pre-tokens that are frequent in SAMPLE texts of up to SAMPLE_BYTES, the first that Spark comes upon: the table changes the speed, never a count."""
    count: Counter[str] = Counter()
    for (text,) in own.select("text").where(F.octet_length("text") <= SAMPLE_BYTES).take(SAMPLE):
        count.update(x for x in pre_tokens(text, path) if x is not None and len(x) <= LONGEST)
    common = [x for x, _ in count.most_common(TABLE)]
    return {x: len(e.ids) for x, e in zip(common, loaded(path)[0].encode_batch(common, add_special_tokens=False), strict=True)} if common else {}


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens as the library counts them, over_limit.

    A null text counts as empty: 0 bytes, 0 tokens. Null and repeated ids pass as they are; other columns are
    ignored; an empty table gives no rows. Special strings inside a text count as the library's default has it.
    Repeated rows get a row each. A very long text is split some pre-tokens at a time, by a worker that holds some
    six times its size; a single pre-token of many MB takes what the library takes for it.
    """
    path = path or tokenizer_path()
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(own, path))

    def count(batch: pa.RecordBatch) -> dict:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        texts = pc.fill_null(batch.column("text"), "")
        n = lengths(texts.to_pylist(), frequent.value, path)
        return {"doc_id": batch.column("doc_id"), "n_bytes": pc.binary_length(texts), "n_tokens": n, "over_limit": [x > limit for x in n]}

    return map_texts(own, count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_tokens(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
