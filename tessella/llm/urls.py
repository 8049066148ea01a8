"""URL filters: host and path rules, and a list of URLs found through a blocked Bloom filter and an exact hash join."""

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import written
from tessella.llm.workers import ready


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)

#: Bytes that the filter may have at most: it is broadcast, however long the list is. A fuller filter lets more pass to the join.
FILTER_BYTES = 32 << 20
BITS_PER_URL, WORDS = 16, 8


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host + path without a leading ``www.`` or ``m.`` label or a closing slash; scheme, query and fragment don't count. '' if there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, F.regexp_replace(path_of(url), "/+$", "")))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Index of the longest rule that fits (of equally long ones the first), else null."""
    out = F.lit(None).cast("int")
    for i, r in sorted(enumerate(rules), key=lambda x: (len(x[1].name), -x[0])):
        own = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        out = F.when(own & F.startswith(path, F.lit(r.path)), F.lit(i)).otherwise(out)
    return out


def words_of(key: str) -> list[Column]:
    """The bit, 0 to 63, that a key sets in each of the 8 words of its block."""
    return [F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(i)), 58) for i in range(WORDS)]


def bloom(keys: DataFrame, key: str, n: int) -> np.ndarray:
    """A filter of n keys in blocks of 512 bits: each key sets one bit in each of the 8 words of one block.

    Spark puts the blocks together; what comes to the driver is bounded by FILTER_BYTES.
    """
    blocks = int(max(1, min(FILTER_BYTES // (8 * WORDS), -(-n * BITS_PER_URL // (64 * WORDS)))))
    bits = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[c.alias(f"b{i}") for i, c in enumerate(words_of(key))])
    got = bits.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, cast(b{i} as int))")).alias(f"w{i}") for i in range(WORDS)]).toArrow()
    table = np.zeros((blocks, WORDS), np.int64)
    if got.num_rows:
        table[got["block"].to_numpy()] = np.stack([got[f"w{i}"].to_numpy() for i in range(WORDS)], axis=1)
    return table


def may_hold(spark, table: np.ndarray, key: str) -> Column:
    """Whether the key of a row may be among those of the filter."""
    ready()
    held = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def hit(block: pd.Series, b0: pd.Series, b1: pd.Series, b2: pd.Series, b3: pd.Series, b4: pd.Series, b5: pd.Series, b6: pd.Series, b7: pd.Series) -> pd.Series:
        rows = held.value[block.to_numpy()]
        ok = np.ones(len(block), bool)
        for i, b in enumerate((b0, b1, b2, b3, b4, b5, b6, b7)):
            ok &= (rows[:, i] >> b.to_numpy()) & 1 == 1
        return pd.Series(ok)

    return hit(F.pmod(F.xxhash64(key), F.lit(len(table))), *words_of(key))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, canonical, listed.

    The verdict is that of the longest rule that fits; where none fits, ``block`` if the canonical URL is on the
    list (a column ``url`` of URLs as they are found), else ``allow``. A null URL, or one without ``://``, has an
    empty host and path, fits no rule and is never on the list. Repeated rows of pages give a row each, repeated
    rows of the list change nothing; null ids pass; other columns are ignored; either table may be empty. A very long URL is
    one like any other. Equally long rules that fit are told apart by their order.

    The pages are read and the filter asked once, into a table. Only rows that no rule decides and that pass the
    filter are shuffled from it, for the exact join on the canonical URL, which rules out what the filter has let
    through by chance; ``listed`` is false for rows that a rule decides.
    """
    raw = F.col(url_column)
    names, verdicts = ([F.lit(x) for x in xs] or [F.lit("")] for xs in ([r.name for r in rules], [r.verdict for r in rules]))
    keyed = pages.select(F.col(id_column).alias("page_id"), host_of(raw).alias("host"), path_of(raw).alias("path"), canonical(raw).alias("canonical"))
    keyed = keyed.withColumn("i", rule_of(F.col("host"), F.col("path"), rules))
    keys = written(listed.select(canonical(F.col("url")).alias("canonical")).where("canonical <> ''").distinct(), "listed")
    passed = may_hold(pages.sparkSession, bloom(keys, "canonical", keys.count()), "canonical")
    marked = written(keyed.withColumn("candidate", F.when(F.col("i").isNull() & (F.col("canonical") != ""), passed).otherwise(F.lit(False))), "marked")
    out = ["page_id", "host", "path", "i", "canonical", "listed"]
    sure = marked.where("not candidate").withColumn("listed", F.lit(False)).select(*out)
    found = marked.where("candidate").join(keys.withColumn("listed", F.lit(True)), "canonical", "left")
    return sure.unionByName(found.withColumn("listed", F.coalesce("listed", F.lit(False))).select(*out)).select(
        "page_id",
        "host",
        "path",
        F.get(F.array(*names), F.col("i")).alias("rule"),
        F.coalesce(F.get(F.array(*verdicts), F.col("i")), F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"),
        "canonical",
        "listed",
    )


#: The list of the query where none is given: hosts of these labels in some domains, and pages of these languages and numbers. It doesn't look at the pages.
BAD_HOSTS = ("adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets")
DOMAINS, LANGUAGES, NUMBERS = ("example.com", "example.net"), ("de", "en", "es", "fr"), 2_000


def block_list(spark) -> DataFrame:
    """The URLs of that list (column url): 384,000 of them, of which pages have some."""
    urls = spark.range(NUMBERS)
    for name, values in (("label", BAD_HOSTS), ("prefix", ("", "blog.")), ("domain", DOMAINS), ("lang", LANGUAGES), ("suffix", ("", ".html"))):
        urls = urls.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return urls.select(F.concat(F.lit("http://"), "prefix", "label", F.lit("."), "domain", F.lit("/"), "lang", F.lit("/"), "id", "suffix").alias("url"))


def op4_urls(spark, sf_dir: str, listed: DataFrame | None = None) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, block_list(spark) if listed is None else listed)


OP4_SQL = r"""
WITH split AS (
  SELECT page_id,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), keyed AS (
  SELECT *, CASE WHEN regexp_replace(host, '^(www|m)\.', '') = '' THEN '' ELSE regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') END AS canonical
  FROM split
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), urls AS (SELECT DISTINCT host, path FROM keyed),
best AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rverdict
  FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
), listed AS (
  SELECT prefix || label || '.' || domain || '/' || lang || '/' || n || suffix AS canonical
  FROM range(2000) AS r(n), (VALUES ('adult-x'), ('spam-farm'), ('cheap-pills'), ('ads-track'), ('casino-win'), ('free-bets')) AS a(label),
    (VALUES (''), ('blog.')) AS b(prefix), (VALUES ('example.com'), ('example.net')) AS c(domain),
    (VALUES ('de'), ('en'), ('es'), ('fr')) AS d(lang), (VALUES (''), ('.html')) AS e(suffix)
)
SELECT page_id, host, path, rule, coalesce(rverdict, CASE WHEN canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict, canonical,
  rule IS NULL AND canonical IN (SELECT canonical FROM listed) AS listed
FROM keyed LEFT JOIN best USING (host, path)
"""
