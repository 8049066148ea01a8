"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir); docs has the columns of the table documents, others are dropped. All stages but
the last return these columns. In each, a null text has no words and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.contamination import find_contamination
from tessella.llm.mixing import mixed
from tessella.llm.nearcopies import near_duplicates
from tessella.llm.quality import resample
from tessella.llm.repeats import remove_repeats
from tessella.llm.shared import scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the importance sample; those that the target's model rules out go. Repeated rows share a fate, ties at the cut too; empty texts stay, null ids are ids like any other."""
    return resample(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")).where("weight.kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest id, of null ids the last.

    Of rows that agree in id and text one stays. Different texts under one id are documents of their own, null ids
    ids like any other: copies go by their texts. Texts without words have no copies but such equal rows.
    """
    docs = docs.select(*COLUMNS)
    key = {"key_id": F.coalesce(F.col("doc_id"), F.lit(-(2**63))), "key_text": F.xxhash64("text")}
    found = near_duplicates(docs).where("kept").withColumnRenamed("text_hash", "key_text").withColumn("key_id", key["key_id"])
    kept = written(found.groupBy(*key).agg(F.count("*").alias("rows")), "kept")
    own = docs.withColumns(key)
    one = own.join(kept.where("rows = 1").hint("merge"), [*key], "left_semi")
    again = own.join(kept.where("rows > 1").hint("merge"), [*key], "left_semi").dropDuplicates([*key])
    return one.unionByName(again).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 20 words that start earlier in the corpus; those that lose all their words go. Of a passage the first occurrence stays, null ids come first; repeated rows keep what the first keeps."""
    cut = remove_repeats(docs.select(*COLUMNS))
    changed = F.col("repeats.n_removed") > 0
    return cut.where(~changed | (F.col("repeats.n_removed") < F.col("repeats.n_words"))).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; each row is judged by its text alone."""
    found = find_contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("found.hit_start") == 0).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, each with the number of its copies. Repeated rows are documents of their own."""
    return mixed(docs.select(*COLUMNS)).select(*COLUMNS, "size", "source_size", "target", "copies", "taken")


STAGES = [("quality", quality), ("near_copies", near_copies), ("substrings", substrings), ("decontaminated", decontaminated), ("mix", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        with scratch(spark) as kept:
            docs = kept(written(stage(spark, docs, sf_dir), f"pipeline-{name}"))
    return docs


ORACLE_SQL = None
