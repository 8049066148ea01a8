"""Connected components by alternating large-star and small-star steps; no vertex's edges meet in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import drop, written

#: Rows that a task writes about: small graphs take few tasks, however many partitions a shuffle has.
ROWS = 500_000


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for all ends of the edges (u, v) but those that are the smallest of their component, which names it.

    Loops and repeated edges don't matter. What is joined is read from tables, so that the planner can split a
    vertex that many edges meet in. Tables of a step that the next one no longer needs are removed.
    """
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        tasks = max(1, -(-now[0] // ROWS))
        # large star: the larger neighbours of u go to the least of u and all its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).coalesce(tasks), name)
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        starred = written(larger.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(tasks), name)
        drop(edges, least)
        # small star: u and its smaller neighbours go to the least of these
        least = written(starred.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks), name)
        moved = starred.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(least.select("u", F.col("m").alias("v")).unionByName(moved).distinct().coalesce(tasks), name)
        drop(starred, least)
