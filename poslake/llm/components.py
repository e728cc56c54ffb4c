"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fitted, materialise, tasks_for


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; the root is the smallest node reachable.

    Each step joins edges with one minimum per node.  A hub's edges may be split between tasks, for both
    sides of the join are plain shuffles; the edges never leave the executors."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = fitted(edges)
    before = None
    while (now := _state(edges)) != before:
        before, tasks = now, tasks_for(now[0])
        edges = edges.coalesce(tasks)  # few links need few tasks and files in each shuffle
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.coalesce(tasks).distinct().coalesce(tasks))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        next_edges = small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks)
        edges = materialise(next_edges.distinct().coalesce(tasks))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
