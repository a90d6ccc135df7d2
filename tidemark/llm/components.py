"""Connected components of a graph that is given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, fewer

#: Edges of a task.
EDGES = 250_000


def _stars(edges: DataFrame, rows: int) -> DataFrame:
    """One round: every node's larger neighbours, then its smaller ones, are hung on the smallest. rows is how many edges there are."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = fewer(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), rows, EDGES).distinct()
    large = fewer(large, rows, EDGES)
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    found = fewer(down.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v"), rows, EDGES)
    return fewer(found.distinct(), rows, EDGES)


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node reachable, of every node that has an edge and isn't smallest.

    edges has columns u and v, both long. Works by large stars and small stars in turn, each round a
    few shuffles, until nothing changes; a graph of few edges goes in few tasks.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or new[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = new
        now = cut(_stars(fewer(now, new[0], EDGES), new[0]))
