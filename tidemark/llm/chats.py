"""Collapse of cumulative snapshots of conversations, and their rendering.

Loggers write a conversation again after every turn. Each turn gets a hash of its place, role and
text; their running sum, twice with other hashes, stands for the prefix that ends there. A
conversation goes if its whole hash is a prefix of a longer one, by an anti-join with the prefixes
that go on, or if an equal one has a smaller id. What is left is rendered as text.

Everything is built from SQL functions, with no Python on the executors.

Defined results: turns are ordered by turn, role and text, nulls first, and counted anew from 0, so
missing turn numbers don't matter and repeated rows are turns of their own. A null role or text
differs from an empty one when conversations are compared and is rendered as empty. What rows with a
null conv_id belong to is unknown: each is a conversation of one turn, and goes like any other if an
equal one or a longer one that begins with it is there. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, group_key

START, STOP = "<|im_start|>", "<|im_end|>"
#: Turn numbers of a conversation that are put in order together.
TURNS = 1024


def _line() -> Column:
    return F.concat(F.lit(START), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(STOP))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("place"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, its key, the place of each turn, its last place, and the hash of the prefix that it ends.

    Places and sums are taken in two steps: over the stretches of TURNS turn numbers of a conversation, whose counts
    and sums are added up first, then within a stretch, so that no long conversation is sorted in one task.
    """
    part = ["key", "stretch"]
    stretch = F.coalesce(F.floor(F.col("turn") / TURNS).cast("long"), F.lit(-(1 << 62)))  # null turns come first
    rows = turns.select("conv_id", group_key(F.col("conv_id")).alias("key"), stretch.alias("stretch"), "turn", "role", "text")
    by_stretch = Window.partitionBy("key").orderBy("stretch")
    ahead = by_stretch.rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(*part).agg(F.count("*").alias("size"))
    sizes = sizes.select(*part, "size", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"), F.lead("stretch").over(by_stretch).isNull().alias("ends"))
    own = F.row_number().over(Window.partitionBy(*part).orderBy("turn", "role", "text"))
    placed = rows.withColumn("own", own).join(sizes, part).withColumn("place", (F.col("ahead") + F.col("own") - 1).cast("int"))
    hashed = cut(placed.select("conv_id", *part, "own", "place", (F.col("ends") & (F.col("own") == F.col("size"))).alias("last"), *[_hash(s).cast("decimal(38,0)").alias(n) for s, n in ((1, "a1"), (2, "a2"))]))
    sums = hashed.groupBy(*part).agg(F.sum("a1").alias("s1"), F.sum("a2").alias("s2"))
    sums = sums.select(*part, *[F.coalesce(F.sum(f"s{n}").over(ahead), F.lit(0)).cast("decimal(38,0)").alias(f"before{n}") for n in (1, 2)])
    upto = Window.partitionBy(*part).orderBy("own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = [(F.col(f"before{n}") + F.sum(f"a{n}").over(upto)).cast("decimal(38,0)").alias(f"h{n}") for n in (1, 2)]
    return hashed.join(sums, part).select("conv_id", "key", "place", "last", *whole)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, key, n_turns and n_equal of the conversations that no other one contains as a prefix.

    Where conv_id is null, line is the conversation's one turn, rendered.
    """
    prefixes = cut(_prefixes(turns.where("conv_id IS NOT NULL")))
    going_on = prefixes.where("NOT last").select("place", "h1", "h2").distinct()
    one = F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "key")
    named = prefixes.where("last").select("place", "h1", "h2", one.alias("c"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("line"))
    alone = turns.where("conv_id IS NULL").groupBy("role", "text").agg(F.count("*").alias("n")).withColumns({"conv_id": F.lit(None).cast(dict(turns.dtypes)["conv_id"]), "key": F.lit(None).cast("string"), "place": F.lit(0)})
    alone = alone.select("place", *[_hash(s).cast("decimal(38,0)").alias(h) for s, h in ((1, "h1"), (2, "h2"))], one.alias("c"), "n", _line().alias("line"))
    whole = named.unionByName(alone).groupBy("place", "h1", "h2").agg(F.min("c").alias("c"), F.sum("n").alias("equal"), F.max("line").alias("line"))
    kept = whole.join(going_on, ["place", "h1", "h2"], "left_anti")
    return kept.select("c.conv_id", "c.key", (F.col("place") + 1).cast("long").alias("n_turns"), F.col("equal").alias("n_equal"), "line")


def render(turns: DataFrame) -> DataFrame:
    """A row per maximal conversation: conv_id, n_turns, n_equal (copies of it, itself included) and text."""
    kept = cut(maximal(turns))
    rows = turns.where("conv_id IS NOT NULL").select(group_key(F.col("conv_id")).alias("key"), F.struct("turn", "role", "text", _line().alias("line")).alias("t"))
    texts = rows.join(kept.select("key"), "key", "left_semi").groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]), "\n").alias("text"))
    named = kept.where("conv_id IS NOT NULL").join(texts, "key").select("conv_id", "n_turns", "n_equal", "text")
    return named.unionByName(kept.where("conv_id IS NULL").select("conv_id", "n_turns", "n_equal", F.col("line").alias("text")))
