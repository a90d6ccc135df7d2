"""Mixing of sources to target weights, word for word.

Each document gets a key from a hash of its id, which orders the documents of its source at random
but alike in every run. A source whose target is t words out of s takes its documents t // s times
whole, and once more from the front of that order until t words are reached; the document at the
cut gives only its first words. Prefix sums are taken in two steps: sums of ranges of keys per
source first, then only within the one range of each source that holds the cut, so that no source
is sorted in one task and no text is shuffled.

Everything is built from SQL functions, with no Python on the executors.

Defined results: null and empty texts have size 0 and take 0 words. A null source is a source of
its own and comes last. Documents with equal ids are ordered by their size, equal rows in any
order. A null id has the key of the word "null". An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, group_key, lookup, word_count, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2.0
SEED = "mix-1"
#: Documents in a range of keys, on average over all sources.
RANGE_ROWS = 4096
KEY_BITS = 52


def sort_key(doc_id: Column) -> Column:
    """A 52-bit integer from a hash of the id."""
    name = F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Per source_key: source_size, target, and epochs and rest, the whole passes and the words after them.

    Targets share SHARE of all words by weight; none is above MOST_EPOCHS times its source, and
    what is cut off is shared anew by weight, which ends in target = min(cap, level * weight).
    """
    totals = sizes.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    place = Window.orderBy(F.col("source_key") == "n", "source_key")
    weigh = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(place) - 1) % len(WEIGHTS) + 1).cast("int"))
    caps = totals.withColumn("weight", weigh.cast("double")).withColumn("cap", MOST_EPOCHS * F.col("source_size").cast("double"))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    below = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    levels = (
        caps.withColumn("wanted", F.sum(F.col("source_size").cast("double")).over(every) * SHARE)
        .withColumn("same_cap", F.sum("cap").over(Window.partitionBy("ratio")))
        .withColumn("same_weight", F.sum("weight").over(Window.partitionBy("ratio")))
        .withColumn("capped", F.sum("cap").over(below) - F.col("same_cap"))
        .withColumn("free", F.sum("weight").over(every) - F.sum("weight").over(below) + F.col("same_weight"))
        .withColumn("level", (F.col("wanted") - F.col("capped")) / F.col("free"))
    )
    first_free = F.min_by(F.when(F.col("level") < F.col("ratio"), F.col("level")), F.when(F.col("level") < F.col("ratio"), F.col("ratio"))).over(every)
    budget = F.floor("target").cast("long")
    return (
        levels.withColumn("target", F.coalesce(F.least(F.col("cap"), first_free * F.col("weight")), F.col("cap")))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
        .select("source_key", "source_size", "target", "epochs", (budget - F.col("epochs") * F.col("source_size")).alias("rest"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", group_key(F.col("source")).alias("source_key"), word_count(F.col("text")).alias("size"), sort_key(F.col("doc_id")).alias("key"))


def _plan(sizes: DataFrame) -> tuple[DataFrame, int]:
    """Per source also cut_range, the range of keys with the cut, and before, the words ahead of it."""
    ranges = max(1, sizes.count() // RANGE_ROWS)
    slot = _slot(F.col("key"), ranges)
    sums = sizes.groupBy("source_key", slot.alias("slot")).agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reach = sums.withColumn("upto", F.sum("words").over(so_far))
    goals = targets(sizes)
    at = (
        reach.join(goals.select("source_key", "rest"), "source_key")
        .where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("words") <= F.col("rest")))
        .select("source_key", F.col("slot").alias("cut_range"), (F.col("upto") - F.col("words")).alias("before"))
    )
    return cut(goals.join(at, "source_key", "left")), ranges


def _slot(key: Column, ranges: int) -> Column:
    return F.floor(key.cast("double") * (ranges / 2.0**KEY_BITS)).cast("long")


def _taken(rows: DataFrame, plan: DataFrame, ranges: int) -> DataFrame:
    """rows (source_key, size, key, doc_id and more) with the plan's columns and taken."""
    placed = rows.join(lookup(plan), "source_key").withColumn("slot", _slot(F.col("key"), ranges))
    at_cut = F.coalesce(F.col("slot") == F.col("cut_range"), F.lit(False))
    whole = placed.where(~at_cut).withColumn(
        "taken", F.col("size") * (F.col("epochs") + F.when(F.col("slot") < F.col("cut_range"), 1).otherwise(0))
    )
    order = Window.partitionBy("source_key").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.col("size"))
    part = placed.where(at_cut).withColumn(
        "taken", F.col("size") * F.col("epochs") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    )
    return whole.unionByName(part)


def mix(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, size, source_size, target and taken."""
    sizes = cut(_keyed(docs))
    plan, ranges = _plan(sizes)
    return _taken(sizes, plan, ranges).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for every whole pass of a document, and one with the first words at a cut.

    Columns are those of docs. A text that is cut has its words joined by single spaces.
    """
    plan, ranges = _plan(cut(_keyed(docs)))
    row = F.struct(*[F.col(c) for c in docs.columns])
    rows = docs.select(
        row.alias("_row"), F.col("text").alias("_text"), "doc_id", group_key(F.col("source")).alias("source_key"),
        word_count(F.col("text")).alias("size"), sort_key(F.col("doc_id")).alias("key"),
    )
    taken = _taken(rows, plan, ranges)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.floor(F.col("taken") / F.col("size"))).cast("int")
    extra = F.col("taken") - copies * F.col("size")
    pieces = F.concat(
        F.transform(F.when(copies > 0, F.sequence(F.lit(1), copies)).otherwise(F.array().cast("array<int>")), lambda i: F.lit(0).cast("long")),
        F.when(extra > 0, F.array(extra.cast("long"))).otherwise(F.array().cast("array<bigint>")),
    )
    out = taken.withColumn("_first", F.explode(pieces))
    text = F.when(F.col("_first") == 0, F.col("_text")).otherwise(
        F.array_join(F.slice(words(F.col("_text")), 1, F.col("_first").cast("int")), " ")
    )
    return out.select(F.col("_row").withField("text", text).alias("_row")).select("_row.*")
