"""Shards of bounded size by extendible hashing.

The directory is indexed by leading bits of a hash of the document's id and text. It starts as one
bucket; a bucket of more bytes than the limit, and only such a one, is split on the next bit, until
every bucket fits. STEP bits are decided in one pass: bytes are summed by the finest prefix of the
pass, and each takes the shortest prefix whose sum fits; what fits none goes on to the next bits, up
to all 64. A bucket of one hash value, which no bit splits, is laid into overflow pages by running
sums. A text of up to half the limit shares pages that never pass the limit, a larger one has a page
of its own, so that only a single text above the limit makes a shard that is too large. Running sums
are taken within the partitions that rows lie in and then over partitions, so that a hash value of
very many rows isn't sorted in one task.

Defined results: null and empty texts have 0 bytes. Rows with equal ids and texts share a bucket and
go to its pages in any order. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, lookup

LIMIT = 4 << 20
STEP = 8


def _hash(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def placed(sized: DataFrame, limit: int = LIMIT) -> DataFrame:
    """sized, which has columns h and bytes, with depth and bucket_bytes of each row's bucket."""
    done, open_, first = None, sized, 0
    while True:
        last = min(64, (first + STEP - 1) // STEP * STEP if first else STEP)
        rows = open_.withColumn("prefix", F.shiftrightunsigned("h", 64 - last))
        sums = rows.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high"))
        levels = sums.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
        # A prefix of the coarsest level has at most 2^(STEP + 1) rows.
        bucket = Window.partitionBy("depth", F.expr(f"shiftrightunsigned(prefix, {last} - depth)"))
        levels = levels.select("prefix", "depth", F.sum("bytes").over(bucket).alias("bucket_bytes"), (F.min("low").over(bucket) == F.max("high").over(bucket)).alias("single"))
        fitting = levels.where((F.col("bucket_bytes") <= limit) | F.col("single")).groupBy("prefix").agg(F.min(F.struct("depth", "bucket_bytes")).alias("b"))
        fitting = lookup(cut(fitting))
        found = rows.join(fitting, "prefix").select(*sized.columns, "b.depth", "b.bucket_bytes")
        done = found if done is None else done.unionByName(found)
        if last == 64:
            return done
        open_ = cut(rows.join(fitting.select("prefix"), "prefix", "left_anti").select(*sized.columns))
        if not open_.limit(1).count():
            return done
        first = last + 1


def _pages(over: DataFrame, limit: int) -> DataFrame:
    """over, rows of buckets of one hash value that don't fit, with page and shard_bytes."""
    half = max(1, limit // 2)
    large = F.col("bytes") > limit // 2
    row = F.monotonically_increasing_id()
    over = cut(over.select("*", row.alias("row"), F.shiftright(row, 33).alias("part"), F.when(large, 0).otherwise(F.col("bytes")).alias("small"), large.cast("long").alias("large")))
    before = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("h")
    parts = over.groupBy("h", "part").agg(F.sum("small").alias("s"), F.sum("large").alias("n"), F.count_if(F.col("large") == 0).alias("k")).select(
        "h", "part",
        F.coalesce(F.sum("s").over(before), F.lit(0)).alias("small_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("large_before"),
        F.when(F.sum("k").over(every) > 0, F.floor(F.sum("s").over(every) / half) + 1).otherwise(0).alias("small_pages"),
    )
    upto = Window.partitionBy("h", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = over.withColumns({"small_upto": F.sum("small").over(upto), "large_upto": F.sum("large").over(upto)}).join(lookup(cut(parts)), ["h", "part"])
    start = F.col("small_before") + F.col("small_upto") - F.col("bytes")
    page = F.when(F.col("large") == 0, F.floor(start / half)).otherwise(F.col("small_pages") + F.col("large_before") + F.col("large_upto") - 1)
    rows = cut(rows.select("doc_id", "bytes", "h", "depth", page.cast("long").alias("page")))
    sums = rows.groupBy("h", "page").agg(F.sum("bytes").alias("shard_bytes"))
    return rows.join(lookup(cut(sums)), ["h", "page"])


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """A row per document: doc_id, bytes, prefix (bits as text), depth, page and shard_bytes."""
    sized = cut(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"), _hash(F.col("doc_id"), F.col("text")).alias("h")))
    label = F.substring(F.lpad(F.bin("h"), 64, "0"), F.lit(1), F.col("depth")).alias("prefix")
    rows = placed(sized, limit)
    fits = F.col("bucket_bytes") <= limit
    one = rows.where(fits).select("doc_id", "bytes", label, "depth", F.lit(0).cast("long").alias("page"), F.col("bucket_bytes").alias("shard_bytes"))
    over = rows.where(~fits).select("doc_id", "bytes", "h", "depth")
    return one.unionByName(_pages(over, limit).select("doc_id", "bytes", label, "depth", "page", "shard_bytes"))
