"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chats, chroma, mixing, near_dedup, packing, quality_classifier, quality_rules, repeats, sharding, spelling, sql, token_counts, warc, whitening


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no audio: each vector of embeddings is rendered as a recording, a tone per number.

    Every vector whose id is divisible by 20 is a query and has a noisy copy that begins a second later, whose id is the negative.
    """
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("rec_id"), "embedding")
    copies = vectors.where("rec_id % 20 = 0 AND rec_id > 0").select((-F.col("rec_id")).alias("rec_id"), chroma.render_copy("embedding", "rec_id").alias("media"))
    recordings = vectors.select("rec_id", chroma.render_tones("embedding").alias("media")).unionByName(copies)
    return chroma.search(recordings, F.col("media"), F.col("rec_id") % 20 == 0)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(read(spark, sf_dir, "documents"), size=2)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.render(read(spark, sf_dir, "conversations"))


def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that a long can't hold is null."""
    return whitening.whiten(read(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_words(read(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pack_sequences, op2_chroma_fingerprints, op3_near_duplicates, op4_warc, op5_token_counts, op6_quality_classifier, op7_chat_collapse, op8_shards, op9_mix_sources, op10_quality_rules]
    found += [op11_whitened_embeddings, op12_repeated_passages, op13_spelling_variants]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": sql.OP4, "op7_chat_collapse": sql.OP7, "op9_mix_sources": sql.op9(), "op10_quality_rules": sql.op10(), "op12_repeated_passages": sql.OP12, "op13_spelling_variants": sql.op13()}
