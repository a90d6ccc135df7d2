"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps with the columns
that they came with; the last returns where their tokens go. run() writes what a stage returns to
the shared folder and reads it back for the next one.

Defined results: rows with null or empty texts fail the rules. Rows that repeat id and text become one
in the dedup stage, where a row with a null id stays; a null source is mixed as a source of its own.
Very long texts go whole through every stage. Columns besides doc_id, text, lang and source are carried
along under any name. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, near_dedup, packing, quality_classifier, quality_rules
from tidemark.llm.common import shared_folder


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the quality rules."""
    return quality_rules.keep_good(docs, _labels(spark, sf_dir))


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a score under 0.5 by a model of the raw documents, as the rules leave hardly any bad ones to learn from."""
    return quality_classifier.keep_good(docs, _labels(spark, sf_dir), _raw(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near duplicates, on shingles of five words."""
    return near_dedup.keep_one(docs, size=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents to the weights of their sources."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' tokens in sequences."""
    return packing.pack(docs)


STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]

#: A learned classifier and a tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _raw(spark, sf_dir)
    top = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
