"""Queries over files and versioned tables, which they write from the given tables into the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import files
from tidemark.sources.versions import VersionedTable
from tidemark.sources.views import read

#: Documents in a file.
PER_FILE = 64


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, doc_id and line of each document: its id, its source and its text on one line."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\r\n\t]", " ")
    return read(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / PER_FILE).alias("bucket"), "doc_id", F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("source", F.lit("")), text).alias("line")
    )


def _written(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a text file for each bucket."""
    path = files.shared_folder(spark)
    _lines(spark, sf_dir).repartition("bucket").sortWithinPartitions("bucket", "doc_id", "line").select("bucket", F.col("line").alias("value")).write.partitionBy("bucket").text(path)
    return path


def _bucket(source: Column) -> Column:
    return F.regexp_extract(source, "bucket=(-?[0-9]+)/", 1)


_LINE = r"""bl AS (SELECT doc_id // 64 AS bucket, doc_id, doc_id || chr(9) || coalesce(source, '') || chr(9) || regexp_replace(coalesce(text, ''), '[\r\n\t]', ' ', 'g') AS line FROM documents),
fl AS (SELECT bucket, string_agg(line || chr(10), '' ORDER BY doc_id, line) AS content FROM bl GROUP BY bucket)"""


@query(f"""WITH {_LINE} SELECT 'b' || bucket AS company_id, strlen(content)::BIGINT AS n_bytes, sha256(content) AS digest FROM fl""")
def s26_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole text of each file, whose company is in its path."""
    rows = files.text_files(spark, f"{_written(spark, sf_dir)}/*/*.txt", F.concat(F.lit("b"), _bucket(F.col("source"))))
    return rows.select("company_id", "n_bytes", F.sha2("content", 256).alias("digest"))


@query(f"""WITH {_LINE}, m AS (SELECT bucket AS name, CASE WHEN bucket % 7 = 0 THEN repeat('0', 64) ELSE sha256(content) END AS stated FROM fl WHERE bucket % 11 != 3 UNION ALL SELECT bucket + 1000000000, 'x' FROM fl WHERE bucket % 5 = 0)
SELECT coalesce(m.name, bucket)::BIGINT AS name, strlen(content)::BIGINT AS n_bytes, CASE WHEN content IS NULL THEN 'missing' WHEN m.name IS NULL THEN 'unlisted' WHEN stated = sha256(content) THEN 'same' ELSE 'changed' END AS status FROM fl FULL JOIN m ON name = bucket""")
def s35_checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of files against a manifest with wrong digests, without some files, and with some that aren't there."""
    ordered = F.sort_array(F.collect_list(F.struct("doc_id", "line")))
    stated = _lines(spark, sf_dir).groupBy("bucket").agg(F.sha2(F.concat(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), F.lit("\n")), 256).alias("sha256"))
    wrong = F.when(F.col("bucket") % 7 == 0, F.lit("0" * 64)).otherwise(F.col("sha256"))
    gone = stated.where("bucket % 5 = 0").select((F.col("bucket") + 1_000_000_000).cast("string").alias("name"), F.lit("x").alias("sha256"))
    manifest = stated.where("bucket % 11 != 3").select(F.col("bucket").cast("string").alias("name"), wrong.alias("sha256")).unionByName(gone)
    found = files.checked_files(spark, f"{_written(spark, sf_dir)}/*/*.txt", manifest, _bucket(F.col("source")))
    return found.select(F.col("name").cast("long").alias("name"), "n_bytes", "status")


@query("""WITH g AS (SELECT *, doc_id // 13 AS c, row_number() OVER (PARTITION BY doc_id // 13, doc_id % 17 IN (3, 5) OR doc_id % 13 NOT IN (0, 4) ORDER BY doc_id) AS k FROM documents)
SELECT doc_id, CASE WHEN doc_id % 17 = 3 THEN 'not_json' WHEN doc_id % 17 = 5 THEN 'no_case_id' WHEN doc_id % 13 = 4 AND k > 1 THEN 'repeated_case_id'
  WHEN doc_id % 17 = 7 THEN 'no_input_or_expected' WHEN doc_id % 17 = 11 THEN 'no_responses' END AS fault FROM g""")
def s27_case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of files as cases: broken ones, without an id, with the id of an earlier line, and without parts."""
    k = F.col("doc_id")
    case = F.when(k % 13 == 4, F.concat(F.lit("c"), F.floor(k / 13) * 13)).otherwise(F.concat(F.lit("c"), k))
    body = F.struct(
        F.when(k % 17 != 5, case).alias("case_id"), F.create_map(F.lit("doc_id"), k.cast("string")).alias("input"),
        F.when(k % 17 != 7, F.create_map(F.lit("status"), F.lit("completed"))).alias("expected"), F.when(k % 17 != 11, F.array("source")).alias("scripted_responses"),
    )
    line = F.when(k % 17 == 3, F.concat(F.lit("{doc "), k)).otherwise(F.to_json(body))
    path = files.shared_folder(spark)
    read(spark, sf_dir, "documents").repartitionByRange("doc_id").sortWithinPartitions("doc_id").select(line.alias("value")).write.text(path)
    found = files.cases(spark, path)
    lines = files.numbered_lines(spark, path)
    doc_id = F.coalesce(F.get_json_object("value", "$.input.doc_id"), F.regexp_extract("value", "[0-9]+", 0)).cast("long")
    return found.join(lines.select("source", "line", doc_id.alias("doc_id")), ["source", "line"]).select("doc_id", "fault")


@query("SELECT conv_id AS run_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL")
def s28_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as run records, a file each, read back."""
    path = files.shared_folder(spark)
    rows = read(spark, sf_dir, "conversations").where("conv_id IS NOT NULL").select(F.col("conv_id").alias("run_id"), "turn", "role", "text")
    files.save_runs(rows, path, order=["turn", "role", "text"])
    types = dict(rows.dtypes)
    return spark.read.schema(", ".join(f"{c} {types[c]}" for c in rows.columns)).json(f"{path}/*.jsonl")


@query("""SELECT doc_id AS document_id, sha256(CASE WHEN doc_id % 5 = 0 THEN upper(coalesce(lang, '')) || coalesce(source, '') ELSE coalesce(lang, '') || coalesce(source, '') END) AS content_hash, n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS n_chars FROM documents""")
def c32_index_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of two thirds of the documents, then of all with every fifth changed, a batch that comes twice; read, it's what a rebuild gives."""
    docs, k = read(spark, sf_dir, "documents"), F.col("doc_id")

    def version(changed: Column) -> DataFrame:
        lang = F.coalesce("lang", F.lit(""))
        body = F.concat(F.when(changed, F.upper(lang)).otherwise(lang), F.coalesce("source", F.lit("")))
        return docs.select(k.alias("document_id"), F.sha2(body, 256).alias("content_hash"), (F.col("n_chars") + F.when(changed, 1).otherwise(0)).alias("n_chars"))

    table = VersionedTable(spark, files.shared_folder(spark))
    table.commit(version(F.lit(False)).where("document_id % 3 != 0"), "first")
    for _ in range(2):
        table.commit(version(k % 5 == 0), "second")
    return table.read()
