"""Sources over files: whole texts, checksums of bytes, cases in JSON lines; and the sink of run records.

Folders are read and written by Spark, so they can be of any store that it knows; only the run-record
sink writes with Python, into a folder that the executors share.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """A new folder's path below what spark.checkpoint.dir names; a local master without it gets a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if top is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/files-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared checkpoint folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark).rsplit("/", 1)[0])
    return df.checkpoint()


def _bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("source"), F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified_at"), "content")


def text_files(spark: SparkSession, path: str, company: Column | None = None) -> DataFrame:
    """A row per file: content, its text in UTF-8, source, n_bytes, modified_at and company_id, which company makes from source; null without it. Spark leaves out empty files."""
    found = _bytes(spark, path).withColumn("content", F.decode("content", "UTF-8"))
    return found.withColumn("company_id", F.lit(None).cast("string") if company is None else company)


def checked_files(spark: SparkSession, path: str, manifest: DataFrame, name: Column) -> DataFrame:
    """Each file below path and each entry of the manifest (name, sha256) with its status: same, changed, missing or unlisted.

    name makes a file's name, as the manifest has it, from the column source. Bytes are hashed where they are read.
    """
    files = _bytes(spark, path).select("source", "n_bytes", F.sha2("content", 256).alias("found"))
    both = files.withColumn("name", name).drop("source").join(manifest.select("name", "sha256"), "name", "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unlisted").when(F.lower("sha256") == F.col("found"), "same").otherwise("changed")
    return both.select("name", "n_bytes", status.alias("status"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, source and line, its place in its file from 1: counted within each block of a file, and blocks by their counts."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    before = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("source", "at").agg(F.count("*").alias("n")).select("source", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("source", "at").orderBy("k"))).join(blocks, ["source", "at"])
    return placed.select("value", "source", (F.col("ahead") + F.col("place")).alias("line"))


CASE = "case_id string, input map<string,string>, expected map<string,string>, scripted_responses array<string>"


def cases(spark: SparkSession, path: str) -> DataFrame:
    """The lines of JSON files as cases: source, line, case_id, input, expected, scripted_responses, and fault, null for a good line.

    fault, the first that holds: not_json, no_case_id, repeated_case_id (by an earlier line of a good id), no_input_or_expected,
    no_responses. Empty lines are left out. line is the place in its file, from 1.
    """
    lines = numbered_lines(spark, path).where("trim(value) != ''")
    parsed = lines.withColumn("v", F.try_parse_json("value"))

    def kind(path_: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("v", path_, "variant"))

    named = F.when(kind("$.case_id") == "STRING", F.try_variant_get("v", "$.case_id", "string"))
    rows = parsed.withColumn("case_id", named)
    place = F.struct("source", "line")
    first = rows.where("case_id IS NOT NULL").groupBy("case_id").agg(F.min(place).alias("first"))
    rows = rows.join(first, "case_id", "left")
    again = F.coalesce(F.col("first") != place, F.lit(False))
    fault = (
        F.when(F.col("v").isNull(), "not_json").when(F.col("case_id").isNull(), "no_case_id").when(again, "repeated_case_id")
        .when(~F.coalesce(kind("$.input").startswith("OBJECT") & kind("$.expected").startswith("OBJECT"), F.lit(False)), "no_input_or_expected")
        .when(~F.coalesce(kind("$.scripted_responses").startswith("ARRAY"), F.lit(False)), "no_responses")
    )
    fields = F.from_json("value", CASE)
    return rows.select("source", "line", "case_id", fields["input"].alias("input"), fields["expected"].alias("expected"), fields["scripted_responses"].alias("scripted_responses"), fault.alias("fault"))


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _RunWriter(DataSourceWriter):
    def __init__(self, path: str, columns: list[str], run_key: str) -> None:
        self.path, self.columns, self.run_key = path, columns, run_key

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """One file for each run of this task, under a name that isn't a record's until commit()."""
        files: dict[object, tuple] = {}
        os.makedirs(self.path, exist_ok=True)
        made = []
        try:
            for row in rows:
                run = row[self.run_key]
                if run not in files:
                    name = f"{self.path}/.{run}.{uuid.uuid4().hex}.part"
                    made.append(name)
                    files[run] = open(name, "x", encoding="utf-8")
                files[run].write(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str) + "\n")
            for file in files.values():
                file.close()
        except BaseException:
            for name in made:
                os.unlink(name)
            raise
        return _Written(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """Gives the files their names, none of which may exist; if one does, all of this write go."""
        made = [f for m in messages if m is not None for f in m.files]
        done = []
        try:
            for name in made:
                run = os.path.basename(name)[1:].rsplit(".", 2)[0]
                final = f"{self.path}/{run}.jsonl"
                os.link(name, final)  # fails where the name is taken
                done.append(final)
        except BaseException:
            for final in done:
                os.unlink(final)
            self._clean(made)
            raise
        self._clean(made)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clean([f for m in messages if m is not None for f in m.files])

    @staticmethod
    def _clean(files: list[str]) -> None:
        for name in files:
            if os.path.exists(name):
                os.unlink(name)


class RunRecords(DataSource):
    """Writes rows as JSON lines, a file {run}.jsonl per run in a folder that all executors share; append only, and never over a file.

    Options: path; run, the column that names the run, run_id by default. All rows of a run must be in
    one partition, as save_runs() sees to; a second file of a run is an error, as is a run that is there already.
    Files get their names when all tasks have ended, so that a write that fails leaves none.
    """

    @classmethod
    def name(cls) -> str:
        return "run_records"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("run records are only appended")
        path = self.options["path"].removeprefix("file://")
        return _RunWriter(path, schema.fieldNames(), self.options.get("run", "run_id"))


def save_runs(rows: DataFrame, path: str, run: str = "run_id", order: list[str] | None = None) -> None:
    """Writes a file of JSON lines per run, its rows in this order."""
    spark = rows.sparkSession
    spark.dataSource.register(RunRecords)
    dealt = rows.repartition(run).sortWithinPartitions(run, *(order or []))
    dealt.write.format("run_records").mode("append").option("path", path).option("run", run).save()
