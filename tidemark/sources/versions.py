"""A table of documents in versions: what is new is added, and a manifest that is swapped in last says what counts.

A folder holds data/ (a parquet folder for each commit, with the rows of new and changed documents),
documents/ (for each commit the whole list of documents, their content hashes and data folders) and
manifests/ (a small JSON file for each version, which names the two). A commit writes its folders
under fresh names, then moves its manifest to the next number, which fails if that is taken. Until then
readers see the version before, and so they do if the writer is killed; its folders are just never named.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has made the version meanwhile."""


class VersionedTable:
    """Rows by document_id and content_hash; all rows of one commit have the same columns."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._jpath(self.path).toUri() if self._fs.getScheme() != "file" else jvm.java.net.URI("file:///"), spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def versions(self) -> list[int]:
        """Numbers of the versions, rising."""
        top = self._jpath(f"{self.path}/manifests")
        if not self._fs.exists(top):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(top)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict | None:
        """The manifest of a version, by default the newest; None of an empty table."""
        there = self.versions()
        if not there:
            return None
        stream = self._fs.open(self._jpath(f"{self.path}/manifests/{there[-1] if version is None else version:010d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        """Makes the manifest the version it names, in one move, if there is none yet."""
        temporary = self._jpath(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        option = gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(temporary.makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()), self._jpath(f"{self.path}/manifests/{manifest['version']:010d}.json").makeQualified(self._fs.getUri(), self._fs.getWorkingDirectory()), option)
        except Exception as e:
            self._fs.delete(temporary, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {manifest['version']} is there already") from None
            raise

    def commit(self, rows: DataFrame, batch_id: str) -> int:
        """Adds documents that are new or whose hash differs, which replace those of the same id; returns the version.

        rows: document_id, content_hash and more, several rows a document if they share the hash. A batch that
        was committed before changes nothing, so that a stream's foreachBatch may repeat one.
        """
        base = self.manifest()
        if base is not None and batch_id in base["batches"]:
            return base["batches"][batch_id]
        version = 1 if base is None else base["version"] + 1
        fresh = uuid.uuid4().hex
        kept = None if base is None else self.documents()
        new = rows if kept is None else rows.join(kept.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")
        new.write.parquet(f"{self.path}/data/{fresh}")
        added = self.spark.read.parquet(f"{self.path}/data/{fresh}").groupBy("document_id").agg(F.min("content_hash").alias("content_hash"), F.max("content_hash").alias("most"))
        if added.where("content_hash != most").limit(1).count():
            raise ValueError("a document has several content hashes in one batch")
        listed = added.select("document_id", "content_hash", F.lit(fresh).alias("folder"))
        if kept is not None:
            listed = kept.join(listed.select("document_id"), "document_id", "left_anti").unionByName(listed)
        listed.write.parquet(f"{self.path}/documents/{fresh}")
        folders = [*(base["folders"] if base else []), fresh]
        batches = dict(base["batches"]) if base else {}
        self._publish({"version": version, "documents": fresh, "folders": folders, "batches": batches | {batch_id: version}})
        return version

    def documents(self, version: int | None = None) -> DataFrame:
        """document_id, content_hash and folder of the documents of a version."""
        found = self.manifest(version)
        if found is None:
            return self.spark.createDataFrame([], "document_id long, content_hash string, folder string")
        return self.spark.read.parquet(f"{self.path}/documents/{found['documents']}")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of the documents of a version."""
        found = self.manifest(version)
        if found is None:
            raise ValueError("the table has no version")
        rows = self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/data/{f}" for f in found["folders"]])
        folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
        return rows.withColumn("folder", folder).join(self.documents(version), ["document_id", "content_hash", "folder"], "left_semi").drop("folder")
