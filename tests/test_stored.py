"""Files, the run-record sink and the versioned table, with writers that fail and batches that repeat."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, versions


def test_text_files_are_read_whole(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo", encoding="utf-8")
    (tmp_path / "b.txt").write_text("", encoding="utf-8")
    rows = {r["source"].rsplit("/", 1)[1]: r for r in files.text_files(spark, str(tmp_path), F.upper(F.regexp_extract("source", "([a-z])\\.txt", 1))).collect()}
    assert rows["a.txt"]["content"] == "one\n\ntwo" and rows["a.txt"]["company_id"] == "A" and rows["a.txt"]["n_bytes"] == 8
    assert "b.txt" not in rows and files.text_files(spark, str(tmp_path)).first()["company_id"] is None


def test_cases_name_their_fault(spark, tmp_path):
    good = {"case_id": "a", "input": {"x": "1"}, "expected": {}, "scripted_responses": ["r"]}
    lines = [json.dumps(good), "", "{", "[1]", json.dumps(good | {"case_id": 3}), json.dumps(good), json.dumps(good | {"case_id": "b", "input": 1}), json.dumps(good | {"case_id": "c", "scripted_responses": {}}), "null"]
    (tmp_path / "cases.jsonl").write_text("\n".join(lines))
    rows = {r["line"]: r for r in files.cases(spark, str(tmp_path)).collect()}
    assert {k: r["fault"] for k, r in rows.items()} == {1: None, 3: "not_json", 4: "no_case_id", 5: "no_case_id", 6: "repeated_case_id", 7: "no_input_or_expected", 8: "no_responses", 9: "no_case_id"}
    assert rows[1]["input"] == {"x": "1"} and rows[1]["scripted_responses"] == ["r"]


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"{k}\n" for k in range(1, 5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r["line"] == int(r["value"]) for r in rows)


def runs(spark, ids):
    return spark.createDataFrame([(r, k, "é \n") for r in ids for k in range(3)], "run_id string, k int, text string")


def test_run_records_are_never_overwritten(spark, tmp_path):
    files.save_runs(runs(spark, ["a", "b"]), str(tmp_path), order=["k"])
    assert sorted(os.listdir(tmp_path)) == ["a.jsonl", "b.jsonl"]
    assert [json.loads(x) for x in (tmp_path / "a.jsonl").read_text().splitlines()] == [{"run_id": "a", "k": k, "text": "é \n"} for k in range(3)]
    before = (tmp_path / "b.jsonl").read_text()
    with pytest.raises(Exception, match="File exists|FileExists"):
        files.save_runs(runs(spark, ["b", "c"]).withColumn("text", F.lit("other")), str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["a.jsonl", "b.jsonl"] and (tmp_path / "b.jsonl").read_text() == before
    with pytest.raises(Exception, match="appended"):
        runs(spark, ["d"]).write.format("run_records").mode("overwrite").option("path", str(tmp_path)).save()


def test_a_task_that_fails_leaves_no_file(spark, tmp_path):
    bad = runs(spark, [f"r{k}" for k in range(20)]).withColumn("k", F.when((F.col("run_id") == "r7") & (F.col("k") == 2), F.raise_error(F.lit("broken"))).otherwise(F.col("k")))
    with pytest.raises(Exception, match="broken"):
        files.save_runs(bad, str(tmp_path))
    assert os.listdir(tmp_path) == []


def index(spark, rows):
    return spark.createDataFrame(rows, "document_id long, content_hash string, chunk string")


def content(table, version=None):
    return sorted((r["document_id"], r["content_hash"], r["chunk"]) for r in table.read(version).collect())


FIRST = [(1, "a", "1.0"), (1, "a", "1.1"), (2, "b", "2.0"), (3, "c", "3.0")]
SECOND = [(2, "B", "2.0 new"), (3, "c", "not taken, same hash"), (4, "d", "4.0"), (4, "d", "4.1")]
BOTH = sorted([*FIRST[:2], SECOND[0], FIRST[3], *SECOND[2:]])


def test_versions_overlay_and_stay_readable(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    assert table.manifest() is None and table.documents().collect() == []
    assert table.commit(index(spark, FIRST), "one") == 1
    assert table.commit(index(spark, SECOND), "two") == 2
    assert table.commit(index(spark, [(9, "z", "z")]), "two") == 2  # the batch comes again
    assert content(table) == BOTH and content(table, 1) == sorted(FIRST)
    assert table.commit(index(spark, []), "empty") == 3 and content(table) == BOTH
    with pytest.raises(ValueError, match="several content hashes"):
        table.commit(index(spark, [(7, "x", ""), (7, "y", "")]), "bad")
    assert content(table) == BOTH


@pytest.mark.parametrize("step", ["data", "documents", "swap"])
def test_a_writer_that_is_killed_changes_nothing(spark, tmp_path, monkeypatch, step):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    table.commit(index(spark, FIRST), "one")
    if step == "data":
        rows = index(spark, SECOND).withColumn("chunk", F.when(F.col("document_id") == 4, F.raise_error(F.lit("killed"))).otherwise(F.col("chunk")))
        with pytest.raises(Exception, match="killed"):
            table.commit(rows, "two")
    else:
        with monkeypatch.context() as m:
            if step == "swap":
                m.setattr(table, "_publish", lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt()))
            else:
                m.setattr(table, "documents", lambda version=None: (_ for _ in ()).throw(KeyboardInterrupt()))
            with pytest.raises(KeyboardInterrupt):
                table.commit(index(spark, SECOND), "two")
    assert versions.VersionedTable(spark, str(tmp_path / "t")).versions() == [1] and content(table) == sorted(FIRST)
    assert table.commit(index(spark, SECOND), "two") == 2 and content(table) == BOTH


def test_two_writers_of_one_version_conflict(spark, tmp_path):
    one, two = (versions.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    one.commit(index(spark, FIRST), "one")
    stale = two.manifest()
    one.commit(index(spark, SECOND), "two")
    two.manifest = lambda version=None: stale
    with pytest.raises(versions.Conflict):
        two.commit(index(spark, [(5, "e", "5")]), "three")
    assert content(one) == BOTH and one.versions() == [1, 2]


def test_a_stream_repeats_a_batch(spark, tmp_path):
    table = versions.VersionedTable(spark, str(tmp_path / "t"))
    index(spark, FIRST).coalesce(1).write.parquet(str(tmp_path / "in"))
    done = []

    def both_times(rows, batch):
        done.append(table.commit(rows, f"stream-{batch}"))
        done.append(table.commit(rows, f"stream-{batch}"))

    stream = spark.readStream.schema("document_id long, content_hash string, chunk string").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(both_times).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert done == [1, 1] and content(table) == sorted(FIRST)
