"""Streams with state, over several triggers, against the batch queries over the same rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.plans import records
from tidemark.sources import views
from tidemark.streaming import event_log, replay

DATA = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)
EVENT = "thread_id long, turn long, type string, data string, created_at timestamp"
ASK = "thread_id long, request_id long, cursor long, created_at timestamp"


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def feed(spark, folder, batches, schema):
    """A file a trigger, in this order; empty batches are files of no rows."""
    folder.mkdir()
    for k, rows in enumerate(batches):
        part = folder / f"stage-{k}"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        file = next(part.glob("*.parquet"))
        file.rename(folder / f"{k:03}.parquet")
        import os

        os.utime(folder / f"{k:03}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "[0-9]*.parquet").parquet(str(folder))


def drained(spark, stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return spark.table(name).collect(), q


def test_ring_cursors_and_drops(spark, tmp_path):
    def at(s):
        return START + timedelta(seconds=s)

    events = [
        [(1, 1, "stage", "a", at(0)), (1, 3, "answer_delta", "c", at(0)), (1, 2, "answer_delta", "b", at(0)), (2, 1, "stage", "x", at(0))],
        [(1, 4, "completed", "d", at(10)), (2, 2, "failed", "y", at(10)), (2, 3, "stage", "z", at(10))],
        [(3, 1, "stage", "later", at(400))],
        [(3, 2, "stage", "later", at(401))],
        [(1, 1, "stage", "anew", at(500)), (2, 4, "stage", "w", at(500))],
    ]
    asks = [
        [(1, 10, 0, at(0))],
        [(1, 11, 0, at(10)), (1, 12, 1, at(10)), (1, 13, 4, at(10)), (1, 14, 9, at(10)), (2, 15, 0, at(10))],
        [(9, 16, 0, at(400)), (9, 17, 3, at(400))],
        [],
        [(1, 18, 0, at(500)), (2, 19, 3, at(500))],
    ]
    stream = replay.replay_stream(feed(spark, tmp_path / "e", events, EVENT), feed(spark, tmp_path / "a", asks, ASK), keep=3, ttl_s=300)
    rows, _ = drained(spark, stream, "ring", tmp_path)
    sent = sorted((r["thread_id"], r["event_id"], r["data"]) for r in rows if r["kind"] == "event")
    assert sent == [(1, 1, "a"), (1, 1, "anew"), (1, 2, "b"), (1, 3, "c"), (1, 4, "d"), (2, 1, "x"), (2, 2, "y"), (2, 3, "z"), (2, 4, "w"), (3, 1, "later"), (3, 2, "later")]
    replayed = {}
    for r in rows:
        if r["kind"] == "replayed":
            replayed.setdefault(r["request_id"], []).append(r["data"])
    assert replayed == {10: ["a", "b", "c"], 11: ["b", "c", "d"], 12: ["b", "c", "d"], 15: ["x", "y", "z"], 18: ["anew"], 19: ["w"]}
    ends = {r["request_id"]: r["complete"] for r in rows if r["kind"] == "replay_end"}
    assert ends == {10: True, 11: False, 12: True, 13: True, 14: False, 15: True, 16: True, 17: False, 18: True, 19: True}
    assert [r["thread_id"] for r in rows if r["kind"] == "dropped"] == [1]


def test_stream_equals_the_batch_buffer(spark, tmp_path):
    log = event_log.numbered(views.event_log(spark, DATA))
    rows = [(r["thread_id"], r["turn"], r["type"], r["data"], START + timedelta(seconds=10 * min(3, r["turn"] // 2))) for r in log.collect()]
    third = [[r for r in rows if min(3, r[1] // 2) == k] for k in range(4)]
    threads = sorted({r[0] for r in rows})
    asks = [[], [], [], [(t, 100 * t + c, c, START + timedelta(seconds=90)) for t in threads for c in (0, 1, 2, 5, 9)]]
    stream = replay.replay_stream(feed(spark, tmp_path / "e", third, EVENT), feed(spark, tmp_path / "a", asks, ASK), keep=3, ttl_s=10_000)
    found, _ = drained(spark, stream, "buffer", tmp_path)
    buffer = event_log.replay_buffer(log, 3)
    want = {(r["thread_id"], r["event_id"], r["data"]) for r in buffer.collect()}
    assert {(r["thread_id"], r["event_id"], r["data"]) for r in found if r["kind"] == "replayed" and r["request_id"] == 100 * r["thread_id"]} == want
    cursors = spark.createDataFrame([(t, c) for t in threads for c in (0, 1, 2, 5, 9)], "thread_id long, cursor long")
    batch = {(r["thread_id"], r["cursor"]): (r["n_events"], r["complete"]) for r in event_log.replay(buffer, cursors).collect()}
    counts = {}
    for r in found:
        if r["kind"] == "replayed":
            counts[r["request_id"]] = counts.get(r["request_id"], 0) + 1
    ends = {r["request_id"]: r["complete"] for r in found if r["kind"] == "replay_end"}
    assert {k: (counts.get(100 * k[0] + k[1], 0), ends[100 * k[0] + k[1]]) for k in batch} == batch


def test_late_future_and_repeated_ticks_count_once(spark, tmp_path):
    ticks = records.arriving_ticks(spark, DATA).where("trigger % 4 < 3")
    rows = ticks.orderBy("trigger").collect()
    triggers = sorted({r["trigger"] for r in rows})
    step = -(-len(triggers) // 6)
    number = {t: k // step for k, t in enumerate(triggers)}
    batches = [[tuple(r[c] for c in ("symbol", "event_id", "ts", "received_at")) for r in rows if min(5, number[r["trigger"]] + 2 * (r["event_id"] % 10 == 0)) == k] for k in range(6)]
    schema = ", ".join(f"{c} {t}" for c, t in ticks.dtypes if c != "trigger")
    found, _ = drained(spark, replay.arrivals(feed(spark, tmp_path / "t", batches, schema), parts=3), "arrivals", tmp_path)
    stored = spark.createDataFrame([(*r, k) for k, part in enumerate(batches) for r in part], schema + ", k int")
    batch = replay.arrivals_of(stored, F.col("k"), parts=3).collect()

    def counted(some):
        return sorted((r["symbol"], r["event_id"], r["ts_us"], r["status"]) for r in some)

    assert counted(found) == counted(batch) and len(found) == len(rows)
    assert {r["status"] for r in found} == {"on_time", "late", "future", "repeated"}
