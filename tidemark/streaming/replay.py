"""Streams with state of their own: a replay buffer per thread, and the arrival of ticks against a watermark.

Both need the RocksDB state store. What a key has in one trigger is handled in an order that its rows
give, so that a stream gives what the batch queries over the same rows give.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.event_log import KEEP, TERMINAL, TTL_S

SENT = "thread_id long, kind string, request_id long, event_id long, turn long, type string, data string, complete boolean"
_EVENT = "event_id long, turn long, type string, data string"


class _Replay(StatefulProcessor):
    """A thread's newest events in a ring of slots, its last id, and a timer once it has ended."""

    def __init__(self, keep: int, ttl_s: int) -> None:
        self.keep, self.ttl_ms = keep, ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long")
        self.ring = handle.getMapState("ring", "slot long", _EVENT)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        events = found[found["request_id"].isna()].sort_values(["turn", "type", "data"])
        asked = found[found["request_id"].notna()].sort_values("request_id")
        last = self.last.get()[0] if self.last.exists() else 0
        out = []
        for turn, kind, data, at in zip(events["turn"], events["type"], events["data"], events["created_at"]):
            last += 1
            self.ring.updateValue((last % self.keep,), (last, int(turn), kind, data))
            out.append((key[0], "event", None, last, int(turn), kind, data, None))
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            if kind in TERMINAL:
                self.handle.registerTimer(int(pd.Timestamp(at).value // 1_000_000) + self.ttl_ms)
        if len(events):
            self.last.update((last,))
        first = max(1, last - self.keep + 1)
        for request, cursor in zip(asked["request_id"], asked["cursor"]):
            start = max(int(cursor) + 1, first)
            for slot in range(start, last + 1):
                out.append((key[0], "replayed", int(request), *self.ring.getValue((slot % self.keep,)), None))
            complete = cursor == last or first - 1 <= cursor < last
            out.append((key[0], "replay_end", int(request), None, None, None, None, bool(complete)))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SENT.split(", ")]).astype({"request_id": "Int64", "event_id": "Int64", "turn": "Int64", "complete": "boolean"})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.last.clear()
        self.ring.clear()
        yield pd.DataFrame(
            [(key[0], "dropped", None, None, None, None, None, None)], columns=[c.split()[0] for c in SENT.split(", ")]
        ).astype({"request_id": "Int64", "event_id": "Int64", "turn": "Int64", "complete": "boolean"})

    def close(self) -> None:
        pass


def replay_stream(events: DataFrame, requests: DataFrame, keep: int = KEEP, ttl_s: int = TTL_S, delay: str = "0 seconds") -> DataFrame:
    """What a thread's readers are sent: each event with its id (kind event), and for each request the kept events after its cursor, in order, and whether none is lost.

    events: thread_id, turn, type, data, created_at. requests: thread_id, request_id, cursor, created_at.
    Both are streams. Within a trigger a thread's events come in order of turn, type and data, then
    its requests. A thread whose newest event is terminal is dropped (kind dropped) when the
    watermark, delay behind the newest created_at, is ttl_s past it, and begins anew at id 1.
    Rows behind the watermark are dropped by Spark; arrivals() tells them apart beforehand.
    """
    none = F.lit(None)
    one = events.select("thread_id", none.cast("long").alias("request_id"), none.cast("long").alias("cursor"), "turn", "type", "data", F.col("created_at").cast("timestamp").alias("created_at"))
    two = requests.select(
        "thread_id", F.col("request_id").cast("long").alias("request_id"), F.col("cursor").cast("long").alias("cursor"), none.cast("long").alias("turn"), none.cast("string").alias("type"), none.cast("string").alias("data"),
        F.col("created_at").cast("timestamp").alias("created_at"),
    )
    both = one.unionByName(two).withWatermark("created_at", delay)
    return both.groupBy("thread_id").transformWithStateInPandas(statefulProcessor=_Replay(keep, ttl_s), outputStructType=SENT, outputMode="Append", timeMode="EventTime")


#: Seconds that a tick may be behind the newest one seen before it, and ahead of its receipt.
LATE_S, AHEAD_S = 300, 5


class _Arrivals(StatefulProcessor):
    """The newest time that counts, and the ids seen since the watermark, by minute."""

    def __init__(self, late_s: int, ahead_s: int) -> None:
        self.late_s, self.ahead_s = late_s, ahead_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ts long")
        self.seen = handle.getMapState("seen", "minute long", "ids array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["event_id", "received_us", "ts_us"])
        newest = self.newest.get()[0] if self.newest.exists() else None
        mark = None if newest is None else newest - self.late_s * 1_000_000
        if mark is not None:
            for (minute,) in list(self.seen.keys()):
                if (minute + 1) * 60_000_000 <= mark:
                    self.seen.removeKey((minute,))
        held: dict[int, set[int]] = {}
        status = []
        for event_id, ts, received in zip(found["event_id"], found["ts_us"], found["received_us"]):
            minute = ts // 60_000_000
            if ts > received + self.ahead_s * 1_000_000:
                status.append("future")
            elif mark is not None and ts < mark:
                status.append("late")
            else:
                if minute not in held:
                    held[minute] = set(self.seen.getValue((minute,))[0]) if self.seen.containsKey((minute,)) else set()
                status.append("repeated" if event_id in held[minute] else "on_time")
                held[minute].add(event_id)
                newest = ts if newest is None else max(newest, ts)
        for minute, ids in held.items():
            self.seen.updateValue((int(minute),), (sorted(int(i) for i in ids),))
        if newest is not None:
            self.newest.update((int(newest),))
        found["status"] = status
        yield found[["symbol", "part", "event_id", "ts_us", "status"]]

    def close(self) -> None:
        pass


def _keyed(ticks: DataFrame, parts: int, *more: str) -> DataFrame:
    part = F.pmod(F.xxhash64("event_id"), F.lit(parts)).cast("long").alias("part")
    return ticks.select("symbol", part, "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("received_us"), *more)


def arrivals(ticks: DataFrame, late_s: int = LATE_S, ahead_s: int = AHEAD_S, parts: int = 1) -> DataFrame:
    """symbol, part, event_id, ts_us and status of each tick of a stream (symbol, event_id, ts, received_at): none is dropped.

    future: more than ahead_s after its receipt, which moves no watermark. late: more than late_s behind
    the newest tick of earlier triggers. repeated: an id with the same minute that has been seen
    since. Else on_time. A symbol's ids are dealt into parts, each with its own newest tick, so
    that a frequent symbol is no single task. State is what is not yet behind the watermark.
    """
    return _keyed(ticks, parts).groupBy("symbol", "part").transformWithStateInPandas(
        statefulProcessor=_Arrivals(late_s, ahead_s), outputStructType="symbol string, part long, event_id long, ts_us long, status string", outputMode="Append", timeMode="None"
    )


def arrivals_of(ticks: DataFrame, trigger: Column, late_s: int = LATE_S, ahead_s: int = AHEAD_S, parts: int = 1) -> DataFrame:
    """arrivals() over stored ticks, with the column trigger, the number of the batch that each came in."""
    rows = _keyed(ticks.withColumn("trigger", trigger), parts, "trigger").withColumn("future", F.col("ts_us") > F.col("received_us") + ahead_s * 1_000_000)
    key = ["symbol", "part"]
    newest = rows.groupBy(*key, "trigger").agg(F.max(F.when(~F.col("future"), F.col("ts_us"))).alias("newest"))
    before = Window.partitionBy(*key).orderBy("trigger").rowsBetween(Window.unboundedPreceding, -1)
    marks = newest.select(*key, "trigger", (F.max("newest").over(before) - late_s * 1_000_000).alias("mark"))
    judged = rows.join(marks, [*key, "trigger"]).withColumn("late", ~F.col("future") & F.coalesce(F.col("ts_us") < F.col("mark"), F.lit(False)))
    taken = F.when(~F.col("future") & ~F.col("late"), 1).otherwise(0)
    same = Window.partitionBy(*key, "event_id", F.floor(F.col("ts_us") / 60_000_000)).orderBy("trigger", "received_us", "ts_us").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    status = F.when(F.col("future"), "future").when(F.col("late"), "late").when(F.sum(taken).over(same) > 1, "repeated").otherwise("on_time")
    return judged.select("symbol", "part", "event_id", "ts_us", "trigger", status.alias("status"))
