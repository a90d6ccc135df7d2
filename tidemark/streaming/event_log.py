"""The replayable event log, as a batch over stored events and as a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

KEEP = 2000
TTL_S = 300
TERMINAL = ["completed", "failed", "cancelled"]


def numbered(events: DataFrame) -> DataFrame:
    """Adds event_id, from 1 in each thread, in order of turn, type and data."""
    return events.withColumn("event_id", F.row_number().over(Window.partitionBy("thread_id").orderBy("turn", "type", "data")).cast("long"))


def replay_buffer(log: DataFrame, keep: int = KEEP) -> DataFrame:
    """The newest keep events of each thread; ids have no holes, so the largest id tells which."""
    last = log.groupBy("thread_id").agg(F.max("event_id").alias("last_id"))
    return log.join(last, "thread_id").where(F.col("event_id") > F.col("last_id") - keep)


def replay(buffer: DataFrame, cursors: DataFrame) -> DataFrame:
    """Per thread and cursor: the events to send again and whether none of them is lost."""
    ends = buffer.groupBy("thread_id").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))
    c, first, last = F.col("cursor"), F.col("first_id"), F.col("last_id")
    rows = cursors.join(ends, "thread_id", "left")
    complete = F.when(last.isNull(), c == 0).when(c > last, False).otherwise((c == last) | (c >= first - 1))
    return rows.select("thread_id", "cursor", F.coalesce(F.greatest(F.lit(0), last - F.greatest(c, first - 1)), F.lit(0)).cast("long").alias("n_events"), complete.alias("complete"))


def expired(log: DataFrame, now: Column, ttl_s: int = TTL_S) -> DataFrame:
    """Threads whose newest event is terminal and at least ttl_s old; log has created_at."""
    last = log.groupBy("thread_id").agg(F.max_by(F.struct("type", "created_at"), "event_id").alias("e"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("e.created_at").cast("timestamp"))
    return last.where(F.col("e.type").isin(TERMINAL) & (age >= ttl_s * 1_000_000)).select("thread_id")


def answers(log: DataFrame) -> DataFrame:
    """The answer of each thread: its deltas in order."""
    parts = log.where("type = 'answer_delta'").groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "data"))).alias("p"))
    return parts.select("thread_id", F.size("p").cast("long").alias("deltas"), F.array_join(F.transform("p", lambda x: x["data"]), "").alias("answer"))


def sse(log: DataFrame) -> DataFrame:
    """Events as server-sent frames."""
    data = F.regexp_replace("data", "\r\n|\r|\n", "\ndata: ")
    return log.select("thread_id", "event_id", F.concat(F.lit("id: "), F.col("event_id").cast("string"), F.lit("\nevent: "), F.col("type"), F.lit("\ndata: "), data, F.lit("\n\n")).alias("frame"))


class _Counter(StatefulProcessor):
    """Gives the events of a thread their ids, going on from the last one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", StructType([StructField("id", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else 0
        # All that a thread has in this trigger, in the order of numbered(); Arrow may hand it over in parts.
        found = pd.concat(list(rows)).sort_values(["turn", "type", "data"])
        found["event_id"] = range(last + 1, last + 1 + len(found))
        self.last.update((last + len(found),))
        yield found[["thread_id", "turn", "type", "event_id"]]

    def close(self) -> None:
        pass


def numbered_stream(events: DataFrame) -> DataFrame:
    """thread_id, turn, type and event_id of a stream of events; needs the RocksDB state store."""
    made = events.groupBy("thread_id").transformWithStateInPandas(
        statefulProcessor=_Counter(), outputStructType="thread_id long, turn long, type string, event_id long", outputMode="Append", timeMode="None"
    )
    return made


def bars_stream(trades: DataFrame, late: str = "5 minutes") -> DataFrame:
    """One-minute bars of a stream of trades (symbol, ts, price, event_id); later trades than that are dropped."""
    at = F.col("ts").cast("timestamp")
    return (
        trades.withColumn("ts", at).withWatermark("ts", late).groupBy("symbol", F.window("ts", "1 minute"))
        .agg(F.min_by("price", "event_id").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "event_id").alias("close"), F.count("*").alias("volume"))
        .select("symbol", F.col("window.start").alias("start_at"), "open", "high", "low", "close", "volume")
    )
