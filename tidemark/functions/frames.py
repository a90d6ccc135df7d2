"""Server-sent frames out of chunks that may be cut anywhere."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MOST_CHARS = 1 << 20
LARGEST_RETRY = 2**31 - 1

FRAME = "kind string, id string, event string, data string, retry bigint"
_ENDS = re.compile("\r\n|\r|\n")


class Frames:
    """What is open between two chunks of one stream: a part of a line, and the lines of an event that isn't complete.

    feed() gives rows (kind, id, event, data, retry): event, at an empty line after data; cursor, at one
    after an id alone; retry; and error, when an event outgrows most characters, after which
    nothing more is read. Lines end by CR, LF or CRLF, which may lie in two chunks. An event that the end of the
    stream cuts off is none.
    """

    def __init__(self, first_id: str = "", most: int = MOST_CHARS, state: str | None = None) -> None:
        self.most = most
        self.rest, self.after_cr, self.data, self.event, self.id, self.named, self.failed = json.loads(state) if state else ("", False, [], "", first_id, False, False)

    def state(self) -> str:
        return json.dumps([self.rest, self.after_cr, self.data, self.event, self.id, self.named, self.failed])

    def _size(self, line: str) -> int:
        return len(line) + sum(len(d) + 1 for d in self.data) + len(self.event) + len(self.id)

    def feed(self, chunk: str) -> Iterator[tuple]:
        if self.failed or not chunk:
            return
        if self.after_cr and chunk[0] == "\n":
            chunk = chunk[1:]
        self.after_cr = chunk.endswith("\r")
        *lines, self.rest = _ENDS.split(self.rest + chunk)
        for line in lines:
            if self._size(line) > self.most:
                break
            yield from self._line(line)
        else:
            if self._size(self.rest) <= self.most:
                return
        self.failed = True
        yield ("error", self.id, None, None, None)

    def _line(self, line: str) -> Iterator[tuple]:
        if not line:
            if self.data:
                yield ("event", self.id, self.event or "message", "\n".join(self.data), None)
            elif self.named:
                yield ("cursor", self.id, None, None, None)
            self.data, self.event, self.named = [], "", False
            return
        field, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if field == "data":
            self.data.append(value)
        elif field == "event":
            self.event = value
        elif field == "id" and "\0" not in value:
            self.id, self.named = value, True
        elif field == "retry" and re.fullmatch("[0-9]+", value) and int(value) <= LARGEST_RETRY:
            yield ("retry", self.id, None, None, int(value))


def parsed(chunks: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Frames of stored chunks (stream_id, seq, chunk): stream_id, n, their place in the stream from 1, and FRAME's columns.

    A stream's chunks are read in order of seq, one Arrow batch at a time, with what is open carried along.
    """
    kind = dict(chunks.dtypes)["stream_id"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, frames, n = None, None, 0
        for batch in batches:
            rows = []
            for stream_id, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if frames is None or stream_id != stream:
                    stream, frames, n = stream_id, Frames(most=most), 0
                for row in frames.feed(chunk or ""):
                    n += 1
                    rows.append((stream_id, n, *row))
            types = [batch.schema.types[0], pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows)) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["stream_id", "n", "kind", "id", "event", "data", "retry"])

    ordered = chunks.repartition("stream_id").sortWithinPartitions("stream_id", "seq").select("stream_id", "chunk")
    return ordered.mapInArrow(fold, f"stream_id {kind}, n bigint, {FRAME}")


class _Parser(StatefulProcessor):
    def __init__(self, most: int) -> None:
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "state string, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state, n = self.open.get() if self.open.exists() else (None, 0)
        frames, out = Frames(most=self.most, state=state), []
        for chunk in pd.concat(list(rows)).sort_values("seq")["chunk"]:
            for row in frames.feed(chunk or ""):
                n += 1
                out.append((key[0], n, *row))
        self.open.update((frames.state(), n))
        yield pd.DataFrame(out, columns=["stream_id", "n", "kind", "id", "event", "data", "retry"]).astype({"retry": "Int64"})

    def close(self) -> None:
        pass


def parsed_stream(chunks: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """parsed() of a stream of chunks, which come in order of seq from trigger to trigger; needs the RocksDB state store."""
    kind = dict(chunks.dtypes)["stream_id"]
    return chunks.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=_Parser(most), outputStructType=f"stream_id {kind}, n bigint, {FRAME}", outputMode="Append", timeMode="None")
