"""WARC archives as a Spark data source, format "warc".

Reading plans partitions over files, by their sizes. A record's headers are parsed first; filters
on record_type and on the columns taken from headers are pushed down and decided on them, and a
payload is inflated and decoded only for records that pass. Each record written here is a gzip member
of its own that carries its lengths in the "sl" field of the gzip header, so that the rest of an
unwanted record is skipped without inflating it. Members without it, members of several records, and
files that aren't compressed are read too. Option payload=false leaves all payloads out.

Writing makes files of about FILE_BYTES and, when the job commits, a manifest that names the files
of the tasks that counted, so that files of lost or repeated tasks are never read.

Defined results: a null payload is empty. Null header columns leave their header out. Characters
that would break a header line are percent-encoded. A record without a block gives an empty
payload; an empty folder gives no rows. Names of headers are matched without case; of a name that
repeats, values are joined by commas. A response whose body can't be decoded (no end of HTTP headers,
bad chunks or bad compression) gives its bytes as they are and a null status; a coding that isn't
known leaves the body as it is. A file that ends within a record, or whose records can't be parsed,
is an error that names the file, as leaving its rest out would lose records unseen. Filters reach the
source by a session setting that register() turns on. Pages: see archive() and pages_of().
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from tidemark.llm.common import cut, lookup, ready, shared_folder

FILE_BYTES = 128 << 20
SCAN_BYTES = 128 << 20
ROWS = 512
BATCH_BYTES = 8 << 20
LEVEL = 3
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"

#: Columns and the headers that they come from.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "warc_date": "WARC-Date",
    "refers_to": "WARC-Refers-To",
    "payload_digest": "WARC-Payload-Digest",
    "content_type": "Content-Type",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, http_status int, payload binary"
ARROW = pa.schema([*[(c, pa.string()) for c in HEADERS], ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("payload", pa.binary())])


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _line(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(row: dict) -> bytes:
    """The bytes of one record. row has the columns of SCHEMA; headers holds more headers."""
    payload = row.get("payload") or b""
    revisit = row.get("record_type") == "revisit"
    status = f"HTTP/1.1 {row.get('http_status') or 200} OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = status.encode() + (b"" if revisit else payload)
    named = {h: row.get(c) for c, h in HEADERS.items()} | ({"WARC-Profile": SAME_PAYLOAD} if revisit else {}) | dict(row.get("headers") or {})
    lines = ["WARC/1.1", *(f"{k}: {_line(v)}" for k, v in named.items() if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member of data that states its own length."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    extra_length = 12
    total = 12 + extra_length + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff" + struct.pack("<H2sHII", extra_length, b"sl", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Bytes:
    """A stream that can be looked ahead in."""

    def __init__(self, file):
        self.file, self.held, self.at, self.over = file, b"", 0, False

    def need(self, n: int) -> bytes:
        while len(self.held) - self.at < n and not self.over:
            more = self.file.read(max(1 << 20, n - len(self.held) + self.at))
            self.over = not more
            self.held = self.held[self.at :] + more
            self.at = 0
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> bytes:
        out = self.need(n)
        self.at += len(out)
        return out

    def back(self, n: int) -> None:
        """Goes back by n bytes of those taken last."""
        self.at -= n

    def skip(self, n: int) -> None:
        here = min(n, len(self.held) - self.at)
        self.at += here
        if n > here:
            self.file.seek(n - here, 1)


class _Member:
    """Inflates one gzip member, a part at a time, and has one record or several."""

    def __init__(self, source: _Bytes):
        self.source, self.inflater, self.out = source, zlib.decompressobj(31), b""
        head = source.need(24)
        known = len(head) == 24 and head[3] == 4 and head[12:14] == b"sl"
        self.length, self.whole = struct.unpack("<II", head[16:24]) if known else (0, 0)
        self.used, self.done = 0, False

    def _more(self) -> bool:
        if self.inflater.eof:
            return False
        data = self.inflater.unconsumed_tail or self.source.take(1 << 14)
        if not data:
            raise EOFError("a gzip member ends early")
        self.out += self.inflater.decompress(data, 1 << 16)
        left = len(self.inflater.unconsumed_tail)
        if self.inflater.eof:
            left = len(self.inflater.unused_data)
            self.source.back(left)
        self.used += len(data) - left
        return True

    def begins(self) -> bool:
        """Whether another record follows; goes to its start."""
        while True:
            self.out = self.out.lstrip(b"\r\n")
            if self.out:
                return True
            if not self._more():
                return False

    def upto(self, mark: bytes) -> bytes:
        while (at := self.out.find(mark)) < 0 and self._more():
            pass
        if at < 0:
            raise ValueError("a record has no end of headers")
        found, self.out = self.out[:at], self.out[at + len(mark) :]
        return found

    def exactly(self, n: int) -> bytes:
        parts, size = [self.out], len(self.out)
        while size < n:
            self.out = b""
            if not self._more():
                raise EOFError("a record ends early")
            parts.append(self.out)
            size += len(self.out)
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]

    def leave(self, head: int, n: int) -> None:
        """Goes past a block of n bytes after head bytes of headers, without inflating if it is known to be the member's last."""
        if self.length and self.whole <= head + n + 4 and not self.inflater.eof:
            self.source.back(len(self.inflater.unconsumed_tail))
            self.source.skip(self.length - self.used)
            self.inflater, self.out = zlib.decompressobj(31), b""
            self.done = True
            return
        while len(self.out) < n:
            n -= len(self.out)
            self.out = b""
            if not self._more():
                raise EOFError("a record ends early")
        self.out = self.out[n:]


class _Plain:
    """A record of a file that isn't compressed."""

    def __init__(self, source: _Bytes):
        self.source = source

    def upto(self, mark: bytes) -> bytes:
        n = 1 << 12
        while (at := self.source.need(n).find(mark)) < 0:
            if self.source.over:
                raise ValueError("a record has no end of headers")
            n *= 2
        found = self.source.take(at)
        self.source.take(len(mark))
        return found

    def exactly(self, n: int) -> bytes:
        found = self.source.take(n)
        if len(found) < n:
            raise EOFError("a record ends early")
        return found

    def leave(self, head: int, n: int) -> None:
        self.source.skip(n)


def _headers(head: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    last = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in " \t" and last:
            found[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            found[last] = f"{found[last]}, {value.strip()}" if last in found else value.strip()
    return found


def _unchunked(body: bytes) -> bytes:
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        n = int(body[at:line].split(b";")[0], 16)
        if not n:
            return b"".join(parts)
        if n < 0 or line + 2 + n > len(body):
            raise ValueError("a chunk ends early")
        parts.append(body[line + 2 : line + 2 + n])
        at = line + 2 + n + 2


def _http(block: bytes) -> tuple[int | None, bytes]:
    """Status and body of an HTTP response; null and the bytes as they are if it can't be decoded."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not head.startswith(b"HTTP/") or not mark:
        return None, block
    first = head.split(b"\r\n", 1)[0].split()
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    coding = fields.get(b"content-encoding")
    plain = body
    try:
        if fields.get(b"transfer-encoding") == b"chunked":
            plain = _unchunked(plain)
        if coding in (b"gzip", b"x-gzip") and plain:
            plain = gzip.decompress(plain)
        elif coding == b"deflate" and plain:
            plain = zlib.decompress(plain, 15 if plain[0] & 15 == 8 else -15)
    except (ValueError, EOFError, OSError, zlib.error):
        return None, body
    return int(first[1]) if len(first) > 1 and first[1].isdigit() else None, plain


def records(file, passes, payloads: bool = True) -> Iterator[dict]:
    """The records of an open file for whose headers passes() holds."""
    source = _Bytes(file)
    while True:
        while source.need(1) in (b"\r", b"\n"):
            source.take(1)
        start = source.need(2)
        if not start:
            return
        one = _Member(source) if start == b"\x1f\x8b" else _Plain(source)
        if isinstance(one, _Plain):
            yield from _record(one, passes, payloads)
            continue
        while not one.done and one.begins():
            yield from _record(one, passes, payloads)


def _record(one: _Member | _Plain, passes, payloads: bool) -> Iterator[dict]:
    """The next record, if passes() holds for it."""
    head = one.upto(b"\r\n\r\n")
    headers = _headers(head)
    lower = {k.lower(): v for k, v in headers.items()}
    size = int(lower.get("content-length") or 0)
    row = {c: lower.get(h.lower()) for c, h in HEADERS.items()} | {"headers": headers, "http_status": None, "payload": None}
    wanted = passes(row)
    if wanted and payloads and row["record_type"] != "revisit":
        block = one.exactly(size)
        row["http_status"], row["payload"] = _http(block) if row["record_type"] == "response" else (None, block)
    else:
        one.leave(len(head) + 4, size)
    if wanted:
        yield row


@dataclass
class _Files(InputPartition):
    paths: tuple[str, ...]


def _test(f: Filter):
    """A function of a row for a filter on a header column, or None if it can't be decided on headers."""
    name = getattr(f, "attribute", ())
    if len(name) != 1 or name[0] not in HEADERS:
        return None
    column = name[0]
    kinds = {
        EqualTo: lambda v, x: v is not None and v == x,
        EqualNullSafe: lambda v, x: v == x,
        In: lambda v, x: v is not None and v in x,
        StringStartsWith: lambda v, x: v is not None and v.startswith(x),
        StringEndsWith: lambda v, x: v is not None and v.endswith(x),
        StringContains: lambda v, x: v is not None and x in v,
    }
    if type(f) in kinds:
        return lambda row, test=kinds[type(f)], x=f.value: test(row[column], x)
    if type(f) in (IsNotNull, IsNull):
        return lambda row, wanted=type(f) is IsNull: (row[column] is None) == wanted
    return None


def _named(path: str, rows: Iterator[dict]) -> Iterator[dict]:
    try:
        yield from rows
    except (ValueError, EOFError, zlib.error) as error:
        raise ValueError(f"{path}: {error}") from error


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = str(options.get("payload", "true")).lower() != "false"
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, top = _store(self.path)
        info = store.get_file_info(top)
        if info.type == fs.FileType.File:
            return [_Files((top,))]
        found = {x.path: x.size for x in store.get_file_info(fs.FileSelector(top, recursive=True)) if x.path.endswith((".warc", ".warc.gz"))}
        named = f"{top}/{MANIFEST}"
        if store.get_file_info(named).type == fs.FileType.File:
            kept = set(json.loads(store.open_input_stream(named).readall()))
            found = {p: n for p, n in found.items() if p.rsplit("/", 1)[-1] in kept}
        groups: list[_Files] = []
        now: list[str] = []
        size = 0
        for path, n in sorted(found.items()):
            if now and size + n > SCAN_BYTES:
                groups.append(_Files(tuple(now)))
                now, size = [], 0
            now.append(path)
            size += n
        return [*groups, _Files(tuple(now))]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        tests = [_test(f) for f in self.filters]
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with store.open_input_file(path) as file:
                for row in _named(path, records(file, lambda r: all(t(r) for t in tests), self.payloads)):
                    row["headers"] = list(row["headers"].items())
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= ROWS or size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


@dataclass
class _Done(WriterCommitMessage):
    names: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        names: list[str] = []
        out, size = None, 0
        for batch in iterator:
            columns = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{top}/{names[-1]}", compression=None), 0
                data = member(record({name: c[i].as_py() for name, c in columns.items()}))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Done(tuple(names))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = _store(self.path)
        store.create_dir(top, recursive=True)
        names = [n for m in messages if m for n in m.names]
        named = f"{top}/{MANIFEST}"
        if not self.overwrite and store.get_file_info(named).type == fs.FileType.File:
            names = [*json.loads(store.open_input_stream(named).readall()), *names]
        with store.open_output_stream(named, compression=None) as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, top = _store(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{top}/{name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ready(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


#: Payloads under this many bytes are never revisited.
LEAST_BYTES = 100
PAGE, FIRST_PAGE, PAYLOAD_BYTES = "Page-Id", "Refers-To-Page-Id", "Payload-Length"


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def archive(pages: DataFrame, path: str) -> None:
    """Writes a record per page: the first of equal payloads, by page_id, as response, others as revisit.

    Payloads of fewer than LEAST_BYTES bytes are all responses, and so are pages without an id.
    Rows that repeat the smallest id are responses too.
    """
    register(pages.sparkSession)
    row = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    ).withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    small = cut(row.where((F.col("bytes") >= LEAST_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest"))
    firsts = lookup(cut(small.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")))
    # Whole rows meet the verdicts by page, as a payload that is everywhere would be one key.
    verdicts = lookup(cut(small.join(firsts, "digest").where("page_id > first").distinct()))
    named = row.where("page_id IS NOT NULL").join(verdicts, ["page_id", "digest"], "left")
    placed = named.unionByName(row.where("page_id IS NULL").withColumn("first", F.lit(None).cast("long")))
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    fields = F.map_from_arrays(
        F.array(F.lit(PAGE), F.lit(FIRST_PAGE), F.lit(PAYLOAD_BYTES)),
        F.array(F.col("page_id").cast("string"), F.when(again, F.col("first")).cast("string"), F.col("bytes").cast("string")),
    )
    placed.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        _urn(F.col("page_id")).alias("record_id"),
        F.col("url").cast("string").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.when(again, _urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        fields.alias("headers"),
        F.lit(200).alias("http_status"),
        F.when(~again, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def pages_of(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of an archive of pages: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Responses are measured on the payloads that are read; revisits have no payload, and what their
    headers say of it stands.
    """
    register(spark)
    page = F.col("headers")[PAGE].cast("long").alias("page_id")
    kind = F.col("record_type")
    # Loaded twice: filters pushed to one loaded source would hold for every use of it.
    responses = spark.read.format("warc").load(path).where(kind == "response").select(
        page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), kind,
        F.lit(None).cast("long").alias("refers_to"),
    )
    revisits = spark.read.format("warc").load(path).where(kind == "revisit").select(
        page, F.col("headers")[PAYLOAD_BYTES].cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), kind,
        F.col("headers")[FIRST_PAGE].cast("long").alias("refers_to"),
    )
    return responses.unionByName(revisits)


def round_trip(pages: DataFrame) -> DataFrame:
    """Archives pages in the shared folder and reads them back."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archive(pages, path)
    return pages_of(spark, path)
