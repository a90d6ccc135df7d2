import gzip
import hashlib
import io
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc


def pages(spark):
    big, small = "x" * 150, "tiny"
    rows = [(5, "http://a/", big), (2, "http://b/\r\nX: y", big), (7, None, small), (8, "u", small), (9, "u", None), (10, "u", ""), (None, "u", big), (2, "u", big), (11, "u", "é" * 60), (12, "u", "é" * 60)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string")


def test_round_trip(spark):
    rows, frame = pages(spark)
    found = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(frame).collect())
    want = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        again = len(data) >= 100 and page is not None and page > first
        want.append((-1 if page is None else page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first if again else None))
    assert found == sorted(want, key=lambda w: (w[0], w[1]))


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_pushdown_gives_the_rows_of_a_plain_filter(spark, tmp_path):
    _, frame = pages(spark)
    warc.archive(frame, str(tmp_path / "w"))

    def load(**options):
        return spark.read.format("warc").options(**options).load(str(tmp_path / "w"))

    everything = load().collect()
    assert len(everything) == 10
    for sql in ("record_type = 'revisit'", "record_type IN ('response')", "target_uri LIKE 'http%'", "refers_to IS NULL", "target_uri LIKE '%a%' AND http_status = 200"):
        pushed = sorted(str(sorted(r["headers"].items())) for r in load().where(sql).collect())
        plain = sorted(str(sorted(r["headers"].items())) for r in spark.createDataFrame(everything, load().schema).where(sql).collect())
        assert pushed == plain
    assert load(payload="false").where(F.col("payload").isNotNull()).count() == 0


@pytest.mark.parametrize("pack", [lambda data: data, warc.member, lambda data: _gzip(data)])
def test_reads_plain_and_foreign_files(pack):
    rows = [{"record_type": "response", "target_uri": f"u{i}", "payload": bytes([65 + i]) * (i * 70000), "headers": {}} for i in range(4)]
    rows.append({"record_type": "warcinfo", "content_type": "text/plain", "payload": b"info", "headers": {"X": "a"}})
    data = b"".join(pack(warc.record(r)) for r in rows)
    found = list(warc.records(io.BytesIO(data), lambda r: True))
    assert [r["target_uri"] for r in found] == ["u0", "u1", "u2", "u3", None]
    assert [r["payload"] for r in found][:4] == [r["payload"] for r in rows][:4]
    some = list(warc.records(io.BytesIO(data), lambda r: r["target_uri"] == "u3"))
    assert [r["payload"] for r in some] == [rows[3]["payload"]]


def _gzip(data):
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def test_http_bodies():
    packed = _gzip(b"hello")
    assert warc._http(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n2;x=1\r\nde\r\n0\r\n\r\n") == (200, b"abcde")
    assert warc._http(b"HTTP/1.1 404 No\r\nContent-Encoding: gzip\r\n\r\n" + packed) == (404, b"hello")
    assert warc._http(b"no http") == (None, b"no http")


def test_foreign_archives(spark, tmp_path):
    def rec(kind, name, block):
        return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-TARGET-URI: {name}\r\ncontent-length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    def page(body, *fields):
        return b"\r\n".join([b"HTTP/1.1 200 OK", *fields]) + b"\r\n\r\n" + body

    chunked = b"Transfer-Encoding: chunked"
    blocks = {
        "a": page(b"one" * 40000), "b": page(b"3\r\nabc\r\n0\r\n\r\n", chunked), "c": page(b"zz\r\nabc", chunked), "d": page(b"no gzip", b"Content-Encoding: gzip"),
        "e": page(gzip.compress(b"x" * 50) + gzip.compress(b"y"), b"Content-Encoding: gzip"), "f": page(zlib.compress(b"deflated")[2:-4], b"Content-Encoding: deflate"), "g": b"HTTP/1.1 200 OK", "h": page(b"5\r\nab", chunked),
    }
    want = {
        "a": (200, b"one" * 40000), "b": (200, b"abc"), "c": (None, b"zz\r\nabc"), "d": (None, b"no gzip"),
        "e": (200, b"x" * 50 + b"y"), "f": (200, b"deflated"), "g": (None, b"HTTP/1.1 200 OK"), "h": (None, b"5\r\nab"),
    }
    data = b"".join(rec("response", k, b) for k, b in blocks.items())
    for name, whole in (("one.warc.gz", gzip.compress(data)), ("two.warc.gz", b"".join(gzip.compress(rec("response", k, b)) for k, b in blocks.items())), ("plain.warc", data)):
        (tmp_path / name).write_bytes(whole)
        warc.register(spark)
        read = spark.read.format("warc").load(str(tmp_path / name))
        assert {r["target_uri"]: (r["http_status"], bytes(r["payload"])) for r in read.collect()} == want, name
        read = spark.read.format("warc").load(str(tmp_path / name))
        assert [bytes(r["payload"]) for r in read.where("target_uri = 'f'").collect()] == [b"deflated"], name
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(data)[:-60])
    with pytest.raises(Exception, match="cut.warc.gz"):
        spark.read.format("warc").load(str(tmp_path / "cut.warc.gz")).collect()
