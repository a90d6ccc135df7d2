"""Text functions by their invariants, and streams against their batch queries."""

from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import mentions, text
from tidemark.sources import views
from tidemark.streaming import event_log

DATA = "/root/testdata/sf0.001"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(2, 40), st.data())
def test_chunks_cover_the_text(content, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    found = text.chunk_bounds(content, size, overlap)
    assert bool(found) == bool(content)
    if found:
        assert found[0][0] == 0 and found[-1][1] == len(content)
        assert all(0 < e - s <= size for s, e in found)
        assert all(b[0] == a[1] - overlap and b[0] > a[0] for a, b in zip(found, found[1:]))


def test_chunks_end_at_the_best_separator():
    assert text.chunk_bounds("aaaa bbbb cccc dddd", 10, 2) == [(0, 9), (7, 14), (12, 19)]
    assert text.chunk_bounds("aaaaa\n\nb c d e f g h i", 12, 3) == [(0, 6), (3, 14), (11, 22)]
    assert text.chunk_bounds("aaaaaaa\n\nb c d", 12, 3) == [(0, 7), (4, 14)]
    assert text.chunk_bounds("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]


def test_json_that_is_too_deep_has_no_evidence():
    assert text.evidence_modes("[" * 100_000 + "]" * 100_000) == []


def test_normalized_text(spark):
    row = spark.createDataFrame([("  a b  c​ \n\n\n \nd\t e \n",)], "t string").select(text.normalized(F.col("t")).alias("t")).first()
    assert row["t"] == "a b c\n\nd e"


def test_tickers(spark):
    row = spark.createDataFrame([("buy $aapl, BRK.B or MSFT; not abc or TOOLONGS, MSFT again",)], "t string").select(text.tickers(F.col("t")).alias("t")).first()
    assert row["t"] == ["AAPL", "BRK.B", "MSFT"]
    assert mentions.ticker_spans("x $ab-c y") == [("AB-C", 2, 7)]


def test_merged_mentions_keep_the_longest():
    start, stop, rank = (np.array(x) for x in ([0, 2, 10, 11, 9], [3, 9, 12, 13, 10], [0, 1, 1, 0, 1]))
    assert mentions.kept(start, stop, rank).tolist() == [1, 4, 3]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9), st.integers(0, 1)), max_size=30))
def test_merged_mentions_are_those_of_a_plain_loop(given_):
    rows = list(dict.fromkeys((a, a + n, r) for a, n, r in given_))
    chosen = []
    for m in sorted(rows, key=lambda m: (m[0] - m[1], m[2], m[0])):
        if not any(m[0] < o[1] and o[0] < m[1] for o in chosen):
            chosen.append(m)
    columns = [np.array(c, dtype=np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3
    assert [rows[i] for i in mentions.kept(*columns)] == sorted(chosen)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abAB1_ 英伟达苹İſ+.", max_size=60), st.lists(st.text(alphabet="abA1 英伟达苹+.", min_size=1, max_size=4), max_size=8, unique=True))
def test_aliases_are_found_as_by_a_pattern_each(message, entries):
    entries = list({mentions.folded(e): e for e in entries}.values())
    want = []
    for entry in entries:
        pattern = re.escape(mentions.folded(entry))
        if any(c.isascii() and c.isalpha() for c in entry):
            pattern = rf"(?<![A-Za-z0-9]){pattern}(?![A-Za-z0-9])"
        want += [(*m.span(), entry) for m in re.finditer(pattern, mentions.folded(message))]
    assert sorted(mentions.Scanner(entries).spans(message)) == sorted(want)
    plain = [(*m.span(), e) for e in entries for m in re.finditer(re.escape(e), message)]
    assert sorted(mentions.Scanner(entries, plain=True).spans(message)) == sorted(plain)


def test_an_alias_that_overlaps_itself_counts_as_asked():
    assert sorted(mentions.Scanner(["the the"]).spans("breathe the the")) == [(8, 15, "the the")]
    assert sorted(mentions.Scanner(["the the"], split=True).spans("breathe the the")) == []
    assert sorted(mentions.Scanner(["the the"], split=True).spans("The the the the")) == [(0, 7, "the the"), (8, 15, "the the")]


def _document(tmp_path, text):
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"doc_id": pa.array([1], pa.int64()), "text": [text], "lang": ["en"]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"n_nationkey": pa.array(range(25), pa.int32()), "n_name": [f"{chr(65 + k)}LAND" for k in range(25)]}), tmp_path / "nation.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": ["the the report"]}), tmp_path / "benchmark.parquet")
    return str(tmp_path)


def test_queries_count_aliases_that_overlap_themselves_as_their_sql(spark, tmp_path):
    import duckdb

    from tidemark.plans import catalog

    folder, db = _document(tmp_path, "They breathe the the air, the the the"), duckdb.connect()
    for table in ("documents", "nation", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    for name in ("u01_mention_spans", "j18_mention_overlap", "c34_from_messages"):
        want = db.execute(catalog.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        found = [tuple(r) for r in catalog.queries()[name](spark, folder).select(columns).collect()]
        assert sorted(found) == sorted(want.fetchall())


def test_aliases_without_latin_letters_are_found(spark):
    messages = spark.createDataFrame([(1, "买英伟达和NVIDIA Corp_2"), (2, "用C++11或c++"), (3, "pineapple apple"), (4, None), (5, "")], "doc_id long, text string")
    names = spark.createDataFrame([("英伟达",), ("nvidia corp",), ("c++",), ("apple",), ("",), (None,)], "alias string")
    found = {(r["doc_id"], r["start"], r["stop"], r["name"], r["said"]) for r in mentions.spans(messages, names, with_tickers=False).collect()}
    assert found == {(1, 1, 4, "英伟达", "英伟达"), (1, 5, 16, "nvidia corp", "NVIDIA Corp"), (2, 7, 10, "c++", "c++"), (3, 10, 15, "apple", "apple")}
    assert {tuple(r) for r in text.aliases_in(messages, names).collect()} == {(1, "英伟达"), (1, "nvidia corp"), (2, "c++"), (3, "apple")}


def test_overlapping_blocks_and_chunks(spark):
    b = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 12, 23)], "doc_id long, block_index int, start_char long, end_char long")
    c = spark.createDataFrame([(1, 0, 0, 11), (1, 1, 8, 20), (1, 2, 17, 23)], "doc_id long, chunk_index int, start_char int, end_char int")
    found = {(r["block_index"], r["chunk_index"]) for r in text.overlaps(b, c, "doc_id", width=4).collect()}
    assert found == {(0, 0), (0, 1), (1, 1), (1, 2)}


def test_release_types(spark):
    rows = spark.createDataFrame([("the CPI print",), ("weekly claims",), ("nothing",)], "q string").select(text.release_type(F.col("q")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["cpi", "weekly_claims", None]


def _drained(stream, name, tmp_path, spark):
    query = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_stream_of_bars_equals_the_batch(spark, tmp_path):
    ticks = views.ticks(spark, DATA).orderBy("ts")
    ticks.coalesce(1).write.parquet(str(tmp_path / "ticks"))
    stream = event_log.bars_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks")))
    found = {tuple(r) for r in _drained(stream, "stream_bars", tmp_path, spark).select("symbol", F.col("start_at").cast("timestamp_ntz"), "open", "close", "volume").collect()}
    batch = {tuple(r) for r in views.minute_bars(spark, DATA).select("symbol", "start_at", "open", "close", "volume").collect()}
    assert found <= batch and len(batch) - len(found) <= 10  # the newest windows are still open


def test_stream_of_ids_equals_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    log = views.event_log(spark, DATA).select("thread_id", "turn", "type", "data")
    log.write.parquet(str(tmp_path / "log"))
    stream = event_log.numbered_stream(spark.readStream.schema(log.schema).parquet(str(tmp_path / "log")))
    found = {tuple(r) for r in _drained(stream, "stream_ids", tmp_path, spark).select("thread_id", "turn", "event_id").collect()}
    batch = {tuple(r) for r in event_log.numbered(views.event_log(spark, DATA)).select("thread_id", "turn", "event_id").collect()}
    assert found == batch


def test_a_large_dictionary_is_scanned_in_blocks(spark, tmp_path, monkeypatch):
    from tidemark.plans import records

    spark.createDataFrame([(i, f"a w{i % 7} b w{i % 11} c") for i in range(40)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    entries = [(k, f" w{k} ") for k in range(13)] + [(3, " w5 "), (4, " w4 "), (20, ""), (21, None)]
    spark.createDataFrame(entries, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    monkeypatch.setattr(mentions, "BLOCK_CHARS", 12)
    want = {}
    for item, entry in entries:
        n = sum(entry in f"a w{i % 7} b w{i % 11} c" for i in range(40)) if entry else 0
        if n:
            want[item] = want.get(item, 0) + n
    assert {r["item_id"]: r["documents"] for r in records.j21_alias_scan(spark, str(tmp_path)).collect()} == want
    spark.createDataFrame([(k, f"entry {k}") for k in range(10_001)] + [(0, "w1 b")], "item_id long, text string").write.parquet(str(tmp_path / "more" / "benchmark.parquet"))
    spark.createDataFrame([(1, "entry 10000 w1 b")], "doc_id long, text string").write.parquet(str(tmp_path / "more" / "documents.parquet"))
    monkeypatch.setattr(mentions, "BLOCK_CHARS", 50_000)
    found = {r["item_id"]: r["documents"] for r in records.j21_alias_scan(spark, str(tmp_path / "more")).collect()}
    assert found == {0: 1, 1: 1, 10: 1, 100: 1, 1000: 1, 10000: 1}
