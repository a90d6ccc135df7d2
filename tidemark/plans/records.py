"""Queries over quality, facts, retrieval, text and the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import html_tree, mentions, text
from tidemark.operators import facts, quality, retrieval
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import read, sql
from tidemark.streaming import event_log, replay

NOW = "2024-01-20 00:00:00"


def now() -> Column:
    return F.to_timestamp_ntz(F.lit(NOW))


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


@query(sql("minute_bars", """SELECT symbol, count(*)::BIGINT AS bars, count(*) FILTER (low <= 0 OR open <= 0 OR close <= 0)::BIGINT AS price_not_positive,
count(*) FILTER (high < greatest(open, close, low) OR low > least(open, close, high))::BIGINT AS out_of_range FROM minute_bars GROUP BY symbol"""))
def f01_ohlc_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = views.minute_bars(spark, sf_dir).withColumn("fault", quality.bar_fault())
    return marked.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(F.col("fault") == "price_not_positive").alias("price_not_positive"), F.count_if(F.col("fault").isin("high_too_low", "low_too_high")).alias("out_of_range")
    )


@query(sql("ticks", f"""q AS (SELECT event_id, symbol, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ts END AS quoted_at, ts + to_seconds(CASE WHEN event_id % 13 = 0 THEN -5 ELSE 5 END) AS received_at,
  CASE WHEN event_id % 11 = 0 THEN 'fixture' WHEN event_id % 3 = 0 THEN 'historical' ELSE 'live' END AS mode, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS delayed,
  CASE event_id % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'trading' ELSE 'closed' END AS state, TIMESTAMP '{NOW}' AS now FROM ticks),
r AS (SELECT *, CASE WHEN quoted_at IS NULL THEN 'quote_missing' WHEN quoted_at > now THEN 'quote_after_as_of' WHEN quoted_at > received_at THEN 'quote_after_received_at' WHEN mode = 'fixture' THEN 'fixture_not_current_price'
  WHEN state != 'closed' AND now - quoted_at > INTERVAL 60 SECOND THEN 'quote_stale' END AS bad,
  concat_ws('|', CASE state WHEN 'closed' THEN 'market_closed' WHEN 'unknown' THEN 'market_state_unknown' END, CASE WHEN mode != 'live' THEN 'quote_not_live' END, CASE WHEN delayed THEN 'quote_delayed' WHEN delayed IS NULL THEN 'quote_delay_unknown' END) AS notes FROM q)
SELECT event_id, CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN notes != '' THEN 'degraded' ELSE 'usable' END AS status, coalesce(bad, notes) AS issues FROM r"""))
def c15_quote_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick as a quote, with made-up modes, delays and market states."""
    k = F.col("event_id")
    quotes = views.ticks(spark, sf_dir).select(
        "event_id", "symbol", F.col("symbol").alias("wanted"), F.when(k % 17 != 0, F.col("ts")).alias("quoted_at"), (F.col("ts") + F.make_dt_interval(secs=F.when(k % 13 == 0, -5).otherwise(5))).alias("received_at"),
        F.when(k % 11 == 0, "fixture").when(k % 3 == 0, "historical").otherwise("live").alias("data_mode"), F.when(k % 5 == 0, None).otherwise(k % 5 == 1).alias("is_delayed"),
        F.when(k % 7 == 0, "unknown").when(k % 7 == 1, "trading").otherwise("closed").alias("market_state"),
    )
    return quality.quote_quality(quotes, now()).select("event_id", "status", "issues")


_BQ = """b AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY day) AS ordinal, day, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
q AS (SELECT symbol, ordinal, CASE WHEN symbol = 'N03' AND ordinal = 5 THEN day - 400 ELSE day END AS day, CASE WHEN symbol = 'N05' AND ordinal = 7 THEN 'raw' ELSE 'forward_adjusted' END AS adjustment,
  NOT (ordinal = n OR (symbol = 'N07' AND ordinal = n - 1)) AS is_complete FROM b)"""


@query(sql("bars", f"""{_BQ}, l AS (SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY ordinal) AS before, ordinal = max(ordinal) OVER (PARTITION BY symbol) AS last FROM q),
d AS (SELECT DISTINCT symbol FROM q GROUP BY symbol, day HAVING count(*) > 1),
f AS (SELECT symbol, count(DISTINCT adjustment) AS a, bool_or(day < before) AS unsorted, count(*) FILTER (NOT is_complete) AS open_bars, bool_or(last AND is_complete) AS lc, count(*) FILTER (is_complete) AS c FROM l GROUP BY symbol),
r AS (SELECT f.*, CASE WHEN a != 1 THEN 'mixed_bar_adjustment' WHEN unsorted THEN 'bars_not_sorted' WHEN symbol IN (SELECT symbol FROM d) THEN 'duplicate_bar' WHEN open_bars > 1 THEN 'multiple_incomplete_bars' WHEN open_bars > 0 AND lc THEN 'incomplete_bar_not_last' WHEN c = 0 THEN 'completed_bars_missing' END AS bad,
  concat_ws('|', {', '.join(f"CASE WHEN c < {n} THEN '{k}' END" for k, n in quality.REQUIRED.items())}) AS away FROM f)
SELECT symbol, CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN c < 60 OR away != '' THEN 'degraded' ELSE 'usable' END AS status,
coalesce(bad, concat_ws('|', CASE WHEN c < 60 THEN 'bar_window_insufficient' END, CASE WHEN away != '' THEN 'technical_windows_unavailable' END)) AS issues, CASE WHEN bad IS NULL THEN away END AS unavailable FROM r"""))
def c16_bar_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with planted faults in some symbols; the newest bar is open."""
    by = Window.partitionBy("symbol")
    b = views.bars(spark, sf_dir).select("symbol", "day", F.row_number().over(by.orderBy("day")).alias("ordinal"), F.count("*").over(by).alias("n"))
    planted = F.when((F.col("symbol") == "N03") & (F.col("ordinal") == 5), F.date_sub("day", 400)).otherwise(F.col("day"))
    at = planted.cast("timestamp_ntz")
    rows = b.select(
        "symbol", "ordinal", at.alias("start_at"), (at + F.expr("INTERVAL 8 HOURS")).alias("end_at"),
        (~((F.col("ordinal") == F.col("n")) | ((F.col("symbol") == "N07") & (F.col("ordinal") == F.col("n") - 1)))).alias("is_complete"),
        F.when((F.col("symbol") == "N05") & (F.col("ordinal") == 7), "raw").otherwise("forward_adjusted").alias("adjustment"),
    )
    return quality.bar_quality(rows, now())


_SESSION = "CASE WHEN hour(start_at) < 9 THEN 'pre' WHEN hour(start_at) < 16 THEN 'regular' WHEN hour(start_at) < 20 THEN 'post' ELSE 'unknown' END"


@query(sql("minute_bars", f"""s AS (SELECT symbol, {_SESSION} AS session FROM minute_bars),
c AS (SELECT symbol, count(*) FILTER (session = 'pre')::BIGINT AS pre, count(*) FILTER (session = 'regular')::BIGINT AS regular, count(*) FILTER (session = 'post')::BIGINT AS post, count(*) FILTER (session = 'unknown')::BIGINT AS unknown FROM s GROUP BY symbol)
SELECT symbol, CASE WHEN pre + regular + post = 0 THEN 'none_observed' WHEN pre = 0 OR regular = 0 OR post = 0 THEN 'partially_observed' ELSE 'all_observed' END AS status, pre, regular, post, unknown,
concat_ws('|', CASE WHEN pre = 0 OR regular = 0 OR post = 0 THEN 'required_sessions_not_observed' END, CASE WHEN unknown > 0 THEN 'unknown_trade_session_present' END) AS warnings FROM c"""))
def a02_session_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.hour("start_at")
    session = F.when(hour < 9, "pre").when(hour < 16, "regular").when(hour < 20, "post").otherwise("unknown")
    bars = views.minute_bars(spark, sf_dir).select("symbol", session.alias("session"))
    return quality.session_coverage(bars, ["pre", "regular", "post"])


@query(sql("facts", """r AS (SELECT *, row_number() OVER (PARTITION BY concept, unit, start_date, end_date ORDER BY filed_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, value DESC) AS k FROM facts WHERE filed_date <= DATE '1999-06-15')
SELECT concept, unit, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, filed_date::VARCHAR AS filed_date, value FROM r WHERE k = 1"""))
def a04_latest_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = facts.visible(views.facts(spark, sf_dir), F.lit("1999-06-15"))
    found = facts.latest_per_period(seen, ["concept", "unit"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "value"])
    return found.select("concept", "unit", _text("start_date"), _text("end_date"), _text("filed_date"), "value")


@query(sql("facts", """p AS (SELECT concept, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN start_date ELSE start_date - 275 END AS s, end_date AS e, CASE l_linenumber % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '10-K/A' ELSE '8-K' END AS form FROM facts)
SELECT CASE WHEN s IS NULL THEN 'instant' WHEN form LIKE '10-Q%' AND e - s + 1 BETWEEN 70 AND 110 THEN 'quarterly' WHEN form LIKE '10-K%' AND e - s + 1 BETWEEN 330 AND 380 THEN 'annual' ELSE 'other' END AS shape, concept, count(*)::BIGINT AS n FROM p GROUP BY ALL"""))
def f12_period_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    start = F.when(k % 3 == 1, F.col("start_date")).when(k % 3 == 2, F.date_sub("start_date", 275))
    form = F.when(k % 4 == 0, "10-K").when(k % 4 == 1, "10-Q").when(k % 4 == 2, "10-K/A").otherwise("8-K")
    return views.facts(spark, sf_dir).groupBy(facts.period_shape(form, start, F.col("end_date")).alias("shape"), "concept").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, sha256('{\"key\":' || c_custkey || ',\"segment\":\"' || c_mktsegment || '\",\"frame\":null}') AS fact_id FROM customer")
def x13_content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.lit(None).cast("string").alias("frame")]
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), facts.content_id(*parts).alias("fact_id"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j03_new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("SELECT d.doc_id, d.source FROM documents d WHERE (doc_id, n_chars) IN (SELECT doc_id, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1)")
def j02_version_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    wanted = docs.select("doc_id", "n_chars").join(read(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "n_chars")
    return docs.select("doc_id", "n_chars", "source").join(wanted, ["doc_id", "n_chars"], "left_semi").select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN n_chars ELSE -quality END::BIGINT AS version FROM documents LEFT JOIN labels USING (doc_id)")
def u04_manifest_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("version"))
    new = read(spark, sf_dir, "labels").select("doc_id", (-F.col("quality")).cast("long").alias("version"))
    return retrieval.merge_versions(base, new, "doc_id")


_M = "m AS (SELECT c_mktsegment AS company, c_nationkey % 2 AS config, o_orderdate::DATE AS as_of, max(o_orderkey) AS manifest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"WITH {_M} SELECT company, config, max(as_of)::VARCHAR AS as_of, arg_max(manifest, as_of) AS manifest FROM m WHERE as_of < DATE '1999-06-15' GROUP BY company, config")
def k03_latest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("company"), (F.col("c_nationkey") % 2).alias("config"))
    made = read(spark, sf_dir, "orders").join(customers, "o_custkey").groupBy("company", "config", F.to_date("o_orderdate").alias("as_of")).agg(F.max("o_orderkey").alias("manifest"))
    return retrieval.latest_manifest(made, F.to_date(F.lit("1999-06-15")), inclusive=False).select("company", "config", _text("as_of"), "manifest")


_TOP = """q AS (SELECT vec_id AS query_id, embedding AS query, label FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, vec_id, list_cosine_distance(query::DOUBLE[], embedding::DOUBLE[]) AS distance FROM q JOIN embeddings e ON e.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s)"""


@query(f"WITH {_TOP} SELECT query_id, vec_id, round(distance, 5) AS distance, rank::INT AS rank FROM r WHERE rank <= 5")
def k01_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 against all vectors of its label."""
    vectors = read(spark, sf_dir, "embeddings")
    questions = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "label")
    return retrieval.top_k(questions, vectors, 5, "label").withColumn("distance", F.round("distance", 5))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS query, label FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT query_id, q.label, e.label AS found, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(query::DOUBLE[], embedding::DOUBLE[]), vec_id) AS rank FROM q CROSS JOIN embeddings e)
SELECT query_id, count(*) FILTER (found = label)::BIGINT AS hits, round(count(*) FILTER (found = label) / 10.0::DOUBLE, 4) AS precision_at_10 FROM r WHERE rank <= 10 GROUP BY query_id""")
def c40_retrieval_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    questions = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    found = retrieval.top_k(questions, vectors.select("vec_id", "embedding"), 10)
    label = vectors.select("vec_id", "label")
    rows = found.join(label, "vec_id").join(label.where("vec_id % 20 = 0").toDF("query_id", "wanted"), "query_id")
    return rows.groupBy("query_id").agg(F.count_if(F.col("label") == F.col("wanted")).alias("hits"), F.round(F.count_if(F.col("label") == F.col("wanted")) / 10, 4).alias("precision_at_10"))


@query("""WITH s AS (SELECT vec_id, embedding, source AS company_id, lang FROM embeddings JOIN documents ON doc_id = vec_id),
q AS (SELECT vec_id AS query_id, embedding AS query, company_id FROM s WHERE vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, q.company_id, lang, list_cosine_distance(query::DOUBLE[], embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(query::DOUBLE[], embedding::DOUBLE[]), vec_id) AS rank
  FROM q JOIN s ON q.company_id IS NOT DISTINCT FROM s.company_id)
SELECT query_id, rank::INT AS rank, vec_id, company_id, lang, round(distance, 5) AS distance FROM r WHERE rank <= 2""")
def k02_company_retriever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of documents with their vectors, each source a company; every 20th vector asks about its own company, or about none."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("source").alias("company_id"), "lang")
    store = read(spark, sf_dir, "embeddings").select("vec_id", "embedding").join(docs, "vec_id")
    questions = store.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "company_id", F.col("embedding").alias("query"))
    return retrieval.company_retriever(questions, store, 2).withColumn("distance", F.round("distance", 5))


@query("""WITH e AS (SELECT source AS run_id, doc_id % 50 AS evidence_id, CASE WHEN doc_id % 9 = 0 THEN 'live' WHEN doc_id % 2 = 0 THEN 'historical' ELSE 'live' END AS mode FROM documents),
i AS (SELECT run_id, evidence_id, min(mode) AS low, max(mode) AS high FROM e GROUP BY ALL)
SELECT run_id, CASE WHEN min(low) = max(high) THEN min(low) WHEN min(low) IS NOT NULL THEN 'mixed' END AS mode, count(*) FILTER (low != high)::BIGINT AS conflicts FROM i GROUP BY run_id""")
def a21_data_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("run_id"), (k % 50).alias("evidence_id"), F.when(k % 9 == 0, "live").when(k % 2 == 0, "historical").otherwise("live").alias("mode"))
    return retrieval.data_modes(rows)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'copyright') OR contains(lower(text), 'license')")
def f14_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    return read(spark, sf_dir, "documents").where(t.contains("copyright") | t.contains("license")).select("doc_id")


def _last(mark: str, n: int) -> str:
    return f"CASE WHEN contains(part, {mark}) THEN low + length(part) - strpos(reverse(part), {mark}) + 1 - {n} END"


#: Chunks of 1000 characters, cut in their second half, that begin 150 before the last one's end.
_CHUNKS = f"""g(doc_id, text, k, s, e) AS (
  SELECT doc_id, text, 0, 0, 0 FROM documents WHERE length(text) > 0
  UNION ALL
  SELECT doc_id, text, k + 1, from_, CASE WHEN stop = length(text) THEN stop ELSE coalesce({_last("chr(10) || chr(10)", 2)}, {_last("chr(10)", 1)}, {_last("' '", 1)}, stop) END
  FROM (SELECT *, least(from_ + 500, stop) AS low, substr(text, least(from_ + 500, stop)::BIGINT + 1, (stop - least(from_ + 500, stop))::BIGINT) AS part
    FROM (SELECT *, least(from_ + 1000, length(text)) AS stop FROM (SELECT *, CASE WHEN k = 0 THEN 0 ELSE e - 150 END AS from_ FROM g WHERE k = 0 OR e < length(text))))),
ch AS (SELECT doc_id, (k - 1)::INT AS chunk_index, s::INT AS start_char, e::INT AS end_char FROM g WHERE k > 0)"""


@query(f"WITH RECURSIVE {_CHUNKS} SELECT * FROM ch")
def w22_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.chunks(read(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "start_char", "end_char")


@query()
def x03_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their source paths."""
    return html_tree.block_rows(read(spark, sf_dir, "pages"))


_LINES = r"l AS (SELECT doc_id, i AS block_index, ls[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"


@query(f"""WITH RECURSIVE {_CHUNKS}, {_LINES}, b AS (SELECT doc_id, block_index - 1 AS block_index, length(text) AS n, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT b.doc_id, block_index::INT AS block_index, chunk_index FROM b JOIN ch USING (doc_id) WHERE start < end_char AND start + n > start_char""")
def j17_block_chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of a document, as its blocks, each of its chunks holds."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("block_index", "text"))
    return text.overlaps(text.block_offsets(lines, "doc_id", "block_index", gap=1), text.chunks(docs), "doc_id")


@query(f"WITH {_LINES} SELECT doc_id, block_index::BIGINT AS block_index, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_char FROM l")
def w23_block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a document as its blocks."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text")).select("doc_id", (F.col("at") + 1).cast("long").alias("block_index"), "text")
    return text.block_offsets(lines, "doc_id", "block_index").select("doc_id", "block_index", "start_char")


@query("""WITH m AS (SELECT doc_id, item_id FROM documents JOIN benchmark b ON contains(documents.text, b.text) WHERE length(b.text) > 0)
SELECT item_id, count(*)::BIGINT AS documents FROM m GROUP BY item_id""")
def j21_alias_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a dictionary's entries, the passages of benchmark."""
    entries = read(spark, sf_dir, "benchmark").where(F.length("text") > 0).select("item_id", F.col("text").alias("entry"))
    found = mentions.entries_in(read(spark, sf_dir, "documents").select("doc_id", "text"), entries.select("entry"), plain=True)
    counts = found.groupBy("entry").agg(F.count("*").alias("documents"))
    return entries.join(counts, "entry").groupBy("item_id").agg(F.sum("documents").alias("documents"))


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.numbered(views.event_log(spark, sf_dir))


_LOG = "lg AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY turn, type, data) AS event_id FROM event_log)"


@query(sql("event_log", f"{_LOG} SELECT thread_id, turn, type, event_id FROM lg"))
def r01_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).select("thread_id", "turn", "type", "event_id")


@query(sql("event_log", f"{_LOG} SELECT thread_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY event_id DESC) AS k FROM lg) WHERE k <= 3"))
def r02_replay_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.replay_buffer(_log(spark, sf_dir), 3).select("thread_id", "event_id")


@query(sql("event_log", f"""{_LOG}, b AS (SELECT thread_id, greatest(max(event_id) - 2, 1) AS first_id, max(event_id) AS last_id FROM lg GROUP BY thread_id), c AS (SELECT thread_id, unnest([0, 1, 2, 5, 9]) AS cursor, first_id, last_id FROM b)
SELECT thread_id, cursor::BIGINT AS cursor, greatest(0, last_id - greatest(cursor, first_id - 1))::BIGINT AS n_events, CASE WHEN cursor > last_id THEN false ELSE cursor = last_id OR cursor >= first_id - 1 END AS complete FROM c"""))
def r03_replay_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    buffer = event_log.replay_buffer(_log(spark, sf_dir), 3)
    cursors = buffer.select("thread_id").distinct().withColumn("cursor", F.explode(F.array(*[F.lit(c).cast("long") for c in (0, 1, 2, 5, 9)])))
    return event_log.replay(buffer, cursors)


@query(sql("event_log", f"{_LOG}, e AS (SELECT thread_id, arg_max(type, event_id) AS type, max(event_id) AS n FROM lg GROUP BY thread_id) SELECT thread_id FROM e WHERE type IN ('completed', 'failed', 'cancelled') AND n * 100 <= 500"))
def r04_terminal_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events 100 seconds apart from a fixed start, seen 800 seconds after it."""
    start = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    timed = _log(spark, sf_dir).withColumn("created_at", start + F.make_dt_interval(secs=F.col("event_id") * 100))
    return event_log.expired(timed, start + F.expr("INTERVAL 800 SECONDS"))


@query(sql("event_log", f"{_LOG} SELECT thread_id, count(*)::BIGINT AS deltas, string_agg(data, '' ORDER BY event_id) AS answer FROM lg WHERE type = 'answer_delta' GROUP BY thread_id"))
def r09_delta_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.answers(_log(spark, sf_dir))


@query(sql("event_log", f"{_LOG} SELECT thread_id, event_id, 'id: ' || event_id || chr(10) || 'event: ' || type || chr(10) || 'data: ' || replace(data, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS frame FROM lg"))
def x24_sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.sse(_log(spark, sf_dir))


@query(sql("ticks", """p AS (SELECT * FROM ticks WHERE event_id % 3 != 0 UNION ALL SELECT * FROM ticks WHERE event_id % 2 = 0)
SELECT event_id, symbol, min(price) AS price, count(DISTINCT price) > 1 AS conflict FROM p GROUP BY event_id, symbol"""))
def s09_overlap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping pages of ticks."""
    t = views.ticks(spark, sf_dir).select("event_id", "symbol", "price")
    return facts.overlap_dedup(t.where("event_id % 3 != 0").unionByName(t.where("event_id % 2 = 0")), ["event_id", "symbol"], ["price"])


@query("SELECT o_custkey AS id, count(*)::BIGINT AS inserted FROM (SELECT o_orderkey, any_value(o_custkey) AS o_custkey FROM orders GROUP BY o_orderkey) WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_custkey")
def s29_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return facts.insert_ignore(present, read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"]).groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("inserted"))


@query("""WITH w AS (SELECT c_custkey AS id, DATE '1998-01-01' AS covered FROM customer UNION ALL SELECT o_custkey, max(o_orderdate)::DATE FROM orders GROUP BY o_custkey) SELECT id, max(covered)::VARCHAR AS covered FROM w GROUP BY id""")
def s30_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.to_date(F.lit("1998-01-01")).alias("covered"))
    new = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(F.to_date("o_orderdate")).alias("covered"))
    return facts.upsert(present, new, ["id"], "covered").select("id", _text("covered"))


def arriving_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks in triggers of ten minutes, a second after their time; some two triggers late, some before their time, some twice."""
    t = views.ticks(spark, sf_dir)
    k = F.col("event_id")
    slot = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000)
    first = t.withColumn("trigger", slot + F.when(k % 50 == 0, 2).otherwise(0)).withColumn("received_at", F.when(k % 41 == 0, F.expr("ts - INTERVAL 1 HOUR")).otherwise(F.expr("ts + INTERVAL 1 SECOND")))
    again = first.where("event_id % 37 = 0").withColumn("trigger", F.col("trigger") + 1).withColumn("received_at", F.expr("received_at + INTERVAL 1 SECOND"))
    return first.unionByName(again).select("symbol", "event_id", "ts", "received_at", "trigger")


@query(sql("ticks", f"""f AS (SELECT symbol, event_id, epoch_us(ts) AS us, epoch_us(ts) // 600000000 + CASE WHEN event_id % 50 = 0 THEN 2 ELSE 0 END AS trig, epoch_us(ts) + CASE WHEN event_id % 41 = 0 THEN -3600000000 ELSE 1000000 END AS rec FROM ticks),
a AS (SELECT *, us > rec + {replay.AHEAD_S * 1_000_000} AS future FROM (SELECT * FROM f UNION ALL SELECT symbol, event_id, us, trig + 1, rec + 1000000 FROM f WHERE event_id % 37 = 0)),
n AS (SELECT symbol, trig, max(us) FILTER (NOT future) AS newest FROM a GROUP BY ALL), m AS (SELECT symbol, trig, max(newest) OVER (PARTITION BY symbol ORDER BY trig ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM n),
j AS (SELECT a.*, NOT future AND coalesce(us < newest - {replay.LATE_S * 1_000_000}, false) AS late FROM a JOIN m USING (symbol, trig)),
g AS (SELECT *, row_number() OVER (PARTITION BY symbol, event_id, us // 60000000, future, late ORDER BY trig, rec, us) AS k FROM j)
SELECT symbol, event_id, trig AS "trigger", CASE WHEN future THEN 'future' WHEN late THEN 'late' WHEN k > 1 THEN 'repeated' ELSE 'on_time' END AS status FROM g"""))
def r11_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick once, with what came of it."""
    return replay.arrivals_of(arriving_ticks(spark, sf_dir), F.col("trigger")).select("symbol", "event_id", "trigger", "status")
