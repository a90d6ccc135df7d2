"""Queries over the smaller parts: scalars, sets, ids, and the steps that larger queries are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import facts, indicators, macro, pit, quality, reaction, retrieval
from tidemark.plans import reactions
from tidemark.plans.registry import query
from tidemark.sources import vendors, views
from tidemark.sources.views import read, sql
from tidemark.streaming import event_log

DAY = "1999-06-15"


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _r(c: Column | str, n: int = 6) -> Column:
    return F.round(c, n)


@query(sql("bars", "SELECT symbol, day::VARCHAR AS day, CASE WHEN count(*) OVER w = 10 THEN round(avg(close) OVER w, 4) END AS mean FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 9 PRECEDING)"))
def a01_mean_of_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars(spark, sf_dir).select("symbol", _text("day"), _r(indicators.moving_average(10), 4).alias("mean"))


@query(sql("bars", "SELECT symbol, day::VARCHAR AS day, CASE WHEN count(*) OVER w = 15 THEN min(low) OVER w END AS low, CASE WHEN count(*) OVER w = 15 THEN max(high) OVER w END AS high FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 14 PRECEDING)"))
def a13_range_of_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = indicators.last_n(F.min("low"), 15), indicators.last_n(F.max("high"), 15)
    return views.bars(spark, sf_dir).select("symbol", _text("day"), low.alias("low"), high.alias("high"))


@query("WITH l AS (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY o_custkey) SELECT o_custkey, d::DATE::VARCHAR AS day, CASE WHEN count(*) = 1 THEN max(o_orderkey) END AS o_orderkey FROM l JOIN orders USING (o_custkey) WHERE o_orderdate = d GROUP BY ALL")
def a03_unique_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of a key; null where several share its day."""
    by_day = read(spark, sf_dir, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.max("o_orderkey").alias("o_orderkey"))
    last = macro.newest(by_day, ["o_custkey"], "day")
    return last.select("o_custkey", _text("day"), F.when(F.col("n") == 1, F.col("o_orderkey")).alias("o_orderkey"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) = count(*) AND min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AS whole FROM lineitem GROUP BY l_orderkey")
def a09_same_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the lines of an order are just those that there should be."""
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("int"))).alias("has"))
    return lines.select("l_orderkey", (F.col("has") == F.sequence(F.lit(1), F.size("has"))).alias("whole"))


@query("SELECT o_custkey, o_orderstatus, max(o_orderdate)::DATE::VARCHAR AS day, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY ALL")
def a14_latest_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max(F.struct(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("o_orderkey"))).alias("m"))
    return o.select("o_custkey", "o_orderstatus", F.col("m.day").cast("string").alias("day"), "m.o_orderkey")


_RESULTS = "r AS (SELECT l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 4 = 1 OR l_quantity > 45 THEN 'rejected' ELSE 'usable' END AS status, CASE WHEN l_suppkey % 5 = 0 THEN 'late' END AS warnings FROM lineitem)"


@query(f"""WITH {_RESULTS} SELECT l_suppkey, CASE WHEN count(status) = 0 THEN 'not_assessed' WHEN bool_and(status = 'rejected') THEN 'rejected' WHEN bool_and(status = 'usable') AND count(warnings) = 0 THEN 'usable' ELSE 'degraded' END AS overall FROM r GROUP BY l_suppkey""")
def a16_overall_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.when(s % 4 == 0, None).when((s % 4 == 1) | (F.col("l_quantity") > 45), "rejected").otherwise("usable").alias("status"), F.when(s % 5 == 0, "late").alias("warnings"))
    return quality.overall(rows, ["l_suppkey"])


@query(sql("event_log", "SELECT thread_id, count(*)::BIGINT AS last_id FROM event_log GROUP BY thread_id"))
def a19_last_event_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log.numbered(views.event_log(spark, sf_dir)).groupBy("thread_id").agg(F.max("event_id").alias("last_id"))


@query("SELECT o_custkey, string_agg(w, '|' ORDER BY w) AS warnings FROM (SELECT DISTINCT o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'filled' WHEN o_totalprice > 150000 THEN 'large' END AS w FROM orders) WHERE w IS NOT NULL GROUP BY o_custkey")
def a20_warning_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.when(F.col("o_orderstatus") == "F", "filled").when(F.col("o_totalprice") > 150000, "large")
    return read(spark, sf_dir, "orders").select("o_custkey", w.alias("w")).where("w IS NOT NULL").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("w")), "|").alias("warnings"))


@query(sql("monthly_series", "SELECT a.series, a.period::VARCHAR AS period, a.value AS adjusted, b.value AS plain FROM monthly_series a JOIN monthly_series b USING (series, period) WHERE a.variant = 'F' AND b.variant = 'O'"))
def j16_both_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.monthly_series(spark, sf_dir)
    a, b = (s.where(F.col("variant") == v).select("series", "period", F.col("value").alias(n)) for v, n in (("F", "adjusted"), ("O", "plain")))
    return a.join(b, ["series", "period"]).select("series", _text("period"), "adjusted", "plain")


@query(sql("monthly_series", "SELECT period::VARCHAR AS period FROM monthly_series WHERE series = 'A' INTERSECT SELECT period::VARCHAR FROM monthly_series WHERE series = 'N'"))
def u02_common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.monthly_series(spark, sf_dir).select("series", _text("period"))
    return s.where("series = 'A'").select("period").intersect(s.where("series = 'N'").select("period"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def u03_unknown_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cited less what is allowed."""
    allowed = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(allowed, "l_orderkey", "left_anti")


@query("""SELECT o_orderkey, CASE WHEN upper(trim(o_orderpriority)) = upper(o_orderstatus) THEN upper(o_orderstatus) ELSE upper(o_orderstatus) || '|' || upper(trim(o_orderpriority)) END AS symbols FROM orders""")
def u05_ordered_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols trimmed, in upper case, without blanks, each where it first came."""
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    given = F.array(F.concat(F.lit(" "), F.lower(s)), F.lower(p), F.lit("  "), s, F.concat(p, F.lit(" ")))
    clean = F.array_distinct(F.filter(F.transform(given, pit.ticker), lambda x: x != ""))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(clean, "|").alias("symbols"))


@query("SELECT DISTINCT l_suppkey, f AS missing FROM (SELECT DISTINCT l_suppkey FROM lineitem), (SELECT unnest(['A', 'N', 'R']) AS f) WHERE (l_suppkey, f) NOT IN (SELECT (l_suppkey, l_returnflag) FROM lineitem WHERE l_quantity >= 50 AND l_linenumber = 1)")
def u06_unavailable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements less those that are satisfied."""
    lines = read(spark, sf_dir, "lineitem")
    wanted = lines.select("l_suppkey").distinct().select("l_suppkey", F.explode(F.array(*map(F.lit, "ANR"))).alias("missing"))
    return wanted.join(lines.where("l_quantity >= 50 AND l_linenumber = 1").select("l_suppkey", F.col("l_returnflag").alias("missing")), ["l_suppkey", "missing"], "left_anti")


@query("SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS upper, lower(p_type) AS folded FROM part")
def x01_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", pit.ticker(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("upper"), F.lower("p_type").alias("folded"))


@query("SELECT p_partkey, p_name || chr(10) || chr(10) || p_brand AS text FROM part")
def x02_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with stray blanks, no-break spaces and empty lines, cleaned."""
    messy = F.concat(F.lit(" \t "), F.regexp_replace("p_name", " ", "  \t"), F.lit(" \r\n\r\n\n\n​"), F.col("p_brand"), F.lit("  \n"))
    return read(spark, sf_dir, "part").select("p_partkey", text.normalized(messy).alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE p_size::DOUBLE / 4 END AS percent, CASE p_partkey % 3 WHEN 0 THEN p_size * 1500 WHEN 1 THEN p_size * 2000000 END::DOUBLE AS count FROM part")
def x04_percents_and_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a calendar: percents, and counts with K and M; what is neither gives null."""
    k, size = F.col("p_partkey"), F.col("p_size")
    percent = F.when(k % 5 == 0, "-").when(k % 5 == 1, "n/a").otherwise(F.concat(F.lit(" "), (size / 4).cast("string"), F.lit("% ")))
    count = F.when(k % 3 == 0, F.concat((size * 1.5).cast("decimal(12,1)").cast("string"), F.lit("K"))).when(k % 3 == 1, F.concat((size * 2).cast("string"), F.lit(" m"))).otherwise("many")
    return read(spark, sf_dir, "part").select("p_partkey", vendors.percent(percent).cast("double").alias("percent"), vendors.count(count).cast("double").alias("count"))


@query(sql("monthly_series", "SELECT series, variant, period::VARCHAR AS period, (period + INTERVAL 1 MONTH)::DATE::VARCHAR AS next, (period - INTERVAL 13 MONTH)::DATE::VARCHAR AS past FROM monthly_series"))
def x07_shifted_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.monthly_series(spark, sf_dir).select("series", "variant", _text("period"), F.add_months("period", 1).cast("string").alias("next"), F.add_months("period", -13).cast("string").alias("past"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount != 0 AND l_tax != 0 THEN round((l_discount / l_tax - 1) * 100, 6) END AS change FROM lineitem")
def x08_percent_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero counts as no data."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(macro.pct_change(F.col("l_discount"), F.col("l_tax"))).alias("change"))


@query("SELECT o_orderkey, round((o_totalprice::DECIMAL(18,2) / 8)::DECIMAL(28,10), 1)::DOUBLE AS rounded FROM orders")
def x09_half_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal halves go away from zero, as they don't in binary."""
    exact = (F.col("o_totalprice").cast("decimal(18,2)") / F.lit(8).cast("decimal(4,0)")).cast("decimal(28,10)")
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(exact, 1).cast("double").alias("rounded"))


@query("SELECT event_id, timezone('America/New_York', timezone('UTC', ts))::DATE::VARCHAR AS day FROM events")
def x10_eastern_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", macro.eastern_date(F.col("ts")).cast("string").alias("day"))


@query("SELECT event_id, strftime(timezone('UTC', timezone('America/New_York', ts::TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS utc FROM events")
def x11_vendor_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times without a zone are the vendor's, whose zone is named."""
    return read(spark, sf_dir, "events").select("event_id", F.date_format(F.to_utc_timestamp(F.col("ts").cast("timestamp"), macro.EASTERN), "yyyy-MM-dd HH:mm:ss").alias("utc"))


@query("SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS floor, strftime(CASE WHEN date_trunc('minute', ts) = ts THEN ts ELSE date_trunc('minute', ts) + INTERVAL 1 MINUTE END, '%Y-%m-%d %H:%M:%S') AS ceiling FROM events")
def x12_whole_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp_ntz")
    low = F.date_trunc("minute", ts).cast("timestamp_ntz")
    high = F.when(low == ts, low).otherwise(low + F.expr("INTERVAL 1 MINUTE"))
    return read(spark, sf_dir, "events").select("event_id", F.date_format(low, "yyyy-MM-dd HH:mm:ss").alias("floor"), F.date_format(high, "yyyy-MM-dd HH:mm:ss").alias("ceiling"))


@query("SELECT c_custkey, lpad(c_custkey::VARCHAR, 10, '0') AS cik, 'https://example.test/' || c_custkey || '/00012345000000000' || lpad(c_nationkey::VARCHAR, 3, '0') || '/a.htm' AS url FROM customer")
def x14_padded_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, accession = F.col("c_custkey"), F.concat(F.lit("0001234500-00-00"), F.lit("000"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0"))
    url = F.concat_ws("/", F.lit("https://example.test"), k.cast("string"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("a.htm"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.lpad(k.cast("string"), 10, "0").alias("cik"), url.alias("url"))


@query("SELECT vec_id, len(embedding)::INT AS width, round(sqrt(list_aggregate(list_transform(embedding::DOUBLE[], lambda x: x * x), 'sum')), 4) AS norm FROM embeddings")
def k12_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index of vectors stores of each chunk."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").alias("width"), _r(retrieval.norm(F.col("embedding")), 4).alias("norm"))


@query("SELECT a.vec_id, round(list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def x15_cosine_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", _r(retrieval.cosine_distance(F.col("embedding"), F.col("other")), 5).alias("distance"))


@query("SELECT o_orderkey, o_orderstatus || '|' || o_orderpriority AS first_two, (o_orderstatus = o_orderpriority)::INT + 1 AS added FROM orders")
def x21_array_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists flattened, appended to if absent, and cut."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    flat = F.array_distinct(F.flatten(F.array(F.array(s), F.array(p, s))))
    added = F.when(F.array_contains(F.array(s), p), F.array(s)).otherwise(F.array_append(F.array(s), p))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.slice(flat, 1, 2), "|").alias("first_two"), F.when(F.size(added) == 2, 1).otherwise(2).alias("added"))


@query("""SELECT doc_id, 'a' || doc_id AS evidence_id, 'live' AS data_mode FROM documents UNION ALL SELECT doc_id, 'b' || doc_id, CASE WHEN doc_id % 2 = 0 THEN 'historical' ELSE 'live' END FROM documents UNION ALL SELECT doc_id, 'c' || doc_id, NULL FROM documents WHERE doc_id % 3 = 0""")
def x22_evidence_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results as JSON of some depth; a mode holds for all below it until another is named."""
    k = F.col("doc_id")
    inner = F.struct(F.when(k % 2 == 0, "historical").alias("data_mode"), F.array(F.struct(F.concat(F.lit("b"), k).alias("evidence_id"))).alias("rows"))
    outer = F.struct(F.lit("live").alias("data_mode"), F.concat(F.lit("a"), k).alias("evidence_id"), inner.alias("part"))
    other = F.when(k % 3 == 0, F.struct(F.concat(F.lit("c"), k).alias("evidence_id")))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(outer.alias("x"), F.array(other).alias("y"))).alias("result"))
    return text.evidence_in(rows, "doc_id", "result")


@query("""SELECT o_orderkey, '{"price":"' || o_totalprice::DECIMAL(18,2)::VARCHAR || '","day":"' || o_orderdate::DATE::VARCHAR || '","note":null}' AS value FROM orders""")
def x23_json_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimals as text, dates in ISO form, nulls kept."""
    value = F.struct(F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"), F.to_date("o_orderdate").cast("string").alias("day"), F.lit(None).cast("string").alias("note"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.to_json(value, {"ignoreNullFields": "false"}).alias("value"))


@query("SELECT doc_id, 'rag:' || source || ':' || doc_id AS evidence_id, source || ':' || doc_id AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'empty' END AS fault FROM documents")
def x25_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of evidence built from those of chunks, and parsed again; a prefix with nothing behind it is a fault."""
    chunk = F.concat_ws(":", "source", "doc_id")
    rows = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("rag:"), F.coalesce("source", F.lit(None)), F.lit(":"), "doc_id").alias("evidence_id"), chunk.alias("c"))
    given = F.when(F.col("doc_id") % 4 == 0, "rag:").otherwise(F.col("evidence_id"))
    return rows.select("doc_id", "evidence_id", F.substring("evidence_id", 5, 1 << 20).alias("chunk_id"), F.when(F.length(given) == 4, "empty").alias("fault"))


@query(sql("bars", "SELECT symbol, count(*)::BIGINT - 1 AS completed, max(day)::VARCHAR AS current FROM bars GROUP BY symbol"))
def f02_completed_and_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, now = indicators.split_current(views.bars(spark, sf_dir))
    return now.select("symbol", F.col("day").cast("string").alias("current")).join(done.groupBy("symbol").agg(F.count("*").alias("completed")), "symbol", "left").select("symbol", F.coalesce("completed", F.lit(0)).alias("completed"), "current")


@query(sql("facts", f"SELECT concept, unit, count(*)::BIGINT AS n, max(filed_date)::VARCHAR AS last FROM facts WHERE filed_date <= DATE '{DAY}' GROUP BY ALL"))
def f11_visible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.visible(views.facts(spark, sf_dir), F.lit(DAY)).groupBy("concept", "unit").agg(F.count("*").alias("n"), F.max("filed_date").cast("string").alias("last"))


_TYPED = """p AS (SELECT concept, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN start_date ELSE start_date - 275 END AS s, end_date AS e, CASE l_linenumber % 4 WHEN 0 THEN '10-K' WHEN 1 THEN '10-Q' WHEN 2 THEN '10-K/A' ELSE '8-K' END AS form FROM facts)"""


@query(sql("facts", f"""{_TYPED}, t AS (SELECT concept, CASE WHEN s IS NULL THEN 'instant' WHEN form LIKE '10-Q%' AND e - s + 1 BETWEEN 70 AND 110 THEN 'quarterly' WHEN form LIKE '10-K%' AND e - s + 1 BETWEEN 330 AND 380 THEN 'annual' END AS shape FROM p)
SELECT concept, shape AS period_type, count(*)::BIGINT AS n FROM t WHERE shape IS NOT NULL GROUP BY ALL UNION ALL SELECT concept, 'all', count(*)::BIGINT FROM t GROUP BY concept"""))
def f13_facts_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    rows = views.facts(spark, sf_dir).withColumns({
        "start_date": F.when(k % 3 == 1, F.col("start_date")).when(k % 3 == 2, F.date_sub("start_date", 275)), "form": F.when(k % 4 == 0, "10-K").when(k % 4 == 1, "10-Q").when(k % 4 == 2, "10-K/A").otherwise("8-K"),
    })
    out = None
    for name in ("all", "quarterly", "annual", "instant"):
        found = facts.of_period(rows, name).groupBy("concept").agg(F.count("*").alias("n")).select("concept", F.lit(name).alias("period_type"), "n")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT o_orderkey, c_custkey IS NOT NULL AS allowed FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def f18_allowed_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a request is about one of the resolved targets."""
    resolved = read(spark, sf_dir, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("o_custkey"), F.lit(True).alias("allowed"))
    return read(spark, sf_dir, "orders").join(resolved, "o_custkey", "left").select("o_orderkey", F.coalesce("allowed", F.lit(False)).alias("allowed"))


#: Public error codes and the stage that each belongs to.
ERROR_STAGES = {
    "invalid_json": "validation", "invalid_output": "validation", "invalid_evidence": "validation", "data_mode_mismatch": "validation", "incomplete_response": "model", "model_refusal": "model", "invalid_tool_call": "tool",
    "model_timeout": "model", "model_error": "model", "tool_timeout": "tool", "total_timeout": "task", "cancelled": "task", "budget_exhausted": "task",
}


@query("""WITH c(i, code, stage) AS (VALUES """ + ", ".join(f"({i}, '{c}', '{s}')" for i, (c, s) in enumerate(ERROR_STAGES.items())) + """) SELECT event_id, code, stage, CASE WHEN event_id % 5 = 0 OR code IS NULL THEN 'mismatch' ELSE 'ok' END AS status FROM events LEFT JOIN c ON i = event_id % 14""")
def f20_error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by code, and whether the stage that they state is that of the code; an unknown code has none."""
    codes, k = list(ERROR_STAGES), F.col("event_id")
    rows = read(spark, sf_dir, "events").select("event_id", F.get(F.array(*map(F.lit, codes)), (k % 14).cast("int")).alias("code"))
    stage = F.try_element_at(F.create_map(*[F.lit(x) for kv in ERROR_STAGES.items() for x in kv]), F.col("code"))
    stated = F.when(k % 5 == 0, "elsewhere").otherwise(stage)
    return rows.select("event_id", "code", stage.alias("stage"), F.when(stated == stage, "ok").otherwise("mismatch").alias("status"))


@query(sql("minute_bars", f"""{reactions._MARKED} SELECT event_id, symbol, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at FROM mk WHERE kind != 'post' """))
def j07_event_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bars that were fetched for an event and don't lie after it."""
    rows = reaction.bars_until(reactions.events(spark, sf_dir), reactions.bars(spark, sf_dir))
    return rows.select("event_id", "symbol", F.date_format("start_at", "yyyy-MM-dd HH:mm:ss").alias("start_at"))


@query(sql("minute_bars", f"""{reactions._EV} SELECT event_id, symbol, w AS "window", strftime(event_at + to_minutes(m), '%Y-%m-%d %H:%M:%S') AS target_at FROM ev, sy, (SELECT unnest(['5m', '30m', '1h']) AS w, unnest([5, 30, 60]) AS m)"""))
def r10_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event, symbol and window, with the time it is about."""
    wide = reactions.events(spark, sf_dir).join(F.broadcast(reactions.symbols(spark, sf_dir)), how="cross")
    windows = F.array(*[F.struct(F.lit(w).alias("window"), F.date_format(F.col("event_at") + F.expr(f"INTERVAL {m} MINUTES"), "yyyy-MM-dd HH:mm:ss").alias("target_at")) for w, m in reaction.WINDOWS.items()])
    return wide.select("event_id", "symbol", F.inline(windows))


@query(sql("facts", """f AS (SELECT l_orderkey || '-' || l_linenumber AS fact_id, max(value) AS value FROM facts GROUP BY ALL),
e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'rag:' || o_orderkey ELSE 'fact:' || o_orderkey || '-1' END AS evidence_id FROM orders)
SELECT o_orderkey, CASE WHEN evidence_id NOT LIKE 'fact:%' THEN 'other_kind' WHEN value IS NULL THEN 'not_found' ELSE 'found' END AS status, value FROM e LEFT JOIN f ON evidence_id = 'fact:' || fact_id"""))
def j24_fact_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cited = read(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 3 == 0, F.concat(F.lit("rag:"), k)).otherwise(F.concat(F.lit("fact:"), k, F.lit("-1"))).alias("evidence_id"))
    known = views.facts(spark, sf_dir).groupBy(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("fact_id")).agg(F.max("value").alias("value"))
    ours = F.col("evidence_id").startswith("fact:")
    rows = cited.withColumn("fact_id", F.when(ours, F.substring("evidence_id", 6, 100))).join(known, "fact_id", "left")
    return rows.select("o_orderkey", F.when(~ours, "other_kind").when(F.col("value").isNull(), "not_found").otherwise("found").alias("status"), "value")


@query(sql("facts", f"""r AS (SELECT *, row_number() OVER (PARTITION BY concept, unit, start_date, end_date ORDER BY filed_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, value DESC) AS k FROM facts WHERE filed_date <= DATE '{DAY}'),
n AS (SELECT *, row_number() OVER (PARTITION BY concept, unit ORDER BY end_date DESC, start_date DESC) AS rank FROM r WHERE k = 1) SELECT concept, unit, end_date::VARCHAR AS end_date, value, rank::INT AS rank FROM n WHERE rank <= 4"""))
def k09_newest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = facts.visible(views.facts(spark, sf_dir), F.lit(DAY))
    latest = facts.latest_per_period(seen, ["concept", "unit"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "value"])
    return facts.newest_facts(latest, ["concept", "unit"]).select("concept", "unit", _text("end_date"), "value", "rank")


@query(f"""WITH m AS (SELECT c_mktsegment AS company, c_nationkey % 2 AS config, o_orderdate::DATE AS as_of, max(o_orderkey) AS manifest FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT company, config, max(as_of)::VARCHAR AS as_of, arg_max(manifest, as_of) AS manifest FROM m WHERE as_of <= DATE '{DAY}' GROUP BY company, config""")
def k11_manifest_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the very day counts too."""
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("company"), (F.col("c_nationkey") % 2).alias("config"))
    made = read(spark, sf_dir, "orders").join(customers, "o_custkey").groupBy("company", "config", F.to_date("o_orderdate").alias("as_of")).agg(F.max("o_orderkey").alias("manifest"))
    return retrieval.latest_manifest(made, F.to_date(F.lit(DAY)), inclusive=True).select("company", "config", _text("as_of"), "manifest")


@query(sql("weekly_counts", "SELECT a.series, a.week::VARCHAR AS week, a.claims, b.claims AS previous, a.claims - b.claims AS change FROM weekly_counts a LEFT JOIN weekly_counts b ON a.series = b.series AND b.week = a.week - 7"))
def c07_claims_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.weekly_reading(views.weekly_counts(spark, sf_dir)).select("series", _text("week"), "claims", "previous", "change")


@query(sql("monthly_series", """s AS (SELECT series, period, value FROM monthly_series WHERE variant = 'F'),
x AS (SELECT a.series, a.period, (a.value / b.value - 1) * 100 AS mom, (b.value / c.value - 1) * 100 AS previous_mom, (a.value / d.value - 1) * 100 AS yoy FROM s a JOIN s b ON a.series = b.series AND b.period = (a.period - INTERVAL 1 MONTH)::DATE LEFT JOIN s c ON a.series = c.series AND c.period = (a.period - INTERVAL 2 MONTH)::DATE JOIN s d ON a.series = d.series AND d.period = (a.period - INTERVAL 12 MONTH)::DATE)
SELECT series, max(period)::VARCHAR AS period, round(arg_max(mom, period), 6) AS mom, round(arg_max(previous_mom, period), 6) AS previous_mom, round(arg_max(yoy, period), 6) AS yoy FROM x GROUP BY series"""))
def c02_single_series_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month and year changes out of one series that is both."""
    one = views.monthly_series(spark, sf_dir).where("variant = 'F'").select("series", "period", "value")
    found = macro.inflation_reading(one, one)
    return found.select("series", _text("period"), *[_r(c).alias(c) for c in ("mom", "previous_mom", "yoy")])


@query(sql("weekly_counts monthly_series", """SELECT 'claims' AS indicator, series, 'count' AS unit, a.week::VARCHAR AS period, a.claims::DOUBLE AS actual, b.claims::DOUBLE AS previous FROM weekly_counts a LEFT JOIN weekly_counts b USING (series) WHERE b.week = a.week - 7
UNION ALL SELECT 'jobs', a.series, 'thousands', a.period::VARCHAR, a.persons / 1000.0::DOUBLE, b.persons / 1000.0::DOUBLE FROM monthly_series a JOIN monthly_series b ON a.series = b.series AND b.variant = 'F' AND b.period = (a.period - INTERVAL 1 MONTH)::DATE WHERE a.variant = 'F'"""))
def c44_metric_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and jobs in one form of record, where the value before is known."""
    claims = macro.weekly_reading(views.weekly_counts(spark, sf_dir)).where("previous IS NOT NULL")
    jobs = macro.shifted(views.monthly_series(spark, sf_dir).where("variant = 'F'").select("series", "period", "persons"), ["series"], [1], "persons").where("persons_m1 IS NOT NULL")
    one = claims.select(F.lit("claims").alias("indicator"), "series", F.lit("count").alias("unit"), F.col("week").cast("string").alias("period"), F.col("claims").cast("double").alias("actual"), F.col("previous").cast("double").alias("previous"))
    return one.unionByName(jobs.select(F.lit("jobs").alias("indicator"), "series", F.lit("thousands").alias("unit"), _text("period"), (F.col("persons") / 1000).alias("actual"), (F.col("persons_m1") / 1000).alias("previous")))


#: The stage that a client is shown for each kind of event.
STAGES = {"stage": "researching", "answer_delta": "answering", "completed": "done"}


@query(sql("event_log", "SELECT thread_id, CASE type WHEN 'stage' THEN 'researching' WHEN 'answer_delta' THEN 'answering' ELSE 'done' END AS stage, count(*)::BIGINT AS events, sum(CASE WHEN type = 'answer_delta' THEN length(data) ELSE 0 END)::BIGINT AS characters FROM event_log GROUP BY ALL"))
def r07_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col("type"))
    size = F.when(F.col("type") == "answer_delta", F.length("data")).otherwise(0)
    return views.event_log(spark, sf_dir).groupBy("thread_id", stage.alias("stage")).agg(F.count("*").alias("events"), F.sum(size).cast("long").alias("characters"))


@query("SELECT d.doc_id, d.lang FROM documents d WHERE (doc_id, lang) IN (SELECT (s_suppkey * 3, 'en') FROM supplier)")
def s33_composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("doc_id"), F.lit("en").alias("lang"))
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(keys, ["doc_id", "lang"], "left_semi")


@query("""WITH a AS (SELECT item_id, lower(regexp_extract(text, '[A-Za-z]+ +[A-Za-z]+')) AS alias FROM benchmark), u AS (SELECT DISTINCT alias FROM a WHERE length(alias) > 0)
SELECT alias, count(*)::BIGINT AS documents FROM u JOIN documents ON regexp_matches(lower(text), '(^|[^a-z0-9])' || alias || '($|[^a-z0-9])') GROUP BY alias""")
def j21_alias_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name an alias, the first two words of a passage, in any case and not within a word."""
    aliases = read(spark, sf_dir, "benchmark").select(F.lower(F.regexp_extract("text", "[A-Za-z]+ +[A-Za-z]+", 0)).alias("alias")).where("length(alias) > 0").distinct()
    found = text.aliases_in(read(spark, sf_dir, "documents").select("doc_id", "text"), aliases)
    return found.groupBy("alias").agg(F.count("*").alias("documents"))
