"""Queries over what was visible at a time: scans, filings, contexts and their quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import context, macro, pit, quality, retrieval
from tidemark.plans import macro as macro_plans
from tidemark.plans.registry import ORACLES, query
from tidemark.sources import views
from tidemark.sources.views import read, sql

NOW = "2024-01-20 00:00:00"
DAY = "1999-06-15"
_T = "'%Y-%m-%d %H:%M:%S'"


def at(text: str) -> Column:
    return F.to_timestamp_ntz(F.lit(text))


def _time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _minutes(start: Column, n: Column) -> Column:
    return start + F.make_dt_interval(mins=n)


@query(sql("ticks", f"""q AS (SELECT event_id AS quote_id, upper(symbol) AS symbol, ts AS quoted_at, ts + to_minutes((event_id % 50)::INT) AS received_at, price FROM ticks)
SELECT symbol, arg_max(quote_id, (quoted_at, quote_id)) AS quote_id, arg_max(price, (quoted_at, quote_id)) AS price, strftime(max(quoted_at), {_T}) AS quoted_at FROM q WHERE received_at <= TIMESTAMP '{NOW}' GROUP BY symbol"""))
def s01_quote_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as quotes that arrive up to 49 minutes late."""
    ticks = views.ticks(spark, sf_dir)
    quotes = ticks.select(F.col("event_id").alias("quote_id"), F.concat(F.lit(" "), "symbol").alias("symbol"), F.col("ts").alias("quoted_at"), _minutes(F.col("ts"), (F.col("event_id") % 50).cast("int")).alias("received_at"), "price")
    return pit.quotes_as_of(quotes, at(NOW)).select("symbol", "quote_id", "price", _time("quoted_at"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of which some are incomplete, known late, of unknown time, or not adjusted."""
    k = F.dayofyear("day")
    start = F.col("day").cast("timestamp_ntz")
    known = start + F.expr("INTERVAL 8 HOURS")
    return views.bars(spark, sf_dir).select(
        "symbol", start.alias("start_at"), "close", (k % 11 != 0).alias("is_complete"),
        F.when(k % 13 == 0, None).when(k % 7 == 0, known + F.expr("INTERVAL 30 DAYS")).otherwise(known).alias("updated_at"), F.when(k % 5 == 0, "raw").otherwise("forward_adjusted").alias("adjustment"),
    )


_DAILY = """dl AS (SELECT symbol, day::TIMESTAMP AS start_at, close, dayofyear(day) % 11 != 0 AS is_complete, CASE WHEN dayofyear(day) % 13 = 0 THEN NULL WHEN dayofyear(day) % 7 = 0 THEN day::TIMESTAMP + INTERVAL 8 HOUR + INTERVAL 30 DAY ELSE day::TIMESTAMP + INTERVAL 8 HOUR END AS updated_at,
  CASE WHEN dayofyear(day) % 5 = 0 THEN 'raw' ELSE 'forward_adjusted' END AS adjustment FROM bars)"""


@query(sql("bars", f"""{_DAILY}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_at DESC) AS n FROM dl WHERE updated_at <= TIMESTAMP '{DAY}' AND is_complete AND adjustment = 'forward_adjusted')
SELECT symbol, strftime(start_at, {_T}) AS start_at, close FROM r WHERE n <= 20"""))
def s02_daily_bars_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.bars_as_of(daily(spark, sf_dir), at(f"{DAY} 00:00:00"), 20, adjustment="forward_adjusted").select("symbol", _time("start_at"), "close")


@query(sql("bars", f"""{_DAILY}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_at DESC) AS n FROM dl WHERE adjustment = 'forward_adjusted'),
r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY start_at DESC) AS m FROM p WHERE n <= 1000 AND start_at <= TIMESTAMP '{DAY}' AND is_complete) SELECT symbol, strftime(start_at, {_T}) AS start_at, close FROM r WHERE m <= 999"""))
def s10_bars_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pit.vendor_bars(daily(spark, sf_dir), at(f"{DAY} 00:00:00"), 999).select("symbol", _time("start_at"), "close")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of ninety minutes after sign-ups, of which some are backwards, empty, or beyond what may be seen."""
    k = F.col("event_id")
    start = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    end = F.when(k % 9 == 0, start).when(k % 9 == 1, start - F.expr("INTERVAL 5 MINUTES")).otherwise(start + F.expr("INTERVAL 90 MINUTES"))
    return views.ticks(spark, sf_dir).where("symbol = 'signup'").select(k.alias("request_id"), F.lit(" View").alias("symbol"), start.alias("start_at"), end.alias("end_at"), F.when(k % 4 == 0, start + F.expr("INTERVAL 30 MINUTES")).otherwise(at("2024-03-01 00:00:00")).alias("as_of"))


_REQUESTS = """rq AS (SELECT event_id AS request_id, date_trunc('minute', ts)::TIMESTAMP AS start_at, date_trunc('minute', ts)::TIMESTAMP + to_minutes(CASE event_id % 9 WHEN 0 THEN 0 WHEN 1 THEN -5 ELSE 90 END) AS end_at,
  CASE WHEN event_id % 4 = 0 THEN date_trunc('minute', ts)::TIMESTAMP + INTERVAL 30 MINUTE ELSE TIMESTAMP '2024-03-01' END AS as_of FROM events WHERE event_type = 'signup'),
rf AS (SELECT *, CASE WHEN start_at >= end_at THEN 'start_not_before_end' WHEN end_at > as_of THEN 'end_after_as_of' END AS fault FROM rq)"""


@query(f"WITH {_REQUESTS} SELECT request_id, coalesce(fault, 'ok') AS fault FROM rf")
def s04_request_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).select("request_id", F.coalesce(pit.request_fault(F.col("start_at"), F.col("end_at"), F.col("as_of")), F.lit("ok")).alias("fault"))


@query(sql("minute_bars", f"""{_REQUESTS}, mv AS (SELECT *, minute(start_at) % 17 != 0 AS is_complete, CASE WHEN minute(start_at) % 23 = 0 THEN TIMESTAMP '2025-01-01' ELSE end_at END AS updated_at FROM minute_bars WHERE symbol = 'view')
SELECT request_id, strftime(m.start_at, {_T}) AS start_at, close FROM mv m JOIN rf ON m.start_at >= rf.start_at AND m.end_at <= rf.end_at AND m.end_at <= as_of AND updated_at <= as_of AND is_complete WHERE fault IS NULL"""))
def s03_minute_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    minute = F.minute("start_at")
    bars = views.minute_bars(spark, sf_dir).withColumns({"is_complete": minute % 17 != 0, "updated_at": F.when(minute % 23 == 0, at("2025-01-01 00:00:00")).otherwise(F.col("end_at"))})
    return pit.minutes_in(bars, requests(spark, sf_dir)).select("request_id", _time("start_at"), "close")


@query("""WITH r AS (SELECT o_custkey || '-' || year(o_orderdate) AS series, o_orderstatus AS release, o_orderdate::DATE::VARCHAR AS day FROM orders), o AS (SELECT series FROM r GROUP BY series HAVING count(DISTINCT release) = 1)
SELECT series, release, string_agg(DISTINCT day, '|' ORDER BY day) AS dates FROM o JOIN r USING (series) GROUP BY ALL""")
def s15_release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's year as a series, order states as releases: dates of the series that have exactly one release."""
    day = F.to_date("o_orderdate")
    rows = read(spark, sf_dir, "orders").select(F.concat_ws("-", "o_custkey", F.year(day)).alias("series"), F.col("o_orderstatus").alias("release"), day.cast("string").alias("day"))
    found = rows.groupBy("series").agg(F.min("release").alias("release"), F.max("release").alias("other"), F.array_join(F.sort_array(F.collect_set("day")), "|").alias("dates"))
    return found.where("release = other").select("series", "release", "dates")


@query(sql("weekly_counts", """t AS (SELECT series, week, CASE dayofyear(week) % 9 WHEN 0 THEN '.' WHEN 1 THEN '-' || claims WHEN 2 THEN claims || '.5' ELSE claims::VARCHAR END AS text FROM weekly_counts)
SELECT series, week::VARCHAR AS week, CASE WHEN regexp_full_match(text, '[0-9]+') THEN text::BIGINT END AS claims, CASE WHEN text = '.' THEN 'missing' WHEN NOT regexp_full_match(text, '[0-9]+') THEN 'not_a_count' END AS fault FROM t"""))
def s16_weekly_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as a vendor writes them: a dot for none, and some that are no counts."""
    k = F.dayofyear("week") % 9
    c = F.col("claims").cast("string")
    raw = views.weekly_counts(spark, sf_dir).withColumn("text", F.when(k == 0, ".").when(k == 1, F.concat(F.lit("-"), c)).when(k == 2, F.concat(c, F.lit(".5"))).otherwise(c))
    whole = F.col("text").rlike("^[0-9]+$")
    return raw.select("series", F.col("week").cast("string").alias("week"), F.when(whole, F.col("text").cast("long")).alias("claims"), F.when(F.col("text") == ".", "missing").when(~whole, "not_a_count").alias("fault"))


@query(sql("curve_points", "SELECT tenor, day::VARCHAR AS day, round(yield_pct, 6) AS yield_pct FROM curve_points WHERE tenor IN ('10y', '3m') AND day <= DATE '1998-06-15' AND day > DATE '1998-06-15' - 14"))
def s17_treasury_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.sql("SELECT explode(array_distinct(array('10y', '3m', '10y'))) AS tenor")
    points = views.curve_points(spark, sf_dir).where("day <= DATE '1998-06-15' AND day > DATE '1998-06-15' - INTERVAL 14 DAYS")
    return points.join(F.broadcast(wanted), "tenor").select("tenor", F.col("day").cast("string").alias("day"), F.round("yield_pct", 6).alias("yield_pct"))


@query("""WITH t AS (SELECT doc_id, 'c' || doc_id % 997 AS case_id, doc_id % 7 AS k FROM documents WHERE doc_id % 10 != 0), d AS (SELECT case_id, count(*)::BIGINT AS n, min(k)::INT AS k FROM t GROUP BY case_id)
SELECT case_id, k, CASE WHEN n = 1 THEN 'ok' ELSE 'duplicate' END AS status FROM d""")
def s27_unique_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as lines of JSON, blank ones among them; an id that repeats is refused."""
    doc = F.col("doc_id")
    lines = read(spark, sf_dir, "documents").select(F.when(doc % 10 == 0, "  ").otherwise(F.to_json(F.struct(F.concat(F.lit("c"), doc % 997).alias("case_id"), (doc % 7).cast("int").alias("k")))).alias("value"))
    cases = lines.where(F.trim("value") != "").select(F.from_json("value", "case_id string, k int").alias("c")).select("c.*")
    return cases.groupBy("case_id").agg(F.min("k").alias("k"), F.when(F.count("*") == 1, "ok").otherwise("duplicate").alias("status"))


@query("SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'missing' WHEN doc_id % 10 = 0 THEN 'mismatch' ELSE 'match' END AS status FROM documents")
def s35_manifest_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts against a manifest of checksums that lacks some and has some of other texts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("found"))
    manifest = read(spark, sf_dir, "documents").where("doc_id % 19 != 0").select("doc_id", F.sha2(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 10 == 0, "!").otherwise("")), 256).alias("stated"))
    status = F.when(F.col("stated").isNull(), "missing").when(F.col("stated") == F.col("found"), "match").otherwise("mismatch")
    return docs.join(manifest, "doc_id", "left").select("doc_id", status.alias("status"))


@query("SELECT conv_id, count(*)::BIGINT AS turns, string_agg(coalesce(role, '') || ':' || length(coalesce(text, '')), '|' ORDER BY turn, role, text) AS children FROM conversations GROUP BY conv_id")
def s32_ordered_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    child = F.concat_ws(":", F.coalesce("role", F.lit("")), F.length(F.coalesce("text", F.lit(""))))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sort_array(F.collect_list(F.struct("turn", "role", "text", child.alias("child")))).alias("cs"))
    return rows.select("conv_id", "turns", F.array_join(F.transform("cs", lambda c: c["child"]), "|").alias("children"))


@query("""SELECT k.s_suppkey AS key, d.doc_id IS NOT NULL AS found, d.source FROM supplier k LEFT JOIN documents d ON d.doc_id = k.s_suppkey * 7 AND d.lang = 'en'""")
def s31_point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by a key of two parts; absent ones are rows too."""
    keys = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), (F.col("s_suppkey") * 7).alias("doc_id"), F.lit("en").alias("lang"))
    return keys.join(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.lit(True).alias("found")), ["doc_id", "lang"], "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "source")


@query("""SELECT s_suppkey AS company_id, s_name AS name, CASE WHEN s_suppkey % 3 != 0 THEN 'n' || s_nationkey END AS state, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE 's' || s_suppkey % 4 END AS sic, coalesce(CASE WHEN s_suppkey % 5 != 0 THEN s_suppkey % 2 END, 0)::INT AS insiders,
'historical' AS data_mode FROM supplier""")
def s34_company_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles out of submissions, with defaults for what they lack."""
    k = F.col("s_suppkey")
    fields = F.struct(F.col("s_name").alias("name"), F.when(k % 3 != 0, F.concat(F.lit("n"), "s_nationkey")).alias("state"), F.when(k % 4 != 0, F.concat(F.lit("s"), k % 4)).alias("sic"), F.when(k % 5 != 0, (k % 2).cast("int")).alias("insiders"))
    payload = read(spark, sf_dir, "supplier").select(k.alias("company_id"), F.to_json(fields).alias("payload"))
    p = payload.select("company_id", F.from_json("payload", "name string, state string, sic string, insiders int").alias("p"))
    return p.select("company_id", "p.name", "p.state", F.coalesce("p.sic", F.lit("unknown")).alias("sic"), F.coalesce("p.insiders", F.lit(0)).alias("insiders"), F.lit("historical").alias("data_mode"))


@query(sql("monthly_series", f"""v AS (SELECT max(period) AS vintage FROM monthly_series WHERE series = 'A' AND period <= DATE '{DAY}'),
y AS (SELECT year(period)::VARCHAR AS target, value FROM monthly_series, v WHERE series = 'A' AND variant = 'F' AND period = vintage),
l AS (SELECT 'longer_run' AS target, arg_max(value, period) AS value FROM monthly_series WHERE series = 'R' AND variant = 'F' AND period <= DATE '{DAY}') SELECT * FROM y UNION ALL SELECT * FROM l WHERE value IS NOT NULL"""))
def s36_policy_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the newest vintage, and the newest longer-run row."""
    seen = views.monthly_series(spark, sf_dir).where((F.col("period") <= F.to_date(F.lit(DAY))) & (F.col("variant") == "F"))
    newest = seen.where("series = 'A'").agg(F.max("period").alias("period"))
    years = seen.where("series = 'A'").join(F.broadcast(newest), "period").select(F.year("period").cast("string").alias("target"), "value")
    longer = seen.where("series = 'R'").agg(F.max_by("value", "period").alias("value")).where("value IS NOT NULL").select(F.lit("longer_run").alias("target"), "value")
    return years.unionByName(longer)


#: What bars of each kind are called by the vendor.
PERIODS = {"click": "1m", "view": "1d", "purchase": "1w"}


@query("SELECT event_id, CASE event_type WHEN 'click' THEN '1m' WHEN 'view' THEN '1d' WHEN 'purchase' THEN '1w' END AS code, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'unsupported:' || event_type END AS fault FROM events")
def s40_period_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.try_element_at(F.create_map(*[F.lit(x) for kv in PERIODS.items() for x in kv]), F.col("symbol"))
    return views.ticks(spark, sf_dir).select("event_id", code.alias("code"), F.when(code.isNull(), F.concat(F.lit("unsupported:"), "symbol")).alias("fault"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filings of a company per source and language, some about earnings."""
    k = F.col("doc_id")
    extra = F.when(k % 5 == 0, "\nItem 2.02 Results").when(k % 7 == 0, "\nRESULTS of Operations and Financial Condition").otherwise("")
    return read(spark, sf_dir, "documents").select(
        k.alias("filing_id"), F.concat_ws("-", "source", "lang").alias("company"), F.when(k % 3 == 0, "10-Q").otherwise("8-K").alias("form"),
        _minutes(at("2024-01-01 00:00:00"), (k % 40000).cast("int")).alias("accepted_at"), F.concat(F.coalesce("text", F.lit("")), extra).alias("content"),
    )


_FILINGS = """fl AS (SELECT doc_id AS filing_id, concat_ws('-', source, lang) AS company, CASE WHEN doc_id % 3 = 0 THEN '10-Q' ELSE '8-K' END AS form, TIMESTAMP '2024-01-01' + to_minutes((doc_id % 40000)::INT) AS accepted_at,
  lower(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' item 2.02 results' WHEN doc_id % 7 = 0 THEN ' results of operations and financial condition' ELSE '' END) AS content FROM documents),
er AS (SELECT *, form = '8-K' AND (contains(content, 'item 2.02') OR contains(content, 'results of operations and financial condition')) AS hit FROM fl)"""


@query(f"WITH {_FILINGS} SELECT filing_id, hit AS is_earnings FROM er")
def f14_earnings_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings(spark, sf_dir).select("filing_id", pit.is_earnings(F.col("form"), F.col("content")).alias("is_earnings"))


@query(f"""WITH {_FILINGS}, s AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY accepted_at DESC, filing_id DESC) AS n FROM er WHERE form = '8-K' AND accepted_at <= TIMESTAMP '{NOW}'),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY accepted_at DESC, filing_id DESC) AS rank FROM s WHERE n <= 100 AND hit AND accepted_at < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR)
SELECT company, filing_id, rank::INT AS rank FROM r WHERE rank <= 5""")
def k05_earnings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pit.earnings_releases(filings(spark, sf_dir), at(NOW), 5, before=at(NOW) - F.expr("INTERVAL 1 HOUR"))
    return found.select("company", "filing_id", "rank")


_SESSION = "CASE WHEN hour(start_at) < 9 THEN 'pre' WHEN hour(start_at) < 16 THEN 'regular' ELSE 'post' END"
_QM = f"""mb AS (SELECT symbol, start_at, end_at, symbol || ':' || start_at::DATE AS request_id, day(start_at) % 14 AS dd, row_number() OVER (PARTITION BY symbol, start_at::DATE ORDER BY start_at) AS ordinal,
  lag(start_at) OVER (PARTITION BY symbol, start_at::DATE ORDER BY start_at) AS prev, start_at::DATE::TIMESTAMP AS from_at FROM minute_bars WHERE hour(start_at) < 20),
q AS (SELECT request_id, ordinal, symbol AS wanted, dd, from_at, from_at + INTERVAL 20 HOUR AS to_at, CASE WHEN dd = 12 THEN from_at + INTERVAL 10 HOUR ELSE TIMESTAMP '2025-01-01' END AS now,
  CASE WHEN dd = 0 AND ordinal = 3 THEN 'other' ELSE symbol END AS symbol,
  CASE WHEN ordinal != 3 THEN start_at WHEN dd = 2 THEN start_at + INTERVAL 30 SECOND WHEN dd = 4 THEN start_at - INTERVAL 1 DAY WHEN dd = 6 THEN prev WHEN dd = 7 THEN prev - INTERVAL 1 MINUTE ELSE start_at END AS start_at,
  CASE WHEN ordinal != 3 THEN end_at WHEN dd = 1 THEN end_at + INTERVAL 1 MINUTE WHEN dd = 2 THEN end_at + INTERVAL 30 SECOND WHEN dd = 4 THEN end_at - INTERVAL 1 DAY WHEN dd = 6 THEN prev + INTERVAL 1 MINUTE WHEN dd = 7 THEN prev ELSE end_at END AS end_at,
  NOT (dd = 3 AND ordinal = 3) AS is_complete, CASE WHEN ordinal != 3 THEN TIMESTAMP '2024-06-01' WHEN dd = 5 THEN TIMESTAMP '2026-01-01' WHEN dd != 10 THEN TIMESTAMP '2024-06-01' END AS updated_at,
  CASE WHEN dd = 8 AND ordinal = 3 THEN 'forward_adjusted' ELSE 'raw' END AS adjustment, CASE WHEN dd = 9 AND ordinal = 3 THEN 'live' ELSE 'historical' END AS data_mode, CASE WHEN dd = 11 THEN 'unknown' WHEN dd = 13 THEN 'regular' ELSE {_SESSION} END AS session FROM mb),
u AS (SELECT * REPLACE (CASE WHEN dd = 12 THEN NULL ELSE updated_at END AS updated_at) FROM q),
g AS (SELECT *, lag(start_at) OVER w AS before, lag(end_at) OVER w AS before_end FROM u WINDOW w AS (PARTITION BY request_id ORDER BY ordinal)),
f AS (SELECT *, CASE WHEN upper(symbol) != upper(wanted) THEN 'intraday_symbol_mismatch' WHEN end_at - start_at != INTERVAL 1 MINUTE THEN 'invalid_minute_interval' WHEN date_trunc('minute', start_at) != start_at THEN 'minute_not_aligned' WHEN NOT is_complete THEN 'incomplete_intraday_bar'
  WHEN start_at < from_at OR end_at > to_at THEN 'intraday_outside_window' WHEN end_at > now THEN 'intraday_bar_from_future' WHEN updated_at > now THEN 'intraday_update_after_as_of' WHEN start_at = before THEN 'duplicate_intraday_bar' WHEN start_at < before THEN 'intraday_not_sorted' WHEN start_at < before_end THEN 'overlapping_intraday_bars' END AS fault FROM g),
a AS (SELECT request_id, arg_min(fault, ordinal) FILTER (fault IS NOT NULL) AS fault, count(DISTINCT adjustment) AS adj, count(DISTINCT data_mode) AS modes, count(*) FILTER (session = 'pre') AS pre, count(*) FILTER (session = 'regular') AS reg, count(*) FILTER (session = 'post') AS post,
  count(*) FILTER (session = 'unknown') AS unk, count(*) FILTER (updated_at IS NULL) AS untimed FROM f GROUP BY request_id),
c AS (SELECT *, coalesce(fault, CASE WHEN adj > 1 THEN 'mixed_intraday_adjustment' WHEN modes > 1 THEN 'mixed_intraday_data_mode' END) AS bad,
  concat_ws('|', CASE WHEN pre = 0 OR reg = 0 OR post = 0 THEN 'required_sessions_not_observed' END, CASE WHEN unk > 0 THEN 'unknown_trade_session' END, CASE WHEN untimed > 0 THEN 'intraday_update_time_unknown' END) AS notes FROM a)"""


def minute_requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The minute bars of a symbol and day, each day of the month with another fault in its third bar, and a request for each."""
    day, by = F.to_date("start_at"), Window.partitionBy("symbol", F.to_date("start_at")).orderBy("start_at")
    raw = views.minute_bars(spark, sf_dir).where(F.hour("start_at") < 20).select(
        "symbol", "start_at", "end_at", F.concat_ws(":", "symbol", day.cast("string")).alias("request_id"), (F.dayofmonth("start_at") % 14).alias("dd"), F.row_number().over(by).alias("ordinal"), F.lag("start_at").over(by).alias("prev"),
    )
    start, end, prev, dd, hour = F.col("start_at"), F.col("end_at"), F.col("prev"), F.col("dd"), F.hour("start_at")
    third = F.col("ordinal") == 3

    def shift(c: Column, text: str) -> Column:
        return c + F.expr(f"INTERVAL {text}")

    bars = raw.select(
        "request_id", "ordinal", F.when(third & (dd == 0), "other").otherwise(F.col("symbol")).alias("symbol"),
        F.when(~third, start).when(dd == 2, shift(start, "30 SECONDS")).when(dd == 4, shift(start, "-1 DAY")).when(dd == 6, prev).when(dd == 7, shift(prev, "-1 MINUTE")).otherwise(start).alias("start_at"),
        F.when(~third, end).when(dd == 1, shift(end, "1 MINUTE")).when(dd == 2, shift(end, "30 SECONDS")).when(dd == 4, shift(end, "-1 DAY")).when(dd == 6, shift(prev, "1 MINUTE")).when(dd == 7, prev).otherwise(end).alias("end_at"),
        (~(third & (dd == 3))).alias("is_complete"),
        F.when(dd == 12, None).when(~third, at("2024-06-01 00:00:00")).when(dd == 5, at("2026-01-01 00:00:00")).when(dd != 10, at("2024-06-01 00:00:00")).alias("updated_at"),
        F.when(third & (dd == 8), "forward_adjusted").otherwise("raw").alias("adjustment"), F.when(third & (dd == 9), "live").otherwise("historical").alias("data_mode"),
        F.when(dd == 11, "unknown").when(dd == 13, "regular").when(hour < 9, "pre").when(hour < 16, "regular").otherwise("post").alias("session"),
    )
    day_start = F.col("day").cast("timestamp_ntz")
    asked = raw.select("request_id", F.col("symbol").alias("wanted"), day.alias("day"), "dd").distinct()
    return bars, asked.select("request_id", "wanted", day_start.alias("from_at"), shift(day_start, "20 HOURS").alias("to_at"), F.when(F.col("dd") == 12, shift(day_start, "10 HOURS")).otherwise(at("2025-01-01 00:00:00")).alias("as_of"))


@query(sql("minute_bars", f"{_QM} SELECT request_id, CASE WHEN bad IS NOT NULL OR pre + reg + post = 0 THEN 'rejected' WHEN notes != '' THEN 'degraded' ELSE 'usable' END AS status, coalesce(bad, notes) AS issues FROM c"))
def c17_minute_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars, asked = minute_requests(spark, sf_dir)
    return quality.minute_quality(bars, asked, ["pre", "regular", "post"])


def _quality_sql(strict: bool) -> str:
    m, r = macro_plans._metric_case, macro_plans._release_case
    bad = "'reject'" if strict else "'usable_with_warning'"
    return sql("monthly_series", f"""{macro_plans._CONSENSUS}, nm AS (SELECT *, {macro_plans._NOW} AS now FROM cs), jm AS (SELECT *, {m(strict, 1)} AS md, {m(strict, 2)} AS mw, CASE WHEN consensus IS NOT NULL AND NOT coalesce(pit_verified, false) THEN {bad} ELSE 'usable' END AS cd FROM nm),
ag AS (SELECT release_id, count(*) AS n, count(*) FILTER (md != 'reject') AS usable, string_agg(concat_ws('|', CASE WHEN md != 'usable' THEN series || ':' || mw END, CASE WHEN md != 'reject' AND cd != 'usable' THEN series || ':consensus_pit_unverified' END), '|' ORDER BY series) FILTER (md != 'usable' OR cd != 'usable') AS ws FROM jm GROUP BY release_id),
rb AS (SELECT DISTINCT release_id, release_date FROM mt), {macro_plans._RELEASES.split("rb AS (SELECT DISTINCT release_id, release_date FROM mt),", 1)[1].strip()},
jr AS (SELECT *, {r(strict, 1)} AS d, CASE WHEN {r(strict, 1)} != 'usable' THEN {r(strict, 2)} END AS why FROM rl)
SELECT release_id, CASE WHEN d = 'reject' OR n IS NULL OR usable = 0 THEN 'rejected' WHEN why IS NOT NULL OR ws IS NOT NULL THEN 'degraded' ELSE 'usable' END AS status,
CASE WHEN d = 'reject' THEN why WHEN n IS NULL THEN concat_ws('|', why, 'macro_metrics_missing') WHEN usable = 0 THEN concat_ws('|', why, ws, 'no_usable_macro_metrics') ELSE concat_ws('|', why, ws) END AS issues FROM jr LEFT JOIN ag USING (release_id)""")


@query(_quality_sql(False))
def c18_release_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.release_quality(macro_plans.releases(spark, sf_dir), macro_plans._matched(spark, sf_dir), macro_plans.as_of(), False)


@query(_quality_sql(True))
def c18_release_quality_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.release_quality(macro_plans.releases(spark, sf_dir), macro_plans._matched(spark, sf_dir), macro_plans.as_of(), True)


@query(sql("monthly_series", f"""{macro_plans._RELEASES}, j AS (SELECT *, {macro_plans._release_case(False, 1)} AS d, {macro_plans._release_case(False, 2)} AS why, coalesce(released_at, vendor_release_at) AS t, released_at IS NULL AND vendor_release_at IS NOT NULL AS vendor FROM rl)
SELECT release_id, strftime(CASE WHEN d != 'reject' THEN t END, {_T}) AS event_at, CASE WHEN released_at IS NOT NULL THEN 'release' WHEN vendor THEN 'vendor' END AS source, CASE WHEN t IS NULL THEN 'actual_release_time_missing' WHEN d = 'reject' THEN why END AS reason,
CASE WHEN t IS NULL OR d = 'reject' THEN '' ELSE concat_ws('|', CASE WHEN vendor THEN 'event_time_uses_vendor_timestamp' END, CASE WHEN d = 'usable_with_warning' AND NOT (vendor AND why = 'event_time_uses_vendor_timestamp') THEN why END) END AS warnings FROM j"""))
def f10_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = macro_plans.releases(spark, sf_dir).withColumn("e", macro.event_time(macro_plans.as_of()))
    return rows.select("release_id", F.date_format("e.event_at", "yyyy-MM-dd HH:mm:ss").alias("event_at"), F.col("e.source").alias("source"), F.col("e.reason").alias("reason"), F.col("e.warnings").alias("warnings"))


@query(sql("monthly_series", f"{macro_plans._RELEASES} SELECT release_id, release_date::VARCHAR AS release_date, row_number() OVER (ORDER BY release_date DESC, release_id DESC)::INT AS rank FROM rl ORDER BY rank LIMIT 24"))
def k07_newest_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = macro_plans.releases(spark, sf_dir).orderBy(F.desc("release_date"), F.desc("release_id")).limit(24)
    rank = F.row_number().over(Window.orderBy(F.desc("release_date"), F.desc("release_id")))  # of 24 rows
    return last.select("release_id", F.col("release_date").cast("string").alias("release_date"), rank.alias("rank"))


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A context per supplier that asks for some components, and has been assessed or not."""
    k = F.col("s_suppkey")
    names = [F.when(k % (i + 2) != 1, c) for i, c in enumerate(context.PURPOSES)]
    return read(spark, sf_dir, "supplier").select(k.alias("context_id"), F.concat(F.lit(" s"), k).alias("symbol"), F.array_compact(F.array(*names)).alias("requested"), (k % 6 != 0).alias("assessed"))


_REQUESTED = "CASE component WHEN 'quote' THEN s_suppkey % 2 != 1 WHEN 'technical' THEN s_suppkey % 3 != 1 WHEN 'macro' THEN s_suppkey % 4 != 1 ELSE s_suppkey % 5 != 1 END"
_COMPONENTS = "(SELECT unnest(['quote', 'technical', 'macro', 'market_reaction']) AS component, unnest(['current_price', 'daily_technical', 'macro_research', 'market_reaction']) AS purpose)"


@query(f"""WITH rs AS (SELECT l_suppkey AS target, CASE l_linenumber % 4 WHEN 0 THEN 'current_price' WHEN 1 THEN 'daily_technical' WHEN 2 THEN 'macro_research' ELSE 'market_reaction' END AS purpose, CASE WHEN l_suppkey % 7 = 0 THEN 'rejected' WHEN l_suppkey % 7 = 1 OR l_quantity % 9 = 0 THEN 'degraded' ELSE 'usable' END AS status FROM lineitem WHERE l_suppkey % 8 != 0),
c AS (SELECT s_suppkey, component, purpose, {_REQUESTED} AS asked FROM supplier, {_COMPONENTS}),
b AS (SELECT purpose, target, count(*) AS n, count(*) FILTER (status = 'usable') AS u, count(*) FILTER (status = 'rejected') AS r FROM rs WHERE purpose != 'macro_research' GROUP BY ALL UNION ALL SELECT purpose, NULL, count(*), count(*) FILTER (status = 'usable'), count(*) FILTER (status = 'rejected') FROM rs WHERE purpose = 'macro_research' GROUP BY ALL)
SELECT s_suppkey AS context_id, component, CASE WHEN NOT asked THEN 'not_requested' WHEN s_suppkey % 6 = 0 OR n IS NULL THEN 'not_assessed' WHEN u = n THEN 'usable' WHEN r = n THEN 'rejected' ELSE 'degraded' END AS status
FROM c LEFT JOIN b ON b.purpose = c.purpose AND (c.component = 'macro' OR b.target = s_suppkey)""")
def a17_component_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as quality results: of a supplier, by purpose; every eighth supplier has none."""
    n, s = F.col("l_linenumber") % 4, F.col("l_suppkey")
    results = read(spark, sf_dir, "lineitem").where(s % 8 != 0).select(
        F.concat(F.lit("S"), s).alias("target_id"), F.when(n == 0, "current_price").when(n == 1, "daily_technical").when(n == 2, "macro_research").otherwise("market_reaction").alias("purpose"),
        F.when(s % 7 == 0, "rejected").when((s % 7 == 1) | (F.col("l_quantity") % 9 == 0), "degraded").otherwise("usable").alias("status"),
    )
    return context.component_quality(contexts(spark, sf_dir), results)


@query(f"SELECT s_suppkey AS context_id, string_agg(component || ':' || CASE WHEN NOT {_REQUESTED} THEN 'not_requested' WHEN s_suppkey % 3 = 0 THEN 'missing' ELSE 'available' END, '|' ORDER BY i) AS components FROM supplier, (SELECT unnest(['quote', 'technical', 'macro', 'market_reaction']) AS component, unnest([1, 2, 3, 4]) AS i) GROUP BY s_suppkey")
def f22_component_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    present = F.col("context_id") % 3 != 0
    parts = [F.concat(F.lit(f"{c}:"), context.availability(F.array_contains("requested", c), present)) for c in context.PURPOSES]
    return contexts(spark, sf_dir).select("context_id", F.concat_ws("|", *parts).alias("components"))


#: Which field of every so many contexts is wrong.
_WRONG = ["quote_symbol", "quoted_at", "received_at", "technical_symbol", "price_at", "macro_as_of", "reaction_symbol", "event_at", "reference_at", "observed_at", "report_as_of"]
_FAULTS = ["quote_symbol_mismatch", "quote_after_as_of", "quote_received_after_as_of", "technical_symbol_mismatch", "technical_price_after_as_of", "macro_after_as_of", "reaction_symbol_mismatch", "event_after_as_of", "reference_after_as_of", "observation_after_as_of", "report_after_as_of"]


@query("SELECT s_suppkey AS context_id, CASE s_suppkey % 13 " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(_FAULTS)) + " END AS fault FROM supplier")
def c28_context_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts of which one field at a time belongs elsewhere, and some with all or nothing in order."""
    k = F.col("s_suppkey")
    now = at(NOW)
    fields = []
    for i, name in enumerate(_WRONG):
        good, bad = (F.concat(F.lit("s"), k), F.lit("other")) if name.endswith("symbol") else (now, now + F.expr("INTERVAL 1 SECOND"))
        fields.append(F.when(k % 13 == i, bad).when(k % 13 != 12, good).alias(name))
    rows = read(spark, sf_dir, "supplier").select(k.alias("context_id"), F.concat(F.lit("S"), k).alias("symbol"), now.alias("as_of"), *fields)
    return rows.select("context_id", context.context_fault().alias("fault"))


@query("""WITH f AS (SELECT conv_id, role, min((turn, text)) AS o FROM conversations WHERE role IS NOT NULL GROUP BY ALL) SELECT conv_id, string_agg(role, '|' ORDER BY o, role) AS sources FROM f GROUP BY conv_id""")
def a15_source_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of a conversation in the order in which they first speak."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return context.sources(turns, ["conv_id"], ["turn", "text"], "role").select("conv_id", F.array_join("sources", "|").alias("sources"))


@query("""WITH p AS (SELECT l_suppkey AS context_id, CASE l_linenumber % 4 WHEN 0 THEN 'quote' WHEN 1 THEN 'technical' WHEN 2 THEN 'macro' ELSE 'market_reaction' END AS component, l_returnflag || l_linestatus AS source, min(l_orderkey) AS o FROM lineitem GROUP BY ALL)
SELECT context_id, component, string_agg(source, '|' ORDER BY o, source) AS sources FROM p GROUP BY ALL""")
def c29_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of each context and component, in the order in which they first came."""
    n = F.col("l_linenumber") % 4
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("context_id"), F.when(n == 0, "quote").when(n == 1, "technical").when(n == 2, "macro").otherwise("market_reaction").alias("component"), F.concat("l_returnflag", "l_linestatus").alias("source"), "l_orderkey",
    )
    return context.sources(rows, ["context_id", "component"], ["l_orderkey"], "source").select("context_id", "component", F.array_join("sources", "|").alias("sources"))


@query("""SELECT source, lang, CASE WHEN count(n) = count(*) THEN sum(n)::BIGINT END AS tokens FROM (SELECT source, lang, CASE WHEN doc_id % 211 != 0 THEN n_chars END AS n FROM documents) GROUP BY ALL""")
def a18_token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sum of a group's counts, null where one of them is missing."""
    rows = read(spark, sf_dir, "documents").select("source", "lang", F.when(F.col("doc_id") % 211 != 0, F.col("n_chars")).alias("n"))
    return rows.groupBy("source", "lang").agg(F.when(F.count("n") == F.count("*"), F.sum("n")).cast("long").alias("tokens"))


@query("SELECT o_custkey, CASE WHEN count(DISTINCT o_orderdate) = 1 THEN max(o_orderdate)::DATE::VARCHAR END AS scheduled FROM orders GROUP BY o_custkey")
def a11_common_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one time on which all of a group agree, else null; least and largest are enough to see it."""
    day = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.when(F.min(day) == F.max(day), F.max(day)).cast("string").alias("scheduled"))


@query(sql("curve_points", "SELECT a.day::VARCHAR AS day, round(a.yield_pct, 6) AS lower, round(b.yield_pct, 6) AS upper, a.yield_pct <= b.yield_pct AS ordered FROM curve_points a JOIN curve_points b USING (day) WHERE a.tenor = '3m' AND b.tenor = '2y'"))
def j15_common_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = views.curve_points(spark, sf_dir)
    low, high = (points.where(F.col("tenor") == t).select("day", F.col("yield_pct").alias(n)) for t, n in (("3m", "lower"), ("2y", "upper")))
    return low.join(high, "day").select(F.col("day").cast("string").alias("day"), F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), (F.col("lower") <= F.col("upper")).alias("ordered"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0), c AS (SELECT vec_id, embedding FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en' AND d.source IS NOT NULL),
r AS (SELECT query_id, vec_id, list_cosine_distance(query::DOUBLE[], embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(query::DOUBLE[], embedding::DOUBLE[]), vec_id) AS rank FROM q, c) SELECT query_id, vec_id, round(distance, 5) AS distance, rank::INT AS rank FROM r WHERE rank <= 3""")
def j01_chunk_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that pass the filters meet their vectors by id, before the search."""
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    chunks = read(spark, sf_dir, "documents").where("lang = 'en' AND source IS NOT NULL").select(F.col("doc_id").alias("vec_id"))
    questions = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.top_k(questions, vectors.join(chunks, "vec_id"), 3).withColumn("distance", F.round("distance", 5))


@query("""WITH b AS (SELECT conv_id, turn, count(*)::BIGINT AS blocks FROM conversations GROUP BY ALL), e AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'rag:' ELSE 'rag:' || doc_id % 900 || '/' || doc_id % 4 END AS evidence_id FROM documents)
SELECT doc_id, evidence_id, CASE WHEN evidence_id = 'rag:' THEN 'empty_id' WHEN blocks IS NULL THEN 'not_found' ELSE 'found' END AS status, coalesce(blocks, 0) AS blocks FROM e LEFT JOIN b ON evidence_id = 'rag:' || conv_id || '/' || turn""")
def j19_evidence_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evidence id names a thread and a turn, whose blocks are counted; prefixes are told apart first."""
    k = F.col("doc_id")
    cited = read(spark, sf_dir, "documents").select("doc_id", F.when(k % 5 == 0, "rag:").otherwise(F.concat(F.lit("rag:"), k % 900, F.lit("/"), k % 4)).alias("evidence_id"))
    parts = F.split(F.substring("evidence_id", 5, 1 << 20), "/")
    parsed = cited.withColumns({"conv_id": F.when(F.col("evidence_id").startswith("rag:"), F.try_element_at(parts, F.lit(1)).try_cast("long")), "turn": F.try_element_at(parts, F.lit(2)).try_cast("long")})
    turns = read(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")).agg(F.count("*").alias("blocks"))
    status = F.when(F.length("evidence_id") == 4, "empty_id").when(F.col("blocks").isNull(), "not_found").otherwise("found")
    return parsed.join(turns, ["conv_id", "turn"], "left").select("doc_id", "evidence_id", status.alias("status"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


@query("""SELECT p_partkey, coalesce(c.c_mktsegment, s.s_name) AS name, CASE WHEN c.c_custkey IS NOT NULL THEN lpad(c.c_custkey::VARCHAR, 10, '0') END AS cik, CASE WHEN c.c_custkey IS NOT NULL THEN 'primary' WHEN s.s_suppkey IS NOT NULL THEN 'secondary' END AS origin
FROM part LEFT JOIN customer c ON c.c_custkey = p_partkey * 3 LEFT JOIN supplier s ON s.s_suppkey = p_partkey""")
def j20_registry_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Securities from one master, else from another; registration numbers from the first alone."""
    wanted = read(spark, sf_dir, "part").select("p_partkey")
    first = read(spark, sf_dir, "customer").select((F.col("c_custkey") / 3).alias("key"), "c_custkey", "c_mktsegment").where("key = floor(key)").select(F.col("key").cast("long").alias("p_partkey"), "c_custkey", "c_mktsegment")
    second = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_name")
    rows = wanted.join(first, "p_partkey", "left").join(second, "p_partkey", "left")
    primary = F.col("c_custkey").isNotNull()
    return rows.select("p_partkey", F.coalesce("c_mktsegment", "s_name").alias("name"), F.when(primary, F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("cik"), F.when(primary, "primary").when(F.col("s_name").isNotNull(), "secondary").alias("origin"))


@query(sql("bars", f"""qs AS (SELECT DISTINCT symbol, substr(symbol, 2)::INT AS k FROM bars), q AS (SELECT symbol, CASE WHEN k % 6 = 0 THEN 'rejected' ELSE 'degraded' END AS quote_status FROM qs)
SELECT symbol, quote_status, b.status AS bars_status, quote_status != 'rejected' AS has_quote, b.status != 'rejected' AS has_technical FROM q JOIN ({ORACLES['c16_bar_quality']}) b USING (symbol)"""))
def c20_guarded_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rejected quote is withheld, and so is the analysis of rejected bars."""
    from tidemark.plans import records

    k = F.substring("symbol", 2, 2).cast("int")
    quotes = views.bars(spark, sf_dir).select("symbol").distinct().select(
        "symbol", F.col("symbol").alias("wanted"), at(NOW).alias("quoted_at"), at(NOW).alias("received_at"), F.when(k % 6 == 0, "fixture").otherwise("historical").alias("data_mode"), F.lit(False).alias("is_delayed"), F.lit("closed").alias("market_state"),
    )
    rated = quality.quote_quality(quotes, at(NOW)).select("symbol", F.col("status").alias("quote_status"))
    bars = records.c16_bar_quality(spark, sf_dir).select("symbol", F.col("status").alias("bars_status"))
    return rated.join(bars, "symbol").select("symbol", "quote_status", "bars_status", (F.col("quote_status") != "rejected").alias("has_quote"), (F.col("bars_status") != "rejected").alias("has_technical"))


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans import reactions

    return reactions.w25_window_returns(spark, sf_dir)


@query(f"""SELECT status, count(*)::BIGINT AS n, count(*) FILTER ((status = 'usable') != (price IS NOT NULL) OR (status = 'usable') != (reason IS NULL))::BIGINT AS broken FROM ({ORACLES['w25_window_returns']}) GROUP BY status""")
def f21_state_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of observations by status: how many have a field that their status forbids, or lack one that it asks for."""
    usable = F.col("status") == "usable"
    wrong = (usable != F.col("price").isNotNull()) | (usable != F.col("reason").isNull())
    return _windows(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_if(wrong).alias("broken"))


@query(f"""SELECT a.event_id, a.symbol, a.status AS alignment, a.issues, w.windows, c.status AS close_status, c.return_pct AS close_return FROM ({ORACLES['w24_alignment']}) a
JOIN (SELECT event_id, symbol, string_agg("window" || ':' || status, '|' ORDER BY "window") AS windows FROM ({ORACLES['w25_window_returns']}) GROUP BY ALL) w USING (event_id, symbol) LEFT JOIN ({ORACLES['w26_close_return']}) c USING (event_id, symbol)""")
def c30_event_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record of each event and symbol: how its bars align, its windows, and its close."""
    from tidemark.plans import reactions

    key = ["event_id", "symbol"]
    windows = _windows(spark, sf_dir).groupBy(*key).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "window", "status"))), "|").alias("windows"))
    aligned = reactions.w24_alignment(spark, sf_dir).select(*key, F.col("status").alias("alignment"), "issues")
    close = reactions.w26_close_return(spark, sf_dir).select(*key, F.col("status").alias("close_status"), F.col("return_pct").alias("close_return"))
    return aligned.join(windows, key).join(close, key, "left")
