"""Queries over vendor payloads, made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import vendors, views
from tidemark.sources.views import read, sql

AS_OF = "1999-06-15 18:30:00"
TICK_AS_OF = "2024-01-20 00:00:00"


def at(text: str):
    return F.to_timestamp_ntz(F.lit(text))


@query(sql("ticks", f"""o AS (SELECT event_id, 0 AS k, 'regular' AS session, CASE WHEN event_id % 4 != 0 THEN price END AS price, ts AS t FROM ticks
UNION ALL SELECT event_id, 1, 'pre', CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE price + 1 END, ts + to_minutes(event_id % 3) FROM ticks
UNION ALL SELECT event_id, 2, 'post', price + 2, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 2 MINUTE END FROM ticks
UNION ALL SELECT event_id, 3, 'overnight', CASE WHEN event_id % 6 = 0 THEN price + 3 END, ts + INTERVAL 1 MINUTE FROM ticks),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY t DESC, k) AS place FROM o WHERE price != 0 AND t IS NOT NULL)
SELECT event_id, session, price, strftime(t, '%Y-%m-%d %H:%M') AS quoted_at FROM r WHERE place = 1 AND t <= TIMESTAMP '{TICK_AS_OF}'"""))
def s05_vendor_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tick as a vendor quote with up to four sessions."""
    k, price, ts = F.col("event_id"), F.col("price"), F.col("ts")
    sessions = {
        "regular": (F.when(k % 4 != 0, price), ts),
        "pre": (F.when(k % 7 == 0, 0.0).otherwise(price + 1), ts + F.make_dt_interval(mins=(k % 3).cast("int"))),
        "post": (price + 2, F.when(k % 5 == 0, ts + F.expr("INTERVAL 2 MINUTES"))),
        "overnight": (F.when(k % 6 == 0, price + 3), ts + F.expr("INTERVAL 1 MINUTE")),
    }
    best = views.ticks(spark, sf_dir).select("event_id", vendors.newest_session(sessions, at(TICK_AS_OF)).alias("q")).where("q IS NOT NULL")
    return best.select("event_id", "q.session", "q.price", F.date_format("q.quoted_at", "yyyy-MM-dd HH:mm").alias("quoted_at"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calendar of weekdays with bars; early closes on the 24th."""
    days = views.bars(spark, sf_dir).select("day").distinct().where(F.dayofweek("day").between(2, 6))
    day = F.col("day").cast("timestamp_ntz")
    close = F.when(F.dayofmonth("day") == 24, day + F.expr("INTERVAL 18 HOURS")).otherwise(day + F.expr("INTERVAL 21 HOURS"))
    return days.select("day", (day + F.expr("INTERVAL '14:30' HOUR TO MINUTE")).alias("open_at"), close.alias("close_at"))


@query(sql("bars", f"""c AS (SELECT symbol, day, CASE WHEN dayofweek(day) BETWEEN 1 AND 5 THEN day + CASE WHEN day(day) = 24 THEN INTERVAL 18 HOUR ELSE INTERVAL 21 HOUR END END AS end_at FROM bars)
SELECT symbol, day::VARCHAR AS day, strftime(CASE WHEN end_at IS NOT NULL THEN day + INTERVAL 870 MINUTE END, '%Y-%m-%d %H:%M') AS start_at, strftime(end_at, '%Y-%m-%d %H:%M') AS end_at,
coalesce(end_at <= TIMESTAMP '{AS_OF}', false) AS is_complete, strftime(CASE WHEN end_at <= TIMESTAMP '{AS_OF}' THEN end_at ELSE TIMESTAMP '{AS_OF}' END, '%Y-%m-%d %H:%M') AS updated_at,
CASE WHEN end_at <= TIMESTAMP '{AS_OF}' THEN 'historical' ELSE 'live' END AS data_mode FROM c"""))
def s06_vendor_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds from the calendar (S08), then what is known of each bar at as_of."""
    bars = vendors.daily_bounds(views.bars(spark, sf_dir).select("symbol", "day"), sessions(spark, sf_dir))
    done = vendors.bar_state(bars, at(AS_OF), at(AS_OF))
    shown = [F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("start_at", "end_at", "updated_at")]
    return done.select("symbol", F.col("day").cast("string").alias("day"), "is_complete", "data_mode", *shown)


@query("""SELECT c_custkey AS id, upper('c.' || c_custkey) || '.' || upper(n_name[1:2]) AS code, upper('c.' || c_custkey) AS ticker FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def s11_symbol_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.substring("n_name", 1, 2).alias("region"))
    named = read(spark, sf_dir, "customer").join(nations, "c_nationkey")
    codes = named.select(F.col("c_custkey").alias("id"), vendors.vendor_symbol(F.concat(F.lit(" c."), F.col("c_custkey").cast("string")), F.col("region")).alias("code"))
    return codes.withColumn("ticker", vendors.plain_symbol(F.col("code")))


@query(sql("monthly_series", "SELECT series, period::VARCHAR AS period, persons::DOUBLE AS value FROM monthly_series WHERE variant = 'F' AND month(period) NOT IN (6, 9)"))
def s12_monthly_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly texts with a year's average, dashes and blanks among them."""
    rows = views.monthly_series(spark, sf_dir).where("variant = 'F'")
    month = F.month("period")
    text = F.when(month == 6, " - ").when(month == 9, "").otherwise(F.format_number("persons", 0))
    raw = rows.select("series", F.year("period").alias("year"), F.explode(F.array(F.concat(F.lit("M"), F.lpad(month.cast("string"), 2, "0")), F.lit("M13"))).alias("code"), text.alias("text"))
    return vendors.monthly_points(raw).select("series", F.col("period").cast("string").alias("period"), "value")


@query(sql("monthly_series", "SELECT CASE series WHEN 'A' THEN 'pce' ELSE 'core_pce' END AS series, period::VARCHAR AS period, (persons * 1000 + 7)::DOUBLE AS value FROM monthly_series WHERE variant = 'O' AND series IN ('A', 'N') AND month(period) != 2"))
def s13_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.monthly_series(spark, sf_dir).where("variant = 'O'")
    text = F.when(F.month("period") == 2, "NA").otherwise(F.format_number(F.col("persons") * 1000 + 7, 0))
    raw = rows.select(F.col("series").alias("code"), F.concat(F.year("period").cast("string"), F.lit("M"), F.month("period").cast("string")).alias("time_period"), text.alias("text"))
    found = vendors.index_points(raw, {"A": "pce", "N": "core_pce"})
    return found.select("series", F.col("period").cast("string").alias("period"), "value")


@query(sql("facts", """d AS (SELECT concept, unit, start_date, filed_date, count(*)::BIGINT AS n FROM facts GROUP BY ALL),
v AS (SELECT *, coalesce(lead(filed_date) OVER (PARTITION BY concept, unit, start_date ORDER BY filed_date) - 1, DATE '9999-12-31') AS until FROM d)
SELECT concept, unit, start_date::VARCHAR AS start_date, n, filed_date::VARCHAR AS realtime_start, until::VARCHAR AS realtime_end FROM v WHERE filed_date <= DATE '1999-06-15' AND until >= DATE '1999-06-15'"""))
def s14_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily reports of a quarter as vintages of one observation."""
    keys = ["concept", "unit", "start_date"]
    reports = views.facts(spark, sf_dir).groupBy(*keys, "filed_date").agg(F.count("*").alias("n"))
    stood = vendors.at_vintage(vendors.vintages(reports, keys), F.to_date(F.lit("1999-06-15")))
    return stood.select("concept", "unit", "n", *[F.col(c).cast("string").alias(c) for c in ("start_date", "realtime_start", "realtime_end")])



@query("""WITH r AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k, o_orderkey % 1000 AS v, o_orderkey % 2 = 0 AS thousand, o_orderkey % 5 < 2 AS whole FROM orders),
n AS (SELECT *, CASE k WHEN 3 THEN v + 0.5 WHEN 4 THEN 1000 + v WHEN 5 THEN -v - 0.25 END::DOUBLE * CASE WHEN thousand THEN 1000 ELSE 1 END AS number FROM r),
s AS (SELECT *, CASE WHEN k IN (0, 1) THEN 'missing' WHEN k = 2 THEN 'invalid' WHEN whole AND number != floor(number) THEN 'not_whole' ELSE 'ok' END AS status FROM n)
SELECT id, status, CASE WHEN status = 'ok' THEN number END AS value FROM s""")
def s18_scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    v = (k % 1000).cast("string")
    text = (
        F.when(k % 6 == 0, None).when(k % 6 == 1, " -- ").when(k % 6 == 2, "12x").when(k % 6 == 3, F.concat(v, F.lit(".5")))
        .when(k % 6 == 4, F.concat(F.lit("1,"), F.lpad(v, 3, "0"))).otherwise(F.concat(F.lit("-"), v, F.lit(".25")))
    )
    read_ = read(spark, sf_dir, "orders").select(k.alias("id"), vendors.scaled(text, F.when(k % 2 == 0, 1000).otherwise(1), k % 5 < 2).alias("s"))
    return read_.select("id", "s.status", "s.value")


@query(sql("ticks", """r AS (SELECT event_id, symbol, ts::DATE AS day, event_id % 9 AS k FROM ticks WHERE event_id % 4 != 0 AND event_id % 5 != 0 AND symbol IN ('view', 'click', 'purchase'))
SELECT event_id, CASE symbol WHEN 'view' THEN 'cpi' WHEN 'click' THEN 'payrolls' ELSE 'claims' END AS indicator, CASE symbol WHEN 'view' THEN 'mom' ELSE 'level' END AS measure,
(CASE WHEN symbol = 'purchase' THEN day ELSE date_trunc('month', day) END)::DATE::VARCHAR AS period,
CASE WHEN symbol = 'view' THEN CASE WHEN k IN (0, 1) THEN NULL WHEN k = 2 THEN NULL ELSE event_id % 100 / 10.0 END
  ELSE CASE WHEN k = 0 THEN NULL WHEN k = 1 THEN NULL WHEN k = 2 THEN (event_id % 100) * 1000 ELSE (event_id % 100) * 100000 END END::DOUBLE AS value FROM r"""))
def s19_calendar_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks as calendar rows: percentages for one event, counts for two."""
    k = F.col("event_id")
    v = (k % 100).cast("string")
    share = F.when(k % 9 == 0, "").when(k % 9 == 1, " - ").when(k % 9 == 2, "n/a").otherwise(F.concat((k % 100 / 10).cast("decimal(6,1)").cast("string"), F.lit(" %")))
    many = F.when(k % 9 == 0, "").when(k % 9 == 1, "0.0005K").when(k % 9 == 2, F.concat(v, F.lit(" k"))).otherwise(F.concat((k % 100 / 10).cast("decimal(6,1)").cast("string"), F.lit("M")))
    raw = views.ticks(spark, sf_dir).select(
        "event_id", F.col("symbol").alias("event"), F.when(k % 5 == 0, "elsewhere").otherwise("here").alias("country"), F.when(k % 4 == 0, 1).otherwise(0).alias("date_span"),
        F.to_date("ts").alias("reference_day"), F.when(F.col("symbol") == "view", share).otherwise(many).alias("text"),
    )
    names = spark.createDataFrame([("view", "cpi", "mom", False), ("click", "payrolls", "level", False), ("purchase", "claims", "level", True)], "event string, indicator string, measure string, weekly boolean")
    found = vendors.calendar_rows(raw, names, "here", ["payrolls", "claims"])
    return found.select("event_id", "indicator", "measure", F.col("period").cast("string").alias("period"), "value")


@query("""WITH f AS (SELECT source AS company, 'a-' || lpad(doc_id::VARCHAR, 12, '0') AS accession, CASE doc_id % 3 WHEN 0 THEN '8-K' WHEN 1 THEN '10-Q' ELSE '10-K' END AS form, TIMESTAMP '2020-01-01' + to_hours(doc_id % 5000) AS accepted_at, doc_id FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY accepted_at DESC, accession DESC) AS place FROM f WHERE form IN ('8-K', '10-Q') AND accepted_at <= TIMESTAMP '2020-06-01')
SELECT company, accession, form, place FROM r WHERE place <= 5""")
def s20_recent_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as filings in pages of parallel arrays, a hundred ids a page, read back; the newest five of each company (K06)."""
    d = F.col("doc_id")
    rows = read(spark, sf_dir, "documents").select(
        F.col("source").alias("company"), F.floor(d / 100).alias("page"), F.concat(F.lit("a-"), F.lpad(d.cast("string"), 12, "0")).alias("accession"),
        F.when(d % 3 == 0, "8-K").when(d % 3 == 1, "10-Q").otherwise("10-K").alias("form"),
        (at("2020-01-01 00:00:00") + F.make_dt_interval(hours=(d % 5000).cast("int"))).alias("accepted_at"), F.concat(d.cast("string"), F.lit(".htm")).alias("primary_name"),
    )
    kept = ["accession", "form", "accepted_at", "primary_name"]
    pages = rows.groupBy("company", "page").agg(F.collect_list(F.struct(*kept)).alias("r"))
    payloads = pages.select("company", F.to_json(F.struct(*[F.col(f"r.{c}").alias(c) for c in kept])).alias("payload"))
    return vendors.recent_filings(vendors.filings(payloads), ["8-K", "10-Q"], at("2020-06-01 00:00:00"), 5).select("company", "accession", "form", "place")


@query("""WITH f AS (SELECT doc_id, doc_id % 4 = 0 AS is_primary, CASE doc_id % 3 WHEN 0 THEN '8-K' WHEN 1 THEN '6-K/A' ELSE '10-Q' END AS form, CASE doc_id % 5 WHEN 0 THEN 'A.HTM' WHEN 1 THEN 'a.html' ELSE 'a.txt' END AS name,
CASE doc_id % 7 WHEN 0 THEN 'EX-10' WHEN 1 THEN 'ex-99.1' ELSE 'EX-99' END AS kind FROM documents)
SELECT doc_id, is_primary OR (form IN ('8-K', '6-K', '6-K/A') AND lower(name) SIMILAR TO '.*\\.html?' AND upper(kind) LIKE 'EX-99%') AS relevant FROM f""")
def s22_relevant_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    form = F.when(d % 3 == 0, "8-K").when(d % 3 == 1, "6-K/A").otherwise("10-Q")
    name = F.when(d % 5 == 0, "A.HTM").when(d % 5 == 1, "a.html").otherwise("a.txt")
    kind = F.when(d % 7 == 0, "EX-10").when(d % 7 == 1, "ex-99.1").otherwise("EX-99")
    return read(spark, sf_dir, "documents").select("doc_id", vendors.relevant_file(form, name, kind, d % 4 == 0).alias("relevant"))


@query(sql("facts", """SELECT l_orderkey AS company, start_date::VARCHAR AS start_date, end_date::VARCHAR AS end_date, filed_date::VARCHAR AS filed_date, value FROM facts WHERE concept = 'N' AND unit = 'O'"""))
def s24_concept_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's facts as one nested JSON document, of which one concept and unit is read (S23)."""
    entry = F.struct(F.col("start_date").alias("start"), F.col("end_date").alias("end"), F.col("value").alias("val"), F.col("filed_date").alias("filed"), F.lit("10-Q").alias("form"))
    units = views.facts(spark, sf_dir).groupBy("l_orderkey", "concept", "unit").agg(F.collect_list(entry).alias("e"))
    concepts = units.groupBy("l_orderkey", "concept").agg(F.map_from_entries(F.collect_list(F.struct("unit", "e"))).alias("units"))
    companies = concepts.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("units")))).alias("c"))
    payloads = companies.select(F.col("l_orderkey").alias("company"), F.to_json(F.struct(F.create_map(F.lit("gaap"), F.col("c")).alias("facts"))).alias("payload"))
    found = vendors.concept_entries(payloads, "gaap", "N", "O")
    return found.select("company", *[F.col(c).cast("string").alias(n) for c, n in (("start", "start_date"), ("end", "end_date"), ("filed", "filed_date"))], F.col("val").alias("value"))


@query("SELECT 'T' || s_suppkey AS ticker, lpad(s_suppkey::VARCHAR, 10, '0') AS cik, s_name AS title, 'https://example.org/' || s_suppkey || '/000112/a.htm' AS url FROM supplier")
def s25_security_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct(F.col("s_suppkey").cast("bigint").alias("cik_str"), F.concat(F.lit(" t"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_name").alias("title"))
    payloads = read(spark, sf_dir, "supplier").select(F.to_json(F.create_map(F.lit("0"), entry)).alias("payload"))
    found = vendors.securities(payloads)
    return found.withColumn("url", vendors.document_url("https://example.org", F.col("cik"), F.lit("0001-1-2"), F.lit("a.htm")))


@query("""SELECT event_id, CASE WHEN event_id % 3 != 2 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS at FROM events""")
def s38_vendor_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch seconds, ISO texts and texts that are neither."""
    k, second = F.col("event_id"), F.date_trunc("second", "ts").cast("timestamp_ntz")
    epoch = F.unix_seconds(second.cast("timestamp")).cast("string")
    text = F.when(k % 3 == 0, epoch).when(k % 3 == 1, F.date_format(second, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("soon")
    return read(spark, sf_dir, "events").select("event_id", F.date_format(vendors.vendor_time(text), "yyyy-MM-dd HH:mm:ss").alias("at"))
