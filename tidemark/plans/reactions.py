"""Queries over events and minute bars: signups are the events, other event types the symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import reaction
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import sql

AS_OF = "2024-01-28 12:00:00"
#: Fixed value: the event type that stands for releases.
EVENT = "signup"


def as_of() -> Column:
    return F.to_timestamp_ntz(F.lit(AS_OF))


def _time(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ticks(spark, sf_dir).where(F.col("symbol") == EVENT).select("event_id", F.col("ts").alias("event_at"), "user_id")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.ticks_to_bars(views.ticks(spark, sf_dir).where(F.col("symbol") != EVENT))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most as many rows as there are event types."""
    return views.ticks(spark, sf_dir).where(F.col("symbol") != EVENT).select("symbol").distinct()


_EV = f"ev AS (SELECT event_id, ts AS event_at, user_id FROM events WHERE event_type = '{EVENT}'), mb AS (SELECT * FROM minute_bars WHERE symbol != '{EVENT}'), sy AS (SELECT DISTINCT symbol FROM mb)"
_REF = f"""{_EV}, rf AS (SELECT event_id, event_at, symbol, max(end_at) AS reference_at, arg_max(close, end_at) AS reference_price FROM ev JOIN mb ON end_at <= event_at AND event_at - end_at <= INTERVAL 5 MINUTE GROUP BY ALL)"""
_F = "'%Y-%m-%d %H:%M:%S'"


@query(sql("minute_bars", f"{_REF} SELECT event_id, symbol, strftime(reference_at, {_F}) AS reference_at, reference_price FROM rf"))
def j04_reference_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.reference_bars(events(spark, sf_dir), bars(spark, sf_dir)).select("event_id", "symbol", _time("reference_at"), "reference_price")


_OBS = f"""{_REF}, wd AS (SELECT unnest(['5m', '30m', '1h']) AS "window", unnest([5, 30, 60]) AS mins),
tg AS (SELECT event_id, event_at, symbol, "window", event_at + to_minutes(mins) AS target_at FROM ev, sy, wd),
ob AS (SELECT t.event_id, t."window", t.symbol, arg_max(close, end_at) AS price, max(end_at) AS price_at FROM tg t JOIN mb ON mb.symbol = t.symbol AND start_at >= event_at AND end_at <= target_at AND end_at > target_at - INTERVAL 60 SECOND AND end_at <= TIMESTAMP '{AS_OF}' GROUP BY ALL)"""


@query(sql("minute_bars", f"""{_OBS} SELECT event_id, "window", symbol, price, strftime(price_at, {_F}) AS price_at FROM ob"""))
def j05_observation_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = F.array(*[F.struct(F.lit(w).alias("window"), (F.col("event_at") + F.expr(f"INTERVAL {m} MINUTES")).alias("target_at")) for w, m in reaction.WINDOWS.items()])
    targets = events(spark, sf_dir).select("event_id", "event_at", F.inline(windows))
    return reaction.observation_bars(targets, bars(spark, sf_dir), as_of()).select("event_id", "window", "symbol", "price", _time("price_at"))


_MARKED = f"""{_EV}, mk AS (SELECT event_id, event_at, symbol, CASE WHEN end_at <= event_at THEN 'pre' WHEN start_at >= event_at THEN 'post' ELSE 'crossing' END AS kind, start_at, end_at
FROM ev JOIN mb ON start_at >= date_trunc('minute', event_at - INTERVAL 5 MINUTE) AND end_at <= CASE WHEN date_trunc('minute', event_at) = event_at THEN event_at + INTERVAL 2 HOUR ELSE date_trunc('minute', event_at) + INTERVAL 121 MINUTE END)"""


@query(sql("minute_bars", f"{_MARKED} SELECT event_id, symbol, kind, count(*)::BIGINT AS n FROM mk GROUP BY ALL"))
def j06_bar_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.class_counts(events(spark, sf_dir), bars(spark, sf_dir))


@query(sql("minute_bars", f"""{_MARKED}, sd AS (SELECT e.event_id, e.event_at, sy.symbol, max(CASE WHEN kind = 'pre' THEN end_at END) AS pre_end, min(CASE WHEN kind = 'post' THEN start_at END) AS post_start, coalesce(bool_or(kind = 'crossing'), false) AS crossing
  FROM ev e CROSS JOIN sy LEFT JOIN mk ON mk.event_id = e.event_id AND mk.symbol = sy.symbol GROUP BY ALL),
iss AS (SELECT *, CASE WHEN pre_end IS NULL THEN 'pre_bar_missing' WHEN event_at - pre_end > INTERVAL 5 MINUTE THEN 'pre_bar_too_old' END AS a,
  CASE WHEN post_start IS NULL THEN CASE WHEN CASE WHEN date_trunc('minute', event_at) = event_at THEN event_at ELSE date_trunc('minute', event_at) + INTERVAL 1 MINUTE END + INTERVAL 1 MINUTE <= TIMESTAMP '{AS_OF}' THEN 'post_bar_missing' ELSE 'post_bar_not_yet_complete' END
    WHEN post_start - event_at > INTERVAL 5 MINUTE THEN 'post_bar_too_old' END AS b, CASE WHEN date_trunc('minute', event_at) != event_at AND NOT crossing THEN 'event_minute_not_observed' END AS c FROM sd)
SELECT event_id, symbol, CASE WHEN a IS NOT NULL THEN 'unavailable' WHEN b IS NOT NULL THEN 'incomplete' ELSE 'ready' END AS status, concat_ws('|', a, b, c) AS issues FROM iss"""))
def w24_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = events(spark, sf_dir).join(F.broadcast(symbols(spark, sf_dir)), how="cross")
    return reaction.minute_alignment(pairs, bars(spark, sf_dir), as_of())


_RETURNS = f"""{_OBS}, rt AS (SELECT t.event_id, t.symbol, t."window", CASE WHEN reference_price IS NULL THEN 'unavailable' WHEN target_at > TIMESTAMP '{AS_OF}' THEN 'pending' WHEN price IS NULL THEN 'missing' ELSE 'usable' END AS status,
  CASE WHEN reference_price IS NULL THEN 'reference_bar_unavailable' WHEN target_at > TIMESTAMP '{AS_OF}' THEN 'observation_not_yet_reached' WHEN price IS NULL THEN 'observation_bar_unavailable' END AS reason, price, (price / nullif(reference_price, 0) - 1) * 100 AS r
  FROM tg t LEFT JOIN rf ON rf.event_id = t.event_id AND rf.symbol = t.symbol LEFT JOIN ob ON ob.event_id = t.event_id AND ob.symbol = t.symbol AND ob."window" = t."window")"""


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.window_returns(events(spark, sf_dir), symbols(spark, sf_dir), bars(spark, sf_dir), as_of())


@query(sql("minute_bars", f"""{_RETURNS} SELECT event_id, symbol, "window", status, reason, CASE WHEN status = 'usable' THEN price END AS price, CASE WHEN status = 'usable' THEN round(r, 6) END AS return_pct FROM rt"""))
def w25_window_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _returns(spark, sf_dir).withColumn("return_pct", F.round("return_pct", 6))


@query(sql("minute_bars", f"""{_RETURNS}, k AS (SELECT *, CASE status WHEN 'usable' THEN 1 WHEN 'pending' THEN 2 WHEN 'missing' THEN 3 ELSE 4 END AS rank, CASE WHEN status = 'usable' THEN r END AS u FROM rt)
SELECT a.event_id, a."window", CASE WHEN a.rank >= b.rank THEN a.status ELSE b.status END AS status, round(a.u - b.u, 6) AS difference_pp FROM k a JOIN k b ON a.event_id = b.event_id AND a."window" = b."window" WHERE a.symbol = 'click' AND b.symbol = 'view'"""))
def w27_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.relative(_returns(spark, sf_dir), "click", "view").withColumn("difference_pp", F.round("difference_pp", 6))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday closes at 21:00; a day each."""
    days = views.ticks(spark, sf_dir).agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    day = days.select(F.explode(F.sequence("a", F.date_add("b", 14))).alias("d")).where(F.weekday("d") < 5)
    return day.select(F.to_timestamp_ntz(F.concat(F.col("d").cast("string"), F.lit(" 21:00:00"))).alias("close_at"))


_CLOSE = f"""{_REF}, cal AS (SELECT d + INTERVAL 21 HOUR AS close_at FROM (SELECT unnest(generate_series((SELECT min(ts)::DATE FROM events)::TIMESTAMP, (SELECT max(ts)::DATE + 14 FROM events)::TIMESTAMP, INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6),
nc AS (SELECT event_id, event_at, min(close_at) AS close_at FROM ev JOIN cal ON close_at > event_at AND close_at::DATE <= event_at::DATE + 14 GROUP BY ALL)"""


@query(sql("minute_bars", f"{_CLOSE} SELECT event_id, strftime(close_at, {_F}) AS close_at FROM nc"))
def j08_next_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.next_close(events(spark, sf_dir), calendar(spark, sf_dir)).select("event_id", _time("close_at"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes of the symbols: some late, some without a time, some adjusted."""
    rows = views.ticks(spark, sf_dir).where((F.col("symbol") != EVENT) & (F.hour("ts") < 21))
    day = F.to_date("ts")
    made = rows.groupBy("symbol", day.alias("d")).agg(F.max_by("price", "event_id").alias("close"))
    k = F.dayofmonth("d") % 7
    close_at = F.to_timestamp_ntz(F.concat(F.col("d").cast("string"), F.lit(" 21:00:00")))
    return made.select(
        "symbol", close_at.alias("close_at"), "close", (k != 1).alias("is_complete"),
        F.when(k == 2, None).when(k == 3, close_at + F.expr("INTERVAL 30 DAYS")).otherwise(close_at).alias("updated_at"), F.when(k == 4, "forward_adjusted").otherwise("raw").alias("adjustment"),
    )


@query(sql("minute_bars", f"""{_CLOSE}, dl AS (SELECT event_type AS symbol, ts::DATE AS d, arg_max(value, event_id) AS close, day(ts::DATE) % 7 AS k FROM events WHERE event_type != '{EVENT}' AND hour(ts) < 21 GROUP BY ALL),
x AS (SELECT nc.event_id, sy.symbol, nc.close_at, reference_price, dl.close, dl.k, TIMESTAMP '{AS_OF}' AS now FROM nc CROSS JOIN sy LEFT JOIN rf ON rf.event_id = nc.event_id AND rf.symbol = sy.symbol LEFT JOIN dl ON dl.symbol = sy.symbol AND dl.d = nc.close_at::DATE),
y AS (SELECT *, CASE WHEN reference_price IS NULL THEN 'reference_bar_unavailable' WHEN close_at > now THEN 'close_not_yet_reached' WHEN close IS NULL THEN 'daily_close_unavailable' WHEN k = 1 THEN 'daily_bar_not_complete' WHEN k = 2 THEN 'daily_close_time_unverified'
  WHEN k = 3 AND close_at + INTERVAL 30 DAY > now THEN 'daily_close_not_yet_available' WHEN k = 4 THEN 'price_adjustment_mismatch' END AS reason FROM x)
SELECT event_id, symbol, CASE reason WHEN 'reference_bar_unavailable' THEN 'unavailable' WHEN 'price_adjustment_mismatch' THEN 'unavailable' WHEN 'daily_close_unavailable' THEN 'missing' WHEN 'daily_close_time_unverified' THEN 'missing' ELSE CASE WHEN reason IS NULL THEN 'usable' ELSE 'pending' END END AS status,
reason, CASE WHEN reason IS NULL THEN round((close / nullif(reference_price, 0) - 1) * 100, 6) END AS return_pct FROM y"""))
def w26_close_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, mb = events(spark, sf_dir), bars(spark, sf_dir)
    closes = reaction.next_close(ev, calendar(spark, sf_dir)).join(F.broadcast(symbols(spark, sf_dir)), how="cross")
    refs = reaction.reference_bars(ev, mb).select("event_id", "symbol", "reference_price")
    pairs = closes.join(refs, ["event_id", "symbol"], "left").withColumn("reference_adjustment", F.lit("raw"))
    return reaction.close_returns(pairs, daily(spark, sf_dir), as_of()).withColumn("return_pct", F.round("return_pct", 6))


@query(sql("ticks", f"""r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM ticks WHERE symbol = '{EVENT}' AND ts < TIMESTAMP '{AS_OF}')
SELECT event_id, user_id, rank::INT AS rank FROM r WHERE rank <= 3"""))
def k04_recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaction.recent_events(events(spark, sf_dir), as_of(), 3, "user_id").select("event_id", "user_id", "rank")


@query(sql("minute_bars", f"""{_RETURNS}, lt AS (SELECT event_id, event_at, row_number() OVER (ORDER BY event_at DESC, event_id DESC) AS k FROM ev WHERE event_at < TIMESTAMP '{AS_OF}')
SELECT symbol, "window", count(*) FILTER (status = 'usable')::BIGINT AS usable, count(*) FILTER (status = 'missing')::BIGINT AS missing, count(*) FILTER (status = 'unavailable')::BIGINT AS unavailable, round(avg(r) FILTER (status = 'usable'), 4) AS mean_return
FROM rt JOIN lt USING (event_id) WHERE k <= 200 GROUP BY ALL"""))
def k10_history_reaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reactions of every symbol to the last 200 events, by window."""
    last = reaction.recent_events(events(spark, sf_dir), as_of(), 200)
    rows = reaction.window_returns(last, symbols(spark, sf_dir), bars(spark, sf_dir), as_of())
    return rows.groupBy("symbol", "window").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("usable", "missing", "unavailable")], F.round(F.avg("return_pct"), 4).alias("mean_return")
    )


@query(sql("minute_bars", "SELECT symbol, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS start_at, open, high, low, close, volume FROM minute_bars"))
def s07_minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.minute_bars(spark, sf_dir).select("symbol", _time("start_at"), "open", "high", "low", "close", "volume")
