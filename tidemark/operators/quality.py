"""Data-quality guards: statuses usable, degraded and rejected with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Completed bars that each indicator needs.
REQUIRED = {"ma5": 5, "return_5d": 6, "atr14": 15, "ma20": 20, "price_structure_20d": 20, "return_20d": 21, "volume_20d": 21, "ma50": 50}


def first_of(*ladder: tuple[Column, Column | str]) -> Column:
    """The text of the first condition that holds, else null."""
    out = F.lit(None).cast("string")
    for condition, name in reversed(ladder):
        out = F.when(condition, name).otherwise(out)
    return out


def bar_fault() -> Column:
    """What is wrong with a bar (open, high, low, close, volume, start_at, end_at), or null."""
    o, h, lo, c = map(F.col, ("open", "high", "low", "close"))
    return first_of(
        (F.col("start_at") >= F.col("end_at"), "time_order"), ((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0), "price_not_positive"),
        (h < F.greatest(o, c, lo), "high_too_low"), (lo > F.least(o, c, h), "low_too_high"), (F.col("volume") < 0, "volume_negative"),
    )


def quote_quality(quotes: DataFrame, as_of: Column, max_age_s: int = 60) -> DataFrame:
    """status and issues of quotes (symbol, wanted, quoted_at, received_at, data_mode, is_delayed, market_state)."""
    age = F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col("quoted_at").cast("timestamp"))
    reject = first_of(
        (F.col("quoted_at").isNull(), "quote_missing"), (F.upper(F.trim("symbol")) != F.upper(F.trim("wanted")), "symbol_mismatch"), (F.col("quoted_at") > as_of, "quote_after_as_of"),
        (F.col("quoted_at") > F.col("received_at"), "quote_after_received_at"), (F.col("data_mode") == "fixture", "fixture_not_current_price"),
        ((F.col("market_state") != "closed") & (age > max_age_s * 1_000_000), "quote_stale"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("market_state") == "closed", "market_closed"), F.when(F.col("market_state") == "unknown", "market_state_unknown"), F.when(F.col("data_mode") != "live", "quote_not_live"),
        F.when(F.col("is_delayed"), "quote_delayed").when(F.col("is_delayed").isNull(), "quote_delay_unknown"),
    ))
    status = F.when(reject.isNotNull(), "rejected").when(F.size(issues) > 0, "degraded").otherwise("usable")
    return quotes.withColumn("status", status).withColumn("issues", F.when(reject.isNotNull(), reject).otherwise(F.array_join(issues, "|")))


def bar_quality(bars: DataFrame, as_of: Column, needed: int = 60, requests: DataFrame | None = None, timeframe: str = "1d", allow_open: bool = True) -> DataFrame:
    """Per symbol over bars in their input order (ordinal): status, issues and the indicators out of reach.

    bars has symbol, ordinal, start_at, end_at, is_complete, adjustment; all of it is one pass of aggregates after lags. With requests
    (symbol, what was asked for) there is a row for each of them, also without bars, and bars may have found, the symbol that
    a bar names itself, and timeframe, which must be those asked for. allow_open says whether an open bar is allowed.
    """
    for column, value in (("found", F.col("symbol")), ("timeframe", F.lit(timeframe))):
        if column not in bars.columns:
            bars = bars.withColumn(column, value)
    order = Window.partitionBy("symbol").orderBy("ordinal")
    seen = bars.withColumn("before", F.lag("start_at").over(order)).withColumn("_last", F.lead("ordinal").over(order).isNull())
    twice = bars.groupBy("symbol", "start_at", "end_at").count().where("count > 1").select("symbol").distinct().withColumn("twice", F.lit(True))
    facts = seen.groupBy("symbol").agg(
        F.count_distinct("adjustment").alias("adjustments"), F.bool_or(F.col("start_at") < F.col("before")).alias("unsorted"),
        F.bool_or(F.col("start_at") > as_of).alias("future"), F.bool_or(F.col("is_complete") & (F.col("end_at") > as_of)).alias("completed_future"),
        F.count_if(~F.col("is_complete")).alias("open_bars"), F.bool_or(F.col("_last") & F.col("is_complete")).alias("last_complete"), F.count_if("is_complete").alias("completed"),
        F.bool_or(F.upper(F.trim("found")) != F.upper(F.trim("symbol"))).alias("foreign"), F.bool_or(F.col("timeframe") != timeframe).alias("other_frame"),
    ).join(twice, "symbol", "left")
    if requests is not None:
        facts = requests.select("symbol").distinct().join(facts, "symbol", "left")
    reject = first_of(
        (F.col("completed").isNull(), "bars_missing"), (F.coalesce("foreign", F.lit(False)), "bar_symbol_mismatch"), (F.col("other_frame"), "bar_timeframe_mismatch"),
        (F.col("adjustments") != 1, "mixed_bar_adjustment"), (F.coalesce("unsorted", F.lit(False)), "bars_not_sorted"), (F.col("twice").isNotNull(), "duplicate_bar"),
        (F.col("future"), "bar_from_future"), (F.col("completed_future"), "completed_bar_from_future"), (F.col("open_bars") > 1, "multiple_incomplete_bars"),
        ((F.col("open_bars") > 0) & F.col("last_complete"), "incomplete_bar_not_last"), ((F.col("open_bars") > 0) & F.lit(not allow_open), "incomplete_bar_not_allowed"), (F.col("completed") == 0, "completed_bars_missing"),
    )
    out_of_reach = F.array_compact(F.array(*[F.when(F.col("completed") < n, name) for name, n in REQUIRED.items()]))
    issues = F.array_compact(F.array(F.when(F.col("completed") < needed, "bar_window_insufficient"), F.when(F.size(out_of_reach) > 0, "technical_windows_unavailable")))
    status = F.when(reject.isNotNull(), "rejected").when(F.size(issues) > 0, "degraded").otherwise("usable")
    return facts.select(
        "symbol", status.alias("status"), F.when(reject.isNotNull(), reject).otherwise(F.array_join(issues, "|")).alias("issues"), F.when(reject.isNull(), F.array_join(out_of_reach, "|")).alias("unavailable"),
    )


def session_coverage(bars: DataFrame, sessions: list[str]) -> DataFrame:
    """Per symbol: how many of the required sessions have bars; bars has symbol and session."""
    counts = bars.groupBy("symbol").agg(*[F.count_if(F.col("session") == s).alias(s) for s in sessions], F.count_if(F.col("session") == "unknown").alias("unknown"))
    empty = sum(((F.col(s) == 0).cast("int") for s in sessions), F.lit(0))
    status = F.when(empty == len(sessions), "none_observed").when(empty > 0, "partially_observed").otherwise("all_observed")
    warnings = F.array_compact(F.array(F.when(empty > 0, "required_sessions_not_observed"), F.when(F.col("unknown") > 0, "unknown_trade_session_present")))
    return counts.select("symbol", status.alias("status"), *sessions, "unknown", F.array_join(warnings, "|").alias("warnings"))


def overall(results: DataFrame, keys: list[str]) -> DataFrame:
    """not_assessed, rejected, usable or degraded over the results (status, warnings) of each key."""
    s = F.col("status")
    status = F.when(F.count("status") == 0, "not_assessed").when(F.bool_and(s == "rejected"), "rejected").when(F.bool_and(s == "usable") & (F.sum(F.length(F.coalesce("warnings", F.lit("")))) == 0), "usable").otherwise("degraded")
    return results.groupBy(*keys).agg(status.alias("overall"))


def minute_quality(bars: DataFrame, requests: DataFrame, sessions: list[str]) -> DataFrame:
    """Per request (request_id, wanted, from_at, to_at, as_of) over its minute bars in input order: status and issues.

    bars has request_id, ordinal, symbol, start_at, end_at, is_complete, updated_at, adjustment, data_mode
    and session. The first fault of the first bar that has one rejects the request. A request's bars
    are sorted together; they are the minutes of one window.
    """
    order = Window.partitionBy("request_id").orderBy("ordinal")
    asked = bars.join(requests, "request_id").withColumns({"before": F.lag("start_at").over(order), "before_end": F.lag("end_at").over(order)})
    start, end = F.col("start_at"), F.col("end_at")
    fault = first_of(
        (F.upper(F.trim("symbol")) != F.upper(F.trim("wanted")), "intraday_symbol_mismatch"), (end != start + F.expr("INTERVAL 1 MINUTE"), "invalid_minute_interval"),
        (F.date_trunc("minute", start) != start.cast("timestamp"), "minute_not_aligned"), (~F.col("is_complete"), "incomplete_intraday_bar"),
        ((start < F.col("from_at")) | (end > F.col("to_at")), "intraday_outside_window"), (end > F.col("as_of"), "intraday_bar_from_future"), (F.col("updated_at") > F.col("as_of"), "intraday_update_after_as_of"),
        (start == F.col("before"), "duplicate_intraday_bar"), (start < F.col("before"), "intraday_not_sorted"), (start < F.col("before_end"), "overlapping_intraday_bars"),
    )
    marked = asked.withColumn("fault", fault)
    facts = marked.groupBy("request_id").agg(
        F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("ordinal"))).alias("fault"), F.count_distinct("adjustment").alias("adjustments"), F.count_distinct("data_mode").alias("modes"),
        *[F.count_if(F.col("session") == s).alias(f"in_{s}") for s in sessions], F.count_if(F.col("session") == "unknown").alias("unknown"), F.count_if(F.col("updated_at").isNull()).alias("untimed"),
    )
    rows = requests.select("request_id").join(facts, "request_id", "left").na.fill(0)
    empty = sum(((F.col(f"in_{s}") == 0).cast("int") for s in sessions), F.lit(0))
    reject = first_of((F.col("fault").isNotNull(), F.col("fault")), (F.col("adjustments") > 1, "mixed_intraday_adjustment"), (F.col("modes") > 1, "mixed_intraday_data_mode"))
    issues = F.array_compact(F.array(
        F.when(empty > 0, "required_sessions_not_observed"), F.when(F.col("unknown") > 0, "unknown_trade_session"), F.when(F.col("untimed") > 0, "intraday_update_time_unknown"),
    ))
    status = F.when(reject.isNotNull() | (empty == len(sessions)), "rejected").when(F.size(issues) > 0, "degraded").otherwise("usable")
    return rows.select("request_id", status.alias("status"), F.when(reject.isNotNull(), reject).otherwise(F.array_join(issues, "|")).alias("issues"))


def guarded_analysis(quotes: DataFrame, bars_quality: DataFrame, snapshots: DataFrame) -> DataFrame:
    """What may be shown of each symbol: its quote unless that is rejected, its technical snapshot unless its bars are, and both statuses.

    quotes: symbol, price, and status of quote_quality(). bars_quality: symbol and status of bar_quality(). snapshots: symbol and any
    values, of which every one is null where it is withheld. The reference price is the quote's where it may be shown, else the snapshot's
    price. A symbol without a quote has the status rejected for it.
    """
    values = [c for c in snapshots.columns if c != "symbol"]
    rows = bars_quality.select("symbol", F.col("status").alias("bars_status")).join(quotes.select("symbol", "price", F.col("status").alias("quote_status")), "symbol", "left").join(snapshots, "symbol", "left")
    rows = rows.withColumn("quote_status", F.coalesce("quote_status", F.lit("rejected")))
    shown, kept = F.col("quote_status") != "rejected", F.col("bars_status") != "rejected"
    return rows.select("symbol", "quote_status", "bars_status", F.when(shown, F.col("price")).alias("quote_price"), *[F.when(kept, F.col(v)).alias(v) for v in values])
