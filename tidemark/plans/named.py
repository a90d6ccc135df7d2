"""Steps that larger queries are made of, as queries of their own: each takes its rows from the operator's result and its SQL from the whole query's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import indicators, structure
from tidemark.plans import market
from tidemark.plans.registry import ORACLES, QUERIES, query
from tidemark.sources import views
from tidemark.sources.views import sql


def _of(name: str, columns: str, rest: str = "") -> str:
    return f"SELECT {columns} FROM ({ORACLES[name]}) {rest}"


@query(_of("c27_decision", "symbol, view, decision_reasons"))
def c24_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that trend, momentum and level come to, and why."""
    return QUERIES["c27_decision"](spark, sf_dir).select("symbol", "view", "decision_reasons")


@query(_of("c27_decision", "symbol, opposing"))
def c25_opposing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["c27_decision"](spark, sf_dir).select("symbol", "opposing")


@query(_of("c27_decision", "symbol, invalidation"))
def c26_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["c27_decision"](spark, sf_dir).select("symbol", "invalidation")


@query(_of("c27_decision", "symbol, status = 'blocked' AS blocked, CASE WHEN status = 'blocked' THEN missing END AS why, view IS NULL AND opposing = '' AND invalidation = '' AS empty"))
def c45_blocked_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which decisions are blocked and what they lack; a blocked one has no view and nothing for or against it."""
    rows, blocked = QUERIES["c27_decision"](spark, sf_dir), F.col("status") == "blocked"
    return rows.select("symbol", blocked.alias("blocked"), F.when(blocked, F.col("missing")).alias("why"), (F.col("view").isNull() & (F.col("opposing") == "") & (F.col("invalidation") == "")).alias("empty"))


@query(_of("w11_level_candidates", "symbol, role, rank, price, distance", "WHERE role <> 'zone'"))
def k08_nearest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest supports and resistances."""
    return QUERIES["w11_level_candidates"](spark, sf_dir).where("role != 'zone'").select("symbol", "role", "rank", "price", "distance")


@query(_of("w10_level_clusters", "symbol, count(*)::BIGINT AS levels, sum(touches)::BIGINT AS touches, max(touches)::BIGINT AS most, min(lower_bound) AS low, max(upper_bound) AS high, min(first_touch) AS since", "GROUP BY symbol"))
def a12_level_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a symbol's clusters of pivots hold together."""
    rows = QUERIES["w10_level_clusters"](spark, sf_dir).groupBy("symbol")
    return rows.agg(F.count("*").alias("levels"), F.sum("touches").alias("touches"), F.max("touches").alias("most"), F.min("lower_bound").alias("low"), F.max("upper_bound").alias("high"), F.min("first_touch").alias("since"))


@query(_of("a05_curve_snapshot", "day, change_3m, change_2y, change_10y, change_30y, spread_10y_2y, spread_10y_3m"))
def a06_curve_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["a05_curve_snapshot"](spark, sf_dir).select("day", *[f"change_{t}" for t in ("3m", "2y", "10y", "30y")], "spread_10y_2y", "spread_10y_3m")


@query(_of("c11_vendor_releases", "*", "WHERE release_type = 'weekly_claims'"))
def c12_labour_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly releases, whose indicators must be of the weeks that belong together (A10)."""
    return QUERIES["c11_vendor_releases"](spark, sf_dir).where("release_type = 'weekly_claims'")


@query(_of("c11_vendor_releases", "release_date, built", "WHERE release_type = 'weekly_claims'"))
def a10_weekly_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the weeks of a release's indicators agree, so that it is built."""
    return QUERIES["c11_vendor_releases"](spark, sf_dir).where("release_type = 'weekly_claims'").select("release_date", "built")


@query(_of("w25_window_returns", "event_id, symbol, count(*)::BIGINT AS windows, count(*) FILTER (status = 'usable')::BIGINT AS usable", "GROUP BY event_id, symbol"))
def j10_event_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with each symbol, its windows and how many of them have a return."""
    return QUERIES["w25_window_returns"](spark, sf_dir).groupBy("event_id", "symbol").agg(F.count("*").alias("windows"), F.count_if(F.col("status") == "usable").alias("usable"))


@query(_of("w27_relative", "\"window\", status, count(*)::BIGINT AS events, count(difference_pp)::BIGINT AS compared", "GROUP BY ALL"))
def j11_pairs_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two symbols' reactions by window and the worse of their states."""
    return QUERIES["w27_relative"](spark, sf_dir).groupBy("window", "status").agg(F.count("*").alias("events"), F.count("difference_pp").alias("compared"))


@query(_of("w24_alignment", "event_id, symbol, status = 'ready' AS ready, len(string_split(issues, '|')) - CASE WHEN issues = '' THEN 1 ELSE 0 END AS n_issues"))
def c42_alignment_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event's bars are ready, and how many issues stand against it."""
    found = F.when(F.col("issues") == "", 0).otherwise(F.size(F.split("issues", r"\|")))
    return QUERIES["w24_alignment"](spark, sf_dir).select("event_id", "symbol", (F.col("status") == "ready").alias("ready"), found.cast("bigint").alias("n_issues"))


@query(_of("c17_minute_quality", "request_id, issues", "WHERE issues IN ('duplicate_intraday_bar', 'intraday_not_sorted', 'overlapping_intraday_bars')"))
def w21_order_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests whose bars repeat, go back, or overlap."""
    return QUERIES["c17_minute_quality"](spark, sf_dir).where(F.col("issues").isin("duplicate_intraday_bar", "intraday_not_sorted", "overlapping_intraday_bars")).select("request_id", "issues")


@query(_of("s18_scaled_values", "status, count(*)::BIGINT AS n, sum(value) AS total", "GROUP BY status"))
def x06_scaled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled values by what became of their text; sums are of halves and quarters, and so exact."""
    return QUERIES["s18_scaled_values"](spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(_of("s19_calendar_scan", "indicator, measure, count(*)::BIGINT AS n, count(value)::BIGINT AS known, max(value) AS most", "GROUP BY ALL"))
def x26_forecast_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts as numbers, by the unit that their indicator is read in."""
    return QUERIES["s19_calendar_scan"](spark, sf_dir).groupBy("indicator", "measure").agg(F.count("*").alias("n"), F.count("value").alias("known"), F.max("value").alias("most"))


@query(_of("s24_concept_entries", "company, count(*)::BIGINT AS entries, max(filed_date) AS newest", "GROUP BY company"))
def s23_company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that a company's document has at one concept and unit."""
    return QUERIES["s24_concept_entries"](spark, sf_dir).groupBy("company").agg(F.count("*").alias("entries"), F.max("filed_date").alias("newest"))


@query(_of("s20_recent_filings", "company, count(*)::BIGINT AS filings, max(accession) AS last", "GROUP BY company"))
def k06_filing_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many filings a company has up to the limit."""
    return QUERIES["s20_recent_filings"](spark, sf_dir).groupBy("company").agg(F.count("*").alias("filings"), F.max("accession").alias("last"))


@query(_of("a17_component_quality", "*"))
def j22_quality_of_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of contexts joined with the quality results of their purposes."""
    return QUERIES["a17_component_quality"](spark, sf_dir)


@query(_of("c41_citations", "verdict, count(*)::BIGINT AS runs", "GROUP BY verdict"))
def j23_claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs by what the join of their claims with their evidence says."""
    return QUERIES["c41_citations"](spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("runs"))


@query(sql("bars", f"{market._ATR} SELECT symbol, round(atr14 * {structure.TOLERANCE}, 6) AS tolerance FROM osc"))
def x20_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far apart prices of one level may be."""
    return indicators.atr(views.bars(spark, sf_dir)).select("symbol", F.round(F.col("atr14") * structure.TOLERANCE, 6).alias("tolerance"))


@query(sql("bars", f"{market._ATR}, {market._SWING} SELECT symbol, direction, abs(end_price - start_price) >= atr14 AS significant FROM sw JOIN osc USING (symbol)"))
def w15_swing_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the latest swing is of one average true range at least."""
    bars = views.bars(spark, sf_dir)
    swings = structure.latest_swing(structure.pivots(bars))
    kept = structure.meaningful(swings, indicators.atr(bars).withColumnRenamed("atr14", "atr")).select("symbol", F.lit(True).alias("significant"))
    return swings.join(kept, "symbol", "left").select("symbol", "direction", F.coalesce("significant", F.lit(False)).alias("significant"))
