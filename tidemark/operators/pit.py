"""What was visible at a time: quotes, daily and minute bars, filings, and the checks of a request's times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quality import first_of

#: How many of a company's newest earnings forms are looked at, and what marks one.
SCANNED = 100
FORM, ITEM, PHRASE = "8-K", "item 2.02", "results of operations and financial condition"
#: Fixed value: most bars that a vendor returns at once.
PAGE = 1000


def ticker(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def quotes_as_of(quotes: DataFrame, as_of: Column) -> DataFrame:
    """Per symbol the newest quote (quoted_at, ties by quote_id) of those received by as_of."""
    seen = quotes.where(F.col("received_at") <= as_of).withColumn("symbol", ticker(F.col("symbol")))
    rest = [c for c in seen.columns if c != "symbol"]
    return seen.groupBy("symbol").agg(F.max_by(F.struct(*rest), F.struct("quoted_at", "quote_id")).alias("_q")).select("symbol", "_q.*")


def bars_as_of(bars: DataFrame, as_of: Column, limit: int, include_incomplete: bool = False, adjustment: str | None = None) -> DataFrame:
    """The last limit bars of each symbol that were known at as_of, completed ones unless include_incomplete."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    seen = bars.where(F.col("updated_at") <= as_of)
    if not include_incomplete:
        seen = seen.where("is_complete")
    if adjustment is not None:
        seen = seen.where(F.col("adjustment") == adjustment)
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("start_at")))
    return seen.withColumn("_n", newest).where(F.col("_n") <= limit).drop("_n")


def vendor_bars(bars: DataFrame, as_of: Column, limit: int, include_incomplete: bool = False) -> DataFrame:
    """What a vendor's page of limit + 1 newest adjusted bars leaves of each symbol: those begun by as_of, the last limit of them."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("start_at"))
    page = bars.where("adjustment = 'forward_adjusted'").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= min(limit + 1, PAGE))
    begun = page.where(F.col("start_at") <= as_of)
    if not include_incomplete:
        begun = begun.where("is_complete")
    return begun.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= limit).drop("_n")


def request_fault(start_at: Column, end_at: Column, as_of: Column) -> Column:
    """Why a range of minutes can't be asked for, or null."""
    return first_of((start_at.isNull() | end_at.isNull() | as_of.isNull(), "time_missing"), (start_at >= end_at, "start_not_before_end"), (end_at > as_of, "end_after_as_of"))


def minutes_in(bars: DataFrame, requests: DataFrame) -> DataFrame:
    """Complete minute bars inside each request (request_id, symbol, start_at, end_at, as_of) and known by its as_of.

    Requests meet bars by symbol and hour, so that a long history isn't compared with every request.
    """
    ask = requests.where(request_fault(F.col("start_at"), F.col("end_at"), F.col("as_of")).isNull())
    hours = F.sequence(F.date_trunc("hour", "start_at"), F.date_trunc("hour", "end_at"), F.expr("INTERVAL 1 HOUR"))
    ask = ask.select("request_id", ticker(F.col("symbol")).alias("_s"), F.col("start_at").alias("_a"), F.col("end_at").alias("_b"), F.col("as_of").alias("_now"), F.explode(hours).alias("_h"))
    rows = bars.withColumn("_s", ticker(F.col("symbol"))).withColumn("_h", F.date_trunc("hour", "start_at"))
    inside = (F.col("start_at") >= F.col("_a")) & (F.col("end_at") <= F.col("_b")) & F.col("is_complete") & (F.col("end_at") <= F.col("_now")) & (F.col("updated_at") <= F.col("_now"))
    return rows.join(ask, ["_s", "_h"]).where(inside).select("request_id", *bars.columns)


def is_earnings(form: Column, content: Column) -> Column:
    """Whether a filing reports earnings: by its form, and an item or a phrase of its primary text, in any case."""
    text = F.lower(content)
    return F.coalesce((form == FORM) & (text.contains(ITEM) | text.contains(PHRASE)), F.lit(False))


def earnings_releases(filings: DataFrame, as_of: Column, limit: int, before: Column | None = None) -> DataFrame:
    """Per company the limit newest earnings filings of its SCANNED newest forms accepted by as_of, strictly before a time if one is given."""
    order = Window.partitionBy("company").orderBy(F.desc("accepted_at"), F.desc("filing_id"))
    scanned = filings.where((F.col("form") == FORM) & (F.col("accepted_at") <= as_of)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= SCANNED)
    found = scanned.where(is_earnings(F.col("form"), F.col("content")))
    if before is not None:
        found = found.where(F.col("accepted_at") < before)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("_n")
