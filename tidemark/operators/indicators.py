"""Technical indicators over daily bars (symbol, day, open, high, low, close, volume).

All are windows by symbol in order of day; a value without enough bars is null. A symbol has one
bar a day, so a window partition is bounded by the trading days on record and the data grow by
symbols. Wilder's smoothing is not folded bar by bar: unrolled, it is a weighted sum with weights
(1 - 1/n)^age, which Spark aggregates in parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

PERIOD = 14


def by_day() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("day")


def last_n(aggregate: Column, n: int) -> Column:
    """aggregate over the last n bars, null where there are fewer."""
    frame = by_day().rowsBetween(-(n - 1), 0)
    return F.when(F.count("*").over(frame) == n, aggregate.over(frame))


def moving_average(n: int) -> Column:
    return last_n(F.avg("close"), n)


def slope(bars: DataFrame, n: int, lookback: int, name: str) -> DataFrame:
    """Adds the moving average's change over lookback bars, in percent."""
    before = F.lag(f"ma{n}", lookback).over(by_day())
    return bars.withColumn(name, (F.col(f"ma{n}") / F.nullif(before, F.lit(0.0)) - 1) * 100)


def bar_return(n: int) -> Column:
    return (F.col("close") / F.nullif(F.lag("close", n).over(by_day()), F.lit(0.0)) - 1) * 100


def true_range() -> Column:
    """Null for a symbol's first bar."""
    before = F.lag("close").over(by_day())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


def wilder(bars: DataFrame, values: dict[str, Column], n: int = PERIOD) -> DataFrame:
    """The latest Wilder average of each value by symbol; null with fewer than n values.

    A symbol's first bar has no value. The mean of the first n values is the seed.
    """
    place = F.row_number().over(by_day()) - 1
    kept = bars.select("symbol", place.alias("i"), F.count("*").over(Window.partitionBy("symbol")).alias("bars"), *[v.alias(k) for k, v in values.items()]).where("i > 0")
    newest = F.col("bars") - 1
    decay = F.lit((n - 1) / n)
    weight = F.when(F.col("i") <= n, F.pow(decay, newest - n) / n).otherwise(F.pow(decay, newest - F.col("i")) / n)
    return kept.groupBy("symbol").agg(*[F.when(F.count("*") >= n, F.sum(F.col(k) * weight)).alias(k) for k in values])


def atr(bars: DataFrame, n: int = PERIOD) -> DataFrame:
    return wilder(bars, {f"atr{n}": true_range()}, n)


def rsi(bars: DataFrame, n: int = PERIOD) -> DataFrame:
    """50 without any move, 100 without a loss, 0 without a gain."""
    move = F.col("close") - F.lag("close").over(by_day())
    means = wilder(bars, {"gain": F.greatest(move, F.lit(0.0)), "loss": F.greatest(-move, F.lit(0.0))}, n)
    value = (
        F.when((F.col("gain") == 0) & (F.col("loss") == 0), 50.0)
        .when(F.col("loss") == 0, 100.0)
        .when(F.col("gain") == 0, 0.0)
        .otherwise(100 - 100 / (1 + F.col("gain") / F.nullif(F.col("loss"), F.lit(0.0))))
    )
    return means.select("symbol", F.when(F.col("gain").isNotNull(), value).alias(f"rsi{n}"))


def volume_features(bars: DataFrame) -> DataFrame:
    """Per bar: the mean volume of the 20 bars before it, of its last 5, and the two ratios."""
    before = by_day().rowsBetween(-20, -1)
    out = bars.withColumn("base20", F.when(F.count("*").over(before) == 20, F.avg("volume").over(before))).withColumn("avg5", last_n(F.avg("volume"), 5))
    base = F.nullif(F.col("base20"), F.lit(0.0))
    return out.withColumn("rvol", F.col("volume") / base).withColumn("trend", F.col("avg5") / base)


def split_current(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Completed bars, and each symbol's newest bar, which is still open."""
    newest = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("day"))) == 1
    marked = bars.withColumn("_newest", newest)
    return marked.where(~F.col("_newest")).drop("_newest"), marked.where("_newest").drop("_newest")


def current_bar_structure(completed: DataFrame, current: DataFrame) -> DataFrame:
    """The open bar: change from the last close, range over its open and position in it in percent, pullback and rebound."""
    last = completed.groupBy("symbol").agg(F.max_by("close", "day").alias("previous_close"))
    high, low = F.greatest("high", "close"), F.least("low", "close")
    price, width = F.col("close"), F.nullif(high - low, F.lit(0.0))
    before = F.nullif(F.col("previous_close"), F.lit(0.0))
    return current.join(last, "symbol", "left").select(
        "symbol", price.alias("price"), "previous_close",
        ((price / before - 1) * 100).alias("change_pct"), ((high - low) / F.nullif(F.col("open"), F.lit(0.0)) * 100).alias("range_pct"),
        ((price - low) / width * 100).alias("position_pct"), ((high - price) / F.nullif(high, F.lit(0.0)) * 100).alias("pullback_pct"), ((price - low) / F.nullif(low, F.lit(0.0)) * 100).alias("rebound_pct"),
    )


def reference_price(quotes: DataFrame, current: DataFrame, completed: DataFrame) -> DataFrame:
    """symbol, price and price_source: the quote, else the open bar, else the last completed close."""
    closes = completed.groupBy("symbol").agg(F.max_by("close", "day").alias("c"))
    found = (
        closes.join(current.select("symbol", F.col("close").alias("b")), "symbol", "full")
        .join(quotes.select("symbol", F.col("price").alias("q")), "symbol", "full")
    )
    source = F.when(F.col("q").isNotNull(), "quote").when(F.col("b").isNotNull(), "incomplete_bar").when(F.col("c").isNotNull(), "completed_close")
    return found.select("symbol", F.coalesce("q", "b", "c").alias("price"), source.alias("price_source"))


def snapshot(bars: DataFrame) -> DataFrame:
    """A row per symbol with every indicator of its newest bar."""
    out = bars
    for n in (5, 20, 50, 200):
        out = out.withColumn(f"ma{n}", moving_average(n))
    out = slope(slope(out, 20, 5, "slope20"), 50, 5, "slope50")
    out = out.withColumn("return5", bar_return(5)).withColumn("return20", bar_return(20))
    out = out.withColumn("high20", last_n(F.max("high"), 20)).withColumn("low20", last_n(F.min("low"), 20))
    out = volume_features(out).withColumn("_newest", F.lead("day").over(by_day()).isNull()).where("_newest").drop("_newest")
    return out.join(atr(bars), "symbol", "left").join(rsi(bars), "symbol", "left")
