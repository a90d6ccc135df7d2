"""Price structure over daily bars: pivots, levels, gaps, swings and retracements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.indicators import by_day

TOLERANCE = 0.25
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)


def pivots(bars: DataFrame, width: int = 2) -> DataFrame:
    """symbol, day, kind, price and confirmed_day; of equal highs near each other the last one counts."""
    left, right = by_day().rowsBetween(-width, -1), by_day().rowsBetween(1, width)
    whole = (F.count("*").over(left) == width) & (F.count("*").over(right) == width)
    high = whole & (F.col("high") >= F.max("high").over(left)) & (F.col("high") > F.max("high").over(right))
    low = whole & (F.col("low") <= F.min("low").over(left)) & (F.col("low") < F.min("low").over(right))
    marked = bars.select("symbol", "day", "high", "low", high.alias("is_high"), low.alias("is_low"), F.lead("day", width).over(by_day()).alias("confirmed_day"))
    kinds = F.array_compact(F.array(
        F.when(F.col("is_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))),
        F.when(F.col("is_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))),
    ))
    return marked.select("symbol", "day", "confirmed_day", F.inline(kinds))


def previous_swings(points: DataFrame) -> DataFrame:
    """Per symbol and kind the newest pivot."""
    return points.groupBy("symbol", "kind").agg(F.max("day").alias("day"), F.max_by("price", "day").alias("price"))


def level_clusters(points: DataFrame, tolerance: DataFrame) -> DataFrame:
    """Greedy price levels: a pivot, in order of price, joins the open level while it is within tolerance of its running mean.

    A step above the tolerance between neighbouring prices always starts a level, as the mean is no
    higher than the last price. So prices are first cut into independent runs at such steps by a
    window, and only a run is folded; tolerance has symbol and tolerance.
    """
    by_price = Window.partitionBy("symbol").orderBy("price", "day", "kind")
    near = points.join(tolerance.where("tolerance IS NOT NULL"), "symbol")
    starts = F.coalesce((F.col("price") - F.lag("price").over(by_price) > F.col("tolerance")).cast("int"), F.lit(0))
    runs = near.withColumn("_start", starts).withColumn("run", F.sum("_start").over(by_price.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    grouped = runs.groupBy("symbol", "run", "tolerance").agg(F.sort_array(F.collect_list(F.struct("price", "day", "kind"))).alias("points"))
    level = "struct<total:double,touches:bigint,low:double,high:double,first:date,last:date>"

    def one(p: Column) -> Column:
        return F.struct(p["price"], F.lit(1).cast("bigint"), p["price"], p["price"], p["day"], p["day"]).cast(level)

    def grow(levels: Column, p: Column) -> Column:
        last = F.element_at(levels, -1)
        more = F.struct(
            last["total"] + p["price"], last["touches"] + 1, F.least(last["low"], p["price"]), F.greatest(last["high"], p["price"]),
            F.least(last["first"], p["day"]), F.greatest(last["last"], p["day"]),
        ).cast(level)
        fits = F.abs(p["price"] - last["total"] / last["touches"]) <= F.col("tolerance")
        return F.when(fits, F.concat(F.slice(levels, 1, F.size(levels) - 1), F.array(more))).otherwise(F.concat(levels, F.array(one(p))))

    folded = F.aggregate(F.slice("points", 2, F.size("points")), F.array(one(F.element_at("points", 1))), grow)
    return grouped.select("symbol", F.inline(folded)).select(
        "symbol", (F.col("total") / F.col("touches")).alias("price"), F.col("low").alias("lower_bound"), F.col("high").alias("upper_bound"),
        "touches", F.col("first").alias("first_touch"), F.col("last").alias("last_touch"),
    )


def level_candidates(levels: DataFrame, now: DataFrame, touches: int = 2, limit: int = 3) -> DataFrame:
    """The nearest supports and resistances, limit of each, and the zone that holds the price; now has symbol, price and atr."""
    placed = levels.where(F.col("touches") >= touches).join(now.select("symbol", F.col("price").alias("now"), "atr"), "symbol")
    role = F.when(F.col("upper_bound") < F.col("now"), "support").when(F.col("lower_bound") > F.col("now"), "resistance").otherwise("zone")
    distance = F.abs(F.col("price") - F.col("now"))
    placed = placed.select("symbol", role.alias("role"), "price", "lower_bound", "upper_bound", "touches", distance.alias("distance"), (distance / F.nullif(F.col("atr"), F.lit(0.0))).alias("atr_distance"))
    near = F.when(F.col("role") == "support", -F.col("upper_bound")).when(F.col("role") == "resistance", F.col("lower_bound")).otherwise(F.col("distance"))
    rank = F.row_number().over(Window.partitionBy("symbol", "role").orderBy(near, "price"))
    return placed.withColumn("rank", rank).where(F.col("rank") <= F.when(F.col("role") == "zone", 1).otherwise(limit))


def gaps(bars: DataFrame) -> DataFrame:
    """Full gaps between neighbouring bars: direction, bounds, status (open, partial, filled) and filled_day.

    Status comes from frames over the later bars. The day a gap was filled is found in two steps, the
    first month whose extreme reaches the far bound, then the first day in it, so that a gap meets
    months and the days of one month, not all later days.
    """
    before_high, before_low = F.lag("high").over(by_day()), F.lag("low").over(by_day())
    later = by_day().rowsBetween(1, Window.unboundedFollowing)
    up, down = F.col("low") > before_high, F.col("high") < before_low
    found = bars.select(
        "symbol", "day", F.when(up, "up").when(down, "down").alias("direction"),
        F.when(up, before_high).when(down, F.col("high")).alias("lower_bound"), F.when(up, F.col("low")).when(down, before_low).alias("upper_bound"),
        F.min("low").over(later).alias("_low"), F.max("high").over(later).alias("_high"),
    ).where("direction IS NOT NULL")
    filled = F.when(F.col("direction") == "up", F.col("_low") <= F.col("lower_bound")).otherwise(F.col("_high") >= F.col("upper_bound"))
    touched = F.when(F.col("direction") == "up", F.col("_low") <= F.col("upper_bound")).otherwise(F.col("_high") >= F.col("lower_bound"))
    found = found.withColumn("status", F.when(filled, "filled").when(touched, "partial").otherwise("open")).drop("_low", "_high")

    def reached(low: str, high: str) -> Column:
        return ((F.col("direction") == "up") & (F.col(low) <= F.col("lower_bound"))) | ((F.col("direction") == "down") & (F.col(high) >= F.col("upper_bound")))

    days = bars.select("symbol", F.trunc("day", "MM").alias("month"), F.col("day").alias("d"), F.col("low").alias("d_low"), F.col("high").alias("d_high"))
    months = days.groupBy("symbol", "month").agg(F.min("d_low").alias("m_low"), F.max("d_high").alias("m_high"))
    open_ = found.where("status = 'filled'")
    # The gap's own month counts from the day after it, later months whole.
    same = open_.withColumn("month", F.trunc("day", "MM")).join(days, ["symbol", "month"]).where((F.col("d") > F.col("day")) & reached("d_low", "d_high"))
    same = same.groupBy("symbol", "day").agg(F.min("d").alias("filled_day"))
    rest = open_.join(same, ["symbol", "day"], "left_anti")
    first = rest.join(months, "symbol").where((F.col("month") > F.col("day")) & reached("m_low", "m_high")).groupBy("symbol", "day", "direction", "lower_bound", "upper_bound").agg(F.min("month").alias("month"))
    after = first.join(days, ["symbol", "month"]).where(reached("d_low", "d_high")).groupBy("symbol", "day").agg(F.min("d").alias("filled_day"))
    return found.join(same.unionByName(after), ["symbol", "day"], "left")


def latest_swing(points: DataFrame) -> DataFrame:
    """From the last pivot of the other kind to the newest pivot; of a bar's two pivots the high is the newer."""
    newest = points.groupBy("symbol").agg(F.max_by(F.struct("day", "kind", "price"), F.struct("day", F.col("kind") == "high")).alias("n"))
    both = points.join(newest, "symbol").where((F.col("kind") != F.col("n.kind")) & (F.col("day") < F.col("n.day")))
    before = both.groupBy("symbol", "n").agg(F.max_by(F.struct("day", "price"), "day").alias("b"))
    return before.select(
        "symbol", F.when(F.col("n.kind") == "high", "up").otherwise("down").alias("direction"),
        F.col("b.price").alias("start_price"), F.col("n.price").alias("end_price"), F.col("b.day").alias("start_day"), F.col("n.day").alias("end_day"),
    )


def meaningful(swings: DataFrame, atr: DataFrame, multiple: float = 1.0) -> DataFrame:
    """Swings of at least multiple ATR; atr has symbol and atr."""
    return swings.join(atr, "symbol").where(F.abs(F.col("end_price") - F.col("start_price")) >= multiple * F.col("atr")).drop("atr")


def fibonacci(swings: DataFrame) -> DataFrame:
    ratio = F.explode(F.array(*map(F.lit, RATIOS)))
    wide = swings.withColumn("ratio", ratio)
    return wide.withColumn("price", F.col("end_price") - F.col("ratio") * (F.col("end_price") - F.col("start_price")))
