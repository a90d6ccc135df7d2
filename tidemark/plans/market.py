"""Queries over daily bars: indicators, structure and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import decision, indicators, structure
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import sql

def text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def _ma(n: int) -> str:
    return f"CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY day ROWS {n - 1} PRECEDING) = {n} THEN avg(close) OVER (PARTITION BY symbol ORDER BY day ROWS {n - 1} PRECEDING) END AS ma{n}"


_MAS = ", ".join(_ma(n) for n in (5, 20, 50, 200))


@query(sql("bars", f"m AS (SELECT symbol, day, {_MAS} FROM bars) SELECT symbol, day::VARCHAR AS day, round(ma5, 6) AS ma5, round(ma20, 6) AS ma20, round(ma50, 6) AS ma50, round(ma200, 6) AS ma200 FROM m"))
def w01_sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars(spark, sf_dir)
    return bars.select("symbol", text("day"), *[F.round(indicators.moving_average(n), 6).alias(f"ma{n}") for n in (5, 20, 50, 200)])


@query(sql("bars", f"""m AS (SELECT symbol, day, {_MAS} FROM bars),
s AS (SELECT symbol, day, (ma20 / lag(ma20, 5) OVER w - 1) * 100 AS slope20, (ma50 / lag(ma50, 5) OVER w - 1) * 100 AS slope50 FROM m WINDOW w AS (PARTITION BY symbol ORDER BY day))
SELECT symbol, day::VARCHAR AS day, round(slope20, 6) AS slope20, round(slope50, 6) AS slope50 FROM s"""))
def w02_ma_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars(spark, sf_dir).withColumn("ma20", indicators.moving_average(20)).withColumn("ma50", indicators.moving_average(50))
    return indicators.slope(indicators.slope(bars, 20, 5, "slope20"), 50, 5, "slope50").select("symbol", text("day"), r6("slope20"), r6("slope50"))


@query(sql("bars", """SELECT symbol, day::VARCHAR AS day, round((close / lag(close, 1) OVER w - 1) * 100, 6) AS return1, round((close / lag(close, 5) OVER w - 1) * 100, 6) AS return5,
round((close / lag(close, 20) OVER w - 1) * 100, 6) AS return20 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)"""))
def w03_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars(spark, sf_dir).select("symbol", text("day"), *[F.round(indicators.bar_return(n), 6).alias(f"return{n}") for n in (1, 5, 20)])


_TR = """t AS (SELECT symbol, day, row_number() OVER w - 1 AS i, close - lag(close) OVER w AS move,
  CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day))"""
_ATR = f"""{_TR},
seed AS (SELECT symbol, avg(tr) AS v, avg(greatest(move, 0)) AS g, avg(greatest(-move, 0)) AS l FROM t WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14),
fold AS (SELECT symbol, 14 AS i, v, g, l FROM seed UNION ALL
  SELECT f.symbol, f.i + 1, (f.v * 13 + t.tr) / 14, (f.g * 13 + greatest(t.move, 0)) / 14, (f.l * 13 + greatest(-t.move, 0)) / 14
  FROM fold f JOIN t ON t.symbol = f.symbol AND t.i = f.i + 1),
wil AS (SELECT symbol, arg_max(v, i) AS atr14, arg_max(g, i) AS g, arg_max(l, i) AS l FROM fold GROUP BY symbol),
osc AS (SELECT symbol, atr14, CASE WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 WHEN g = 0 THEN 0.0 ELSE 100 - 100 / (1 + g / l) END AS rsi14 FROM wil)"""
_ALL = "sy AS (SELECT DISTINCT symbol FROM bars)"


@query(sql("bars", f"{_TR} SELECT symbol, day::VARCHAR AS day, round(tr, 6) AS true_range FROM t"))
def w04_true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars(spark, sf_dir).select("symbol", text("day"), F.round(indicators.true_range(), 6).alias("true_range"))


@query(sql("bars", f"{_ATR} SELECT symbol, round(atr14, 6) AS atr14 FROM osc"))
def w05_wilder_atr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.atr(views.bars(spark, sf_dir)).where("atr14 IS NOT NULL").select("symbol", r6("atr14"))


@query(sql("bars", f"{_ATR} SELECT symbol, round(rsi14, 6) AS rsi14 FROM osc"))
def w06_wilder_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.rsi(views.bars(spark, sf_dir)).where("rsi14 IS NOT NULL").select("symbol", r6("rsi14"))


_HILO = """CASE WHEN count(*) OVER w20 = 20 THEN max(high) OVER w20 END AS high20, CASE WHEN count(*) OVER w20 = 20 THEN min(low) OVER w20 END AS low20"""
_W20 = "WINDOW w AS (PARTITION BY symbol ORDER BY day), w20 AS (PARTITION BY symbol ORDER BY day ROWS 19 PRECEDING)"


@query(sql("bars", f"SELECT symbol, day::VARCHAR AS day, {_HILO} FROM bars {_W20}"))
def w07_recent_high_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.bars(spark, sf_dir).select("symbol", text("day"), indicators.last_n(F.max("high"), 20).alias("high20"), indicators.last_n(F.min("low"), 20).alias("low20"))


_PIVOTS = """e AS (SELECT symbol, day, high, low, lead(day, 2) OVER w AS confirmed_day, count(*) OVER l AS nl, count(*) OVER r AS nr,
  max(high) OVER l AS hl, max(high) OVER r AS hr, min(low) OVER l AS ll, min(low) OVER r AS lr FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY day), l AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), r AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)),
p AS (SELECT symbol, day, confirmed_day, 'high' AS kind, high AS price FROM e WHERE nl = 2 AND nr = 2 AND high >= hl AND high > hr
  UNION ALL SELECT symbol, day, confirmed_day, 'low', low FROM e WHERE nl = 2 AND nr = 2 AND low <= ll AND low < lr)"""


@query(sql("bars", f"{_PIVOTS} SELECT symbol, day::VARCHAR AS day, confirmed_day::VARCHAR AS confirmed_day, kind, price FROM p"))
def w08_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.pivots(views.bars(spark, sf_dir)).select("symbol", text("day"), text("confirmed_day"), "kind", "price")


@query(sql("bars", f"{_PIVOTS} SELECT symbol, kind, max(day)::VARCHAR AS day, arg_max(price, day) AS price FROM p GROUP BY symbol, kind"))
def w09_prev_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.previous_swings(structure.pivots(views.bars(spark, sf_dir))).select("symbol", "kind", text("day"), "price")


_LEVELS = f"""{_ATR}, {_PIVOTS},
q AS (SELECT p.*, atr14 * {structure.TOLERANCE} AS tol, row_number() OVER (PARTITION BY symbol ORDER BY price, day, kind) AS k FROM p JOIN osc USING (symbol)),
g AS (SELECT symbol, k, 1 AS c, price AS total, 1::BIGINT AS n FROM q WHERE k = 1 UNION ALL
  SELECT q.symbol, q.k, CASE WHEN abs(q.price - g.total / g.n) <= q.tol THEN g.c ELSE g.c + 1 END,
    CASE WHEN abs(q.price - g.total / g.n) <= q.tol THEN g.total + q.price ELSE q.price END, CASE WHEN abs(q.price - g.total / g.n) <= q.tol THEN g.n + 1 ELSE 1 END
  FROM g JOIN q ON q.symbol = g.symbol AND q.k = g.k + 1),
lv AS (SELECT symbol, c, arg_max(total / n, k) AS price, min(q.price) AS lower_bound, max(q.price) AS upper_bound, count(*)::BIGINT AS touches, min(q.day) AS first_touch, max(q.day) AS last_touch
  FROM g JOIN q USING (symbol, k) GROUP BY symbol, c)"""


def _levels(bars: DataFrame) -> DataFrame:
    tolerance = indicators.atr(bars).select("symbol", (F.col("atr14") * structure.TOLERANCE).alias("tolerance"))
    return structure.level_clusters(structure.pivots(bars), tolerance)


@query(sql("bars", f"{_LEVELS} SELECT symbol, round(price, 6) AS price, lower_bound, upper_bound, touches, first_touch::VARCHAR AS first_touch, last_touch::VARCHAR AS last_touch FROM lv"))
def w10_level_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = _levels(views.bars(spark, sf_dir))
    return levels.select("symbol", r6("price"), "lower_bound", "upper_bound", "touches", text("first_touch"), text("last_touch"))


_CANDIDATES = f"""{_LEVELS},
nw AS (SELECT symbol, arg_max(close, day) AS now FROM bars GROUP BY symbol),
pl AS (SELECT lv.*, now, abs(price - now) AS distance, abs(price - now) / atr14 AS atr_distance, CASE WHEN upper_bound < now THEN 'support' WHEN lower_bound > now THEN 'resistance' ELSE 'zone' END AS role
  FROM lv JOIN nw USING (symbol) JOIN osc USING (symbol) WHERE touches >= 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY symbol, role ORDER BY CASE role WHEN 'support' THEN -upper_bound WHEN 'resistance' THEN lower_bound ELSE distance END, price) AS rank FROM pl)"""


@query(sql("bars", f"{_CANDIDATES} SELECT symbol, role, rank::INT AS rank, round(price, 6) AS price, lower_bound, upper_bound, touches, round(distance, 6) AS distance, round(atr_distance, 6) AS atr_distance FROM rk WHERE rank <= CASE role WHEN 'zone' THEN 1 ELSE 3 END"))
def w11_level_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars(spark, sf_dir)
    now = bars.groupBy("symbol").agg(F.max_by("close", "day").alias("price")).join(indicators.atr(bars).withColumnRenamed("atr14", "atr"), "symbol")
    found = structure.level_candidates(_levels(bars), now)
    return found.select("symbol", "role", "rank", r6("price"), "lower_bound", "upper_bound", "touches", r6("distance"), r6("atr_distance"))


_GAPS = """b AS (SELECT symbol, day, high, low, lag(high) OVER w AS ph, lag(low) OVER w AS pl FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
g AS (SELECT symbol, day, CASE WHEN low > ph THEN 'up' ELSE 'down' END AS direction, CASE WHEN low > ph THEN ph ELSE high END AS lower_bound, CASE WHEN low > ph THEN low ELSE pl END AS upper_bound
  FROM b WHERE low > ph OR high < pl),
x AS (SELECT g.*, min(CASE WHEN (direction = 'up' AND c.low <= lower_bound) OR (direction = 'down' AND c.high >= upper_bound) THEN c.day END) AS filled_day,
  count(CASE WHEN (direction = 'up' AND c.low <= upper_bound) OR (direction = 'down' AND c.high >= lower_bound) THEN 1 END) AS touched
  FROM g LEFT JOIN bars c ON c.symbol = g.symbol AND c.day > g.day GROUP BY ALL)"""


@query(sql("bars", f"{_GAPS} SELECT symbol, day::VARCHAR AS day, direction, lower_bound, upper_bound, CASE WHEN filled_day IS NOT NULL THEN 'filled' WHEN touched > 0 THEN 'partial' ELSE 'open' END AS status, filled_day::VARCHAR AS filled_day FROM x"))
def w12_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.gaps(views.bars(spark, sf_dir))
    return found.select("symbol", text("day"), "direction", "lower_bound", "upper_bound", "status", text("filled_day"))


@query(sql("bars", f"{_GAPS} SELECT symbol, day::VARCHAR AS day, direction, lower_bound, upper_bound FROM x WHERE filled_day IS NULL"))
def w13_active_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.gaps(views.bars(spark, sf_dir)).where("status != 'filled'").select("symbol", text("day"), "direction", "lower_bound", "upper_bound")


_SWING = f"""{_PIVOTS},
nw AS (SELECT symbol, arg_max(kind, (day, kind = 'high')) AS kind, arg_max(price, (day, kind = 'high')) AS end_price, max(day) AS end_day FROM p GROUP BY symbol),
sw AS (SELECT n.symbol, CASE n.kind WHEN 'high' THEN 'up' ELSE 'down' END AS direction, arg_max(p.price, p.day) AS start_price, end_price, max(p.day) AS start_day, end_day
  FROM nw n JOIN p ON p.symbol = n.symbol AND p.kind != n.kind AND p.day < end_day GROUP BY n.symbol, n.kind, end_price, end_day)"""


@query(sql("bars", f"{_SWING} SELECT symbol, direction, start_price, end_price, start_day::VARCHAR AS start_day, end_day::VARCHAR AS end_day FROM sw"))
def w14_latest_swing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = structure.latest_swing(structure.pivots(views.bars(spark, sf_dir)))
    return found.select("symbol", "direction", "start_price", "end_price", text("start_day"), text("end_day"))


@query(sql("bars", f"""{_ATR}, {_SWING}
SELECT symbol, direction, r.ratio, round(end_price - r.ratio * (end_price - start_price), 6) AS price FROM sw JOIN osc USING (symbol),
(SELECT unnest([{', '.join(map(str, structure.RATIOS))}]::DOUBLE[]) AS ratio) r WHERE abs(end_price - start_price) >= atr14"""))
def w16_fibonacci(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = views.bars(spark, sf_dir)
    swings = structure.meaningful(structure.latest_swing(structure.pivots(bars)), indicators.atr(bars).withColumnRenamed("atr14", "atr"))
    return structure.fibonacci(swings).select("symbol", "direction", "ratio", r6("price"))


_VOLUME = """v AS (SELECT symbol, day, volume, CASE WHEN count(*) OVER b = 20 THEN avg(volume) OVER b END AS base20, CASE WHEN count(*) OVER f = 5 THEN avg(volume) OVER f END AS avg5 FROM bars
WINDOW b AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), f AS (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING))"""


@query(sql("bars", f"{_VOLUME} SELECT symbol, day::VARCHAR AS day, round(base20, 6) AS base20, round(avg5, 6) AS avg5, round(volume / nullif(base20, 0), 6) AS rvol, round(avg5 / nullif(base20, 0), 6) AS trend FROM v"))
def w18_volume_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.volume_features(views.bars(spark, sf_dir)).select("symbol", text("day"), r6("base20"), r6("avg5"), r6("rvol"), r6("trend"))


_SPLIT = "num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM bars)"


@query(sql("bars", f"""{_SPLIT},
c AS (SELECT n.symbol, n.open, n.close AS price, n.high, n.low, (SELECT arg_max(close, day) FROM num d WHERE d.symbol = n.symbol AND back > 1) AS previous_close FROM num n WHERE back = 1)
SELECT symbol, price, previous_close, round((price / previous_close - 1) * 100, 6) AS change_pct, round((high - low) / nullif(open, 0) * 100, 6) AS range_pct,
round((price - low) / nullif(high - low, 0) * 100, 6) AS position_pct, round((high - price) / high * 100, 6) AS pullback_pct, round((price - low) / low * 100, 6) AS rebound_pct FROM c"""))
def w19_current_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    completed, current = indicators.split_current(views.bars(spark, sf_dir))
    found = indicators.current_bar_structure(completed, current)
    return found.select("symbol", "price", "previous_close", *[r6(c) for c in ("change_pct", "range_pct", "position_pct", "pullback_pct", "rebound_pct")])


_SNAP = f"""{_ATR}, {_VOLUME}, m AS (SELECT symbol, day, close, {_MAS} FROM bars),
h AS (SELECT symbol, day, {_HILO}, (close / lag(close, 5) OVER w - 1) * 100 AS return5, (close / lag(close, 20) OVER w - 1) * 100 AS return20 FROM bars {_W20}),
sl AS (SELECT *, (ma20 / lag(ma20, 5) OVER w - 1) * 100 AS slope20, (ma50 / lag(ma50, 5) OVER w - 1) * 100 AS slope50, lead(day) OVER w IS NULL AS newest FROM m WINDOW w AS (PARTITION BY symbol ORDER BY day)),
snap AS (SELECT sl.symbol, sl.day, close, ma5, ma20, ma50, ma200, slope20, slope50, return5, return20, high20, low20, volume / nullif(base20, 0) AS rvol, avg5 / nullif(base20, 0) AS trend, atr14, rsi14
  FROM sl JOIN h USING (symbol, day) JOIN v USING (symbol, day) LEFT JOIN osc ON osc.symbol = sl.symbol WHERE newest)"""
_SNAP_COLUMNS = ("ma5", "ma20", "ma50", "ma200", "slope20", "slope50", "return5", "return20", "rvol", "trend", "atr14", "rsi14")


@query(sql("bars", f"{_SNAP} SELECT symbol, day::VARCHAR AS day, close, high20, low20, {', '.join(f'round({c}, 6) AS {c}' for c in _SNAP_COLUMNS)} FROM snap"))
def w20_technical_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.snapshot(views.bars(spark, sf_dir)).select("symbol", text("day"), "close", "high20", "low20", *[r6(c) for c in _SNAP_COLUMNS])


@query(sql("bars", f"""{_SPLIT}, c AS (SELECT symbol, arg_max(close, day) AS c FROM num WHERE back > 1 GROUP BY symbol), o AS (SELECT symbol, close AS b FROM num WHERE back = 1),
qt AS (SELECT o.symbol, open AS q FROM num o WHERE back = 1 AND symbol < 'N08')
SELECT coalesce(c.symbol, o.symbol) AS symbol, coalesce(q, b, c) AS price, CASE WHEN q IS NOT NULL THEN 'quote' WHEN b IS NOT NULL THEN 'incomplete_bar' ELSE 'completed_close' END AS price_source
FROM c FULL JOIN o ON c.symbol = o.symbol LEFT JOIN qt ON qt.symbol = o.symbol"""))
def f03_reference_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes stand in for some symbols, the opens of their newest bars."""
    completed, current = indicators.split_current(views.bars(spark, sf_dir))
    quotes = current.where("symbol < 'N08'").select("symbol", F.col("open").alias("price"))
    return indicators.reference_price(quotes, current, completed)


def _context(bars: DataFrame) -> DataFrame:
    """The snapshot of completed bars with the price of the open bar and the nearest levels."""
    completed, current = indicators.split_current(bars)
    snap = indicators.snapshot(completed).drop("trend")
    price = indicators.reference_price(current.select("symbol", F.col("close").alias("price")).limit(0), current, completed)
    now = price.join(snap.select("symbol", F.col("atr14").alias("atr")), "symbol")
    near = structure.level_candidates(_levels(completed), now).where("rank = 1")
    wide = near.groupBy("symbol").agg(
        F.bool_or(F.col("role") == "zone").alias("zone"),
        F.max(F.when(F.col("role") == "support", F.col("atr_distance"))).alias("support_atr"),
        F.max(F.when(F.col("role") == "resistance", F.col("atr_distance"))).alias("resistance_atr"),
    )
    bars_seen = completed.groupBy("symbol").agg(F.count("*").alias("n_bars"))
    quality = F.when(F.col("n_bars") < 15, "rejected").when(F.col("n_bars") < 60, "degraded").otherwise("usable")
    return snap.join(price, "symbol").join(wide, "symbol", "left").join(bars_seen.select("symbol", quality.alias("technical_quality")), "symbol")


_CONTEXT = (
    _CANDIDATES.replace("FROM bars", "FROM done").replace("JOIN bars", "JOIN done").replace("arg_max(close, day) AS now FROM done", "arg_max(close, day) AS now FROM bars")
    + ", " + _SNAP.split(f"{_ATR}, ")[1].replace("FROM bars", "FROM done")
    + """,
nr AS (SELECT symbol, bool_or(role = 'zone') AS zone, max(CASE WHEN role = 'support' THEN atr_distance END) AS support_atr, max(CASE WHEN role = 'resistance' THEN atr_distance END) AS resistance_atr FROM rk WHERE rank = 1 GROUP BY symbol),
ctx AS (SELECT snap.*, now AS price, zone, support_atr, resistance_atr, CASE WHEN n < 15 THEN 'rejected' WHEN n < 60 THEN 'degraded' ELSE 'usable' END AS technical_quality
  FROM snap JOIN nw USING (symbol) LEFT JOIN nr USING (symbol) JOIN (SELECT symbol, count(*) AS n FROM done GROUP BY symbol) USING (symbol)),
fa AS (SELECT *,
  CASE WHEN price IS NULL OR ma20 IS NULL OR ma50 IS NULL OR slope20 IS NULL OR slope50 IS NULL THEN NULL WHEN price > ma20 AND ma20 > ma50 AND slope20 > 0 AND slope50 > 0 THEN 'bullish'
    WHEN price < ma20 AND ma20 < ma50 AND slope20 < 0 AND slope50 < 0 THEN 'bearish' ELSE 'mixed' END AS t,
  CASE WHEN return5 IS NULL OR return20 IS NULL OR rsi14 IS NULL THEN NULL WHEN return5 > 0 AND return20 > 0 THEN 'bullish' WHEN return5 < 0 AND return20 < 0 THEN 'bearish'
    WHEN return5 = 0 AND return20 = 0 THEN 'neutral' ELSE 'mixed' END AS m,
  CASE WHEN price IS NULL OR (high20 IS NULL AND low20 IS NULL AND zone IS NOT TRUE AND support_atr IS NULL AND resistance_atr IS NULL) THEN NULL
    WHEN price > high20 THEN 'bullish' WHEN price < low20 THEN 'bearish' WHEN zone OR (support_atr <= 0.5 AND resistance_atr <= 0.5) THEN 'mixed' ELSE 'neutral' END AS v,
  CASE WHEN price IS NULL THEN 'current_price_missing' WHEN high20 IS NULL AND low20 IS NULL AND zone IS NOT TRUE AND support_atr IS NULL AND resistance_atr IS NULL THEN 'level_data_missing'
    WHEN price > high20 THEN 'breakout_above_20d_high' WHEN price < low20 THEN 'breakdown_below_20d_low' WHEN zone THEN 'at_key_price_zone'
    WHEN support_atr <= 0.5 AND resistance_atr <= 0.5 THEN 'near_support|near_resistance|inside_tight_range' WHEN support_atr <= 0.5 THEN 'near_support' WHEN resistance_atr <= 0.5 THEN 'near_resistance' ELSE 'not_near_key_level' END AS v_reasons
  FROM ctx),
fr AS (SELECT *,
  CASE WHEN t IS NULL THEN 'trend_inputs_missing' ELSE concat_ws('|', CASE t WHEN 'bullish' THEN 'price_above_ma20_above_ma50|ma20_slope_positive|ma50_slope_positive'
    WHEN 'bearish' THEN 'price_below_ma20_below_ma50|ma20_slope_negative|ma50_slope_negative' ELSE 'trend_structure_not_aligned' END,
    CASE WHEN price > ma200 THEN 'price_above_ma200' WHEN price < ma200 THEN 'price_below_ma200' WHEN price = ma200 THEN 'price_at_ma200' END) END AS t_reasons,
  CASE WHEN m IS NULL THEN 'momentum_inputs_missing' ELSE concat_ws('|', CASE m WHEN 'bullish' THEN 'return_5d_positive|return_20d_positive' WHEN 'bearish' THEN 'return_5d_negative|return_20d_negative'
    WHEN 'neutral' THEN 'returns_flat' ELSE 'momentum_horizons_not_aligned' END,
    CASE WHEN rsi14 > 70 THEN 'rsi_overbought' WHEN rsi14 > 50 THEN 'rsi_positive' WHEN rsi14 = 50 THEN 'rsi_neutral' WHEN rsi14 > 30 THEN 'rsi_weak' ELSE 'rsi_oversold' END) END AS m_reasons
  FROM fa),
d1 AS (SELECT *, CASE WHEN t IS NOT NULL AND m IS NOT NULL THEN CASE WHEN (t = 'bullish' AND m = 'bearish') OR (t = 'bearish' AND m = 'bullish') THEN 'mixed' ELSE t END ELSE coalesce(t, m) END AS main,
  CASE WHEN t IS NOT NULL AND m IS NOT NULL THEN CASE WHEN (t = 'bullish' AND m = 'bearish') OR (t = 'bearish' AND m = 'bullish') THEN 'trend_momentum_conflict' WHEN t = 'mixed' THEN 'trend_not_directional'
    WHEN t = m THEN 'primary_factors_aligned' ELSE 'trend_direction_retained_without_momentum_confirmation' END
    WHEN t IS NOT NULL THEN 'trend_only_available' WHEN m IS NOT NULL THEN 'momentum_only_available' END AS why,
  technical_quality = 'rejected' OR (t IS NULL AND m IS NULL AND v IS NULL) AS blocked FROM fr),
d2 AS (SELECT *, CASE WHEN main IS NULL THEN v WHEN (main = 'bearish' AND v = 'bullish') OR (main = 'bullish' AND v = 'bearish') THEN 'mixed' ELSE main END AS view,
  CASE WHEN main IS NULL THEN CASE WHEN v IS NOT NULL THEN 'level_only_available' ELSE '' END ELSE concat_ws('|', why, CASE WHEN (main = 'bearish' AND v = 'bullish') OR (main = 'bullish' AND v = 'bearish') THEN 'level_conflicts_with_primary_direction'
    WHEN main IN ('bullish', 'bearish') AND v = main THEN 'level_confirms_primary_direction' WHEN v IN ('neutral', 'mixed') THEN 'level_no_directional_override'
    WHEN v IS NOT NULL AND main = 'mixed' THEN 'level_does_not_resolve_primary_conflict' END) END AS reasons FROM d1)"""
)
_DONE = "done AS (SELECT * EXCLUDE (back) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS back FROM bars) WHERE back > 1), "


def _factor(name: str, key: str) -> None:
    short = {"trend": "t", "momentum": "m", "level": "v"}[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rated = decision.factors(_context(views.bars(spark, sf_dir)))
        return rated.select("symbol", F.col(f"{name}.signal").alias("signal"), F.array_join(F.col(f"{name}.reasons"), "|").alias("reasons"))

    run.__name__ = key
    query(sql("bars", f"{_DONE}{_CONTEXT} SELECT symbol, {short} AS signal, {short}_reasons AS reasons FROM fr"))(run)


for _name, _key in (("trend", "c21_trend"), ("momentum", "c22_momentum"), ("level", "c23_level")):
    _factor(_name, _key)


@query(sql("bars", f"""{_DONE}{_CONTEXT}
SELECT symbol, CASE WHEN blocked THEN 'blocked' WHEN t IS NULL OR m IS NULL OR v IS NULL THEN 'partial' ELSE 'complete' END AS status, CASE WHEN NOT blocked THEN view END AS view,
  CASE WHEN blocked THEN '' ELSE reasons END AS decision_reasons,
  CASE WHEN blocked OR view NOT IN ('bullish', 'bearish') THEN '' ELSE concat_ws('|', CASE WHEN m IN ('mixed', 'neutral') THEN 'momentum_not_confirmed' END,
    CASE WHEN m = 'mixed' THEN 'momentum_horizons_not_aligned' WHEN m = 'neutral' THEN 'returns_flat' END,
    CASE WHEN view = 'bullish' AND v_reasons LIKE '%near_resistance%' THEN 'near_resistance' WHEN view = 'bearish' AND v_reasons LIKE '%near_support%' THEN 'near_support' END,
    CASE WHEN v_reasons = 'at_key_price_zone' THEN 'at_key_price_zone' END, CASE WHEN v_reasons LIKE '%inside_tight_range%' THEN 'inside_tight_range' END) END AS opposing,
  CASE WHEN blocked THEN '' ELSE concat_ws('|', CASE WHEN view = 'bullish' AND t = 'bullish' THEN 'price_not_above_ma20|ma20_not_above_ma50|ma20_slope_non_positive|ma50_slope_non_positive'
      WHEN view = 'bearish' AND t = 'bearish' THEN 'price_not_below_ma20|ma20_not_below_ma50|ma20_slope_non_negative|ma50_slope_non_negative' END,
    CASE WHEN m IS NOT NULL AND view = 'bullish' THEN 'momentum_turns_bearish' WHEN m IS NOT NULL AND view = 'bearish' THEN 'momentum_turns_bullish' END,
    CASE WHEN v IS NOT NULL AND view = 'bullish' AND low20 IS NOT NULL THEN 'price_breaks_below_20d_low' WHEN v IS NOT NULL AND view = 'bearish' AND high20 IS NOT NULL THEN 'price_breaks_above_20d_high' END,
    CASE WHEN reasons LIKE '%trend_momentum_conflict%' THEN 'momentum_no_longer_opposes_trend|trend_no_longer_opposes_momentum' END,
    CASE WHEN reasons LIKE '%trend_not_directional%' THEN 'trend_becomes_bullish|trend_becomes_bearish' END,
    CASE WHEN reasons LIKE '%level_conflicts_with%' THEN 'level_no_longer_conflicts_with_primary_direction|primary_direction_changes' END,
    CASE WHEN view = 'neutral' AND m = 'neutral' THEN 'return_5d_becomes_nonzero|return_20d_becomes_nonzero' END,
    CASE WHEN view = 'neutral' AND v = 'neutral' AND v_reasons = 'near_support' THEN 'support_distance_exceeds_0_5_atr' WHEN view = 'neutral' AND v = 'neutral' AND v_reasons = 'near_resistance' THEN 'resistance_distance_exceeds_0_5_atr'
      WHEN view = 'neutral' AND v = 'neutral' AND v_reasons = 'not_near_key_level' THEN 'price_enters_key_level_proximity' END) END AS invalidation,
  CASE WHEN technical_quality = 'rejected' THEN 'technical_quality_rejected' ELSE concat_ws('|', CASE WHEN t IS NULL THEN t_reasons END, CASE WHEN m IS NULL THEN m_reasons END, CASE WHEN v IS NULL THEN v_reasons END) END AS missing,
  CASE technical_quality WHEN 'degraded' THEN 'technical_quality_degraded' ELSE '' END AS warnings
FROM d2"""))
def c27_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query: from orders to a decision per symbol."""
    return decision.decide(_context(views.bars(spark, sf_dir)))
