"""Factors and decisions as decision tables: when-chains over one snapshot row per symbol.

The input has symbol, price, price_source, ma20, ma50, ma200, slope20, slope50, return5, return20,
rsi14, high20, low20, zone (whether the price is in a level), support_atr and resistance_atr (the
distances of the nearest ones in ATR), and technical_quality. Any may be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NEAR_ATR = 0.5


def _texts(*parts: Column | str) -> Column:
    """An array of those texts that aren't null."""
    return F.array_compact(F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _missing(*names: str) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | F.col(name).isNull()
    return found


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def trend() -> Column:
    """struct(signal, reasons); a null signal is insufficient data."""
    price, ma20, ma50, ma200 = map(F.col, ("price", "ma20", "ma50", "ma200"))
    missing = _missing("price", "ma20", "ma50", "slope20", "slope50")
    bull = (price > ma20) & (ma20 > ma50) & (F.col("slope20") > 0) & (F.col("slope50") > 0)
    bear = (price < ma20) & (ma20 < ma50) & (F.col("slope20") < 0) & (F.col("slope50") < 0)
    core = (
        F.when(bull, _texts("price_above_ma20_above_ma50", "ma20_slope_positive", "ma50_slope_positive"))
        .when(bear, _texts("price_below_ma20_below_ma50", "ma20_slope_negative", "ma50_slope_negative"))
        .otherwise(_texts("trend_structure_not_aligned"))
    )
    long_term = F.when(price > ma200, "price_above_ma200").when(price < ma200, "price_below_ma200").when(price == ma200, "price_at_ma200")
    signal = F.when(missing, None).when(bull, "bullish").when(bear, "bearish").otherwise("mixed")
    return F.struct(signal.alias("signal"), F.when(missing, _texts("trend_inputs_missing")).otherwise(F.concat(core, _texts(long_term))).alias("reasons"))


def momentum() -> Column:
    r5, r20, rsi = F.col("return5"), F.col("return20"), F.col("rsi14")
    missing = _missing("return5", "return20", "rsi14")
    bull, bear, flat = (r5 > 0) & (r20 > 0), (r5 < 0) & (r20 < 0), (r5 == 0) & (r20 == 0)
    core = (
        F.when(bull, _texts("return_5d_positive", "return_20d_positive"))
        .when(bear, _texts("return_5d_negative", "return_20d_negative"))
        .when(flat, _texts("returns_flat"))
        .otherwise(_texts("momentum_horizons_not_aligned"))
    )
    band = F.when(rsi > 70, "rsi_overbought").when(rsi > 50, "rsi_positive").when(rsi == 50, "rsi_neutral").when(rsi > 30, "rsi_weak").otherwise("rsi_oversold")
    signal = F.when(missing, None).when(bull, "bullish").when(bear, "bearish").when(flat, "neutral").otherwise("mixed")
    return F.struct(signal.alias("signal"), F.when(missing, _texts("momentum_inputs_missing")).otherwise(F.concat(core, _texts(band))).alias("reasons"))


def level() -> Column:
    price = F.col("price")
    above, below = _yes(price > F.col("high20")), _yes(price < F.col("low20"))
    zone = _yes(F.col("zone"))
    no_data = F.col("high20").isNull() & F.col("low20").isNull() & ~zone & F.col("support_atr").isNull() & F.col("resistance_atr").isNull()
    support, resistance = _yes(F.col("support_atr") <= NEAR_ATR), _yes(F.col("resistance_atr") <= NEAR_ATR)
    signal = (
        F.when(price.isNull() | no_data, None).when(above, "bullish").when(below, "bearish").when(zone | (support & resistance), "mixed").otherwise("neutral")
    )
    reasons = (
        F.when(price.isNull(), _texts("current_price_missing"))
        .when(no_data, _texts("level_data_missing"))
        .when(above, _texts("breakout_above_20d_high"))
        .when(below, _texts("breakdown_below_20d_low"))
        .when(zone, _texts("at_key_price_zone"))
        .when(support & resistance, _texts("near_support", "near_resistance", "inside_tight_range"))
        .when(support, _texts("near_support"))
        .when(resistance, _texts("near_resistance"))
        .otherwise(_texts("not_near_key_level"))
    )
    return F.struct(signal.alias("signal"), reasons.alias("reasons"))


def factors(snapshot: DataFrame) -> DataFrame:
    return snapshot.withColumn("trend", trend()).withColumn("momentum", momentum()).withColumn("level", level())


def combine() -> Column:
    """struct(view, reasons) from the columns trend, momentum and level."""
    t, m, v = F.col("trend.signal"), F.col("momentum.signal"), F.col("level.signal")
    clash = ((t == "bullish") & (m == "bearish")) | ((t == "bearish") & (m == "bullish"))
    both = t.isNotNull() & m.isNotNull()
    first = (
        F.when(both, F.when(clash, "mixed").when(t.isin("bullish", "bearish"), t).otherwise("mixed"))
        .when(t.isNotNull(), t).when(m.isNotNull(), m)
    )
    why = (
        F.when(both & clash, "trend_momentum_conflict")
        .when(both & ~t.isin("bullish", "bearish"), "trend_not_directional")
        .when(both & (t == m), "primary_factors_aligned")
        .when(both, "trend_direction_retained_without_momentum_confirmation")
        .when(t.isNotNull(), "trend_only_available")
        .when(m.isNotNull(), "momentum_only_available")
    )
    against = ((first == "bearish") & (v == "bullish")) | ((first == "bullish") & (v == "bearish"))
    directional = first.isin("bullish", "bearish")
    say = (
        F.when(against, "level_conflicts_with_primary_direction")
        .when(directional & (v == first), "level_confirms_primary_direction")
        .when(v.isin("neutral", "mixed"), "level_no_directional_override")
        .when(v.isNotNull() & (first == "mixed"), "level_does_not_resolve_primary_conflict")
    )
    view = F.when(first.isNull(), v).when(_yes(against), "mixed").otherwise(first)
    reasons = F.when(first.isNull() & v.isNotNull(), _texts("level_only_available")).otherwise(_texts(why, say))
    return F.struct(view.alias("view"), reasons.alias("reasons"))


def opposing() -> Column:
    """What speaks against a bullish or bearish view."""
    view, m, lv = F.col("decision.view"), F.col("momentum"), F.col("level.reasons")

    def has(reasons: Column, name: str) -> Column:
        return F.when(F.array_contains(reasons, name), name)

    unsure = m["signal"].isin("mixed", "neutral")
    close = F.when(view == "bullish", has(lv, "near_resistance")).otherwise(has(lv, "near_support"))
    listed = _texts(
        F.when(unsure, "momentum_not_confirmed"), F.when(unsure, has(m["reasons"], "momentum_horizons_not_aligned")), F.when(unsure, has(m["reasons"], "returns_flat")),
        close, has(lv, "at_key_price_zone"), has(lv, "inside_tight_range"),
    )
    return F.when(view.isin("bullish", "bearish"), listed).otherwise(F.array().cast("array<string>"))


def invalidation() -> Column:
    """What would call for a new decision."""
    view, why, lv = F.col("decision.view"), F.col("decision.reasons"), F.col("level.reasons")
    t, m, v = F.col("trend.signal"), F.col("momentum.signal"), F.col("level.signal")
    none = F.array().cast("array<string>")

    def if_(condition: Column, *names: str) -> Column:
        return F.when(_yes(condition), _texts(*names)).otherwise(none)

    flat = (view == "neutral") & (v == "neutral")
    return F.concat(
        if_((view == "bullish") & (t == "bullish"), "price_not_above_ma20", "ma20_not_above_ma50", "ma20_slope_non_positive", "ma50_slope_non_positive"),
        if_((view == "bearish") & (t == "bearish"), "price_not_below_ma20", "ma20_not_below_ma50", "ma20_slope_non_negative", "ma50_slope_non_negative"),
        if_(m.isNotNull() & (view == "bullish"), "momentum_turns_bearish"),
        if_(m.isNotNull() & (view == "bearish"), "momentum_turns_bullish"),
        if_(v.isNotNull() & (view == "bullish") & F.col("low20").isNotNull(), "price_breaks_below_20d_low"),
        if_(v.isNotNull() & (view == "bearish") & F.col("high20").isNotNull(), "price_breaks_above_20d_high"),
        if_(F.array_contains(why, "trend_momentum_conflict"), "momentum_no_longer_opposes_trend", "trend_no_longer_opposes_momentum"),
        if_(F.array_contains(why, "trend_not_directional"), "trend_becomes_bullish", "trend_becomes_bearish"),
        if_(F.array_contains(why, "level_conflicts_with_primary_direction"), "level_no_longer_conflicts_with_primary_direction", "primary_direction_changes"),
        if_((view == "neutral") & (m == "neutral"), "return_5d_becomes_nonzero", "return_20d_becomes_nonzero"),
        if_(flat & F.array_contains(lv, "near_support"), "support_distance_exceeds_0_5_atr"),
        if_(flat & F.array_contains(lv, "near_resistance"), "resistance_distance_exceeds_0_5_atr"),
        if_(flat & F.array_contains(lv, "not_near_key_level"), "price_enters_key_level_proximity"),
    )


def decide(snapshot: DataFrame) -> DataFrame:
    """symbol, status, view, decision_reasons, opposing, invalidation, missing and warnings, texts joined by '|'."""
    rated = factors(snapshot).withColumn("decision", combine())
    rejected = F.col("technical_quality") == "rejected"
    usable = sum((F.col(f"{f}.signal").isNotNull().cast("int") for f in ("trend", "momentum", "level")), F.lit(0))
    status = F.when(_yes(rejected) | (usable == 0), "blocked").when(usable < 3, "partial").otherwise("complete")
    gone = F.flatten(F.array(*[F.when(F.col(f"{f}.signal").isNull(), F.col(f"{f}.reasons")).otherwise(F.array().cast("array<string>")) for f in ("trend", "momentum", "level")]))
    warning = F.when(F.col("technical_quality") == "degraded", "technical_quality_degraded").when(F.col("technical_quality").isNull(), "technical_quality_not_assessed")
    rated = rated.withColumn("status", status)
    going = F.col("status") != "blocked"

    def text(value: Column) -> Column:
        return F.when(going, F.array_join(value, "|")).otherwise("")

    return rated.select(
        "symbol", "status", F.when(going, F.col("decision.view")).alias("view"), text(F.col("decision.reasons")).alias("decision_reasons"),
        text(opposing()).alias("opposing"), text(invalidation()).alias("invalidation"),
        F.when(_yes(rejected), "technical_quality_rejected").otherwise(F.array_join(gone, "|")).alias("missing"),
        F.array_join(_texts(warning), "|").alias("warnings"),
    )
