"""Release events from vendor records: consistency within a release, choice between sources, and the snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.macro import eastern_date, match_consensus, surprise


def _single(values: str) -> Column:
    return F.size(F.array_distinct(F.transform(F.col("r"), lambda r: r[values]))) == 1


def weekly_periods_agree() -> Column:
    """Over the array r of records: the average's week is the initial claims', and continuing claims are seven days older; absent ones don't matter."""

    def period(indicator: str) -> Column:
        return F.try_element_at(F.filter("r", lambda r: r["indicator"] == indicator), F.lit(1))["period"]

    initial, average, continued = map(period, ("initial_claims", "initial_claims_4w_avg", "continuing_claims"))
    same = F.coalesce(initial == average, F.lit(True))
    return same & F.coalesce(F.date_diff(F.coalesce(initial, average), continued) == 7, F.lit(True))


def vendor_releases(releases: DataFrame, records: DataFrame, keys: DataFrame, weekly: str = "weekly_claims") -> DataFrame:
    """A row per release: built or not, its metrics, its time and the warnings in the order of the keys.

    releases: release_type, release_date. keys: release_type, place, indicator, measure, unit (a few rows a type).
    records: release_type, release_date, indicator, measure, unit, period, vendor_release_at, actual, forecast; any number of rows.
    A wrong unit or a time on another Eastern date ends the release, as does disagreement between its records.
    A key without exactly one record, or without a time, is left out with a warning, as is one without an actual value.
    """
    by = ["release_type", "release_date"]
    found = records.groupBy(*by, "indicator", "measure").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c if c != "unit" else "found_unit") for c in ("unit", "period", "vendor_release_at", "actual", "forecast")]
    )
    rows = releases.join(keys, "release_type").join(found, [*by, "indicator", "measure"], "left")
    label = F.concat_ws(":", "indicator", "measure")
    fault = (
        F.when(F.coalesce("n", F.lit(0)) != 1, "record_count_invalid").when(F.col("found_unit") != F.col("unit"), "record_identity_mismatch")
        .when(F.col("vendor_release_at").isNull(), "release_time_missing").when(eastern_date(F.col("vendor_release_at")) != F.col("release_date"), "release_date_mismatch")
    )
    rows = rows.withColumn("fault", fault).select(*by, F.struct("place", label.alias("label"), "indicator", "measure", "period", "vendor_release_at", "actual", "forecast", "fault").alias("k"))
    whole = rows.groupBy(*by).agg(F.sort_array(F.collect_list("k")).alias("k"))
    ends = F.array_min(F.transform(F.filter("k", lambda k: k["fault"].isin("record_identity_mismatch", "release_date_mismatch")), lambda k: k["place"]))
    whole = whole.withColumn("ends", ends).withColumn("r", F.filter("k", lambda k: k["fault"].isNull()))
    agree = F.when(F.col("release_type") == weekly, weekly_periods_agree()).otherwise(_single("period"))
    verdict = (
        F.when(F.col("ends").isNotNull(), "").when(F.size("r") == 0, "no_usable_records").when(~agree, "period_mismatch")
        .when(~_single("vendor_release_at"), "release_time_mismatch").when(~F.exists("r", lambda r: r["actual"].isNotNull()), "no_usable_metrics")
    )
    whole = whole.withColumns({"verdict": verdict, "metrics": F.filter("r", lambda r: r["actual"].isNotNull())})
    seen = F.filter("k", lambda k: k["fault"].isNotNull() & (F.col("ends").isNull() | (k["place"] <= F.col("ends"))))
    notes = F.transform(seen, lambda k: F.concat_ws(":", k["fault"], k["label"]))
    late = F.col("verdict").isNull() | (F.col("verdict") == "no_usable_metrics")
    blank = F.when(late, F.transform(F.filter("r", lambda r: r["actual"].isNull()), lambda r: F.concat_ws(":", F.lit("actual_missing"), r["label"])))
    built, have, want = F.col("verdict").isNull(), F.size("metrics"), F.size("k")
    partial = F.when(built & (have < want), F.concat(F.lit("partial_release:"), have.cast("string"), F.lit("/"), want.cast("string")))
    warnings = F.concat(notes, F.coalesce(blank, F.array().cast("array<string>")), F.array_compact(F.array(F.nullif("verdict", F.lit("")), partial)))
    return whole.select(
        *by, built.alias("built"), F.when(built, have).otherwise(0).alias("n_metrics"), F.when(built, F.try_element_at("r", F.lit(1))["vendor_release_at"]).alias("vendor_release_at"),
        F.when(built, F.transform("metrics", lambda m: F.struct(m["indicator"].alias("indicator"), m["measure"].alias("measure"), m["actual"].alias("actual"), (m["actual"] - m["forecast"]).alias("estimated_surprise")))).alias("metrics"),
        F.array_join(F.transform(warnings, lambda w: F.concat_ws("_", "release_type", w)), "|").alias("warnings"),
    )


def latest_with_actual(records: DataFrame, as_of: Column, days: Column) -> DataFrame:
    """Per type the newest Eastern release date within these days before as_of, of records with a value, a time and a period not after it."""
    date = eastern_date(F.col("vendor_release_at"))
    today = eastern_date(as_of)
    fit = records.where(F.col("actual").isNotNull() & (F.col("vendor_release_at") <= as_of) & date.between(F.date_sub(today, days), today) & (F.col("period") <= date))
    return fit.groupBy("release_type").agg(F.max(date).alias("release_date"))


def prefer(types: DataFrame, vendor: DataFrame, official: DataFrame) -> DataFrame:
    """Per type the vendor's release if it is built, else the official one whole; the two are never mixed.

    vendor: release_type, release_date, built. official: release_type, release_date. At most a row a type in each.
    """
    v = vendor.select("release_type", F.col("release_date").alias("vendor_date"), "built")
    o = official.select("release_type", F.col("release_date").alias("official_date"))
    both = types.join(v, "release_type", "left").join(o, "release_type", "left")
    use = F.coalesce("built", F.lit(False))
    why = F.when(F.col("built").isNull(), F.concat(F.col("release_type"), F.lit("_no_vendor_release"))).when(~use, F.concat_ws("|", F.concat(F.col("release_type"), F.lit("_build_failed")), F.concat(F.col("release_type"), F.lit("_using_official_fallback"))))
    return both.select(
        "release_type", F.when(use, "vendor").when(F.col("official_date").isNotNull(), "official").alias("source"),
        F.when(use, F.col("vendor_date")).otherwise(F.col("official_date")).alias("release_date"), F.coalesce(why, F.lit("")).alias("warnings"),
    )


def snapshot(chosen: DataFrame, parts: DataFrame) -> DataFrame:
    """A row per module: release types and others (module, present); what is absent carries a warning and takes nothing else with it."""
    releases = chosen.select(F.col("release_type").alias("module"), F.col("release_date").isNotNull().alias("present"), "warnings")
    others = parts.select("module", "present", F.lit("").alias("warnings"))
    missing = F.when(~F.col("present"), F.concat(F.col("module"), F.lit("_missing")))
    return releases.unionByName(others).withColumn("warnings", F.concat_ws("|", F.nullif("warnings", F.lit("")), missing))


def missing_types(required: DataFrame, available: DataFrame) -> DataFrame:
    return required.join(available.select("release_type").distinct(), "release_type", "left_anti")


#: Release types whose metrics must all be of one period.
ONE_PERIOD = ["employment_situation"]


def official_releases(dates: DataFrame, metrics: DataFrame, forecasts: DataFrame, day: Column) -> DataFrame:
    """A row per release type with a date up to day: its newest release out of official readings, or the warning why there is none.

    dates: release_type, release_date. metrics: release_type, indicator, measure, period, actual, previous, the newest readings of each
    type. forecasts: indicator, measure, period, forecast_id, consensus, forecast_as_of, scheduled_at. A release of day itself has
    no verified time and isn't built, and employment metrics of several periods end theirs. Without metrics there is no release.
    The time is scheduled where all forecasts of its metrics for that date agree on one. Values are the current version: the
    binding of period and date is assumed, and their status is unverified.
    """
    latest = dates.where(F.col("release_date") <= day).groupBy("release_type").agg(F.max("release_date").alias("release_date"))
    named = metrics.withColumn("series", F.concat_ws(":", "indicator", "measure")).join(latest, "release_type")
    named = named.withColumns({"released_at": F.lit(None).cast("timestamp_ntz"), "actual_pit_status": F.lit("unverified")})
    given = forecasts.select(F.concat_ws(":", "indicator", "measure").alias("series"), "period", "forecast_id", "consensus", "forecast_as_of", "scheduled_at")
    keyed = named.select("release_type", "series", "period", "release_date").join(given.select("series", "period", "scheduled_at"), ["series", "period"])
    times = keyed.where(eastern_date(F.col("scheduled_at")) == F.col("release_date")).groupBy("release_type").agg(F.min("scheduled_at").alias("low"), F.max("scheduled_at").alias("high"))
    parts = surprise(match_consensus(named, given))
    shown = F.struct("indicator", "measure", "period", "actual", "previous", "consensus", "surprise", "surprise_is_estimated")
    lists = parts.groupBy("release_type").agg(F.sort_array(F.collect_list(shown)).alias("metrics"), F.count_distinct("period").alias("periods"))
    rows = latest.join(lists, "release_type", "left").join(times, "release_type", "left")
    warning = F.when(F.col("release_date") == day, F.concat("release_type", F.lit("_release_time_unverified"))).when(
        F.col("release_type").isin(ONE_PERIOD) & (F.col("periods") > 1), F.lit("employment_period_mismatch")
    )
    built = warning.isNull() & F.col("metrics").isNotNull()
    time = F.when(built & (F.col("low") == F.col("high")), F.col("low"))
    return rows.select(
        "release_type", F.when(built, F.concat_ws(":", "release_type", F.col("release_date").cast("string"))).alias("release_id"), F.when(built, F.col("release_date")).alias("release_date"), time.alias("scheduled_release_at"),
        F.when(time.isNotNull(), "trading_economics").alias("schedule_source"), F.when(built, F.col("metrics")).alias("metrics"), F.when(built, "latest_assumed").alias("period_binding"), warning.alias("warning"),
    )
