"""Macro series: calendar-keyed changes, consensus, point-in-time guards, yield curves and policy ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EASTERN = "America/New_York"
#: Sources of release dates that count as verified.
VERIFIED_SOURCES = ["fred", "longbridge", "fixture", "bls"]


def eastern_date(at: Column) -> Column:
    """The New York date of a UTC time."""
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), EASTERN))


def pct_change(now: Column, before: Column) -> Column:
    """Percent; null where either is missing or zero, as zero stands for no data."""
    return (F.nullif(now, F.lit(0.0)) / F.nullif(before, F.lit(0.0)) - 1) * 100


def shifted(series: DataFrame, keys: list[str], months: list[int], value: str = "value") -> DataFrame:
    """Adds value_m<n>, the value n months earlier by calendar, null where that month is absent."""
    out = series
    for n in months:
        past = series.select(*keys, F.add_months("period", n).alias("period"), F.col(value).alias(f"{value}_m{n}"))
        out = out.join(past, [*keys, "period"], "left")
    return out


def inflation_reading(adjusted: DataFrame, plain: DataFrame) -> DataFrame:
    """Per series the newest period with a month change of the adjusted and a year change of the plain one, and those a month before."""
    sa = shifted(adjusted, ["series"], [1, 2])
    nsa = shifted(plain, ["series"], [1, 12, 13])
    a = sa.select("series", "period", pct_change(F.col("value"), F.col("value_m1")).alias("mom"), pct_change(F.col("value_m1"), F.col("value_m2")).alias("previous_mom"))
    b = nsa.select("series", "period", pct_change(F.col("value"), F.col("value_m12")).alias("yoy"), pct_change(F.col("value_m1"), F.col("value_m13")).alias("previous_yoy"))
    both = a.join(b, ["series", "period"]).where("mom IS NOT NULL AND yoy IS NOT NULL")
    return newest(both, ["series"], "period")


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest order by keys; order is unique there."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def level_change(series: DataFrame, scale: float) -> DataFrame:
    """The newest month's change from the exact month before, scaled, and the change before that."""
    moved = shifted(series, ["series"], [1, 2])
    last = newest(moved, ["series"], "period")
    change = (F.col("value") - F.col("value_m1")) * scale
    before = (F.col("value_m1") - F.col("value_m2")) * scale
    return last.where("value_m1 IS NOT NULL").select("series", "period", change.alias("actual"), before.alias("previous"))


def level_metrics(series: DataFrame) -> DataFrame:
    """Rows for the newest level, its month change and its year change; those that can't be computed are left out."""
    last = newest(shifted(series, ["series"], [1, 2, 12, 13]), ["series"], "period")
    v, m1, m2, m12, m13 = (F.col(c) for c in ("value", "value_m1", "value_m2", "value_m12", "value_m13"))
    rows = F.array(
        F.struct(F.lit("level").alias("measure"), v.alias("actual"), m1.alias("previous")),
        F.struct(F.lit("mom").alias("measure"), pct_change(v, m1).alias("actual"), pct_change(m1, m2).alias("previous")),
        F.struct(F.lit("yoy").alias("measure"), pct_change(v, m12).alias("actual"), pct_change(m1, m13).alias("previous")),
    )
    return last.select("series", "period", F.inline(rows)).where("actual IS NOT NULL")


def inflation_metrics(reading: DataFrame) -> DataFrame:
    """A row per measure, mom and yoy, of inflation_reading()."""
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("actual"), F.col(f"previous_{m}").alias("previous")) for m in ("mom", "yoy")])
    return reading.select("series", "period", F.inline(rows))


def newest_level(series: DataFrame) -> DataFrame:
    """The newest level of each series, with that of the exact month before, null where absent."""
    last = newest(shifted(series, ["series"], [1]), ["series"], "period")
    return last.select("series", "period", F.col("value").alias("actual"), F.col("value_m1").alias("previous"))


def weekly_reading(weeks: DataFrame) -> DataFrame:
    """Each week with the value exactly seven days earlier and the change."""
    past = weeks.select("series", F.date_add("week", 7).alias("week"), F.col("claims").alias("previous"))
    return weeks.join(past, ["series", "week"], "left").withColumn("change", F.col("claims") - F.col("previous"))


def curve_snapshot(points: DataFrame, as_of: str, max_age_days: int = 7) -> DataFrame:
    """The newest complete curve up to as_of: yields, changes in basis points from the complete curve before, spreads, age and staleness."""
    tenors = ["3m", "2y", "10y", "30y"]
    wide = points.where(F.col("day") <= F.to_date(F.lit(as_of))).groupBy("day").pivot("tenor", tenors).agg(F.max("yield_pct")).dropna(subset=tenors)
    two = wide.orderBy(F.desc("day")).limit(2)
    order = Window.orderBy("day")
    changes = [((F.col(t) - F.lag(t).over(order)) * 100).alias(f"change_{t}") for t in tenors]
    age = F.datediff(F.to_date(F.lit(as_of)), "day")
    spreads = [((F.col("10y") - F.col("2y")) * 100).alias("spread_10y_2y"), ((F.col("10y") - F.col("3m")) * 100).alias("spread_10y_3m")]
    return two.select("day", *[F.col(t).alias(f"yield_{t}") for t in tenors], *changes, *spreads, age.alias("age_days"), (age > max_age_days).alias("stale")).orderBy(F.desc("day")).limit(1)


def policy_ranges(days: DataFrame) -> DataFrame:
    """Runs of equal ranges, each by its first day; days has series, day, lower and upper."""
    order = Window.partitionBy("series").orderBy("day")
    same = F.col("lower").eqNullSafe(F.lag("lower").over(order)) & F.col("upper").eqNullSafe(F.lag("upper").over(order))
    first = F.row_number().over(order) == 1
    return days.withColumn("_new", first | ~same).where("_new").drop("_new")


def policy_change(ranges: DataFrame) -> DataFrame:
    """The newest range by series and its change from the one before, in basis points."""
    order = Window.partitionBy("series").orderBy("day")
    moved = ranges.withColumn("change_bp", (F.col("upper") - F.lag("upper").over(order)) * 100).withColumn("_last", F.lead("day").over(order).isNull())
    return moved.where("_last").drop("_last")


def match_consensus(metrics: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Adds consensus, forecast_as_of and pit_verified to metrics (key, released_at, release_date).

    Of the forecasts of a metric scheduled for its release date, the one known latest before the
    release counts if no other was known at that time; with none known before, the only one without
    a time counts, unverified.
    """
    keys = ["series", "period"]
    near = metrics.select(*keys, "released_at", "release_date").join(
        forecasts.select(*keys, "forecast_id", F.col("consensus").alias("f"), "forecast_as_of", "scheduled_at"), keys
    ).where(eastern_date(F.col("scheduled_at")) == F.col("release_date"))
    before = F.coalesce(F.col("forecast_as_of") < F.col("released_at"), F.lit(False))
    by_time = near.groupBy(*keys, F.when(before, F.col("forecast_as_of")).alias("at"), before.alias("known"), F.col("forecast_as_of").isNull().alias("untimed")).agg(F.count("*").alias("n"), F.max("f").alias("f"))
    picked = by_time.groupBy(*keys).agg(
        F.max_by(F.struct("f", "n", "at"), F.when(F.col("known"), F.col("at"))).alias("v"),
        F.bool_or("known").alias("any_known"),
        F.max(F.when(F.col("untimed"), F.struct("n", "f"))).alias("u"),
    )
    value = F.when(F.col("any_known"), F.when(F.col("v.n") == 1, F.col("v.f"))).when(F.col("u.n") == 1, F.col("u.f"))
    known = F.when(value.isNotNull(), F.col("any_known"))
    found = picked.select(*keys, value.alias("consensus"), F.when(known, F.col("v.at")).alias("forecast_as_of"), known.alias("pit_verified")).where("consensus IS NOT NULL")
    return metrics.join(found, keys, "left")


def surprise(metrics: DataFrame, digits: int = 1) -> DataFrame:
    """Adds surprise, the actual rounded half up less the consensus if that is verified, and whether it is estimated."""
    verified = F.coalesce("pit_verified", F.lit(False))
    value = F.when(verified, F.round("actual", digits) - F.col("consensus"))
    return metrics.withColumn("surprise", value).withColumn("surprise_is_estimated", F.when(F.col("consensus").isNotNull(), verified & (F.col("actual_pit_status") != "verified")))


def _verdict(decision: str, reason: Column | str) -> Column:
    return F.struct(F.lit(decision).alias("decision"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))


def metric_as_of(as_of: Column, strict: bool) -> Column:
    """struct(decision, reason) from released_at, release_date and actual_pit_status."""
    late = F.col("released_at") > as_of
    date_late = F.col("released_at").isNull() & (F.col("release_date") > eastern_date(as_of))
    status = F.col("actual_pit_status")
    out = F.when(late, _verdict("reject", "released_after_as_of")).when(date_late, _verdict("reject", "release_date_after_as_of"))
    if strict:
        return (
            out.when(status == "verified", _verdict("usable", "pit_verified"))
            .when(status == "date_verified", _verdict("usable_with_warning", "pit_verified_at_date_precision_only"))
            .otherwise(_verdict("reject", "actual_pit_unverified"))
        )
    return out.when(status == "unverified", _verdict("usable_with_warning", "historical_revision_not_verified")).otherwise(_verdict("usable", "available"))


def consensus_usable(strict: bool) -> Column:
    """struct(decision, reason) from consensus and pit_verified."""
    out = F.when(F.col("consensus").isNull(), _verdict("usable", "consensus_missing")).when(F.col("pit_verified"), _verdict("usable", "consensus_pit_verified"))
    return out.otherwise(_verdict("reject" if strict else "usable_with_warning", "consensus_pit_unverified"))


def release_as_of(as_of: Column, strict: bool) -> Column:
    """struct(decision, reason) from released_at, vendor_release_at, release_date, release_date_source and period_binding."""
    vendor = F.col("released_at").isNull() & F.col("vendor_release_at").isNotNull()
    at = F.coalesce("released_at", "vendor_release_at")
    date_only = at.isNull()

    def either(one: str, other: str) -> Column:
        return F.when(vendor, one).otherwise(other)

    out = (
        F.when(at > as_of, _verdict("reject", either("vendor_release_after_as_of", "release_not_yet_published")))
        .when(at.isNotNull() & (eastern_date(at) != F.col("release_date")), _verdict("reject", either("vendor_release_date_time_conflict", "release_date_time_conflict")))
        .when(date_only & (F.col("release_date") >= eastern_date(as_of)), _verdict("reject", "exact_release_time_unverified"))
    )
    unknown = ~F.coalesce(F.col("release_date_source").isin(VERIFIED_SOURCES), F.lit(False))
    unbound = ~F.coalesce(F.col("period_binding") == "verified", F.lit(False))
    if strict:
        return (
            out.when(date_only, _verdict("reject", "exact_release_time_missing"))
            .when(unknown, _verdict("reject", "release_date_source_unverified"))
            .when(vendor, _verdict("reject", "vendor_release_time_unverified"))
            .when(unbound, _verdict("reject", "release_period_binding_unverified"))
            .otherwise(_verdict("usable", "available"))
        )
    return (
        out.when(unknown, _verdict("usable_with_warning", "release_date_source_unverified"))
        .when(unbound, _verdict("usable_with_warning", "release_period_binding_unverified"))
        .when(vendor, _verdict("usable_with_warning", "event_time_uses_vendor_timestamp"))
        .otherwise(_verdict("usable", "available"))
    )


def releases_as_of(releases: DataFrame, metrics: DataFrame, as_of: Column, strict: bool) -> DataFrame:
    """Usable releases with the count of their usable metrics and warnings, in order, joined by '|'.

    Releases without a usable metric go. Strict mode hides an unverified consensus and says so.
    """
    judged = releases.withColumn("r", release_as_of(as_of, strict)).where("r.decision != 'reject'")
    rated = metrics.withColumn("m", metric_as_of(as_of, strict))
    label = F.concat_ws(":", "series", "variant")
    hidden = F.lit(strict) & (F.col("m.decision") != "reject") & F.col("consensus").isNotNull() & ~F.coalesce("pit_verified", F.lit(False))
    notes = F.array_compact(F.array(
        F.when(F.col("m.decision") == "reject", F.concat_ws(":", label, "m.reason")),
        F.when(hidden, F.concat_ws(":", label, F.lit("consensus_hidden_in_strict_pit"))),
        F.when(F.col("m.decision") == "usable_with_warning", F.concat_ws(":", label, "m.reason")),
    ))
    lists = rated.groupBy("release_id").agg(
        F.count_if(F.col("m.decision") != "reject").alias("n_metrics"), F.sort_array(F.collect_list(F.struct("series", "variant", notes.alias("w")))).alias("ws")
    ).where("n_metrics > 0")
    own = F.array_compact(F.array(F.when(F.col("r.decision") == "usable_with_warning", F.col("r.reason"))))
    return judged.join(lists, "release_id").select(
        "release_id", "n_metrics", F.col("r.decision").alias("decision"), F.array_join(F.concat(own, F.flatten(F.transform("ws", lambda x: x["w"]))), "|").alias("warnings")
    )


def strict_metric(metrics: DataFrame) -> DataFrame:
    """Consensus and surprise nulled where they aren't verified, and surprise where the actual isn't."""
    verified = F.coalesce("pit_verified", F.lit(False))
    exact = verified & (F.col("actual_pit_status") == "verified")
    return metrics.withColumn("surprise", F.when(exact, F.col("surprise"))).withColumn("consensus", F.when(verified, F.col("consensus"))).withColumn("forecast_as_of", F.when(verified, F.col("forecast_as_of")))


def release_quality(releases: DataFrame, metrics: DataFrame, as_of: Column, strict: bool) -> DataFrame:
    """Per release: status and issues, of its times first, then of its metrics in order."""
    rated = metrics.withColumn("m", metric_as_of(as_of, strict)).withColumn("c", consensus_usable(strict))
    refused = F.col("m.decision") == "reject"
    notes = F.array_compact(F.array(
        F.when(F.col("m.decision") != "usable", F.concat_ws(":", "series", "m.reason")),
        F.when(~refused & F.col("consensus").isNotNull() & (F.col("c.decision") != "usable"), F.concat_ws(":", "series", "c.reason")),
    ))
    found = rated.groupBy("release_id").agg(F.count("*").alias("n"), F.count_if(~refused).alias("usable"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("series", notes.alias("w")))), lambda x: x["w"])).alias("ws"))
    rows = releases.withColumn("r", release_as_of(as_of, strict)).join(found, "release_id", "left")
    late, none = F.col("r.decision") == "reject", F.coalesce("n", F.lit(0)) == 0
    own = F.array_compact(F.array(F.when(F.col("r.decision") != "usable", F.col("r.reason"))))
    issues = F.when(late, own).when(none, F.concat(own, F.array(F.lit("macro_metrics_missing")))).when(F.col("usable") == 0, F.concat(own, "ws", F.array(F.lit("no_usable_macro_metrics")))).otherwise(F.concat(own, "ws"))
    status = F.when(late | none | (F.col("usable") == 0), "rejected").when(F.size(issues) > 0, "degraded").otherwise("usable")
    return rows.select("release_id", status.alias("status"), F.array_join(issues, "|").alias("issues"))


def event_time(as_of: Column) -> Column:
    """struct(event_at, source, reason, warnings) of a release: its own time, else the vendor's with a warning; a schedule is no time."""
    verdict = release_as_of(as_of, False)
    own, vendor = F.col("released_at"), F.col("vendor_release_at")
    refused = verdict["decision"] == "reject"
    at = F.coalesce(own, vendor)
    warnings = F.array_distinct(F.array_compact(F.array(F.when(own.isNull(), "event_time_uses_vendor_timestamp"), F.when(verdict["decision"] == "usable_with_warning", verdict["reason"]))))
    return F.struct(
        F.when(at.isNotNull() & ~refused, at).alias("event_at"), F.when(own.isNotNull(), "release").when(vendor.isNotNull(), "vendor").alias("source"),
        F.when(at.isNull(), "actual_release_time_missing").when(refused, verdict["reason"]).alias("reason"),
        F.when(at.isNotNull() & ~refused, F.array_join(warnings, "|")).otherwise("").alias("warnings"),
    )
