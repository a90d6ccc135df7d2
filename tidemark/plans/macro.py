"""Queries over macro series, releases and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import macro
from tidemark.operators import releases as releases_
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import sql

AS_OF = "1999-06-15 12:00:00"


def as_of() -> Column:
    return F.to_timestamp_ntz(F.lit(AS_OF))


def _r6(name: str) -> Column:
    return F.round(name, 6).alias(name)


def _day(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _series(spark: SparkSession, sf_dir: str, variant: str) -> DataFrame:
    return views.monthly_series(spark, sf_dir).where(F.col("variant") == variant).select("series", "period", "value")


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of monthly releases: some have a time, some only a date; their history is verified to different degrees."""
    month = F.month("period")
    date = F.date_add(F.add_months("period", 1), 11)
    status = F.when(month % 3 == 0, "verified").when(month % 3 == 1, "date_verified").otherwise("unverified")
    at = F.to_timestamp_ntz(F.concat(date.cast("string"), F.lit(" 12:30:00")))
    return views.monthly_series(spark, sf_dir).select(
        "series", "variant", "period", F.col("value").alias("actual"), date.alias("release_date"), F.when(month % 4 != 0, at).alias("released_at"),
        status.alias("actual_pit_status"), F.concat(F.lit("r:"), date.cast("string")).alias("release_id"),
    )


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forecasts a metric: untimed, tied, or after the release for some months."""
    month, k = F.month("period"), F.col("k")
    at = F.to_timestamp_ntz(F.concat(F.date_add(F.add_months("period", 1), 11).cast("string"), F.lit(" 12:30:00")))
    known = (
        F.when((month + k) % 4 == 0, None).when((month % 5 == 0) & (k < 2), at - F.expr("INTERVAL 1 DAY"))
        .when((month % 3 == 0) & (k == 2), at + F.expr("INTERVAL 1 DAY")).otherwise(at - F.make_dt_interval(k + 1))
    )
    rows = views.monthly_series(spark, sf_dir).where("variant = 'F'").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select("series", "period", F.concat_ws(":", "series", F.col("period").cast("string"), k.cast("string")).alias("forecast_id"), F.round(F.col("value") * (1 + 0.001 * k), 1).alias("consensus"), at.alias("scheduled_at"), known.alias("forecast_as_of"))


_METRICS = """mt AS (SELECT series, variant, period, value AS actual, ((period + INTERVAL 1 MONTH)::DATE + 11) AS release_date,
  CASE WHEN month(period) % 4 != 0 THEN ((period + INTERVAL 1 MONTH)::DATE + 11)::TIMESTAMP + INTERVAL '12:30:00' END AS released_at,
  CASE month(period) % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'date_verified' ELSE 'unverified' END AS actual_pit_status, 'r:' || ((period + INTERVAL 1 MONTH)::DATE + 11)::VARCHAR AS release_id FROM monthly_series)"""
_CONSENSUS = f"""{_METRICS},
fs AS (SELECT series, period, k, round((value * (1 + 0.001::DOUBLE * k))::DECIMAL(28,10), 1)::DOUBLE AS f, ((period + INTERVAL 1 MONTH)::DATE + 11)::TIMESTAMP + INTERVAL '12:30:00' AS sched FROM monthly_series, (SELECT unnest([0, 1, 2]) AS k) WHERE variant = 'F'),
fc AS (SELECT *, CASE WHEN (month(period) + k) % 4 = 0 THEN NULL WHEN month(period) % 5 = 0 AND k < 2 THEN sched - INTERVAL 1 DAY WHEN month(period) % 3 = 0 AND k = 2 THEN sched + INTERVAL 1 DAY ELSE sched - to_days(k::INT + 1) END AS known FROM fs),
kn AS (SELECT m.series, m.period, fc.* EXCLUDE (series, period), released_at FROM mt m JOIN fc ON m.series = fc.series AND m.period = fc.period WHERE m.variant = 'F'),
bs AS (SELECT series, period, max(known) AS last FROM kn WHERE known < released_at GROUP BY ALL),
vf AS (SELECT kn.series, kn.period, count(*) AS n, max(f) AS f, max(last) AS last FROM kn JOIN bs ON bs.series = kn.series AND bs.period = kn.period AND known = last GROUP BY ALL),
uv AS (SELECT series, period, count(*) AS n, max(f) AS f FROM kn WHERE known IS NULL GROUP BY ALL),
cs AS (SELECT m.*, CASE WHEN vf.n IS NOT NULL THEN CASE WHEN vf.n = 1 THEN vf.f END WHEN uv.n = 1 THEN uv.f END AS consensus, CASE WHEN vf.n = 1 THEN vf.last END AS forecast_as_of,
  CASE WHEN vf.n = 1 THEN true WHEN vf.n IS NULL AND uv.n = 1 THEN false END AS pit_verified
  FROM mt m LEFT JOIN vf USING (series, period) LEFT JOIN uv USING (series, period) WHERE variant = 'F')"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.match_consensus(metrics(spark, sf_dir).where("variant = 'F'"), forecasts(spark, sf_dir))


_SHIFT = """s AS (SELECT a.series, a.variant, a.period, a.value, b.value AS m1, c.value AS m12 FROM monthly_series a
LEFT JOIN monthly_series b ON a.series = b.series AND a.variant = b.variant AND a.period = (b.period + INTERVAL 1 MONTH)::DATE
LEFT JOIN monthly_series c ON a.series = c.series AND a.variant = c.variant AND a.period = (c.period + INTERVAL 12 MONTH)::DATE)"""


@query(sql("monthly_series", f"{_SHIFT} SELECT series, variant, period::VARCHAR AS period, round((value / m1 - 1) * 100, 6) AS mom, round((value / m12 - 1) * 100, 6) AS yoy FROM s"))
def j13_series_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = macro.shifted(views.monthly_series(spark, sf_dir).select("series", "variant", "period", "value"), ["series", "variant"], [1, 12])
    v = F.col("value")
    return moved.select("series", "variant", _day("period"), F.round(macro.pct_change(v, F.col("value_m1")), 6).alias("mom"), F.round(macro.pct_change(v, F.col("value_m12")), 6).alias("yoy"))


def _back(alias: str, variant: str, n: int) -> str:
    return f"(SELECT value FROM monthly_series b WHERE b.series = {alias}.series AND b.variant = '{variant}' AND b.period = ({alias}.period - INTERVAL {n} MONTH)::DATE)"


@query(sql("monthly_series", f"""x AS (SELECT a.series, a.period, (a.value / {_back('a', 'F', 1)} - 1) * 100 AS mom, ({_back('a', 'F', 1)} / {_back('a', 'F', 2)} - 1) * 100 AS previous_mom,
({_back('a', 'O', 0)} / {_back('a', 'O', 12)} - 1) * 100 AS yoy, ({_back('a', 'O', 1)} / {_back('a', 'O', 13)} - 1) * 100 AS previous_yoy FROM monthly_series a WHERE a.variant = 'F'),
y AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS k FROM x WHERE mom IS NOT NULL AND yoy IS NOT NULL)
SELECT series, period::VARCHAR AS period, round(mom, 6) AS mom, round(previous_mom, 6) AS previous_mom, round(yoy, 6) AS yoy, round(previous_yoy, 6) AS previous_yoy FROM y WHERE k = 1"""))
def c01_inflation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = macro.inflation_reading(_series(spark, sf_dir, "F"), _series(spark, sf_dir, "O"))
    return found.select("series", _day("period"), *[_r6(c) for c in ("mom", "previous_mom", "yoy", "previous_yoy")])


@query(sql("monthly_series", f"""x AS (SELECT a.series, a.period, a.value, {_back('a', 'F', 1)} AS m1, {_back('a', 'F', 2)} AS m2, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS k FROM monthly_series a WHERE variant = 'F')
SELECT series, period::VARCHAR AS period, round((value - m1) * 1000, 4) AS actual, round((m1 - m2) * 1000, 4) AS previous FROM x WHERE k = 1 AND m1 IS NOT NULL"""))
def c04_payrolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.level_change(_series(spark, sf_dir, "F"), 1000).select("series", _day("period"), F.round("actual", 4).alias("actual"), F.round("previous", 4).alias("previous"))


@query(sql("monthly_series", f"""x AS (SELECT a.series, a.period, a.value, {_back('a', 'O', 1)} AS m1, {_back('a', 'O', 2)} AS m2, {_back('a', 'O', 12)} AS m12, {_back('a', 'O', 13)} AS m13, row_number() OVER (PARTITION BY series ORDER BY period DESC) AS k FROM monthly_series a WHERE variant = 'O'),
y AS (SELECT series, period, 'level' AS measure, value AS actual, m1 AS previous FROM x WHERE k = 1 UNION ALL SELECT series, period, 'mom', (value / m1 - 1) * 100, (m1 / m2 - 1) * 100 FROM x WHERE k = 1
UNION ALL SELECT series, period, 'yoy', (value / m12 - 1) * 100, (m1 / m13 - 1) * 100 FROM x WHERE k = 1)
SELECT series, period::VARCHAR AS period, measure, round(actual, 6) AS actual, round(previous, 6) AS previous FROM y WHERE actual IS NOT NULL"""))
def c06_level_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.level_metrics(_series(spark, sf_dir, "O")).select("series", _day("period"), "measure", _r6("actual"), _r6("previous"))


@query(sql("weekly_counts", "SELECT a.series, a.week::VARCHAR AS week, a.claims, b.claims AS previous, a.claims - b.claims AS change FROM weekly_counts a LEFT JOIN weekly_counts b ON a.series = b.series AND a.week = b.week + 7"))
def j14_weekly_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.weekly_reading(views.weekly_counts(spark, sf_dir)).select("series", _day("week"), "claims", "previous", "change")


@query(sql("curve_points", """p AS (SELECT day, max(yield_pct) FILTER (tenor = '3m') AS a, max(yield_pct) FILTER (tenor = '2y') AS b, max(yield_pct) FILTER (tenor = '10y') AS c, max(yield_pct) FILTER (tenor = '30y') AS d
FROM curve_points WHERE day <= DATE '1999-06-15' GROUP BY day HAVING count(DISTINCT tenor) = 4),
l AS (SELECT *, lag(a) OVER w AS a1, lag(b) OVER w AS b1, lag(c) OVER w AS c1, lag(d) OVER w AS d1 FROM p WINDOW w AS (ORDER BY day))
SELECT day::VARCHAR AS day, round(a, 6) AS yield_3m, round(b, 6) AS yield_2y, round(c, 6) AS yield_10y, round(d, 6) AS yield_30y, round((a - a1) * 100, 6) AS change_3m, round((b - b1) * 100, 6) AS change_2y,
round((c - c1) * 100, 6) AS change_10y, round((d - d1) * 100, 6) AS change_30y, round((c - b) * 100, 6) AS spread_10y_2y, round((c - a) * 100, 6) AS spread_10y_3m,
(DATE '1999-06-15' - day)::INT AS age_days, (DATE '1999-06-15' - day) > 7 AS stale FROM l ORDER BY l.day DESC LIMIT 1"""))
def a05_curve_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = macro.curve_snapshot(views.curve_points(spark, sf_dir), AS_OF[:10])
    return found.select(_day("day"), *[_r6(c) for c in found.columns if c not in ("day", "age_days", "stale")], "age_days", "stale")


_RANGES = """d AS (SELECT tenor AS series, day, floor(yield_pct) AS lower, floor(yield_pct) + 0.25 AS upper FROM curve_points),
r AS (SELECT * FROM (SELECT *, row_number() OVER w AS k, lower IS NOT DISTINCT FROM lag(lower) OVER w AND upper IS NOT DISTINCT FROM lag(upper) OVER w AS same FROM d WINDOW w AS (PARTITION BY series ORDER BY day)) WHERE k = 1 OR NOT same)"""


def _policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.floor("yield_pct").cast("double")
    return macro.policy_ranges(views.curve_points(spark, sf_dir).select(F.col("tenor").alias("series"), "day", low.alias("lower"), (low + 0.25).alias("upper")))


@query(sql("curve_points", f"{_RANGES} SELECT series, day::VARCHAR AS day, lower::DOUBLE AS lower, upper::DOUBLE AS upper FROM r"))
def a07_policy_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy(spark, sf_dir).select("series", _day("day"), "lower", "upper")


@query(sql("curve_points", f"""{_RANGES}, c AS (SELECT *, (upper - lag(upper) OVER w) * 100 AS change_bp, lead(day) OVER w IS NULL AS last FROM r WINDOW w AS (PARTITION BY series ORDER BY day))
SELECT series, day::VARCHAR AS day, lower::DOUBLE AS lower, upper::DOUBLE AS upper, change_bp::DOUBLE AS change_bp FROM c WHERE last"""))
def a08_policy_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.policy_change(_policy(spark, sf_dir)).select("series", _day("day"), "lower", "upper", "change_bp")


@query(sql("monthly_series", f"{_CONSENSUS} SELECT series, period::VARCHAR AS period, consensus, forecast_as_of::VARCHAR AS forecast_as_of, pit_verified FROM cs"))
def j12_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("series", _day("period"), "consensus", F.date_format("forecast_as_of", "yyyy-MM-dd HH:mm:ss").alias("forecast_as_of"), "pit_verified")


@query(sql("monthly_series", f"""{_CONSENSUS} SELECT series, period::VARCHAR AS period, consensus, round(CASE WHEN pit_verified THEN round(actual::DECIMAL(28,10), 1)::DOUBLE - consensus END, 6) AS surprise,
CASE WHEN consensus IS NOT NULL THEN coalesce(pit_verified, false) AND actual_pit_status != 'verified' END AS surprise_is_estimated FROM cs"""))
def c08_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.surprise(_matched(spark, sf_dir)).select("series", _day("period"), "consensus", _r6("surprise"), "surprise_is_estimated")


_EASTERN = "timezone('America/New_York', timezone('UTC', {}))::DATE"
_NOW = f"TIMESTAMP '{AS_OF}'"


def _metric_case(strict: bool, part: int) -> str:
    rows = [("released_at > now", "reject", "released_after_as_of"), (f"released_at IS NULL AND release_date > {_EASTERN.format('now')}", "reject", "release_date_after_as_of")]
    if strict:
        rows += [("actual_pit_status = 'verified'", "usable", "pit_verified"), ("actual_pit_status = 'date_verified'", "usable_with_warning", "pit_verified_at_date_precision_only"), ("true", "reject", "actual_pit_unverified")]
    else:
        rows += [("actual_pit_status = 'unverified'", "usable_with_warning", "historical_revision_not_verified"), ("true", "usable", "available")]
    return "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[part]}'" for r in rows) + " END"


@query(sql("monthly_series", f"""{_METRICS}, n AS (SELECT *, {_NOW} AS now FROM mt)
SELECT series, variant, period::VARCHAR AS period, {_metric_case(False, 1)} AS decision, {_metric_case(False, 2)} AS reason, {_metric_case(True, 1)} AS strict_decision, {_metric_case(True, 2)} AS strict_reason FROM n"""))
def f04_metric_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = metrics(spark, sf_dir).withColumn("a", macro.metric_as_of(as_of(), False)).withColumn("b", macro.metric_as_of(as_of(), True))
    return rated.select("series", "variant", _day("period"), F.col("a.decision").alias("decision"), F.col("a.reason").alias("reason"), F.col("b.decision").alias("strict_decision"), F.col("b.reason").alias("strict_reason"))


@query(sql("monthly_series", f"""{_CONSENSUS} SELECT series, period::VARCHAR AS period,
CASE WHEN consensus IS NULL OR pit_verified THEN 'usable' ELSE 'usable_with_warning' END AS decision, CASE WHEN consensus IS NULL THEN 'consensus_missing' WHEN pit_verified THEN 'consensus_pit_verified' ELSE 'consensus_pit_unverified' END AS reason,
CASE WHEN consensus IS NULL OR pit_verified THEN 'usable' ELSE 'reject' END AS strict_decision FROM cs"""))
def f05_consensus_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = _matched(spark, sf_dir).withColumn("a", macro.consensus_usable(False)).withColumn("b", macro.consensus_usable(True))
    return rated.select("series", _day("period"), F.col("a.decision").alias("decision"), F.col("a.reason").alias("reason"), F.col("b.decision").alias("strict_decision"))


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release per date of the metrics: with a time, a vendor's time, or a date; some with a wrong date or an unknown source."""
    month = F.month("release_date")
    base = metrics(spark, sf_dir).select("release_id", "release_date").distinct()
    at = F.to_timestamp_ntz(F.concat(F.col("release_date").cast("string"), F.lit(" 12:30:00")))
    night = F.to_timestamp_ntz(F.concat(F.col("release_date").cast("string"), F.lit(" 02:00:00")))
    return base.select(
        "release_id", "release_date", F.when(month % 3 == 0, at).alias("released_at"),
        F.when(month % 3 == 1, F.when(month == 7, night).otherwise(at)).alias("vendor_release_at"),
        F.when(month % 5 == 0, "unknown").otherwise("fred").alias("release_date_source"), F.when(month % 4 == 0, "latest_assumed").otherwise("verified").alias("period_binding"),
    )


_RELEASES = f"""{_METRICS}, rb AS (SELECT DISTINCT release_id, release_date FROM mt),
rl AS (SELECT release_id, release_date, CASE WHEN month(release_date) % 3 = 0 THEN release_date::TIMESTAMP + INTERVAL '12:30:00' END AS released_at,
  CASE WHEN month(release_date) = 7 THEN release_date::TIMESTAMP + INTERVAL '02:00:00' WHEN month(release_date) % 3 = 1 THEN release_date::TIMESTAMP + INTERVAL '12:30:00' END AS vendor_release_at,
  CASE WHEN month(release_date) % 5 = 0 THEN 'unknown' ELSE 'fred' END AS release_date_source, CASE WHEN month(release_date) % 4 = 0 THEN 'latest_assumed' ELSE 'verified' END AS period_binding, {_NOW} AS now FROM rb)"""


def _release_case(strict: bool, part: int) -> str:
    at = "coalesce(released_at, vendor_release_at)"
    vendor = "(released_at IS NULL AND vendor_release_at IS NOT NULL)"
    rows = [
        (f"{at} > now AND {vendor}", "reject", "vendor_release_after_as_of"), (f"{at} > now", "reject", "release_not_yet_published"),
        (f"{at} IS NOT NULL AND {_EASTERN.format(at)} != release_date AND {vendor}", "reject", "vendor_release_date_time_conflict"), (f"{at} IS NOT NULL AND {_EASTERN.format(at)} != release_date", "reject", "release_date_time_conflict"),
        (f"{at} IS NULL AND release_date >= {_EASTERN.format('now')}", "reject", "exact_release_time_unverified"),
    ]
    if strict:
        rows += [(f"{at} IS NULL", "reject", "exact_release_time_missing"), ("release_date_source = 'unknown'", "reject", "release_date_source_unverified"), (vendor, "reject", "vendor_release_time_unverified"), ("period_binding != 'verified'", "reject", "release_period_binding_unverified")]
    else:
        rows += [("release_date_source = 'unknown'", "usable_with_warning", "release_date_source_unverified"), ("period_binding != 'verified'", "usable_with_warning", "release_period_binding_unverified"), (vendor, "usable_with_warning", "event_time_uses_vendor_timestamp")]
    rows.append(("true", "usable", "available"))
    return "CASE " + " ".join(f"WHEN {r[0]} THEN '{r[part]}'" for r in rows) + " END"


@query(sql("monthly_series", f"{_RELEASES} SELECT release_id, {_release_case(False, 1)} AS decision, {_release_case(False, 2)} AS reason, {_release_case(True, 1)} AS strict_decision, {_release_case(True, 2)} AS strict_reason FROM rl"))
def f06_release_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = releases(spark, sf_dir).withColumn("a", macro.release_as_of(as_of(), False)).withColumn("b", macro.release_as_of(as_of(), True))
    return rated.select("release_id", F.col("a.decision").alias("decision"), F.col("a.reason").alias("reason"), F.col("b.decision").alias("strict_decision"), F.col("b.reason").alias("strict_reason"))


@query(sql("monthly_series", f"""{_RELEASES}, jr AS (SELECT *, {_release_case(False, 1)} AS d, {_release_case(False, 2)} AS why FROM rl),
n AS (SELECT *, {_NOW} AS now FROM mt), jm AS (SELECT *, {_metric_case(False, 1)} AS md, {_metric_case(False, 2)} AS mw FROM n),
ag AS (SELECT release_id, count(*) FILTER (md != 'reject') AS n_metrics, string_agg(series || ':' || variant || ':' || mw, '|' ORDER BY series, variant) FILTER (md != 'usable') AS w FROM jm GROUP BY release_id)
SELECT release_id, n_metrics, d AS decision, concat_ws('|', CASE WHEN d = 'usable_with_warning' THEN why END, w) AS warnings FROM jr JOIN ag USING (release_id) WHERE d != 'reject' AND n_metrics > 0"""))
def f08_releases_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = metrics(spark, sf_dir).withColumn("consensus", F.lit(None).cast("double")).withColumn("pit_verified", F.lit(None).cast("boolean"))
    return macro.releases_as_of(releases(spark, sf_dir), plain, as_of(), False)


@query(sql("monthly_series", f"""{_CONSENSUS} SELECT series, period::VARCHAR AS period, CASE WHEN pit_verified THEN consensus END AS consensus,
round(CASE WHEN pit_verified AND actual_pit_status = 'verified' THEN round(actual::DECIMAL(28,10), 1)::DOUBLE - consensus END, 6) AS surprise FROM cs"""))
def f09_strict_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.strict_metric(macro.surprise(_matched(spark, sf_dir))).select("series", _day("period"), "consensus", _r6("surprise"))


@query(sql("monthly_series", f"{_METRICS} SELECT DISTINCT release_date::VARCHAR AS release_date FROM mt WHERE release_date <= DATE '1999-06-15' ORDER BY 1 DESC LIMIT 12"))
def f16_release_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = metrics(spark, sf_dir).select("release_date").where(F.col("release_date") <= F.to_date(F.lit(AS_OF[:10]))).distinct()
    return dates.orderBy(F.desc("release_date")).limit(12).select(_day("release_date"))


#: The official release types and what stands for their indicators: a series of monthly means or counts, or of weekly counts.
WEEKLY = {"initial_claims": "1-URGENT", "initial_claims_4w_avg": "2-HIGH", "continuing_claims": "3-MEDIUM"}
OFFICIAL_DAY = "1999-01-12"


def official_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest readings of five release types: cpi and ppi of a seasonal pair each, pce of one series, employment of three, claims of weeks."""
    f, o = _series(spark, sf_dir, "F"), _series(spark, sf_dir, "O")
    persons = views.monthly_series(spark, sf_dir).where("variant = 'F'").select("series", "period", F.col("persons").cast("double").alias("value"))

    def of(rows: DataFrame, release_type: str, indicator: str | None, measure: str | None = None) -> DataFrame:
        name = F.col("series") if indicator is None else F.lit(indicator)
        return rows.select(F.lit(release_type).alias("release_type"), name.alias("indicator"), F.col("measure") if measure is None else F.lit(measure).alias("measure"), "period", "actual", "previous")

    def only(rows: DataFrame, series: str) -> DataFrame:
        return rows.where(F.col("series") == series)

    weeks = macro.newest(macro.weekly_reading(views.weekly_counts(spark, sf_dir).where(F.col("series").isin(*WEEKLY.values()))), ["series"], "week")
    name = F.create_map(*[F.lit(x) for k, v in WEEKLY.items() for x in (v, k)])[F.col("series")]
    claims = weeks.select(F.lit("weekly_claims").alias("release_type"), name.alias("indicator"), F.lit("level").alias("measure"), F.col("week").alias("period"), F.col("claims").cast("double").alias("actual"), F.col("previous").cast("double").alias("previous"))
    parts = [
        of(macro.inflation_metrics(macro.inflation_reading(only(f, "A"), only(o, "A"))), "cpi", "cpi"), of(macro.inflation_metrics(macro.inflation_reading(only(f, "N"), only(o, "N"))), "ppi", "ppi"),
        of(macro.inflation_metrics(macro.inflation_reading(only(f, "R"), only(f, "R"))), "pce", "pce"), of(macro.level_change(only(persons, "A"), 1.0), "employment_situation", "nonfarm_payrolls", "change"),
        of(macro.newest_level(only(f, "N")), "employment_situation", "unemployment_rate", "level"), of(macro.level_metrics(only(f, "R")), "employment_situation", "average_hourly_earnings"), claims,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_OFFICIAL = f"""inf AS (SELECT a.series, a.period, (a.value / {_back('a', 'F', 1)} - 1) * 100 AS mom, ({_back('a', 'F', 1)} / {_back('a', 'F', 2)} - 1) * 100 AS pmom,
  ({_back('a', 'O', 0)} / {_back('a', 'O', 12)} - 1) * 100 AS yoy, ({_back('a', 'O', 1)} / {_back('a', 'O', 13)} - 1) * 100 AS pyoy, (a.value / {_back('a', 'F', 12)} - 1) * 100 AS yoyf, ({_back('a', 'F', 1)} / {_back('a', 'F', 13)} - 1) * 100 AS pyoyf,
  a.value, {_back('a', 'F', 1)} AS m1, a.persons::DOUBLE AS persons, (SELECT persons::DOUBLE FROM monthly_series b WHERE b.series = a.series AND b.variant = 'F' AND b.period = (a.period - INTERVAL 1 MONTH)::DATE) AS p1,
  (SELECT persons::DOUBLE FROM monthly_series b WHERE b.series = a.series AND b.variant = 'F' AND b.period = (a.period - INTERVAL 2 MONTH)::DATE) AS p2 FROM monthly_series a WHERE a.variant = 'F'),
pair AS (SELECT * FROM inf WHERE mom IS NOT NULL AND yoy IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY period DESC) = 1), one AS (SELECT * FROM inf WHERE mom IS NOT NULL AND yoyf IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series ORDER BY period DESC) = 1),
last AS (SELECT * FROM inf QUALIFY row_number() OVER (PARTITION BY series ORDER BY period DESC) = 1),
wk AS (SELECT a.series, a.week, a.claims::DOUBLE AS claims, b.claims::DOUBLE AS previous FROM weekly_counts a LEFT JOIN weekly_counts b ON a.series = b.series AND b.week = a.week - 7 WHERE a.series < '4' QUALIFY row_number() OVER (PARTITION BY a.series ORDER BY a.week DESC) = 1),
om AS (
  SELECT CASE series WHEN 'A' THEN 'cpi' ELSE 'ppi' END AS rt, CASE series WHEN 'A' THEN 'cpi' ELSE 'ppi' END AS indicator, 'mom' AS measure, period, mom AS actual, pmom AS previous FROM pair WHERE series IN ('A', 'N')
  UNION ALL SELECT CASE series WHEN 'A' THEN 'cpi' ELSE 'ppi' END, CASE series WHEN 'A' THEN 'cpi' ELSE 'ppi' END, 'yoy', period, yoy, pyoy FROM pair WHERE series IN ('A', 'N')
  UNION ALL SELECT 'pce', 'pce', 'mom', period, mom, pmom FROM one WHERE series = 'R' UNION ALL SELECT 'pce', 'pce', 'yoy', period, yoyf, pyoyf FROM one WHERE series = 'R'
  UNION ALL SELECT 'employment_situation', 'nonfarm_payrolls', 'change', period, persons - p1, p1 - p2 FROM last WHERE series = 'A' AND p1 IS NOT NULL
  UNION ALL SELECT 'employment_situation', 'unemployment_rate', 'level', period, value, m1 FROM last WHERE series = 'N'
  UNION ALL SELECT * FROM (SELECT 'employment_situation', 'average_hourly_earnings', unnest(['level', 'mom', 'yoy']), period, unnest([value, mom, yoyf]) AS v, unnest([m1, pmom, pyoyf]) FROM last WHERE series = 'R') WHERE v IS NOT NULL
  UNION ALL SELECT 'weekly_claims', CASE series WHEN '1-URGENT' THEN 'initial_claims' WHEN '2-HIGH' THEN 'initial_claims_4w_avg' ELSE 'continuing_claims' END, 'level', week, claims, previous FROM wk)"""


@query(sql("monthly_series weekly_counts", f"{_OFFICIAL} SELECT rt AS release_type, indicator, measure, period::VARCHAR AS period, round(actual, 6) AS actual, round(previous, 6) AS previous FROM om"))
def c09_official_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of inflation (C03), levels (C05), earnings, payrolls and claims in one form of record."""
    return official_metrics(spark, sf_dir).select("release_type", "indicator", "measure", _day("period"), _r6("actual"), _r6("previous"))


@query(sql("monthly_series", f"{_OFFICIAL.split('wk AS')[0].rstrip().rstrip(',')} SELECT series, period::VARCHAR AS period, measure, round(actual, 6) AS actual, round(previous, 6) AS previous FROM (SELECT series, period, unnest(['mom', 'yoy']) AS measure, unnest([mom, yoy]) AS actual, unnest([pmom, pyoy]) AS previous FROM pair)"))
def c03_inflation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = macro.inflation_metrics(macro.inflation_reading(_series(spark, sf_dir, "F"), _series(spark, sf_dir, "O")))
    return found.select("series", _day("period"), "measure", _r6("actual"), _r6("previous"))


@query(sql("monthly_series", f"{_OFFICIAL.split('wk AS')[0].rstrip().rstrip(',')} SELECT series, period::VARCHAR AS period, round(value, 6) AS actual, round(m1, 6) AS previous FROM last"))
def c05_newest_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro.newest_level(_series(spark, sf_dir, "F")).select("series", _day("period"), _r6("actual"), _r6("previous"))


def official_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release dates: on a day of the next month for each type and period, and five days after a week."""
    months = views.monthly_series(spark, sf_dir).select("period").distinct()
    days = F.array(*[F.struct(F.lit(t).alias("release_type"), F.lit(d).alias("lag")) for t, d in (("cpi", 11), ("ppi", 13), ("pce", 27), ("employment_situation", 4))])
    monthly = months.select("period", F.inline(days)).select("release_type", F.expr("date_add(add_months(period, 1), lag)").alias("release_date"))
    return monthly.unionByName(views.weekly_counts(spark, sf_dir).select(F.lit("weekly_claims").alias("release_type"), F.date_add("week", 5).alias("release_date")).distinct())


def official_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts of the metrics for the day of their release: two of most, one of some, with one time or two."""
    at = official_dates(spark, sf_dir).where(F.col("release_date") <= F.to_date(F.lit(OFFICIAL_DAY))).groupBy("release_type").agg(F.max("release_date").alias("release_date"))
    n = F.length("indicator")
    base = official_metrics(spark, sf_dir).join(at, "release_type").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).where((F.col("k") == 0) | (n % 2 == 0))
    hour = F.when((F.col("release_type") == "ppi") & (F.col("k") == 0) & (F.col("measure") == "yoy"), F.expr("INTERVAL 15 HOURS")).otherwise(F.expr("INTERVAL 13 HOURS"))
    known = F.when((F.col("k") == 1) & (n % 4 == 0), F.to_timestamp_ntz(F.lit("1998-12-01 00:00:00")))
    return base.select("indicator", "measure", "period", F.concat_ws(":", "indicator", "measure", "k").alias("forecast_id"), (F.round("actual", 1) - 0.1 * F.col("k")).alias("consensus"), known.alias("forecast_as_of"), (F.col("release_date").cast("timestamp_ntz") + hour).alias("scheduled_at"))


@query(sql("monthly_series weekly_counts", f"""{_OFFICIAL},
dt AS (SELECT unnest(['cpi', 'ppi', 'pce', 'employment_situation']) AS rt, (period + INTERVAL 1 MONTH)::DATE + unnest([11, 13, 27, 4]) AS rd FROM (SELECT DISTINCT period FROM monthly_series) UNION ALL SELECT 'weekly_claims', week + 5 FROM weekly_counts),
la AS (SELECT rt, max(rd) AS rd FROM dt WHERE rd <= DATE '{OFFICIAL_DAY}' GROUP BY rt),
fc AS (SELECT om.rt, indicator, measure, period, k, round(actual::DECIMAL(28, 10), 1)::DOUBLE - 0.1 * k AS f, k = 1 AND length(indicator) % 4 = 0 AS timed, rd + CASE WHEN om.rt = 'ppi' AND k = 0 AND measure = 'yoy' THEN INTERVAL 15 HOUR ELSE INTERVAL 13 HOUR END AS sched FROM om JOIN la USING (rt), (SELECT unnest([0, 1]) AS k) WHERE k = 0 OR length(indicator) % 2 = 0),
co AS (SELECT rt, indicator, measure, period, CASE WHEN count(*) FILTER (NOT timed) = 1 THEN max(f) FILTER (NOT timed) END AS consensus FROM fc GROUP BY ALL),
ti AS (SELECT rt, min(sched) AS low, max(sched) AS high FROM fc GROUP BY rt),
li AS (SELECT rt, count(DISTINCT period) AS periods, string_agg(indicator || ':' || measure || ':' || period || ':' || CASE WHEN consensus IS NULL THEN 'none' ELSE 'assumed' END, '|' ORDER BY indicator, measure) AS metrics, count(*)::BIGINT AS n FROM om LEFT JOIN co USING (rt, indicator, measure, period) GROUP BY rt),
r AS (SELECT *, CASE WHEN rd = DATE '{OFFICIAL_DAY}' THEN rt || '_release_time_unverified' WHEN rt = 'employment_situation' AND periods > 1 THEN 'employment_period_mismatch' END AS warning FROM la LEFT JOIN li USING (rt) LEFT JOIN ti USING (rt))
SELECT rt AS release_type, CASE WHEN warning IS NULL AND n > 0 THEN rt || ':' || rd END AS release_id, CASE WHEN warning IS NULL AND n > 0 AND low = high THEN strftime(low, '%Y-%m-%d %H:%M:%S') END AS scheduled_release_at,
  CASE WHEN warning IS NULL AND n > 0 AND low = high THEN 'trading_economics' END AS schedule_source, CASE WHEN warning IS NULL AND n > 0 THEN metrics END AS metrics, warning FROM r"""))
def c10_official_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest release of each official type; that of the very day isn't built."""
    found = releases_.official_releases(official_dates(spark, sf_dir), official_metrics(spark, sf_dir), official_forecasts(spark, sf_dir), F.to_date(F.lit(OFFICIAL_DAY)))
    line = F.transform("metrics", lambda m: F.concat_ws(":", m["indicator"], m["measure"], m["period"].cast("string"), F.when(m["consensus"].isNull(), "none").when(m["surprise_is_estimated"], "verified").otherwise("assumed")))
    return found.select("release_type", "release_id", F.date_format("scheduled_release_at", "yyyy-MM-dd HH:mm:ss").alias("scheduled_release_at"), "schedule_source", F.array_join(line, "|").alias("metrics"), "warning")
