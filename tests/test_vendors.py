"""Vendor payloads, releases, targets, completeness and citations: golden cases, nulls and absent rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evidence, releases, targets
from tidemark.sources import vendors


def texts(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, t string")


def column(df, expr):
    return [r[0] for r in df.orderBy("k").select(expr).collect()]


def test_counts_and_percents(spark):
    df = texts(spark, "150K", "1.8M", "-20k", "2,500", ".5K", "0.0005K", "x", "", None, "1.5")
    assert [None if v is None else float(v) for v in column(df, vendors.count(F.col("t")))] == [150000, 1800000, -20000, 2500, 500, None, None, None, None, None]
    df = texts(spark, "1.5%", " -0.2 % ", "-", "", "abc", None)
    assert [None if v is None else float(v) for v in column(df, vendors.percent(F.col("t")))] == [1.5, -0.2, None, None, None, None]


def test_scaled_says_why(spark):
    df = texts(spark, "1,234", "1.5", "--", None, "x")
    assert [tuple(v) for v in column(df, vendors.scaled(F.col("t"), F.lit(1), F.lit(True)))] == [(1234.0, "ok"), (None, "not_whole"), (None, "missing"), (None, "missing"), (None, "invalid")]


def test_symbols_and_times(spark):
    assert column(texts(spark, "BRK.B.US", "AAPL.US", "AAPL", None), vendors.plain_symbol(F.col("t"))) == ["BRK.B", "AAPL", "AAPL", None]
    shown = column(texts(spark, "0", "2024-02-29T10:00:00", "soon", None), F.date_format(vendors.vendor_time(F.col("t")), "yyyy-MM-dd HH"))
    assert shown == ["1970-01-01 00", "2024-02-29 10", None, None]


def test_index_that_is_no_positive_number_is_an_error(spark):
    raw = spark.createDataFrame([("A", "2026M7", "-1")], "code string, time_period string, text string")
    with pytest.raises(Exception, match="not a positive index"):
        vendors.index_points(raw, {"A": "pce"}).collect()
    assert vendors.index_points(raw.where("false"), {"A": "pce"}).collect() == []


def test_company_facts_without_the_concept(spark):
    payloads = spark.createDataFrame([(1, '{"facts":{"g":{"c":{"units":{"u":[{"start":"2024-01-01","end":"2024-03-31","val":2.5,"filed":"2024-05-01","form":"10-Q"}]}}}}}'), (2, '{"facts":{}}'), (3, "{"), (4, None)], "company int, payload string")
    assert [(r.company, r.val) for r in vendors.concept_entries(payloads, "g", "c", "u").collect()] == [(1, 2.5)]
    assert vendors.concept_entries(payloads, "g", "c", "other").collect() == []


KEYS = "release_type string, place int, indicator string, measure string, unit string"
RECORDS = "release_type string, release_date date, indicator string, measure string, unit string, period date, vendor_release_at timestamp_ntz, actual double, forecast double"


def build(spark, keys, rows):
    got = spark.sql("SELECT * FROM VALUES " + ", ".join(rows) + " AS t(release_type, release_date, indicator, measure, unit, period, vendor_release_at, actual, forecast)")
    got = got.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in RECORDS.split(", ")])
    out = releases.vendor_releases(got.select("release_type", "release_date").distinct(), got, spark.createDataFrame(keys, KEYS)).collect()
    assert len(out) == 1
    return out[0]


def record(kind, indicator, period, actual="1.5D"):
    return f"('{kind}', DATE '2024-03-14', '{indicator}', 'level', 'persons', DATE '{period}', TIMESTAMP_NTZ '2024-03-14 12:30:00', {actual}, 1.0D)"


WEEKLY = [("weekly_claims", k, i, "level", "persons") for k, i in enumerate(["initial_claims", "initial_claims_4w_avg", "continuing_claims"])]


def test_weekly_release(spark):
    good = [record("weekly_claims", "initial_claims", "2024-03-09"), record("weekly_claims", "initial_claims_4w_avg", "2024-03-09"), record("weekly_claims", "continuing_claims", "2024-03-02")]
    row = build(spark, WEEKLY, good)
    assert row.built and row.n_metrics == 3 and row.warnings == "" and row.metrics[0].estimated_surprise == 0.5
    row = build(spark, WEEKLY, [good[0], record("weekly_claims", "continuing_claims", "2024-03-09")])
    assert not row.built and row.warnings == "weekly_claims_record_count_invalid:initial_claims_4w_avg:level|weekly_claims_period_mismatch"
    row = build(spark, WEEKLY, [good[0], good[0], good[2]])
    assert row.built and row.n_metrics == 1 and row.warnings.endswith("weekly_claims_partial_release:1/3")
    row = build(spark, WEEKLY, [record("weekly_claims", "initial_claims", "2024-03-09", "NULL")])
    assert not row.built and row.warnings.endswith("weekly_claims_actual_missing:initial_claims:level|weekly_claims_no_usable_metrics")


def test_sources_are_never_mixed(spark):
    types = spark.createDataFrame([("a",), ("b",), ("c",)], "release_type string")
    vendor = spark.sql("SELECT * FROM VALUES ('a', DATE '2024-01-02', true), ('b', DATE '2024-01-02', false) AS t(release_type, release_date, built)")
    official = spark.sql("SELECT * FROM VALUES ('a', DATE '2024-01-01'), ('b', DATE '2024-01-01') AS t(release_type, release_date)")
    got = {r.release_type: (r.source, str(r.release_date), r.warnings) for r in releases.prefer(types, vendor, official).collect()}
    assert got == {"a": ("vendor", "2024-01-02", ""), "b": ("official", "2024-01-01", "b_build_failed|b_using_official_fallback"), "c": (None, "None", "c_no_vendor_release")}


def test_targets(spark):
    messages = spark.createDataFrame([(1, "A vs B"), (2, "canvas"), (3, None), (4, "AI"), (5, "$AI")], "message_id int, message string")
    mentions = spark.createDataFrame(
        [(1, 5, "explicit", "B", ["B"]), (1, 0, "explicit", "A", ["A"]), (1, 9, "explicit", "A", ["A"]), (2, 0, "alias", "x", ["A", "B"]), (2, 3, "alias", "y", []), (4, 0, "explicit", "AI", ["AI"]), (5, 0, "explicit", "$AI", ["AI"])],
        "message_id int, start int, source string, text string, candidates array<string>",
    )
    registry = spark.createDataFrame([("A", "A"), ("B", "B"), ("AI", "AI")], "ticker string, symbol string")
    got = {r.message_id: (r.resolved, r.n_ambiguous, r.n_rejected, r.needs_meaning) for r in targets.resolve(messages, mentions, registry).collect()}
    assert got == {1: (["A", "B"], 0, 0, False), 2: ([], 1, 1, True), 3: ([], 0, 0, True), 4: (["AI"], 0, 0, True), 5: (["AI"], 0, 0, False)}


def test_cues(spark):
    df = texts(spark, "A和B", "A VS. B", "canvas", "", None, "1versus2")
    assert column(df, targets.joins_targets(F.col("t"))) == [True, True, False, False, False, False]
    assert column(texts(spark, "过去 12 次", "前五次", "五次", "", None), targets.times_asked(F.col("t"))) == [12, 5, 5, 5, 5]


def test_completeness(spark):
    wanted = spark.createDataFrame([(1, 1, "quote"), (2, 1, "quote"), (3, 1, "quote"), (4, 1, "quote")], "run_id int, company_id int, capability string")
    results = spark.createDataFrame([(1, 1, "quote", True, None), (2, 1, "quote", False, True), (3, 1, "quote", False, None)], "run_id int, company_id int, capability string, usable boolean, outage boolean")
    runs = spark.createDataFrame([(k, 0) for k in range(1, 6)] , "run_id int, retry_count int")
    got = {r.run_id: (r.n_missing, r.status) for r in targets.completeness(runs, targets.missing_information(wanted, results)).collect()}
    assert got == {1: (0, "enough"), 2: (1, "retry"), 3: (1, "cannot_retry"), 4: (1, "retry"), 5: (0, "enough")}


def test_citations_of_runs_without_any(spark):
    runs = spark.createDataFrame([(1, "live", None), (2, "live", "live"), (3, "live", "live"), (4, "live", "live")], "run_id int, request_mode string, output_mode string")
    cited = spark.createDataFrame([(3, "rag:1"), (3, "rag:1"), (4, "other")], "run_id int, evidence_id string")
    given = spark.createDataFrame([(3, "rag:1", "live")], "run_id int, evidence_id string, mode string")
    store = spark.createDataFrame([("rag:1",)], "evidence_id string")
    got = {r.run_id: r.verdict for r in evidence.check_citations(runs, cited, given, store).collect()}
    assert got == {1: "ok", 2: "data_mode_mismatch", 3: "ok", 4: "unknown_evidence_id"}
