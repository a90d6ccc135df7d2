"""Queries over release assembly, targets, completeness, citations and run records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import evidence, releases, targets
from tidemark.plans.registry import query
from tidemark.sources import views
from tidemark.sources.views import read, sql

AS_OF = "1999-06-15 18:30:00"


def as_of():
    return F.to_timestamp_ntz(F.lit(AS_OF))


def keys(spark: SparkSession) -> DataFrame:
    rows = [(t, k, t, v, "percent") for t in "ANR" for k, v in enumerate("FO")]
    rows += [("weekly_claims", k, i, "level", "persons") for k, i in enumerate(["initial_claims", "initial_claims_4w_avg", "continuing_claims"])]
    return spark.createDataFrame(rows, "release_type string, place int, indicator string, measure string, unit string")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor records: monthly ones on the 12th of the next month, weekly ones five days after the week; faults by date."""
    month, series = F.month("period"), F.col("series")
    day = F.date_add(F.add_months("period", 1), 11)
    plain = F.col("variant") == "F"
    monthly = views.monthly_series(spark, sf_dir).select(
        series.alias("release_type"), day.alias("release_date"), series.alias("indicator"), F.col("variant").alias("measure"), F.when((month == 2) & plain, "jobs").otherwise("percent").alias("unit"),
        F.when((month == 3) & plain, F.add_months("period", -1)).otherwise(F.col("period")).alias("period"),
        F.when((month == 4) & plain, None).otherwise(day.cast("timestamp_ntz") + F.when((month == 5) & plain, F.expr("INTERVAL 2 HOURS")).when((month == 6) & plain, F.expr("INTERVAL 15 HOURS")).otherwise(F.expr("INTERVAL 13 HOURS"))).alias("vendor_release_at"),
        F.when((month == 7) | ((month == 8) & plain), None).otherwise(F.col("persons")).cast("double").alias("actual"), F.lit(10.0).alias("forecast"),
    )
    doubled = monthly.where((F.month("release_date") == 10) & (F.col("measure") == "O"))
    names = {"1-URGENT": ("initial_claims", 0), "2-HIGH": ("initial_claims_4w_avg", 0), "3-MEDIUM": ("continuing_claims", 7)}
    indicator, lag = F.lit(None).cast("string"), F.lit(None).cast("int")
    for source, (name, days) in names.items():
        indicator, lag = F.when(F.col("series") == source, name).otherwise(indicator), F.when(F.col("series") == source, days).otherwise(lag)
    week = F.col("week")
    weekly = views.weekly_counts(spark, sf_dir).where(F.col("series").isin(*names)).select(
        F.lit("weekly_claims").alias("release_type"), F.date_add("week", 5).alias("release_date"), indicator.alias("indicator"), F.lit("level").alias("measure"), F.lit("persons").alias("unit"),
        F.date_sub(week, F.when((F.dayofmonth(week) % 5 == 0) & (indicator == "continuing_claims"), 0).otherwise(lag)).alias("period"),
        (F.date_add("week", 5).cast("timestamp_ntz") + F.expr("INTERVAL 13 HOURS")).alias("vendor_release_at"), F.col("claims").cast("double").alias("actual"), F.lit(None).cast("double").alias("forecast"),
    )
    return monthly.unionByName(doubled).unionByName(weekly)


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return releases.vendor_releases(rows.select("release_type", "release_date").distinct(), rows, keys(spark))


_RECORDS = """m0 AS (SELECT series, variant, period, month(period) AS m, variant = 'F' AS f, (period + INTERVAL 1 MONTH + INTERVAL 11 DAY)::DATE AS rd, persons FROM monthly_series),
m1 AS (SELECT series AS rt, rd, CASE variant WHEN 'F' THEN 0 ELSE 1 END AS place, series || ':' || variant AS label, m = 2 AND f AS odd_unit, CASE WHEN m = 3 AND f THEN (period - INTERVAL 1 MONTH)::DATE ELSE period END AS period,
  CASE WHEN m = 4 AND f THEN NULL ELSE rd + CASE WHEN m = 5 AND f THEN INTERVAL 2 HOUR WHEN m = 6 AND f THEN INTERVAL 15 HOUR ELSE INTERVAL 13 HOUR END END AS vat, CASE WHEN m = 7 OR (m = 8 AND f) THEN NULL ELSE persons::DOUBLE END AS actual,
  m = 5 AND f AS odd_day, month(rd) = 10 AND variant = 'O' AS doubled FROM m0),
w0 AS (SELECT 'weekly_claims' AS rt, week + 5 AS rd, CASE series WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS place, week, claims FROM weekly_counts WHERE series IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
w1 AS (SELECT rt, rd, place, CASE place WHEN 0 THEN 'initial_claims:level' WHEN 1 THEN 'initial_claims_4w_avg:level' ELSE 'continuing_claims:level' END AS label, false AS odd_unit, CASE WHEN place < 2 OR day(week) % 5 = 0 THEN week ELSE week - 7 END AS period,
  rd + INTERVAL 13 HOUR AS vat, claims::DOUBLE AS actual, false AS odd_day, false AS doubled FROM w0),
rc AS (SELECT * FROM m1 UNION ALL SELECT * FROM w1), rl AS (SELECT DISTINCT rt, rd FROM rc),
ks AS (SELECT DISTINCT rt, place, label FROM rc),
kr AS (SELECT rl.rt, rl.rd, ks.place, ks.label, rc.period, rc.vat, rc.actual, CASE WHEN rc.rt IS NULL OR doubled THEN 'record_count_invalid' WHEN odd_unit THEN 'record_identity_mismatch' WHEN vat IS NULL THEN 'release_time_missing' WHEN odd_day THEN 'release_date_mismatch' END AS fault
  FROM rl JOIN ks USING (rt) LEFT JOIN rc ON rc.rt = rl.rt AND rc.rd = rl.rd AND rc.place = ks.place),
en AS (SELECT rt, rd, min(place) FILTER (fault IN ('record_identity_mismatch', 'release_date_mismatch')) AS ends, count(*) AS want, count(*) FILTER (fault IS NULL) AS ok, count(*) FILTER (fault IS NULL AND actual IS NOT NULL) AS have,
  count(DISTINCT period) FILTER (fault IS NULL) AS periods, count(DISTINCT vat) FILTER (fault IS NULL) AS times, min(period) FILTER (fault IS NULL AND place = 0) AS p0, min(period) FILTER (fault IS NULL AND place = 1) AS p1, min(period) FILTER (fault IS NULL AND place = 2) AS p2, min(vat) FILTER (fault IS NULL) AS vat FROM kr GROUP BY rt, rd),
ve AS (SELECT *, CASE WHEN ends IS NOT NULL THEN '' WHEN ok = 0 THEN 'no_usable_records' WHEN rt = 'weekly_claims' AND (coalesce(p0 != p1, false) OR coalesce(coalesce(p0, p1) - p2 != 7, false)) THEN 'period_mismatch' WHEN rt != 'weekly_claims' AND periods != 1 THEN 'period_mismatch'
  WHEN times != 1 THEN 'release_time_mismatch' WHEN have = 0 THEN 'no_usable_metrics' END AS verdict FROM en),
wa AS (SELECT rt, rd, string_agg(rt || '_' || fault || ':' || label, '|' ORDER BY place) FILTER (fault IS NOT NULL AND (ends IS NULL OR place <= ends)) AS w1, string_agg(rt || '_actual_missing:' || label, '|' ORDER BY place) FILTER (fault IS NULL AND actual IS NULL AND (verdict IS NULL OR verdict = 'no_usable_metrics')) AS w2 FROM kr JOIN ve USING (rt, rd) GROUP BY rt, rd),
vr AS (SELECT rt AS release_type, rd AS release_date, verdict IS NULL AS built, CASE WHEN verdict IS NULL THEN have ELSE 0 END::BIGINT AS n_metrics, CASE WHEN verdict IS NULL THEN vat END AS vat, concat_ws('|', w1, w2, CASE WHEN verdict != '' THEN rt || '_' || verdict END, CASE WHEN verdict IS NULL AND have < want THEN rt || '_partial_release:' || have || '/' || want END) AS warnings FROM ve JOIN wa USING (rt, rd))"""


@query(sql("monthly_series weekly_counts", f"{_RECORDS} SELECT release_type, release_date::VARCHAR AS release_date, built, n_metrics, strftime(vat, '%Y-%m-%d %H:%M') AS vendor_release_at, warnings FROM vr"))
def c11_vendor_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly and weekly releases (C12) with planted faults."""
    return built(spark, sf_dir).select("release_type", F.col("release_date").cast("string").alias("release_date"), "built", F.col("n_metrics").cast("bigint").alias("n_metrics"), F.date_format("vendor_release_at", "yyyy-MM-dd HH:mm").alias("vendor_release_at"), "warnings")


_LATEST = f"""la AS (SELECT rt AS release_type, max((vat - INTERVAL 5 HOUR)::DATE) AS release_date FROM rc WHERE actual IS NOT NULL AND vat <= TIMESTAMP '{AS_OF}' AND NOT odd_day AND rd >= DATE '1999-06-15' - CASE rt WHEN 'weekly_claims' THEN 28 ELSE 90 END AND period <= rd GROUP BY rt)"""


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return releases.latest_with_actual(records(spark, sf_dir), as_of(), F.when(F.col("release_type") == "weekly_claims", 28).otherwise(90))


@query(sql("monthly_series weekly_counts", f"{_RECORDS}, {_LATEST} SELECT release_type, release_date::VARCHAR AS release_date FROM la"))
def f17_latest_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(spark, sf_dir).select("release_type", F.col("release_date").cast("string").alias("release_date"))


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vendor's newest release of each type, or the official one of the month before; a type that neither has too."""
    types = spark.createDataFrame([(t,) for t in ("A", "N", "R", "weekly_claims", "pce")], "release_type string")
    newest = latest(spark, sf_dir)
    official = newest.where("release_type != 'weekly_claims'").select("release_type", F.add_months("release_date", -1).alias("release_date"))
    vendor = built(spark, sf_dir).join(newest, ["release_type", "release_date"]).select("release_type", "release_date", "built")
    return releases.prefer(types, vendor, official)


_CHOSEN = f"""{_RECORDS}, {_LATEST}, ty AS (SELECT unnest(['A', 'N', 'R', 'weekly_claims', 'pce']) AS release_type),
ch AS (SELECT ty.release_type, CASE WHEN built THEN 'vendor' WHEN o.release_date IS NOT NULL THEN 'official' END AS source, CASE WHEN built THEN v.release_date ELSE o.release_date END AS release_date,
  CASE WHEN built IS NULL THEN ty.release_type || '_no_vendor_release' WHEN NOT built THEN ty.release_type || '_build_failed|' || ty.release_type || '_using_official_fallback' ELSE '' END AS warnings
  FROM ty LEFT JOIN (SELECT vr.* FROM vr JOIN la USING (release_type, release_date)) v USING (release_type) LEFT JOIN (SELECT release_type, (release_date - INTERVAL 1 MONTH)::DATE AS release_date FROM la WHERE release_type != 'weekly_claims') o USING (release_type))"""


@query(sql("monthly_series weekly_counts", f"{_CHOSEN} SELECT release_type, source, release_date::VARCHAR AS release_date, warnings FROM ch"))
def c13_source_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen(spark, sf_dir).withColumn("release_date", F.col("release_date").cast("string"))


@query(sql("monthly_series weekly_counts curve_points", f"""{_CHOSEN}, pa AS (SELECT 'treasury' AS module, count(*) > 0 AS present FROM curve_points UNION ALL SELECT 'projections', false),
un AS (SELECT release_type AS module, release_date IS NOT NULL AS present, warnings FROM ch UNION ALL SELECT module, present, '' FROM pa)
SELECT module, present, concat_ws('|', nullif(warnings, ''), CASE WHEN NOT present THEN module || '_missing' END) AS warnings FROM un"""))
def c14_macro_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = views.curve_points(spark, sf_dir).agg((F.count("*") > 0).alias("present")).select(F.lit("treasury").alias("module"), "present")
    none = spark.createDataFrame([("projections", False)], "module string, present boolean")
    return releases.snapshot(chosen(spark, sf_dir), curve.unionByName(none))


@query(sql("monthly_series weekly_counts", f"{_CHOSEN} SELECT release_type FROM ty WHERE release_type NOT IN (SELECT release_type FROM ch WHERE release_date IS NOT NULL)"))
def c19_required_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    required = spark.createDataFrame([(t,) for t in ("A", "N", "R", "weekly_claims", "pce")], "release_type string")
    return releases.missing_types(required, chosen(spark, sf_dir).where("release_date IS NOT NULL"))


@query("""WITH o AS (SELECT o_custkey AS message_id, o_orderkey AS start, o_orderkey % 30 AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 7 END AS b, o_orderkey % 97 = 0 AS ai FROM orders),
c AS (SELECT message_id, start, 0 AS place, CASE WHEN ai THEN 'AI' ELSE 'N' || lpad(a::VARCHAR, 2, '0') END AS ticker, ai FROM o UNION ALL SELECT message_id, start, 1, 'N' || lpad(b::VARCHAR, 2, '0'), false FROM o WHERE b IS NOT NULL),
g AS (SELECT 'N' || lpad(n_nationkey::VARCHAR, 2, '0') AS ticker, n_name AS symbol FROM nation UNION ALL SELECT 'AI', 'AI'),
p AS (SELECT message_id, start, count(DISTINCT symbol) AS n, min(symbol) AS symbol, bool_or(ai) AS odd FROM c LEFT JOIN g USING (ticker) GROUP BY ALL),
f AS (SELECT message_id, symbol, min(start) AS start FROM p WHERE n = 1 GROUP BY ALL), l AS (SELECT message_id, string_agg(symbol, '|' ORDER BY start) AS resolved, count(*) AS k FROM f GROUP BY ALL),
q AS (SELECT message_id, count(*)::BIGINT AS n_mentions, count(*) FILTER (n > 1)::BIGINT AS n_ambiguous, count(*) FILTER (n = 0)::BIGINT AS n_rejected, bool_or(odd) AS odd FROM p GROUP BY ALL)
SELECT c_custkey AS message_id, coalesce(resolved, '') AS resolved, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_ambiguous, 0) AS n_ambiguous, coalesce(n_rejected, 0) AS n_rejected,
coalesce(n_mentions, 0) = 0 OR n_rejected > 0 OR n_ambiguous > 0 OR coalesce(odd, false) OR (c_custkey % 2 = 0 AND coalesce(k, 0) < 2) AS needs_meaning FROM customer LEFT JOIN q ON c_custkey = q.message_id LEFT JOIN l ON c_custkey = l.message_id""")
def c34_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as messages, their orders as mentions with one or two candidates, nations as the registry."""
    k = F.col("o_orderkey")
    odd = k % 97 == 0

    def ticker(n: int):
        return F.concat(F.lit("N"), F.lpad((k % n).cast("string"), 2, "0"))

    name = F.when(odd, "AI").otherwise(ticker(30))
    mentions = read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("message_id"), k.alias("start"), F.lit("explicit").alias("source"), name.alias("text"), F.array_compact(F.array(name, F.when(k % 4 == 0, ticker(7)))).alias("candidates")
    )
    messages = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("message_id"), F.when(F.col("c_custkey") % 2 == 0, "one vs another").otherwise("canvas").alias("message"))
    nations = read(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("ticker"), F.col("n_name").alias("symbol"))
    registry = nations.unionByName(spark.createDataFrame([("AI", "AI")], "ticker string, symbol string"))
    return targets.resolve(messages, mentions, registry).withColumn("resolved", F.array_join("resolved", "|"))


_CUES = "|".join(targets.JOINING_WORDS)


@query(f"SELECT doc_id, coalesce(regexp_matches(text, '{_CUES}') OR regexp_matches(text, '(?i)(^|[^A-Za-z0-9])(vs|versus)([^A-Za-z0-9]|$)'), false) AS joins FROM documents")
def x17_multi_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", targets.joins_targets(F.col("text")).alias("joins"))


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 2 = 0 AS macro, c_custkey % 3 = 0 AS reaction, c_custkey % 5 = 0 AS history, c_custkey % 7 = 0 AS earnings, c_custkey % 11 != 0 AS typed, c_custkey % 13 < 6 AS ml, c_custkey % 17 < 8 AS el FROM customer)
SELECT id, concat_ws('|', CASE WHEN NOT macro AND typed THEN 'release_type_without_macro' END, CASE WHEN (reaction OR history) AND NOT macro THEN 'reaction_without_macro' END, CASE WHEN (reaction OR history) AND NOT typed THEN 'reaction_without_release_type' END,
CASE WHEN history AND NOT ml THEN 'macro_history_limit_missing' END, CASE WHEN NOT history AND ml THEN 'macro_history_limit_unexpected' END, CASE WHEN earnings AND NOT el THEN 'earnings_history_limit_missing' END, CASE WHEN NOT earnings AND el THEN 'earnings_history_limit_unexpected' END) AS faults FROM p""")
def c37_plan_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    plans = read(spark, sf_dir, "customer").select(
        k.alias("id"), (k % 2 == 0).alias("needs_macro"), (k % 3 == 0).alias("needs_macro_reaction"), (k % 5 == 0).alias("needs_macro_reaction_history"), (k % 7 == 0).alias("needs_earnings_reaction_history"),
        F.when(k % 11 != 0, "cpi").alias("macro_release_type"), F.when(k % 13 < 6, 3).alias("macro_history_limit"), F.when(k % 17 < 8, 4).alias("earnings_history_limit"),
    )
    return plans.select("id", F.array_join(targets.plan_faults(), "|").alias("faults"))


@query("""WITH w AS (SELECT DISTINCT o_custkey AS run_id, o_orderkey % 5 AS company, cap FROM orders, (SELECT unnest(['quote', 'bars', 'filings']) AS cap, unnest([0, 1, 2]) AS ck) c WHERE o_orderkey % 4 != ck),
r AS (SELECT *, (run_id + company) % 3 AS s, length(cap) AS n FROM w), m AS (SELECT *, CASE WHEN (run_id + n) % 7 = 0 THEN 'not' WHEN s = 0 AND n % 2 = 1 THEN 'bad' END AS why FROM r),
a AS (SELECT run_id, count(*) FILTER (why IS NOT NULL)::BIGINT AS n_missing, coalesce(bool_or(why = 'not' OR run_id % 2 = 0) FILTER (why IS NOT NULL), false) AS again FROM m GROUP BY run_id)
SELECT c_custkey AS run_id, coalesce(n_missing, 0) AS n_missing, CASE WHEN coalesce(n_missing, 0) = 0 THEN 'enough' WHEN again AND c_custkey % 3 != 0 THEN 'retry' ELSE 'cannot_retry' END AS status FROM customer LEFT JOIN a ON c_custkey = run_id""")
def c38_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that want capabilities for companies; some never ran, some failed, by an outage or for good (F19)."""
    run, company, cap = F.col("run_id"), F.col("company_id"), F.col("capability")
    k = F.col("o_orderkey")
    caps = F.array_compact(F.array(*[F.when(k % 4 != i, c) for i, c in enumerate(("quote", "bars", "filings"))]))
    wanted = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run_id"), (k % 5).alias("company_id"), F.explode(caps).alias("capability")).distinct()
    bad = ((run + company) % 3 == 0) & (F.length(cap) % 2 == 1)
    results = wanted.where((run + F.length(cap)) % 7 != 0).select("run_id", "company_id", "capability", (~bad).alias("usable"), (bad & (run % 2 == 0)).alias("outage"))
    runs = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0).alias("retry_count"))
    return targets.completeness(runs, targets.missing_information(wanted, results))


@query("""WITH c AS (SELECT conv_id AS run_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
a AS (SELECT run_id, min(n) AS n, count(*) FILTER (role = 'user')::BIGINT AS u FROM c GROUP BY run_id),
r AS (SELECT run_id, n, CASE WHEN run_id % 9 = 0 THEN 2 WHEN run_id % 10 = 0 THEN 0 ELSE 1 END AS ends, CASE WHEN run_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS ended FROM a)
SELECT run_id, CASE WHEN ends != 1 THEN 'terminal_count' ELSE concat_ws('|', CASE WHEN (ended != CASE WHEN run_id % 5 = 0 THEN 'failed' ELSE 'completed' END) THEN 'terminal_mismatch' END, CASE WHEN run_id % 3 = 0 THEN 'tool_call_id_mismatch' END,
CASE WHEN n > 6 THEN 'model_budget' END, CASE WHEN n > 4 THEN 'tool_budget' END, CASE WHEN run_id % 7 = 0 THEN 'tool_execution_count_mismatch' END, CASE WHEN ended = 'completed' AND run_id % 11 = 0 THEN 'missing_final_output' END,
CASE WHEN run_id % 11 != 0 AND ended != 'completed' THEN 'output_status_mismatch' END) END AS errors FROM r""")
def c39_run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as run logs: a tool call a turn, one of them unanswered in some runs, and none, one or two ends."""
    turns = read(spark, sf_dir, "conversations")
    sizes = turns.groupBy(F.col("conv_id").alias("run_id")).agg(F.count("*").alias("n"))
    run = F.col("run_id")
    records = sizes.select(
        "run_id", F.when(run % 5 == 0, "failed").otherwise("completed").alias("terminal_status"), F.col("n").alias("model_requests"),
        F.col("n").alias("tool_executions"), F.lit(6).alias("model_rounds"), F.lit(4).alias("tool_calls"), F.when(run % 11 != 0, "completed").alias("output_status"),
    )
    seen = F.when(run % 7 == 0, F.col("n") - 1).otherwise(F.col("n"))
    calls = sizes.select("run_id", seen.alias("executed"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("tool_call_id"))
    none = F.lit(None).cast("string")
    asked = calls.select("run_id", F.lit("tool_requested").alias("type"), none.alias("status"), "tool_call_id", F.lit(0).cast("bigint").alias("executed"))
    answered = calls.where((run % 3 != 0) | (F.col("tool_call_id") > 1)).select("run_id", F.lit("tool_succeeded").alias("type"), none.alias("status"), "tool_call_id", "executed")
    ends = F.when(run % 9 == 0, 2).when(run % 10 == 0, 0).otherwise(1)
    done = sizes.select("run_id", seen.alias("executed"), F.explode(F.array_repeat(F.when(run % 4 == 0, "failed").otherwise("completed"), ends)).alias("status"))
    done = done.select("run_id", F.lit("run_finished").alias("type"), "status", F.lit(None).cast("bigint").alias("tool_call_id"), "executed")
    return evidence.check_runs(records, asked.unionByName(answered).unionByName(done)).withColumn("errors", F.array_join("errors", "|"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS run_id, l_partkey AS p FROM lineitem), e AS (SELECT *, CASE WHEN p % 5 = 0 THEN 'fixture' ELSE 'rag' END AS kind, CASE WHEN p % 37 = 0 THEN NULL WHEN run_id % 3 = 0 AND p % 2 = 0 THEN 'historical' ELSE 'live' END AS mode, p % 41 != 0 AS given FROM c),
a AS (SELECT run_id, count(*) FILTER (NOT given) AS unknown, count(*) FILTER (kind = 'rag' AND p % 43 = 0) AS gone, count(*) FILTER (NOT given OR mode IS NULL) AS modeless, min(mode) FILTER (given) AS low, max(mode) FILTER (given) AS high FROM e GROUP BY run_id),
r AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 2 WHEN 0 THEN 'mixed' ELSE 'live' END AS request_mode, CASE o_orderkey % 5 WHEN 0 THEN 'mixed' ELSE 'live' END AS output_mode FROM orders)
SELECT run_id, CASE WHEN unknown > 0 THEN 'unknown_evidence_id' WHEN gone > 0 THEN 'evidence_not_accessible' WHEN modeless > 0 THEN 'evidence_data_mode_missing' WHEN request_mode != 'mixed' AND (low != request_mode OR high != request_mode) THEN 'data_mode_not_allowed'
WHEN output_mode IS DISTINCT FROM (CASE WHEN low = high THEN low WHEN low IS NOT NULL THEN 'mixed' END) THEN 'data_mode_mismatch' ELSE 'ok' END AS verdict FROM r LEFT JOIN a USING (run_id)""")
def c41_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs that cite their parts (J23)."""
    p, run = F.col("l_partkey"), F.col("l_orderkey")
    cited = read(spark, sf_dir, "lineitem").select(run.alias("run_id"), p.alias("part")).distinct()
    part = F.col("part")
    name = F.concat(F.when(part % 5 == 0, "fixture:").otherwise("rag:"), part.cast("string"))
    mode = F.when(part % 37 == 0, None).when((F.col("run_id") % 3 == 0) & (part % 2 == 0), "historical").otherwise("live")
    given = cited.where(part % 41 != 0).select("run_id", name.alias("evidence_id"), mode.alias("mode"))
    store = cited.select("part").distinct().where(part % 43 != 0).select(name.alias("evidence_id"))
    o = F.col("o_orderkey")
    runs = read(spark, sf_dir, "orders").select(o.alias("run_id"), F.when(o % 2 == 0, "mixed").otherwise("live").alias("request_mode"), F.when(o % 5 == 0, "mixed").otherwise("live").alias("output_mode"))
    return evidence.check_citations(runs, cited.select("run_id", name.alias("evidence_id")), given, store)
