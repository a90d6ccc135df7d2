"""Queries over plans, run records, frames of events and filings' files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import frames, html_tree
from tidemark.operators import evidence, facts, paging, quality, targets
from tidemark.plans import records, visible
from tidemark.plans.registry import ORACLES, query
from tidemark.sources import views
from tidemark.sources.views import read, sql
from tidemark.streaming import event_log

#: Phrases that questions are composed of, two for each document, by a hash of its text.
PHRASES = [
    "AAPL 现在多少钱", "Current Price", "RSI", "支撑位", "结合技术面", "当前走势", "Market View", "最近 CPI 公布后", "过去 3 次 PPI 后的走势", "前五次财报后", "这次财报后怎么走", "历史上非农后市场反应", "初请",
    "之前几次 PCE 后\n的表现", "公司是做什么", "Company Profile", "为什么", "Earnings", "业绩", "涨了多少", "本次和过去 十 次 weekly claims 跌了多少", "hello", "后来怎么走", "previous earnings",
]
_PHRASES = "[" + ", ".join("'" + p.replace("\n", "' || chr(10) || '") + "'" for p in PHRASES) + "]"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phrases for each document, and its whole text before them for every third."""
    mark = F.md5(F.concat(F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")).cast("binary"))

    def phrase(at: int) -> Column:
        return F.element_at(F.array(*map(F.lit, PHRASES)), (F.conv(F.substring(mark, at, 4), 16, 10).cast("long") % len(PHRASES) + 1).cast("int"))

    text = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.concat_ws(" ", text, phrase(1), phrase(5)).alias("question"))


def _says(what: str) -> str:
    found = " OR ".join(f"contains(q, '{w}')" for w in targets.WORDS[what])
    return f"({found} OR regexp_matches(q, '{targets.PATTERNS[what]}'))" if what in targets.PATTERNS else f"({found})"


_TIMES = "|".join(targets.NUMERALS)
_PAST = "(?:过去|之前|最近|前|历史)"
_PLAN = rf"""h AS (SELECT doc_id, text, md5(coalesce(text, '') || doc_id) AS m FROM documents),
qs AS (SELECT doc_id AS question_id, lower(trim(concat_ws(' ', CASE WHEN doc_id % 3 = 0 THEN text END, ({_PHRASES})[('0x' || m[1:4])::BIGINT % {len(PHRASES)} + 1], ({_PHRASES})[('0x' || m[5:8])::BIGINT % {len(PHRASES)} + 1]))) AS q FROM h),
w AS (SELECT question_id, {', '.join(f'{_says(k)} AS {k}' for k in targets.WORDS)},
  CASE WHEN contains(q, 'cpi') THEN 'cpi' WHEN contains(q, 'ppi') THEN 'ppi' WHEN contains(q, 'pce') THEN 'pce' WHEN regexp_matches(q, '非农|就业报告|employment situation') THEN 'employment_situation' WHEN regexp_matches(q, '初请|续请|失业金|weekly claims') THEN 'weekly_claims' END AS kind,
  coalesce(TRY_CAST(regexp_extract(q, '{_PAST}\s*([0-9]+)\s*次', 1) AS INT), CASE regexp_extract(q, '{_PAST}\s*([{_TIMES}])\s*次', 1) {' '.join(f"WHEN '{k}' THEN {v}" for k, v in targets.NUMERALS.items())} END, {targets.DEFAULT_TIMES}) AS times FROM qs),
p AS (SELECT *, NOT meaning AND (company_profile OR quote OR technical OR full_technical OR decision OR kind IS NOT NULL OR (earnings AND reaction)) AS planned FROM w)"""


@query(rf"""WITH {_PLAN} SELECT question_id, planned, CASE WHEN planned THEN company_profile END AS needs_company_profile, CASE WHEN planned THEN quote END AS needs_quote, CASE WHEN planned THEN technical OR full_technical END AS needs_technical,
  CASE WHEN planned THEN decision OR full_technical END AS needs_decision, NULL::VARCHAR AS knowledge_question, CASE WHEN planned THEN 0 END AS financial_requests, CASE WHEN planned THEN kind IS NOT NULL END AS needs_macro, CASE WHEN planned THEN kind END AS macro_release_type,
  CASE WHEN planned THEN kind IS NOT NULL AND reaction AND (current_event OR NOT history) END AS needs_macro_reaction, CASE WHEN planned THEN kind IS NOT NULL AND reaction AND history END AS needs_macro_reaction_history,
  CASE WHEN planned AND kind IS NOT NULL AND reaction AND history THEN times END AS macro_reaction_history_limit, CASE WHEN planned THEN earnings AND reaction AND (current_event OR NOT history) END AS needs_earnings_reaction,
  CASE WHEN planned THEN earnings AND reaction AND history END AS needs_earnings_reaction_history, CASE WHEN planned AND earnings AND reaction AND history THEN times END AS earnings_reaction_history_limit FROM p""")
def c36_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.plans(questions(spark, sf_dir)).withColumn("financial_requests", F.when(F.col("planned"), F.size("financial_requests")))


@query(rf"WITH {_PLAN} SELECT question_id, kind FROM w")
def x19_release_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.text import release_type

    return questions(spark, sf_dir).select("question_id", release_type(F.col("question")).alias("kind"))


@query(rf"WITH {_PLAN} SELECT question_id, times FROM w")
def x18_history_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("question_id", targets.times_asked(F.lower("question")).alias("times"))


#: Run records and their events out of conversations, in SQL that both engines read: a tool call a turn, with faults where lengths of texts say so.
_RUNS = """
t AS (SELECT conv_id AS run_id, role AS tool, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS BIGINT) AS k, CAST(coalesce(length(text), 0) AS BIGINT) AS len FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT run_id, count(*) AS n, CAST(sum(len) AS BIGINT) AS s FROM t GROUP BY run_id),
z AS (SELECT *, CASE WHEN s % 5 = 0 THEN 'failed' WHEN s % 5 = 1 THEN 'insufficient_information' ELSE 'completed' END AS ended, CASE WHEN (s % 5 = 0 AND s % 11 <> 0) OR s % 13 = 0 THEN 'tool_timeout' END AS err FROM r),
ends AS (SELECT 1 AS e UNION ALL SELECT 2)
"""
_EVENTS = """
SELECT run_id, 4 * k AS seq, CASE WHEN len % 41 = 0 THEN run_id + 1 END AS event_run_id, 'tool_requested' AS type, NULL AS status, NULL AS error_code, NULL AS error_stage, NULL AS error_message, k AS tool_call_id, tool, NULL AS code, CAST(NULL AS BIGINT) AS executed, NULL AS evidence_id, NULL AS fixture_mode FROM t
UNION ALL SELECT run_id, 4 * k + 1, NULL, 'tool_requested', NULL, NULL, NULL, NULL, k, tool, NULL, NULL, NULL, NULL FROM t WHERE len % 37 = 0
UNION ALL SELECT run_id, CASE WHEN len % 43 = 0 THEN 4 * k - 1 ELSE 4 * k + 2 END, NULL, CASE WHEN len % 7 = 0 THEN 'tool_failed' ELSE 'tool_succeeded' END, NULL, NULL, NULL, NULL, k, NULL, CASE WHEN len % 7 = 0 THEN 'timeout' END, k, concat('ev', k), CASE WHEN len % 29 <> 0 THEN 'fixture' END FROM t WHERE len % 31 <> 0
UNION ALL SELECT run_id, CASE WHEN s % 27 = 0 THEN 3 ELSE 4 * n + 3 + e END, CASE WHEN s % 23 = 0 THEN run_id + 1 ELSE run_id END, 'run_finished', ended, err, CASE WHEN err IS NOT NULL THEN 'tool' END, CASE WHEN err IS NOT NULL THEN CASE WHEN s % 3 = 0 THEN 'leak' ELSE 'The tool took too long.' END END, NULL, NULL, NULL, n, NULL, NULL
  FROM z JOIN ends ON s % 17 <> 0 AND (e = 1 OR s % 19 = 0)
"""
_RECORDS = """
SELECT run_id, CASE WHEN s % 7 = 0 THEN 'completed' WHEN ended = 'failed' THEN coalesce(err, 'failed') ELSE ended END AS terminal_status, CASE WHEN s % 8 <> 0 THEN err END AS safe_error, CASE WHEN s % 2 = 0 THEN 'offline' ELSE 'real' END AS execution_mode,
  n + CASE WHEN s % 6 = 0 THEN 20 ELSE 0 END AS model_request_count, n + CASE WHEN s % 9 = 0 THEN 1 WHEN s % 25 = 0 THEN 40 ELSE 0 END AS tool_execution_count, CASE WHEN s % 10 <> 0 THEN n + CASE WHEN s % 12 = 0 THEN 50 ELSE 0 END END AS handler_call_count, 20 AS model_rounds, 30 AS tool_calls,
  'fixture' AS data_mode, LIST('in') AS evidence_ids, ended <> 'failed' AND s % 14 <> 0 AS has_output, CASE WHEN s % 15 = 0 THEN 'other' ELSE ended END AS output_status, CASE WHEN s % 16 <> 0 THEN 'fixture' END AS output_mode,
  CASE WHEN s % 20 = 0 THEN slice(LIST(LIST('in')), 1, 0) WHEN s % 18 = 0 THEN LIST(LIST('in'), LIST('ev99')) ELSE LIST(LIST('in', 'ev1'), LIST(concat('ev', n))) END AS claims FROM z
"""
_EXPECTED = """
SELECT run_id, CASE WHEN s % 22 = 0 THEN 'failed' WHEN ended = 'failed' THEN coalesce(err, 'failed') ELSE ended END AS terminal_status, CASE WHEN s % 24 = 0 THEN LIST('none') ELSE asked END AS tool_requests, CASE WHEN s % 26 = 0 THEN LIST('none') ELSE failures END AS tool_failures, n AS handler_calls, n AS model_requests
FROM z JOIN l USING (run_id) WHERE s % 4 <> 3
"""


def run_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Records, events, expected cases and public errors."""
    turns = read(spark, sf_dir, "conversations")
    top = f"WITH {_RUNS.replace('FROM conversations', 'FROM {conversations}')}"
    listed = "l AS (SELECT run_id, transform(sort_array(collect_list(CASE WHEN type = 'tool_requested' THEN struct(seq, tool) END)), x -> x.tool) AS asked, transform(sort_array(collect_list(CASE WHEN type = 'tool_failed' THEN struct(seq, code) END)), x -> x.code) AS failures FROM ev GROUP BY run_id)"
    events = spark.sql(top + _EVENTS, conversations=turns)
    expected = spark.sql(f"{top}, ev AS ({_EVENTS}), {listed} {_EXPECTED.replace('LIST(', 'array(')}", conversations=turns)
    found = spark.sql(top + _RECORDS.replace("LIST(", "array("), conversations=turns)
    errors = spark.createDataFrame([("tool_timeout", "tool", "The tool took too long.")], "code string, stage string, message string")
    return found, events, expected, errors


_RUN_SQL = f"""WITH {_RUNS}, ev AS ({_EVENTS}), rc AS ({_RECORDS.replace('LIST(', 'list_value(').replace("slice(list_value(list_value('in')), 1, 0)", "list_value(list_value('in'))[1:0]")}),
l AS (SELECT run_id, coalesce(list(tool ORDER BY seq) FILTER (type = 'tool_requested'), []) AS asked, coalesce(list(code ORDER BY seq) FILTER (type = 'tool_failed'), []) AS failures FROM ev GROUP BY run_id),
ex AS ({_EXPECTED.replace('LIST(', 'list_value(')})"""


@query(f"""{_RUN_SQL},
k AS (SELECT run_id, count(*) FILTER (a <> 1 OR b <> 1) AS odd FROM (SELECT run_id, tool_call_id, count(*) FILTER (type = 'tool_requested') AS a, count(*) FILTER (type IN ('tool_succeeded', 'tool_failed')) AS b FROM ev WHERE type <> 'run_finished' GROUP BY ALL) GROUP BY run_id),
g AS (SELECT run_id, count(*) FILTER (type = 'run_finished') AS n_ends, max(event_run_id) FILTER (type = 'run_finished') AS end_run, count(*) FILTER (event_run_id <> run_id) AS foreign_ids, max(status) AS ended, max(error_code) AS err, bool_or(error_message = 'The tool took too long.') AS public, coalesce(max(executed), 0) AS observed,
  count(*) FILTER (type = 'tool_succeeded' AND fixture_mode IS DISTINCT FROM 'fixture') AS nofix, coalesce(list(evidence_id) FILTER (type = 'tool_succeeded'), []) AS gained FROM ev GROUP BY run_id),
j AS (SELECT rc.*, g.* EXCLUDE (run_id), l.asked, l.failures, coalesce(k.odd, 0) AS odd, ex.run_id IS NOT NULL AS judged, ex.terminal_status AS x_status, ex.tool_requests AS x_asked, ex.tool_failures AS x_failures, ex.handler_calls AS x_handler, ex.model_requests AS x_model
  FROM rc LEFT JOIN g USING (run_id) LEFT JOIN k USING (run_id) LEFT JOIN l USING (run_id) LEFT JOIN ex USING (run_id))
SELECT run_id, CASE WHEN n_ends <> 1 THEN 'terminal_count' ELSE concat_ws('|', CASE WHEN end_run IS DISTINCT FROM run_id OR foreign_ids > 0 THEN 'run_id_mismatch' END,
  CASE WHEN terminal_status IS DISTINCT FROM CASE WHEN ended = 'failed' THEN coalesce(err, 'failed') ELSE ended END THEN 'terminal_mismatch' END, CASE WHEN judged AND terminal_status <> x_status THEN 'unexpected_terminal' END, CASE WHEN safe_error IS DISTINCT FROM err THEN 'safe_error_mismatch' END,
  CASE WHEN (ended = 'failed') <> (err IS NOT NULL) THEN 'terminal_error_mismatch' END, CASE WHEN err IS NOT NULL AND NOT coalesce(public, false) THEN 'unsafe_error' END, CASE WHEN odd > 0 THEN 'tool_call_id_mismatch' END, CASE WHEN model_request_count > 20 THEN 'model_budget' END, CASE WHEN tool_execution_count > 30 THEN 'tool_budget' END,
  CASE WHEN tool_execution_count <> observed THEN 'tool_execution_count_mismatch' END, CASE WHEN handler_call_count > 30 THEN 'handler_budget' END, CASE WHEN ended <> 'failed' AND NOT has_output THEN 'missing_final_output' END, CASE WHEN has_output AND output_status <> ended THEN 'output_status_mismatch' END,
  CASE WHEN has_output AND output_mode IS DISTINCT FROM CASE WHEN len(claims) > 0 THEN data_mode END THEN 'data_mode_mismatch' END, CASE WHEN has_output AND len(list_filter(flatten(claims), lambda i: NOT list_contains(list_concat(evidence_ids, gained), i))) > 0 THEN 'invalid_evidence' END, CASE WHEN nofix > 0 THEN 'fixture_mismatch' END,
  CASE WHEN judged AND execution_mode = 'offline' AND asked <> x_asked THEN 'tool_requests' END, CASE WHEN judged AND execution_mode = 'offline' AND failures <> x_failures THEN 'tool_failures' END, CASE WHEN judged AND execution_mode = 'offline' AND handler_call_count IS DISTINCT FROM x_handler THEN 'handler_calls' END,
  CASE WHEN judged AND execution_mode = 'offline' AND model_request_count <> x_model THEN 'model_requests' END) END AS errors FROM j""")
def c39_record_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of run records over conversations as runs."""
    return evidence.check_records(*run_tables(spark, sf_dir)).withColumn("errors", F.array_join("errors", "|"))


@query(f"""{_RUN_SQL},
o AS (SELECT run_id, seq, type, max(CASE WHEN type = 'run_finished' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended,
  count(*) FILTER (type = 'tool_requested') OVER c AS a, count(*) FILTER (type IN ('tool_succeeded', 'tool_failed')) OVER c AS b FROM ev WINDOW c AS (PARTITION BY run_id, tool_call_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT * FROM (SELECT run_id, seq, CASE WHEN ended = 1 THEN 'after_end' WHEN type = 'tool_requested' AND a > 0 THEN 'request_repeated' WHEN type LIKE 'tool_%ed' AND type <> 'tool_requested' AND b > 0 THEN 'result_repeated' WHEN type IN ('tool_succeeded', 'tool_failed') AND a = 0 THEN 'result_before_request' END AS fault FROM o) WHERE fault IS NOT NULL""")
def c39_event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that come before what they answer, twice, or after the end."""
    return evidence.order_faults(run_tables(spark, sf_dir)[1])


@query(sql("event_log", f"{records._LOG} SELECT thread_id, event_id, type, regexp_replace(data, '\\r\\n|\\r|\\n', chr(10), 'g') AS data FROM lg"))
def x24_sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each thread's frames as one text, cut into chunks of a few characters and read again."""
    ordered = F.sort_array(F.collect_list(F.struct("event_id", "frame")))
    text = event_log.sse(records._log(spark, sf_dir)).groupBy("thread_id").agg(F.array_join(F.transform(ordered, lambda x: x["frame"]), "").alias("text"))
    size = F.lit(5) + F.pmod(F.col("thread_id"), F.lit(7))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int")), lambda i: F.substring(F.col("text"), (i * size + 1).cast("int"), size.cast("int")))
    chunks = text.select(F.col("thread_id").alias("stream_id"), F.posexplode(cut).alias("seq", "chunk"))
    return frames.parsed(chunks).where("kind = 'event'").select(F.col("stream_id").alias("thread_id"), F.col("id").cast("long").alias("event_id"), F.col("event").alias("type"), "data")


_INDEX = """<html><body><table class="other"><tr><td>1</td><td>x</td><td><a>no.htm</a></td><td>no</td></tr></table><table class="a tableFile"><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr>"""


@query(r"""WITH i AS (SELECT page_id, length(coalesce(html, '')) AS n, sha256(coalesce(url, '')) AS h FROM pages), j AS (SELECT page_id, k, n, h FROM i, (SELECT unnest([0, 1, 2]) AS k))
SELECT page_id AS filing_id, CASE WHEN (n + k) % 4 <> 0 THEN k::VARCHAR END AS sequence, substr(h, k + 1, 8) || '.htm' AS document_name, CASE WHEN k = 0 THEN '10-K' ELSE 'EX-' || k || ' &' END AS document_type, CASE WHEN (n + k) % 3 <> 0 THEN 'about ' || substr(h, 20, 5) END AS description,
  page_id || '/' || substr(h, 1, 10) || '/' || substr(h, k + 1, 8) || '.htm' AS path, k = n % 3 AS is_primary FROM j WHERE (n + k) % 7 <> 0 AND (n + k) % 11 <> 0""")
def s21_filing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages made from pages: three rows each, some without a link or with too few cells, and a table of another class."""
    h, n = F.sha2(F.coalesce("url", F.lit("")), 256), F.length(F.coalesce("html", F.lit("")))

    def row(k: int) -> Column:
        name = F.concat(F.substring(h, k + 1, 8), F.lit(".htm"))
        seq = F.when((n + k) % 4 != 0, F.lit(f"<b>{k}</b>")).otherwise(" ")
        link = F.when((n + k) % 7 == 0, F.concat(F.lit("<a> </a>"), name)).otherwise(F.concat(F.lit('<span><a href="x">\n'), F.substring(name, 1, 5), F.lit(" <i>"), F.substring(name, 6, 20), F.lit("</i></a></span>")))
        about = F.when((n + k) % 3 != 0, F.concat(F.lit("about <i>"), F.substring(h, 20, 5), F.lit("</i>"))).otherwise("&nbsp;")
        kind = "10-K" if k == 0 else f"EX-{k} &amp;"
        return F.concat(F.lit("<tr><td>"), seq, F.lit("</td><td>"), about, F.lit("<td>"), link, F.lit("</td>"), F.when((n + k) % 11 == 0, "").otherwise(f"<td>{kind}</td>"))

    html = F.concat(F.lit(_INDEX), *[row(k) for k in range(3)], F.lit("</table></body></html>"))
    primary = F.concat(F.substring(h, (n % 3 + 1).cast("int"), F.lit(8)), F.lit(".htm"))
    number = F.concat(F.substring(h, 1, 4), F.lit("-"), F.substring(h, 5, 6))
    pages = read(spark, sf_dir, "pages").select(F.col("page_id").alias("filing_id"), F.lpad(F.col("page_id").cast("string"), 10, "0").alias("cik"), number.alias("accession_number"), primary.alias("primary_document"), html.alias("html"))
    return html_tree.filing_files(pages)


_SIGNUPS = "ev AS (SELECT event_id, ts AS event_at, user_id FROM events WHERE event_type = 'signup')"
_EARNINGS = f"""{visible._FILINGS}, s5 AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY accepted_at DESC, filing_id DESC) AS n FROM er WHERE form = '8-K' AND accepted_at <= TIMESTAMP '{visible.NOW}'),
r5 AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY accepted_at DESC, filing_id DESC) AS rank FROM s5 WHERE n <= 100 AND hit AND accepted_at < TIMESTAMP '{visible.NOW}' - INTERVAL 1 HOUR),
ea AS (SELECT filing_id, accepted_at, company, rank::INT AS rank, CASE WHEN length(company) % 2 = 0 THEN 'click' ELSE 'view' END AS symbol FROM r5 WHERE rank <= 5)"""


def _of_earnings(name: str) -> str:
    """The SQL of a query about events, for filings as the events."""
    return ORACLES[name].replace(_SIGNUPS, f"{_EARNINGS}, ev AS (SELECT filing_id AS event_id, accepted_at AS event_at, 0 AS user_id FROM ea)")


@query(f"""WITH {_EARNINGS} SELECT ea.filing_id AS event_id, ea.symbol, ea.company, ea.rank, a.status AS alignment, a.issues, w.windows, c.status AS close_status, c.return_pct AS close_return FROM ea JOIN ({_of_earnings('w24_alignment')}) a ON a.event_id = filing_id AND a.symbol = ea.symbol
JOIN (SELECT event_id, symbol, string_agg("window" || ':' || status, '|' ORDER BY "window") AS windows FROM ({_of_earnings('w25_window_returns')}) GROUP BY ALL) w ON w.event_id = filing_id AND w.symbol = ea.symbol LEFT JOIN ({_of_earnings('w26_close_return')}) c ON c.event_id = filing_id AND c.symbol = ea.symbol""")
def c31_earnings_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five earnings filings of each company and what its symbol did after them."""
    from tidemark.operators import pit, reaction
    from tidemark.plans import reactions

    at = visible.at(visible.NOW)
    found = pit.earnings_releases(visible.filings(spark, sf_dir), at, 5, before=at - F.expr("INTERVAL 1 HOUR"))
    symbols = found.select("company").distinct().withColumn("symbol", F.when(F.length("company") % 2 == 0, "click").otherwise("view"))
    rows = reaction.earnings_reactions(found, symbols, reactions.bars(spark, sf_dir), reactions.daily(spark, sf_dir), reactions.calendar(spark, sf_dir), reactions.as_of())
    windows = F.array_join(F.transform("windows", lambda w: F.concat_ws(":", w["window"], w["status"])), "|")
    return rows.select("event_id", "symbol", "company", "rank", "alignment", "issues", windows.alias("windows"), "close_status", F.round("close_return", 6).alias("close_return"))


#: Bars with faults of all kinds by symbol: none at all, another symbol's, weekly ones, an open one where none is allowed.
_ALL_BARS = f"""b AS (SELECT symbol, day, close, row_number() OVER (PARTITION BY symbol ORDER BY day) AS ordinal, count(*) OVER (PARTITION BY symbol) AS n, substr(symbol, 2)::INT AS k FROM bars),
q AS (SELECT symbol, ordinal, n, k, CASE WHEN k % 13 = 3 AND ordinal = 5 THEN day - 400 ELSE day END AS day, CASE WHEN k % 13 = 5 AND ordinal = 7 THEN 'raw' ELSE 'forward_adjusted' END AS adjustment, NOT (k % 13 = 7 AND ordinal = n) AS is_complete,
  CASE WHEN k % 13 = 1 AND ordinal = 9 THEN 'other' ELSE lower(symbol) || ' ' END AS found, CASE WHEN k % 13 = 2 AND ordinal = 4 THEN '1w' ELSE '1d' END AS frame FROM b WHERE k % 13 <> 4),
l AS (SELECT *, lag(day) OVER (PARTITION BY symbol ORDER BY ordinal) AS before FROM q),
f AS (SELECT symbol, bool_or(found = 'other') AS foreign_bar, bool_or(frame <> '1d') AS framed, count(DISTINCT adjustment) AS a, bool_or(day < before) AS unsorted, count(*) FILTER (NOT is_complete) AS open_bars, count(*) FILTER (is_complete) AS c FROM l GROUP BY symbol),
d AS (SELECT DISTINCT symbol FROM (SELECT symbol, day FROM q GROUP BY symbol, day HAVING count(*) > 1)),
r AS (SELECT s.symbol, CASE WHEN c IS NULL THEN 'bars_missing' WHEN foreign_bar THEN 'bar_symbol_mismatch' WHEN framed THEN 'bar_timeframe_mismatch' WHEN a <> 1 THEN 'mixed_bar_adjustment' WHEN unsorted THEN 'bars_not_sorted' WHEN s.symbol IN (SELECT symbol FROM d) THEN 'duplicate_bar'
  WHEN open_bars > 0 THEN 'incomplete_bar_not_allowed' WHEN c = 0 THEN 'completed_bars_missing' END AS bad, c, concat_ws('|', {', '.join(f"CASE WHEN c < {n} THEN '{k}' END" for k, n in quality.REQUIRED.items())}) AS away FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN f USING (symbol)),
bq AS (SELECT symbol, CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN c < 60 OR away <> '' THEN 'degraded' ELSE 'usable' END AS status, coalesce(bad, concat_ws('|', CASE WHEN c < 60 THEN 'bar_window_insufficient' END, CASE WHEN away <> '' THEN 'technical_windows_unavailable' END)) AS issues FROM r)"""


def all_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ordinal, day, start_at, end_at, close, is_complete, adjustment, found and timeframe of daily bars with faults."""
    by = Window.partitionBy("symbol")
    k = F.substring("symbol", 2, 2).cast("int") % 13
    b = views.bars(spark, sf_dir).select("symbol", "day", "close", F.row_number().over(by.orderBy("day")).alias("ordinal"), F.count("*").over(by).alias("n")).withColumn("k", k).where("k != 4")
    day = F.when((F.col("k") == 3) & (F.col("ordinal") == 5), F.date_sub("day", 400)).otherwise(F.col("day"))
    at = day.cast("timestamp_ntz")
    return b.select(
        "symbol", "ordinal", "close", at.alias("start_at"), (at + F.expr("INTERVAL 8 HOURS")).alias("end_at"), (~((F.col("k") == 7) & (F.col("ordinal") == F.col("n")))).alias("is_complete"),
        F.when((F.col("k") == 5) & (F.col("ordinal") == 7), "raw").otherwise("forward_adjusted").alias("adjustment"), F.when((F.col("k") == 1) & (F.col("ordinal") == 9), "other").otherwise(F.concat(F.lower("symbol"), F.lit(" "))).alias("found"),
        F.when((F.col("k") == 2) & (F.col("ordinal") == 4), "1w").otherwise("1d").alias("timeframe"),
    )


def all_bar_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = views.bars(spark, sf_dir).select("symbol").distinct()
    return quality.bar_quality(all_bars(spark, sf_dir), visible.at(visible.NOW), requests=asked, allow_open=False)


@query(sql("bars", f"{_ALL_BARS} SELECT symbol, status, issues FROM bq"))
def c16_bar_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested bars that are missing, foreign, of another timeframe, or open where none may be, beside the other faults."""
    return all_bar_quality(spark, sf_dir).select("symbol", "status", "issues")


@query(sql("bars", f"""{_ALL_BARS}, lc AS (SELECT symbol, max(day) AS day, arg_max(close, day) AS price, count(*)::BIGINT AS bars FROM bars WHERE substr(symbol, 2)::INT % 13 <> 4 GROUP BY symbol),
qt AS (SELECT symbol, k, CASE WHEN k % 5 <> 0 THEN price * 2 END AS price, CASE WHEN k % 6 = 1 THEN 'rejected' ELSE 'degraded' END AS status FROM (SELECT symbol, substr(symbol, 2)::INT AS k, arg_max(close, day) AS price FROM bars GROUP BY symbol) WHERE k % 7 <> 6)
SELECT symbol, coalesce(qt.status, 'rejected') AS quote_status, bq.status AS bars_status, CASE WHEN qt.status <> 'rejected' THEN qt.price END AS quote_price, CASE WHEN bq.status <> 'rejected' THEN lc.price END AS last_close, CASE WHEN bq.status <> 'rejected' THEN lc.bars END AS completed_bars,
  CASE WHEN qt.status <> 'rejected' AND qt.price IS NOT NULL THEN qt.price WHEN bq.status <> 'rejected' THEN lc.price END AS reference_price FROM bq LEFT JOIN qt USING (symbol) LEFT JOIN lc USING (symbol)"""))
def c20_guarded_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes that are fixtures are cleared, snapshots over rejected bars withheld; the reference price is what may be shown of the two."""
    k = F.substring("symbol", 2, 2).cast("int")
    last = views.bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "day").alias("last"))
    at = visible.at(visible.NOW)
    quotes = last.where(k % 7 != 6).select(
        "symbol", F.col("symbol").alias("wanted"), F.when(k % 5 != 0, F.col("last") * 2).alias("price"), at.alias("quoted_at"), at.alias("received_at"), F.when(k % 6 == 1, "fixture").otherwise("historical").alias("data_mode"), F.lit(False).alias("is_delayed"), F.lit("closed").alias("market_state"),
    )
    snapshots = all_bars(spark, sf_dir).groupBy("symbol").agg(F.max_by("close", "end_at").alias("last_close"), F.count("*").alias("completed_bars"))
    shown = quality.guarded_analysis(quality.quote_quality(quotes, at), all_bar_quality(spark, sf_dir), snapshots)
    return shown.withColumn("reference_price", F.coalesce("quote_price", "last_close"))


#: Minute bars of a symbol and day in pages of twenty and one, newest first; by the day of the month, the second page is missing, not
#: older than its cursor, different in its newest bar, or there twice, and some histories end in an empty page.
_PAGES = """mb AS (SELECT symbol || ':' || start_at::DATE AS request_id, start_at, end_at, close, start_at::DATE AS d, row_number() OVER (PARTITION BY symbol, start_at::DATE ORDER BY start_at DESC) - 1 AS r FROM minute_bars),
rq AS (SELECT request_id, day(min(d)) AS dd, CASE WHEN day(min(d)) % 5 = 0 THEN min(d)::TIMESTAMP ELSE min(start_at) END AS start_at, min(d)::TIMESTAMP + INTERVAL 1 DAY AS end_at, min(start_at) AS oldest, max(r) AS most FROM mb GROUP BY request_id),
rw AS (SELECT request_id, k, request_id || '#' || lpad(k::VARCHAR, 3, '0') AS page_id, start_at, end_at, CASE WHEN dd % 7 = 3 AND k = 1 AND r = 20 THEN close + 1 ELSE close END AS close, r, dd FROM mb JOIN (SELECT request_id, dd FROM rq) USING (request_id), LATERAL (SELECT unnest([r // 20, (r - 1) // 20]) AS k)
  WHERE k >= 0 AND r BETWEEN 20 * k AND 20 * k + 20),
r1 AS (SELECT DISTINCT request_id, k, page_id, start_at, end_at, close, r, dd FROM rw WHERE NOT (dd % 7 = 1 AND k = 1)),
pg AS (SELECT r1.request_id, page_id, CASE WHEN k = 0 THEN any_value(rq.end_at) ELSE max(r1.start_at) END AS cursor, CASE WHEN any_value(r1.dd) % 7 = 2 AND k = 1 THEN max(r1.start_at) + INTERVAL 1 MINUTE ELSE min(r1.start_at) END AS oldest, k, any_value(r1.dd) AS dd, count(*) AS n FROM r1 JOIN rq USING (request_id) GROUP BY r1.request_id, page_id, k),
pa AS (SELECT request_id, page_id, cursor, oldest FROM pg WHERE NOT (k > 0 AND n = 1) UNION ALL SELECT request_id, page_id || 'b', cursor, oldest FROM pg WHERE dd % 7 = 4 AND k = 1 AND n > 1 UNION ALL SELECT request_id, request_id || '#z', oldest, NULL FROM rq WHERE dd % 10 = 0),
fp AS (SELECT request_id, cursor, min(page_id) AS page_id, arg_min(struct_pack(o := oldest), page_id).o AS oldest, count(*) - 1 AS again FROM pa GROUP BY ALL),
wk AS (SELECT fp.*, 0 AS place FROM fp JOIN rq ON fp.request_id = rq.request_id AND cursor = end_at UNION ALL SELECT fp.*, place + 1 FROM wk JOIN fp ON fp.request_id = wk.request_id AND fp.cursor = wk.oldest AND wk.oldest < wk.cursor WHERE place + 1 < 12),
la AS (SELECT request_id, count(*) AS pages, sum(again)::BIGINT AS repeats, arg_max(struct_pack(o := oldest), place).o AS oldest, max(place) AS place, bool_or(coalesce(oldest >= cursor, false)) AS stuck FROM wk GROUP BY request_id),
co AS (SELECT request_id, count(*) AS n_rows, bool_or(odd) AS odd FROM (SELECT r1.request_id, r1.start_at, min(close) <> max(close) AS odd FROM r1 JOIN wk USING (page_id) JOIN rq ON rq.request_id = r1.request_id AND r1.start_at >= rq.start_at AND r1.end_at <= rq.end_at GROUP BY ALL) GROUP BY request_id)"""


def paged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests, pages and their rows."""
    mb = views.minute_bars(spark, sf_dir).select(F.concat_ws(":", "symbol", F.to_date("start_at").cast("string")).alias("request_id"), "start_at", "end_at", "close", F.to_date("start_at").alias("d"))
    mb = mb.withColumn("r", F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc("start_at"))) - 1)
    rq = mb.groupBy("request_id").agg(F.min("d").alias("d"), F.min("start_at").alias("oldest")).withColumn("dd", F.dayofmonth("d"))
    rq = rq.select("request_id", "dd", F.when(F.col("dd") % 5 == 0, F.col("d").cast("timestamp_ntz")).otherwise(F.col("oldest")).alias("start_at"), (F.col("d").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("end_at"), "oldest")
    own, r = F.floor(F.col("r") / 20), F.col("r")
    k = F.explode(F.when((r % 20 == 0) & (r > 0), F.array(own, own - 1)).otherwise(F.array(own))).alias("k")
    rows = mb.join(rq.select("request_id", "dd"), "request_id").select("request_id", "dd", "r", "start_at", "end_at", "close", k).where(~((F.col("dd") % 7 == 1) & (F.col("k") == 1)))
    rows = rows.withColumn("close", F.when((F.col("dd") % 7 == 3) & (F.col("k") == 1) & (r == 20), F.col("close") + 1).otherwise(F.col("close")))
    rows = rows.withColumn("page_id", F.concat("request_id", F.lit("#"), F.lpad(F.col("k").cast("string"), 3, "0")))
    newest = F.max("start_at")
    made = rows.groupBy("request_id", "page_id", "k", "dd").agg(newest.alias("newest"), F.when((F.col("dd") % 7 == 2) & (F.col("k") == 1), newest + F.expr("INTERVAL 1 MINUTE")).otherwise(F.min("start_at")).alias("oldest"), F.count("*").alias("n")).where((F.col("k") == 0) | (F.col("n") > 1))
    pages = made.join(rq.select("request_id", "end_at"), "request_id").select("request_id", "page_id", F.when(F.col("k") == 0, F.col("end_at")).otherwise(F.col("newest")).alias("cursor"), "oldest", "k", "dd")
    again = pages.where((F.col("dd") % 7 == 4) & (F.col("k") == 1)).withColumn("page_id", F.concat("page_id", F.lit("b")))
    empty = rq.where("dd % 10 = 0").select("request_id", F.concat("request_id", F.lit("#z")).alias("page_id"), F.col("oldest").alias("cursor"), F.lit(None).cast("timestamp_ntz").alias("oldest"))
    names = ["request_id", "page_id", "cursor", "oldest"]
    return rq.select("request_id", "start_at", "end_at"), pages.unionByName(again).select(*names).unionByName(empty), rows.select("page_id", "start_at", "end_at", "close")


@query(sql("minute_bars", f"""{_PAGES} SELECT rq.request_id, coalesce(pages, 0)::BIGINT AS pages, coalesce(repeats, 0)::BIGINT AS repeats, coalesce(n_rows, 0)::BIGINT AS rows,
  CASE WHEN stuck THEN 'no_progress' WHEN odd THEN 'conflicting' WHEN pages IS NOT NULL AND (la.oldest IS NULL OR la.oldest <= rq.start_at) THEN 'complete' WHEN place = 11 THEN 'page_limit' ELSE 'broken' END AS status FROM rq LEFT JOIN la USING (request_id) LEFT JOIN co USING (request_id)"""))
def s09_page_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute bars of a symbol and day, collected from pages that are linked by their cursors."""
    return paging.collected(*paged(spark, sf_dir), ["close"])[1]


@query(sql("facts", f"""sy AS (SELECT concept, unit, CASE concept WHEN 'A' THEN DATE '1996-06-01' WHEN 'N' THEN DATE '1998-06-01' END AS covered FROM (SELECT DISTINCT concept, unit FROM facts)),
rq AS (SELECT concept || unit || year(as_of) AS request_id, concept, unit, as_of FROM sy, (SELECT unnest([DATE '1995-03-31', DATE '1997-03-31', DATE '1999-03-31']) AS as_of) WHERE NOT (unit = 'F' AND year(as_of) = 1999 AND concept = 'N')),
du AS (SELECT DISTINCT concept, unit FROM rq JOIN sy USING (concept, unit) WHERE NOT coalesce(covered >= as_of, false)),
st AS (SELECT f.* FROM facts f JOIN sy USING (concept, unit) WHERE filed_date <= covered OR EXISTS (SELECT 1 FROM du WHERE du.concept = f.concept AND du.unit = f.unit)),
la AS (SELECT request_id, start_date, end_date, value, row_number() OVER (PARTITION BY request_id, start_date, end_date ORDER BY filed_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, value DESC) AS k FROM st JOIN rq USING (concept, unit) WHERE filed_date <= as_of),
ne AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY end_date DESC, start_date DESC) AS rank FROM la WHERE k = 1)
SELECT request_id, EXISTS (SELECT 1 FROM du WHERE du.concept = rq.concept AND du.unit = rq.unit) AS refreshed, end_date::VARCHAR AS end_date, value, rank::INT AS rank FROM rq LEFT JOIN (SELECT * FROM ne WHERE rank <= 4) n USING (request_id)"""))
def c33_facts_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of series at three days, of a store that was synced at different times and is filled where it doesn't reach."""
    source = views.facts(spark, sf_dir).withColumn("company", F.lit("C"))
    covered = F.when(F.col("concept") == "A", F.to_date(F.lit("1996-06-01"))).when(F.col("concept") == "N", F.to_date(F.lit("1998-06-01")))
    series = source.select("company", "concept", "unit").distinct().withColumn("covered_through", covered)
    days = F.array(*[F.to_date(F.lit(f"{y}-03-31")) for y in (1995, 1997, 1999)])
    requests = series.select("company", "concept", "unit", F.explode(days).alias("as_of")).withColumn("request_id", F.concat("concept", "unit", F.year("as_of").cast("string"))).where("NOT (unit = 'F' AND year(as_of) = 1999 AND concept = 'N')")
    store = source.where(F.col("filed_date") <= covered)
    ids = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "value"]
    found = facts.answered(requests, store, series.where("covered_through IS NOT NULL"), source, ids, F.to_date(F.lit("1999-06-15")))[0]
    return found.select("request_id", "refreshed", F.col("end_date").cast("string").alias("end_date"), "value", "rank")
