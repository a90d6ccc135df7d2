"""Citations held against the evidence of their run, and the rules of run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Prefixes of evidence that is stored and must still be found.
STORED = ["rag:", "financial:"]


def stored(evidence_id: Column) -> Column:
    out = F.lit(False)
    for prefix in STORED:
        out = out | evidence_id.startswith(prefix)
    return out


def check_citations(runs: DataFrame, citations: DataFrame, evidence: DataFrame, store: DataFrame) -> DataFrame:
    """Per run the first broken rule, ok if none.

    runs: run_id, request_mode, output_mode. citations: run_id, evidence_id. evidence: run_id, evidence_id, mode,
    what the run's tools gave; unique by the first two. store: evidence_id, unique. In order: a cited id that no tool gave; a stored
    one that is gone; one without a mode; evidence in a mode that the request doesn't allow; an output mode that isn't
    that of what is cited (null without citations, mixed for several).
    """
    cited = citations.select("run_id", "evidence_id").distinct()
    known = cited.join(evidence.select("run_id", "evidence_id", "mode", F.lit(True).alias("given")), ["run_id", "evidence_id"], "left")
    found = known.join(store.select("evidence_id", F.lit(True).alias("kept")), "evidence_id", "left")
    per = found.groupBy("run_id").agg(
        F.count_if(F.col("given").isNull()).alias("unknown"), F.count_if(stored(F.col("evidence_id")) & F.col("kept").isNull()).alias("gone"),
        F.count_if(F.col("mode").isNull()).alias("modeless"), F.min("mode").alias("low"), F.max("mode").alias("high"),
    )
    modes = evidence.where("mode IS NOT NULL").groupBy("run_id").agg(F.min("mode").alias("all_low"), F.max("mode").alias("all_high"))
    rows = runs.join(per, "run_id", "left").join(modes, "run_id", "left")
    want = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNotNull(), "mixed")
    foreign = (F.col("request_mode") != "mixed") & ((F.col("all_low") != F.col("request_mode")) | (F.col("all_high") != F.col("request_mode")))
    verdict = (
        F.when(F.col("unknown") > 0, "unknown_evidence_id").when(F.col("gone") > 0, "evidence_not_accessible").when(F.col("modeless") > 0, "evidence_data_mode_missing")
        .when(foreign, "data_mode_not_allowed").when(~F.col("output_mode").eqNullSafe(want), "data_mode_mismatch").otherwise("ok")
    )
    return rows.select("run_id", verdict.alias("verdict"))


def check_runs(records: DataFrame, events: DataFrame) -> DataFrame:
    """Per run record the rules that its events break, in order.

    records: run_id, terminal_status, model_requests, tool_executions, model_rounds, tool_calls, output_status. events: run_id,
    type, status, tool_call_id, executed. A run without exactly one terminal event breaks that rule alone.
    """
    kind = F.col("type")
    asked, answered = kind == "tool_requested", kind.isin("tool_succeeded", "tool_failed")
    calls = events.where(asked | answered).groupBy("run_id", "tool_call_id").agg(F.count_if(asked).alias("asked"), F.count_if(answered).alias("answered"))
    calls = calls.groupBy("run_id").agg(F.count_if((F.col("asked") != 1) | (F.col("answered") != 1)).alias("odd_calls"))
    per = events.groupBy("run_id").agg(F.count_if(kind == "run_finished").alias("ends"), F.max(F.when(kind == "run_finished", F.col("status"))).alias("ended"), F.max("executed").alias("observed"))
    rows = records.join(per, "run_id", "left").join(calls, "run_id", "left").na.fill({"ends": 0, "odd_calls": 0, "observed": 0})
    needs = F.col("ended").isin("completed", "insufficient_information")
    rules = F.array_compact(F.array(
        F.when(~F.col("terminal_status").eqNullSafe(F.col("ended")), "terminal_mismatch"), F.when(F.col("odd_calls") > 0, "tool_call_id_mismatch"),
        F.when(F.col("model_requests") > F.col("model_rounds"), "model_budget"), F.when(F.col("tool_executions") > F.col("tool_calls"), "tool_budget"),
        F.when(~F.col("tool_executions").eqNullSafe(F.col("observed")), "tool_execution_count_mismatch"), F.when(needs & F.col("output_status").isNull(), "missing_final_output"),
        F.when(F.col("output_status") != F.col("ended"), "output_status_mismatch"),
    ))
    return rows.select("run_id", F.when(F.col("ends") != 1, F.array(F.lit("terminal_count"))).otherwise(rules).alias("errors"))


ENDED_WELL = ["completed", "insufficient_information"]


def _per_run(events: DataFrame, errors: DataFrame) -> DataFrame:
    """What the rules ask of a run's events, in one aggregate a run."""
    kind = F.col("type")
    end, asked, answered = kind == "run_finished", kind == "tool_requested", kind.isin("tool_succeeded", "tool_failed")
    calls = events.where(asked | answered).groupBy("run_id", "tool_call_id").agg(F.count_if(asked).alias("asked"), F.count_if(answered).alias("answered"))
    calls = calls.groupBy("run_id").agg(F.count_if((F.col("asked") != 1) | (F.col("answered") != 1)).alias("odd_calls"))
    known = errors.select(F.col("code").alias("error_code"), F.col("stage").alias("error_stage"), F.col("message").alias("error_message"), F.lit(True).alias("is_public"))
    marked = events.join(F.broadcast(known), ["error_code", "error_stage", "error_message"], "left")

    def listed(when: Column, value: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("seq", value)))), lambda x: x[value])

    per = marked.groupBy("run_id").agg(
        F.count_if(end).alias("ends"), F.max(F.when(end, F.col("event_run_id"))).alias("end_run_id"), F.count_if(F.col("event_run_id") != F.col("run_id")).alias("foreign"),
        F.max(F.when(end, F.col("status"))).alias("ended"), F.max(F.when(end, F.col("error_code"))).alias("end_error"), F.coalesce(F.bool_or(F.when(end, F.col("is_public"))), F.lit(False)).alias("end_public"),
        F.coalesce(F.max("executed"), F.lit(0)).alias("observed"), F.count_if((kind == "tool_succeeded") & ~F.coalesce(F.col("fixture_mode") == "fixture", F.lit(False))).alias("no_fixture"),
        listed(asked, "tool").alias("asked_tools"), listed(kind == "tool_failed", "code").alias("failures"), F.collect_set(F.when(kind == "tool_succeeded", F.col("evidence_id"))).alias("gained"),
    )
    return per.join(calls, "run_id", "left")


def check_records(records: DataFrame, events: DataFrame, expected: DataFrame, errors: DataFrame) -> DataFrame:
    """Per run record the rules that it breaks, of twenty-one, in order.

    records: run_id, terminal_status, safe_error (a code), execution_mode, model_request_count, tool_execution_count, handler_call_count,
    model_rounds and tool_calls (the budgets), data_mode and evidence_ids (of the input), output_status, output_mode, claims (an array of arrays
    of evidence ids) and has_output. events: run_id, seq, event_run_id (null where the event names none), type, status, error_code, error_stage,
    error_message, tool_call_id, tool, code, executed, evidence_id, fixture_mode. expected, of some runs: run_id, terminal_status, tool_requests,
    tool_failures, handler_calls, model_requests. errors: code, stage and message of the public errors, a table of a few rows.
    A run without exactly one terminal event breaks that rule alone.
    """
    want = expected.select("run_id", F.struct(*[c for c in expected.columns if c != "run_id"]).alias("x"))
    rows = records.join(_per_run(events, errors), "run_id", "left").join(want, "run_id", "left").na.fill({"ends": 0, "odd_calls": 0, "observed": 0})
    c, x = F.col, F.col("x")
    failed = c("ended").eqNullSafe(F.lit("failed"))
    normal = F.when(failed, F.coalesce("end_error", F.lit("failed"))).otherwise(F.coalesce("ended", F.lit("missing")))
    allowed = F.concat("evidence_ids", "gained")
    strange = F.exists("claims", lambda ids: F.exists(ids, lambda i: ~F.coalesce(F.array_contains(allowed, i), F.lit(False))))
    judged = x.isNotNull()
    offline = (c("execution_mode") == "offline") & judged
    rules = {
        "run_id_mismatch": ~c("end_run_id").eqNullSafe(c("run_id")) | (c("foreign") > 0),
        "terminal_mismatch": ~c("terminal_status").eqNullSafe(normal),
        "unexpected_terminal": judged & ~c("terminal_status").eqNullSafe(x["terminal_status"]),
        "safe_error_mismatch": ~c("safe_error").eqNullSafe(c("end_error")),
        "terminal_error_mismatch": failed != c("end_error").isNotNull(),
        "unsafe_error": c("end_error").isNotNull() & ~c("end_public"),
        "tool_call_id_mismatch": c("odd_calls") > 0,
        "model_budget": F.coalesce("model_request_count", F.lit(0)) > c("model_rounds"),
        "tool_budget": F.coalesce("tool_execution_count", F.lit(0)) > c("tool_calls"),
        "tool_execution_count_mismatch": ~c("tool_execution_count").eqNullSafe(c("observed")),
        "handler_budget": c("handler_call_count") > c("tool_calls"),
        "missing_final_output": c("ended").isin(ENDED_WELL) & ~c("has_output"),
        "output_status_mismatch": c("has_output") & ~c("output_status").eqNullSafe(c("ended")),
        "data_mode_mismatch": c("has_output") & ~c("output_mode").eqNullSafe(F.when(F.size("claims") > 0, c("data_mode"))),
        "invalid_evidence": c("has_output") & strange,
        "fixture_mismatch": c("no_fixture") > 0,
        "tool_requests": offline & ~c("asked_tools").eqNullSafe(x["tool_requests"]),
        "tool_failures": offline & ~c("failures").eqNullSafe(x["tool_failures"]),
        "handler_calls": offline & ~c("handler_call_count").eqNullSafe(x["handler_calls"]),
        "model_requests": offline & ~c("model_request_count").eqNullSafe(x["model_requests"]),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules.items()]))
    return rows.select("run_id", F.when(c("ends") != 1, F.array(F.lit("terminal_count"))).otherwise(broken).alias("errors"))


def order_faults(events: DataFrame) -> DataFrame:
    """run_id, seq and fault of events out of order: result_before_request, request_repeated, result_repeated, or after_end.

    events: run_id, seq, type, tool_call_id. One pass over each run's events, in order; of events that share a
    seq a request comes first, then a result, and the end last, so that only a larger seq is after it.
    """
    kind = F.col("type")
    asked, answered = (kind == "tool_requested").cast("int"), kind.isin("tool_succeeded", "tool_failed").cast("int")
    order = ["seq", F.when(kind == "tool_requested", 0).when(answered == 1, 1).when(kind == "run_finished", 3).otherwise(2)]
    run = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    call = Window.partitionBy("run_id", "tool_call_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.select("run_id", "seq", asked.alias("asks"), answered.alias("answers"), F.coalesce(F.max((kind == "run_finished").cast("int")).over(run), F.lit(0)).alias("ended"), F.coalesce(F.sum(asked).over(call), F.lit(0)).alias("asked"), F.coalesce(F.sum(answered).over(call), F.lit(0)).alias("answered"))
    c = F.col
    fault = (
        F.when(c("ended") == 1, "after_end").when((c("asks") == 1) & (c("asked") > 0), "request_repeated")
        .when((c("answers") == 1) & (c("answered") > 0), "result_repeated").when((c("answers") == 1) & (c("asked") == 0), "result_before_request")
    )
    return seen.select("run_id", "seq", fault.alias("fault")).where("fault IS NOT NULL")
