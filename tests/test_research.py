"""Frames cut anywhere, HTML trees against a plain walk, plans of known questions, and each rule of run records."""

from __future__ import annotations

import random
import re
import xml.etree.ElementTree as ET

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import frames, html_tree
from tidemark.operators import evidence, targets

TEXT = "id: 1\revent: a\r\ndata: x\ndata:  y\r\n\r: note\nretry: 25\nretry: x\nretry: 99999999999\n\nid: 2\n\ndata\nid: bad\0id\r\rid:\ndata:z\n\ndata: cut off"
WANT = [("event", "1", "a", "x\n y", None), ("retry", "1", None, None, 25), ("cursor", "2", None, None, None), ("event", "2", "message", "", None), ("event", "", "message", "z", None)]


def read(parts, most=1000):
    """The frames of chunks, the parser's state written out between them."""
    state, out = None, []
    for part in parts:
        parser = frames.Frames(most=most, state=state)
        out += parser.feed(part)
        state = parser.state()
    return out


def test_frames_don_t_depend_on_where_chunks_are_cut():
    assert read([TEXT]) == WANT == read(list(TEXT))
    for i in range(len(TEXT)):
        for j in range(i, len(TEXT), 7):
            assert read([TEXT[:i], TEXT[i:j], TEXT[j:]]) == WANT


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="id:dataevnr \r\n\0x", max_size=80), st.lists(st.integers(0, 80), max_size=6))
def test_any_text_and_cuts(text, cuts):
    at = sorted({0, len(text), *(c for c in cuts if c < len(text))})
    assert read([text[a:b] for a, b in zip(at, at[1:])]) == read([text])


def test_frames_end_where_an_event_is_too_large():
    assert read(["data: a\n\ndata: " + "b" * 30], most=20) == [("event", "", "message", "a", None), ("error", "", None, None, None)]
    assert read(["data: " + "b" * 8 + "\n", "data: " + "b" * 8 + "\n", "\ndata: c\n\n"], most=20)[-1][0] == "error"
    assert [f[0] for f in read(["data: 1234567\n\n"] * 9, most=20)] == ["event"] * 9


def test_streams_of_chunks_are_folded_apart(spark):
    rows = [(s, i, TEXT[i * 3 : i * 3 + 3]) for s in range(20) for i in range(len(TEXT) // 3 + 1)] + [(99, 0, None), (99, 1, "data: a\n\n")]
    random.Random(1).shuffle(rows)
    chunks = spark.createDataFrame(rows, "stream_id long, seq long, chunk string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = frames.parsed(chunks).orderBy("stream_id", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in range(20):
        assert [tuple(r)[2:] for r in found if r["stream_id"] == s] == WANT
    assert [r["data"] for r in found if r["stream_id"] == 99] == ["a"]


def test_frames_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "in").mkdir()
    rows = [(s, i, TEXT[i * 25 : i * 25 + 25]) for s in range(3) for i in range(len(TEXT) // 25 + 1)]
    schema = "stream_id long, seq long, chunk string"
    for k in range(len(TEXT) // 25 + 1):
        spark.createDataFrame([r for r in rows if r[1] == k], schema).coalesce(1).write.parquet(str(tmp_path / f"s{k}"))
        next((tmp_path / f"s{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
    stream = frames.parsed_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("frames").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    assert {tuple(r) for r in spark.table("frames").collect()} == {tuple(r) for r in frames.parsed(spark.createDataFrame(rows, schema)).collect()}


BLOCK = html_tree.TEXT_BLOCKS
SHOWN = lambda e: e.tag not in ("script", "style", "noscript")


def plain_text(e):
    parts = [e.text or ""]
    for c in e:
        parts += [plain_text(c) if SHOWN(c) else "", c.tail or ""]
    return "".join(parts)


def plain_blocks(root):
    """The same by recursion over another parser's tree."""
    parent = {c: p for p in root.iter() for c in p}
    squeeze = lambda s: re.sub(r"\s+", " ", s).strip()

    def path(e):
        if e not in parent:
            return "/" + e.tag
        same = [c for c in parent[e] if c.tag == e.tag]
        return path(parent[e]) + "/" + e.tag + (f"[{same.index(e) + 1}]" if len(same) > 1 else "")

    def holds(e):
        return SHOWN(e) and any(SHOWN(c) and (c.tag in BLOCK or c.tag == "table" or holds(c)) for c in e)

    def table(e):
        def rows(x):
            for c in x:
                if c.tag == "tr":
                    yield c
                if c.tag != "table":
                    yield from rows(c)

        lines = [" | ".join(t for c in r if c.tag in ("td", "th") and (t := squeeze(plain_text(c)))) for r in rows(e)]
        return "\n".join(x for x in lines if x)

    out = []

    def walk(e):
        if not SHOWN(e):
            return
        if e.tag == "table":
            if table(e):
                out.append(("table", table(e), path(e)))
            return
        words = e.text or ""
        for c in e:
            if SHOWN(c) and (c.tag in BLOCK or c.tag == "table" or holds(c)):
                if squeeze(words):
                    out.append(("text", squeeze(words), path(e)))
                words = ""
                walk(c)
            elif SHOWN(c):
                words += squeeze(plain_text(c))
            words += c.tail or ""
        if squeeze(words):
            out.append(("text", squeeze(words), path(e)))

    walk(next(root.iter("body")))
    return out


def made(rng, depth, tags, in_text=False):
    """A random tree; within p and h2 there are no blocks, which would end them."""
    e = ET.Element(rng.choice(tags))
    in_text = in_text or e.tag in ("p", "h2")
    e.text = "x" if e.tag == "script" else "" if e.tag in ("table", "tr") else rng.choice(["", "a", " b\n", "c & <d> "])
    below = {"table": ["tr"], "tr": ["td", "th"], "script": []}.get(e.tag, ["span", "b", "i", "script"] if in_text else ["div", "span", "b", "table", "section", "script", "h2", "i", "p"])
    for _ in range(rng.randrange(4) if depth and below else 0):
        c = made(rng, depth - 1, below, in_text)
        c.tail = "" if e.tag in ("table", "tr") else rng.choice(["", " t", "u "])
        e.append(c)
    return e


def test_blocks_and_paths_are_those_of_a_plain_walk():
    rng = random.Random(11)
    seen = set()
    for _ in range(400):
        root = ET.Element("html")
        body = ET.SubElement(root, "body")
        for _ in range(rng.randrange(5)):
            child = made(rng, 5, ["div", "p", "span", "table", "section"])
            child.tail = rng.choice(["", "tail "])
            body.append(child)
        found = html_tree.blocks_of(ET.tostring(root, encoding="unicode", short_empty_elements=False))
        assert found == plain_blocks(root)
        seen |= {k for k, _, _ in found}
    assert seen == {"text", "table"}


def test_blocks_of_odd_html():
    html = "<title>T</title><body><script>var x='<p>no</p>'</script><p>a <b>b</b><p>c<table><tr><td>1<td>2<tr><td><table><tr><td>in</td></tr></table></td></tr></table><noscript>no</noscript>end</span></body>"
    assert html_tree.blocks_of(html) == [("text", "a b", "/body/p[1]"), ("text", "c", "/body/p[2]"), ("table", "1 | 2\nin", "/body/table"), ("text", "end", "/body")]
    assert html_tree.blocks_of("") == [] and html_tree.blocks_of("plain") == [("text", "plain", "/")]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert [b[:2] for b in html_tree.blocks_of(deep)] == [("text", "x")]
    assert html_tree.blocks_of("<ix:header><p>no</p></ix:header><ix:nonnumeric><p>yes</p></ix:nonnumeric>") == [("text", "yes", "/ix:nonnumeric/p")]


def asked(spark, *questions):
    rows = targets.plans(spark.createDataFrame([(i, q) for i, q in enumerate(questions)], "question_id int, question string")).orderBy("question_id").collect()
    return [{k: v for k, v in r.asDict().items() if k not in ("question_id", "planned") and v not in (False, None, [])} if r["planned"] else None for r in rows]


def test_plans_of_known_questions(spark):
    found = asked(
        spark, "AAPL 现在多少钱？", "RSI 和支撑位", "结合技术面看看", "过去 3 次 CPI 后的走势", "这次和过去五次 CPI 公布后怎么走", "最近 CPI 怎么样", "财报后怎么走", "前两次财报后的表现", "为什么 CPI 后下跌", "hello", None, " QUOTE and Earnings 后市场反应 ", "财报",
    )
    assert found == [
        {"needs_quote": True}, {"needs_technical": True}, {"needs_technical": True, "needs_decision": True},
        {"needs_macro": True, "macro_release_type": "cpi", "needs_macro_reaction_history": True, "macro_reaction_history_limit": 3},
        {"needs_macro": True, "macro_release_type": "cpi", "needs_macro_reaction": True, "needs_macro_reaction_history": True, "macro_reaction_history_limit": 5},
        {"needs_macro": True, "macro_release_type": "cpi"}, {"needs_earnings_reaction": True}, {"needs_earnings_reaction_history": True, "earnings_reaction_history_limit": 2},
        None, None, None, {"needs_quote": True, "needs_earnings_reaction": True}, None,
    ]
    assert len(targets.plans(spark.createDataFrame([], "question_id int, question string")).columns) == 16


RECORD = {
    "terminal_status": "completed", "safe_error": None, "execution_mode": "offline", "model_request_count": 2, "tool_execution_count": 1, "handler_call_count": 1, "model_rounds": 5, "tool_calls": 3, "data_mode": "fixture",
    "evidence_ids": ["in"], "output_status": "completed", "output_mode": "fixture", "claims": [["in", "ev"]], "has_output": True,
}
END = {"seq": 9, "type": "run_finished", "status": "completed", "event_run_id": "self", "executed": 1}
ASK = {"seq": 1, "type": "tool_requested", "tool_call_id": "t", "tool": "price"}
DONE = {"seq": 2, "type": "tool_succeeded", "tool_call_id": "t", "executed": 1, "evidence_id": "ev", "fixture_mode": "fixture"}
FAIL = {"error_code": "late", "error_stage": "tool", "error_message": "Too late."}
CASE = {"terminal_status": "completed", "tool_requests": ["price"], "tool_failures": [], "handler_calls": 1, "model_requests": 2}
#: Rule: what is changed of the record, the end, the request, the result and the case.
BROKEN = {
    "run_id_mismatch": ({}, {"event_run_id": "foreign"}, {}, {}, {}),
    "terminal_mismatch": ({"terminal_status": "failed"}, {}, {}, {}, {"terminal_status": "failed"}),
    "unexpected_terminal": ({}, {}, {}, {}, {"terminal_status": "failed"}),
    "safe_error_mismatch": ({"safe_error": "late"}, {}, {}, {}, {}),
    "terminal_error_mismatch": ({"safe_error": "late"}, FAIL, {}, {}, {}),
    "unsafe_error": ({"terminal_status": "late", "safe_error": "late", "has_output": False}, {**FAIL, "status": "failed", "error_message": "secret"}, {}, {}, {"terminal_status": "late"}),
    "tool_call_id_mismatch": ({}, {}, {}, {"tool_call_id": "u"}, {}),
    "model_budget": ({"model_request_count": 6}, {}, {}, {}, {"model_requests": 6}),
    "tool_budget": ({"tool_execution_count": 4}, {"executed": 4}, {}, {}, {}),
    "tool_execution_count_mismatch": ({"tool_execution_count": 2}, {}, {}, {}, {}),
    "handler_budget": ({"handler_call_count": 4}, {}, {}, {}, {"handler_calls": 4}),
    "missing_final_output": ({"has_output": False}, {}, {}, {}, {}),
    "output_status_mismatch": ({"output_status": "insufficient_information"}, {}, {}, {}, {}),
    "data_mode_mismatch": ({"claims": []}, {}, {}, {}, {}),
    "invalid_evidence": ({"claims": [["in"], ["gone"]]}, {}, {}, {}, {}),
    "fixture_mismatch": ({}, {}, {}, {"fixture_mode": "live"}, {}),
    "tool_requests": ({}, {}, {}, {}, {"tool_requests": ["price", "price"]}),
    "tool_failures": ({"claims": [["in"]]}, {}, {}, {"type": "tool_failed", "code": "timeout"}, {}),
    "handler_calls": ({"handler_call_count": None}, {}, {}, {}, {}),
    "model_requests": ({}, {}, {}, {}, {"model_requests": 3}),
}


def test_each_rule_of_run_records_is_found_alone(spark):
    records, events, cases, want = [], [], [], {}
    for k, (rule, changes) in enumerate({"": ({},) * 5, **BROKEN}.items()):
        record, end, ask, done, case = ({**a, **b} for a, b in zip((RECORD, END, ASK, DONE, CASE), changes))
        records.append({"run_id": k, **record})
        for e in (end, ask, done):
            events.append({**e, "run_id": k, "event_run_id": {"self": k, "foreign": k + 1, None: None}[e.get("event_run_id")]})
        cases.append({"run_id": k, **case})
        want[k] = [rule] if rule else []
    records += [{"run_id": 100, **RECORD}, {"run_id": 101, **RECORD}, {"run_id": 102, **RECORD, "execution_mode": "real", "model_request_count": 1}, {"run_id": 103, **RECORD, "model_request_count": 1}]
    events += [{**END, "run_id": 101, "event_run_id": 101, "seq": s} for s in (8, 9)] + [{**e, "run_id": r, "event_run_id": r} for r in (102, 103) for e in (END, ASK, DONE)]
    cases.append({"run_id": 102, **CASE})
    want |= {100: ["terminal_count"], 101: ["terminal_count"], 102: [], 103: []}
    types = "run_id long, seq long, event_run_id long, type string, status string, error_code string, error_stage string, error_message string, tool_call_id string, tool string, code string, executed long, evidence_id string, fixture_mode string"
    names = [c.split()[0] for c in types.split(", ")]
    rows = [tuple(e.get(n) for n in names) for e in events]
    record_type = "run_id long, terminal_status string, safe_error string, execution_mode string, model_request_count long, tool_execution_count long, handler_call_count long, model_rounds long, tool_calls long, data_mode string, evidence_ids array<string>, output_status string, output_mode string, claims array<array<string>>, has_output boolean"
    found = evidence.check_records(
        spark.createDataFrame([tuple(r.values()) for r in records], record_type), spark.createDataFrame(rows, types),
        spark.createDataFrame([tuple(c.values()) for c in cases], "run_id long, terminal_status string, tool_requests array<string>, tool_failures array<string>, handler_calls long, model_requests long"),
        spark.createDataFrame([("late", "tool", "Too late.")], "code string, stage string, message string"),
    )
    assert {r["run_id"]: r["errors"] for r in found.collect()} == want
    odd = evidence.order_faults(spark.createDataFrame([(1, 1, "tool_succeeded", "a"), (1, 2, "tool_requested", "a"), (1, 3, "tool_requested", "a"), (1, 4, "tool_failed", "a"), (1, 5, "run_finished", None), (1, 6, "model_usage", None)], "run_id long, seq long, type string, tool_call_id string"))
    assert {r["seq"]: r["fault"] for r in odd.collect()} == {1: "result_before_request", 3: "request_repeated", 4: "result_repeated", 6: "after_end"}


def test_what_shares_a_place_with_the_end_is_not_after_it(spark):
    rows = [(k, 3, *e) for k in range(8) for e in ([("run_finished", None), ("tool_failed", "a"), ("run_finished", None)] if k % 2 else [("tool_failed", "a"), ("run_finished", None)])]
    odd = evidence.order_faults(spark.createDataFrame(rows, "run_id long, seq long, type string, tool_call_id string"))
    assert sorted((r["run_id"], r["fault"]) for r in odd.collect()) == sorted([(k, "result_before_request") for k in range(8)] + [(k, "after_end") for k in range(1, 8, 2)])


def test_index_rows_need_four_cells_and_a_named_link():
    html = '<table class="tableFile"><tr><td>1</td><td> a <i>b</i></td><td><a> x </a><td>10-K</tr><tr><td>2<td><td>no link<td>t</tr><tr><td>3</td><td></td><td><a></a></td><td></td></tr><tr><td></td><td></td><td><a>y.htm</a></td><td>EX</td><td>9</td></tr></table><table><tr><td>1<td>2<td><a>z</a><td>4</table>'
    assert html_tree.index_rows(html) == [("1", "x", "10-K", "a b"), (None, "y.htm", "EX", None)]


def test_facts_are_filled_where_the_store_does_not_reach(spark):
    from datetime import date

    from tidemark.operators import facts

    row = "company string, concept string, unit string, start_date date, end_date date, filed_date date, value double, k long"
    source = [("C", c, "u", date(2020, m, 1), date(2020, m, 28), date(2020, m + 1, 15), float(m), m) for c in "ab" for m in range(1, 11)]
    store = [r for r in source if r[1] == "a" and r[5] <= date(2020, 6, 30)]
    asked = [(1, "C", "a", "u", date(2020, 6, 1)), (2, "C", "b", "u", date(2020, 4, 1)), (3, "C", "c", "u", date(2020, 4, 1))]
    found, added, states = facts.answered(
        spark.createDataFrame(asked, "request_id long, company string, concept string, unit string, as_of date"), spark.createDataFrame(store, row),
        spark.createDataFrame([("C", "a", "u", date(2020, 6, 30))], "company string, concept string, unit string, covered_through date"), spark.createDataFrame(source, row), ["concept", "k"], F.to_date(F.lit("2020-12-31")),
    )
    rows = {(r["request_id"], r["rank"]): (r["refreshed"], r["value"]) for r in found.collect()}
    assert rows == {(1, 1): (False, 4.0), (1, 2): (False, 3.0), (1, 3): (False, 2.0), (1, 4): (False, 1.0), (2, 1): (True, 2.0), (2, 2): (True, 1.0), (3, None): (True, None)}
    assert {r["concept"] for r in added.collect()} <= {"b"}
    assert {r["concept"]: str(r["covered_through"]) for r in states.collect()} == {"a": "2020-06-30", "b": "2020-12-31", "c": "2020-12-31"}
