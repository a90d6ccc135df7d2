"""What a question is about, and whether its research is complete: verified targets, cues, plan rules, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import mentions
from tidemark.functions.text import release_type

#: Words that compare or join several securities.
JOINING_WORDS = ["比较", "对比", "相比", "和", "与", "跟", "以及", "还有", "还是", "哪个", "哪只", "哪一个"]
#: Tickers that are ordinary words when written without a dollar sign.
ORDINARY_TICKERS = ["AI"]
#: Numerals before the word for times.
NUMERALS = {"两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10}
#: Words for what is past.
_PAST = "(?:过去|之前|最近|前|历史)"
DEFAULT_TIMES = 5


def joins_targets(message: Column) -> Column:
    """Whether the message compares or lists several securities; false for null."""
    cue = message.rlike("|".join(JOINING_WORDS)) | message.rlike("(?i)(?:^|[^A-Za-z0-9])(?:vs|versus)(?:[^A-Za-z0-9]|$)")
    return F.coalesce(cue, F.lit(False))


def times_asked(question: Column) -> Column:
    """How many past events a question asks for, in digits or as a numeral; DEFAULT_TIMES where it doesn't say."""
    digits = F.regexp_extract(question, rf"{_PAST}\s*([0-9]+)\s*次", 1).try_cast("int")
    numeral = F.regexp_extract(question, rf"{_PAST}\s*([{''.join(NUMERALS)}])\s*次", 1)
    table = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in pair])
    return F.coalesce(digits, F.try_element_at(table, numeral), F.lit(DEFAULT_TIMES))


def resolve(messages: DataFrame, mentions: DataFrame, registry: DataFrame) -> DataFrame:
    """A row per message: its resolved symbols in order, how many mentions are ambiguous or rejected, and whether meaning must decide.

    messages: message_id, message. mentions: message_id, start (unique in a message), source, text, candidates.
    registry: ticker (unique), symbol. A mention with one verified symbol is resolved, with several ambiguous, with none rejected.
    """
    each = mentions.select("message_id", "start", "source", "text", F.posexplode_outer("candidates").alias("place", "ticker"))
    known = each.join(registry, "ticker", "left")
    odd = (F.col("source") == "explicit") & ~F.col("text").startswith("$") & F.col("ticker").isin(*ORDINARY_TICKERS)
    per = known.groupBy("message_id", "start").agg(
        F.count_distinct("symbol").alias("n"), F.min_by("symbol", F.when(F.col("symbol").isNotNull(), F.col("place"))).alias("symbol"), F.coalesce(F.bool_or(odd), F.lit(False)).alias("odd")
    )
    first = per.where("n = 1").groupBy("message_id", "symbol").agg(F.min("start").alias("start"))
    lists = first.groupBy("message_id").agg(F.sort_array(F.collect_list(F.struct("start", "symbol")))["symbol"].alias("resolved"))
    counts = per.groupBy("message_id").agg(F.count("*").alias("n_mentions"), F.count_if(F.col("n") > 1).alias("n_ambiguous"), F.count_if(F.col("n") == 0).alias("n_rejected"), F.bool_or("odd").alias("odd"))
    out = messages.join(counts, "message_id", "left").join(lists, "message_id", "left")
    out = out.withColumn("resolved", F.coalesce("resolved", F.array().cast("array<string>"))).na.fill({"n_mentions": 0, "n_ambiguous": 0, "n_rejected": 0})
    unsure = (
        (F.col("n_mentions") == 0) | (F.col("n_rejected") > 0) | (F.col("n_ambiguous") > 0) | F.coalesce("odd", F.lit(False))
        | (joins_targets(F.col("message")) & (F.size("resolved") < 2))
    )
    return out.select("message_id", "resolved", "n_mentions", "n_ambiguous", "n_rejected", unsure.alias("needs_meaning"))


def from_messages(messages: DataFrame, dictionary: DataFrame, registry: DataFrame, fallback: DataFrame | None = None, split: bool = False) -> DataFrame:
    """resolve() for messages (doc_id, text) themselves: both scanners, the longest of overlapping mentions, candidates checked in the registry, else in the fallback.

    dictionary: alias (unique), tickers (array). registry and fallback: ticker (unique), symbol. split is that of mentions.Scanner.
    """
    found = mentions.without_overlaps(mentions.spans(messages, dictionary.select("alias"), split=split))
    named = found.join(dictionary.select(F.lit("alias").alias("source"), F.col("alias").alias("name"), "tickers"), ["source", "name"], "left")
    candidates = F.when(F.col("source") == "explicit", F.array("name")).otherwise(F.col("tickers"))
    known = registry if fallback is None else registry.unionByName(fallback.join(registry.select("ticker"), "ticker", "left_anti"))
    given = named.select(F.col("doc_id").alias("message_id"), "start", "source", F.col("said").alias("text"), candidates.alias("candidates"))
    return resolve(messages.select(F.col("doc_id").alias("message_id"), F.col("text").alias("message")), given, known)


#: Words of a question, and what it needs if it has one of them. A question with a word of
#: meaning needs a reading that keywords don't give.
WORDS = {
    "meaning": ["为什么", "原因", "解释", "管理层", "风险", "数据中心", "毛利率", "营收", "收入", "净利润", "eps", "revenue", "net income"],
    "company_profile": ["公司是做什么", "主营业务", "公司简介", "company profile"],
    "quote": ["现在多少钱", "当前多少钱", "当前股价", "现价", "报价", "current price", "quote"],
    "technical": ["rsi", "ma20", "ma50", "ma200", "atr", "均线", "支撑位", "阻力位", "支撑", "阻力", "技术指标"],
    "full_technical": ["技术分析", "技术层面", "结合技术面", "从技术面"],
    "decision": ["当前走势", "技术面怎么看", "技术面如何", "偏多", "偏空", "趋势怎么样", "动能怎么样", "失效条件", "market view"],
    "reaction": ["发布后", "公布后", "披露后", "财报后", "之后怎么走", "后的走势", "后的表现", "市场反应", "涨了多少", "跌了多少"],
    "history": ["之前几次", "过去几次", "最近几次", "历史几次", "前几次", "之前的", "过去的", "历史上", "historical", "previous releases", "previous earnings"],
    "current_event": ["这次", "本次", "最近一次", "最新一次"],
    "earnings": ["财报", "业绩", "earnings"],
}
#: Patterns that ask for a reaction and for history as the words above do.
PATTERNS = {"reaction": r"后[^\n]*(?:怎么走|走势|表现|市场反应)", "history": rf"{_PAST}\s*(?:[0-9]+|[{''.join(NUMERALS)}])\s*次"}


def _says(question: Column, what: str) -> Column:
    found = F.lit(False)
    for word in WORDS[what]:
        found = found | question.contains(word)
    return found | question.rlike(PATTERNS[what]) if what in PATTERNS else found


def plans(questions: DataFrame) -> DataFrame:
    """question_id, planned, and the fourteen fields of the plan that the words of a question give.

    questions: question_id, question. All intents of a question are taken together. planned is false, and
    every field null, where the question has a word of meaning or none that tells what it wants; null questions aren't planned.
    """
    q = F.lower(F.trim(F.coalesce("question", F.lit(""))))
    said = questions.select("question_id", q.alias("q"), *[_says(q, w).alias(f"_{w}") for w in WORDS], release_type(q).alias("_type"), times_asked(q).alias("_times"))
    c = {w: F.col(f"_{w}") for w in WORDS}
    macro = F.col("_type").isNotNull()
    now = c["current_event"] | ~c["history"]
    fields = {
        "needs_company_profile": c["company_profile"], "needs_quote": c["quote"], "needs_technical": c["technical"] | c["full_technical"], "needs_decision": c["decision"] | c["full_technical"],
        "knowledge_question": F.lit(None).cast("string"), "financial_requests": F.array().cast("array<string>"),
        "needs_macro": macro, "macro_release_type": F.col("_type"), "needs_macro_reaction": macro & c["reaction"] & now, "needs_macro_reaction_history": macro & c["reaction"] & c["history"],
        "macro_reaction_history_limit": F.when(macro & c["reaction"] & c["history"], F.col("_times")),
        "needs_earnings_reaction": c["earnings"] & c["reaction"] & now, "needs_earnings_reaction_history": c["earnings"] & c["reaction"] & c["history"],
        "earnings_reaction_history_limit": F.when(c["earnings"] & c["reaction"] & c["history"], F.col("_times")),
    }
    wants = F.lit(False)
    for name in ("needs_company_profile", "needs_quote", "needs_technical", "needs_decision", "needs_macro", "needs_earnings_reaction", "needs_earnings_reaction_history"):
        wants = wants | fields[name]
    rows = said.withColumn("planned", ~c["meaning"] & wants)
    return rows.select("question_id", "planned", *[F.when(F.col("planned"), value).alias(name) for name, value in fields.items()])


def plan_faults() -> Column:
    """The rules that a plan row breaks, in order."""
    reaction = F.col("needs_macro_reaction") | F.col("needs_macro_reaction_history")

    def limit(needed: str, value: str) -> list[Column]:
        return [F.when(F.col(needed) & F.col(value).isNull(), f"{value}_missing"), F.when(~F.col(needed) & F.col(value).isNotNull(), f"{value}_unexpected")]

    return F.array_compact(F.array(
        F.when(~F.col("needs_macro") & F.col("macro_release_type").isNotNull(), "release_type_without_macro"),
        F.when(reaction & ~F.col("needs_macro"), "reaction_without_macro"), F.when(reaction & F.col("macro_release_type").isNull(), "reaction_without_release_type"),
        *limit("needs_macro_reaction_history", "macro_history_limit"), *limit("needs_earnings_reaction_history", "earnings_history_limit"),
    ))


def missing_information(wanted: DataFrame, results: DataFrame) -> DataFrame:
    """Of wanted (run_id, company_id, capability) those without a usable result, with the reason and whether to retry.

    results: run_id, company_id, capability, usable, outage; unique by the first three. What never ran may be run again, as may what failed by an outage.
    """
    keys = ["run_id", "company_id", "capability"]
    rows = wanted.join(results, keys, "left").where(~F.coalesce("usable", F.lit(False)))
    ran = F.col("usable").isNotNull()
    reason = F.concat(F.col("capability"), F.when(ran, "_unavailable").otherwise("_not_executed"))
    return rows.select(*keys, reason.alias("reason"), (~ran | F.coalesce("outage", F.lit(False))).alias("retryable"))


def completeness(runs: DataFrame, missing: DataFrame, retries: int = 1) -> DataFrame:
    """Per run (run_id, retry_count) enough, retry or cannot_retry, and how much is missing."""
    n = missing.groupBy("run_id").agg(F.count("*").alias("n_missing"), F.bool_or("retryable").alias("again"))
    rows = runs.join(n, "run_id", "left").na.fill({"n_missing": 0})
    status = F.when(F.col("n_missing") == 0, "enough").when(F.col("again") & (F.col("retry_count") < retries), "retry").otherwise("cannot_retry")
    return rows.select("run_id", "n_missing", status.alias("status"))
