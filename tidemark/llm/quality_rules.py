"""Quality rules whose cutoffs are chosen under an exact bound on false rejections.

Each rule rejects a text whose value lies above a cutoff. For each stratum (language) the labelled
good documents are a holdout: a cutoff may be used if "at least a share alpha of the good documents
lies above it" is refuted by the exact binomial tail P(Bin(n, alpha) <= k), where k of the n good
documents lie above. Cutoffs of one rule and stratum are tested from the most lenient to the
strictest, which needs no correction as the tail only rises; the rules and strata together are
corrected by Bonferroni. alpha is shared among the rules, so that all of them together reject a
share of at most false_rejection of the good documents in every stratum, with the given confidence.
The guarantee is for good documents that pass the base rules. A document counts once, however many
rows it has: rows that share an id are one draw, that of the least metrics.

A cutoff that no good document passes needs n of them with (1 - alpha)^n <= error / tests: with the
default risk and four strata, 996 labelled good documents in a stratum; one with fewer has no cutoff.

Everything is built from SQL functions, with no Python on the executors.

Defined results: null and empty texts have no words and fail the base rules. A null language is a
stratum of its own; strata without a labelled good document are not tested and not counted. A document with several labels is good if all of them say so; null labels and
labels of unknown documents count for nothing. A stratum with too few labels to refute anything
has no cutoffs and keeps what passes the base rules. Repeated rows are judged alike. Columns
besides doc_id, text and lang are left as they are; those whose names clash with the metrics are
not touched either, because metrics are computed under names of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import GAP, UPPER, cut, group_key, let, lookup, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Risk:
    """false_rejection: most good documents lost per stratum; error: chance that the bound fails."""

    false_rejection: float = 0.03
    error: float = 0.05


#: Rule, its value from the metrics, and its cutoffs, first, last and step in thousandths.
RULES = {
    "symbols": ("try_divide(m.n_symbols, m.word_chars)", (20, 1000, 20)),
    "dup_lines": ("try_divide(m.n_dup_lines, m.n_lines)", (20, 1000, 20)),
    "repeats": ("try_divide(m.n_repeat_words, m.n_words)", (20, 1000, 20)),
    "capitals": ("try_divide(m.n_capitals, m.word_chars)", (20, 1000, 20)),
    "word_length": ("try_divide(m.word_chars, m.n_words)", (4000, 30000, 250)),
}


def repeated_words(ws: Column) -> Column:
    """Words that stand in a 3-word window found twice or more among the words, as a count.

    Windows are compared by 64-bit hashes; a text is sorted by them only if it has equal ones.
    """
    windows = F.when(
        F.size(ws) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(ws) - 3),
            lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda n, step: n + step)

    def starts(pairs: Column) -> Column:
        same = F.filter(
            pairs,
            lambda x, i: (x["h"] == F.get(pairs, i - 1)["h"]) | (x["h"] == F.get(pairs, i + 1)["h"]),
        )
        return F.sort_array(F.transform(same, lambda x: x["p"]))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(let(pairs, starts), covered)
        )

    return let(windows, count).cast("long")


def metrics(text: Column) -> Column:
    """A struct of the counts that rules use; all of them are long and never null."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def without(chars: str) -> Column:
        return F.length(text) - F.length(F.translate(text, chars, ""))

    def of_words(ws: Column) -> Column:
        return F.struct(F.size(ws).cast("long").alias("n_words"), repeated_words(ws).alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        return F.struct(
            F.size(ls).cast("long").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        )

    def joined(w: Column) -> Column:
        return let(
            let(lines, of_lines),
            lambda ln: F.struct(
                w["n_words"].alias("n_words"),
                F.length(F.regexp_replace(text, GAP, "")).cast("long").alias("word_chars"),
                without(SYMBOLS).cast("long").alias("n_symbols"),
                ln["n_dup_lines"].alias("n_dup_lines"),
                w["n_repeat_words"].alias("n_repeat_words"),
                ln["n_lines"].alias("n_lines"),
                without(UPPER).cast("long").alias("n_capitals"),
            ),
        )

    return let(let(words(text), of_words), joined)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, the stratum and the metrics m of every document."""
    return docs.select("doc_id", group_key(F.col("lang")).alias("stratum"), metrics(F.col("text")).alias("m"))


def tail(n: Column, k: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k) for k < n * alpha, else 1: such a k refutes nothing."""
    odds = F.log(F.lit(alpha / (1 - alpha)))
    first = n * F.log(F.lit(1 - alpha))

    def add(s: Column, i: Column) -> Column:
        term = s["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("t"), (s["p"] + F.exp(term)).alias("p"))

    more = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    total = F.aggregate(more, F.struct(first.alias("t"), F.exp(first).alias("p")), add, lambda s: s["p"])
    return F.when(k >= n * alpha, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The strictest safe cutoff of each stratum and rule: columns stratum, cuts map<rule, cutoff>."""
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .where("quality = 1")
        .select("doc_id")
    )
    alpha = risk.false_rejection / len(RULES)
    held = measured.join(good, "doc_id", "left_semi").where(~base_failed(F.col("m")))
    held = cut(held.groupBy("doc_id").agg(F.min(F.struct("stratum", "m")).alias("one")).select("one.stratum", "one.m"))
    values = held.select(
        "stratum",
        F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.expr(v).alias("value")) for r, (v, _) in RULES.items()])).alias("r"),
    )
    # Counted by the first cutoff that a value lies under, so that one row per cell is left.
    grid = F.lit(None)
    for rule, (_, (low, high, step)) in RULES.items():
        slot = F.least(F.lit((high - low) // step + 1), F.greatest(F.lit(0), F.ceil((F.col("r.value") * 1000 - low) / step)))
        grid = F.when(F.col("r.rule") == rule, slot.cast("int")).otherwise(grid)
    cells = values.groupBy("stratum", F.col("r.rule").alias("rule"), grid.alias("slot")).count()
    totals = cells.groupBy("stratum", "rule").agg(
        F.sum("count").alias("n"), F.collect_list(F.struct("slot", "count")).alias("cells")
    )
    slots = F.lit(None)
    for rule, (_, (low, high, step)) in RULES.items():
        every = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(c / 1000).alias("cutoff")) for i, c in enumerate(range(low, high + 1, step))])
        slots = F.when(F.col("rule") == rule, every).otherwise(slots)
    above = F.aggregate(
        F.filter("cells", lambda c: c["slot"] > F.col("s.slot")), F.lit(0).cast("long"), lambda a, c: a + c["count"]
    )
    tests = totals.withColumn("s", F.explode(slots)).select("stratum", "rule", "n", above.alias("k"), F.col("s.cutoff").alias("cutoff"))
    strata = held.select("stratum").distinct().count()
    level = risk.error / (len(RULES) * max(1, strata))
    safe = tests.where(tail(F.col("n"), F.col("k"), alpha) <= level)
    best = safe.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return best.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))


def verdict(cuts: Column) -> Column:
    """Whether a document with metrics m passes the base rules and all cutoffs; true or false."""
    fails = base_failed(F.col("m"))
    for rule, (value, (low, _, step)) in RULES.items():
        over = F.ceil((F.expr(value) * 1000 - low) / step) * step + low > F.round(cuts[rule] * 1000)
        fails = fails | F.coalesce(over, F.lit(False))
    return ~fails


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured with base_failed and kept."""
    return (
        measured.join(lookup(cuts), "stratum", "left")
        .withColumn("base_failed", base_failed(F.col("m")))
        .withColumn("kept", verdict(F.col("cuts")))
        .drop("cuts")
    )


def apply_rules(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed and kept."""
    table = cut(measured(docs))
    cuts = cut(cutoffs(table, labels, risk))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judge(table, cuts).select("doc_id", *[F.col(f"m.{n}").alias(n) for n in names], "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, risk: Risk = Risk()) -> DataFrame:
    """The documents that pass, with the columns they came with.

    Documents are written with their metrics once: cutoffs need the metrics of that table only, and
    the verdict reads the documents beside them, so that no text is measured twice or shuffled.
    """
    row = F.struct(*[F.col(c) for c in docs.columns])
    table = written(docs.select(row.alias("_row"), "doc_id", group_key(F.col("lang")).alias("stratum"), metrics(F.col("text")).alias("m")))
    cuts = cut(cutoffs(table.select("doc_id", "stratum", "m"), labels, risk))
    return judge(table, cuts).where("kept").select("_row.*")
