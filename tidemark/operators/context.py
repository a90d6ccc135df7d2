"""The context of a decision: which components are there, how good they are, where they come from, and whether they agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pit import ticker
from tidemark.operators.quality import first_of

#: Components in order, with the purpose of the quality results about each; all but macro are about one symbol.
PURPOSES = {"quote": "current_price", "technical": "daily_technical", "macro": "macro_research", "market_reaction": "market_reaction"}
UNSCOPED = ["macro"]


def availability(requested: Column, present: Column) -> Column:
    return F.when(~requested, "not_requested").when(present, "available").otherwise("missing")


def component_quality(contexts: DataFrame, results: DataFrame) -> DataFrame:
    """A row per context (context_id, symbol, requested array, assessed) and component: its quality.

    results has target_id, purpose and status. Results are summed up by purpose and target before
    they meet the contexts; those of unscoped components by purpose alone.
    """
    kinds = F.array(*[F.struct(F.lit(c).alias("component"), F.lit(p).alias("purpose"), F.lit(c not in UNSCOPED).alias("scoped")) for c, p in PURPOSES.items()])
    wide = contexts.select("context_id", "requested", "assessed", ticker(F.col("symbol")).alias("_s"), F.inline(kinds))
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("usable", "rejected")] + [F.count("*").alias("n")]
    by_target = results.groupBy("purpose", ticker(F.col("target_id")).alias("_t")).agg(*counts)
    unscoped = [p for c, p in PURPOSES.items() if c in UNSCOPED]
    by_purpose = by_target.where(F.col("purpose").isin(unscoped)).groupBy("purpose").agg(*[F.sum(c).alias(c) for c in ("usable", "rejected", "n")]).withColumn("_t", F.lit("*"))
    found = by_target.where(~F.col("purpose").isin(unscoped)).unionByName(by_purpose)
    rows = wide.withColumn("_t", F.when(F.col("scoped"), F.col("_s")).otherwise("*")).join(found, ["purpose", "_t"], "left")
    status = first_of(
        (~F.array_contains("requested", F.col("component")), "not_requested"), (~F.col("assessed") | F.col("n").isNull(), "not_assessed"),
        (F.col("usable") == F.col("n"), "usable"), (F.col("rejected") == F.col("n"), "rejected"), (F.lit(True), "degraded"),
    )
    return rows.select("context_id", "component", status.alias("status"))


def context_fault() -> Column:
    """The first thing in a context that belongs to another symbol or to a time after as_of, or null.

    Reads symbol, as_of, quote_symbol, quoted_at, received_at, technical_symbol, price_at, macro_as_of,
    reaction_symbol, event_at, reference_at, observed_at (the latest) and report_as_of; nulls are absent.
    """
    own, now = ticker(F.col("symbol")), F.col("as_of")

    def other(name: str) -> Column:
        return F.coalesce(ticker(F.col(name)) != own, F.lit(False))

    def late(name: str) -> Column:
        return F.coalesce(F.col(name) > now, F.lit(False))

    return first_of(
        (other("quote_symbol"), "quote_symbol_mismatch"), (late("quoted_at"), "quote_after_as_of"), (late("received_at"), "quote_received_after_as_of"),
        (other("technical_symbol"), "technical_symbol_mismatch"), (late("price_at"), "technical_price_after_as_of"), (late("macro_as_of"), "macro_after_as_of"),
        (other("reaction_symbol"), "reaction_symbol_mismatch"), (late("event_at"), "event_after_as_of"), (late("reference_at"), "reference_after_as_of"),
        (late("observed_at"), "observation_after_as_of"), (late("report_as_of"), "report_after_as_of"),
    )


def sources(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The distinct values of each key in the order of their first rows; a set per key is bounded by its distinct values."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_o"))
    return first.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("sources"))
