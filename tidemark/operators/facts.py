"""Reported facts: ids, visibility, period shapes, and the newest fact of a period."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_id(*columns: Column) -> Column:
    """SHA-256 of the canonical JSON of columns, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def visible(facts: DataFrame, as_of: Column) -> DataFrame:
    return facts.where(F.col("filed_date") <= F.to_date(as_of))


def period_shape(form: Column, start: Column, end: Column) -> Column:
    days = F.datediff(end, start) + 1
    return (
        F.when(start.isNull(), "instant").when(form.isin("10-Q", "10-Q/A") & days.between(70, 110), "quarterly").when(form.isin("10-K", "10-K/A") & days.between(330, 380), "annual").otherwise("other")
    )


def latest_per_period(facts: DataFrame, keys: list[str], tiebreak: list[str]) -> DataFrame:
    """Of each key and period (start_date, end_date) the fact filed last; ties by tiebreak, largest first.

    A partial aggregate, so that a period with many facts isn't sorted in one task.
    """
    rest = [c for c in facts.columns if c not in keys and c not in ("start_date", "end_date")]
    best = F.max_by(F.struct(*rest), F.struct("filed_date", *tiebreak)).alias("_f")
    return facts.groupBy(*keys, "start_date", "end_date").agg(best).select(*keys, "start_date", "end_date", "_f.*")


def insert_ignore(present: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows whose keys are not present yet, one for each key; append them to write."""
    once = new.dropDuplicates(keys)
    return once.join(present.select(*keys), keys, "left_anti")


def upsert(present: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All rows with the newest version by keys; at equal versions the new row wins."""
    both = present.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in present.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r")).select(*keys, "_r.*")


def overlap_dedup(rows: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Rows of overlapping pages once by keys, with whether their payloads differ."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("_p"), (F.min(F.struct(*payload)) != F.max(F.struct(*payload))).alias("conflict")).select(*keys, "_p.*", "conflict")


def of_period(facts: DataFrame, period_type: str) -> DataFrame:
    """The facts (form, start_date, end_date) of a type: all, quarterly, annual or instant."""
    if period_type not in ("all", "quarterly", "annual", "instant"):
        raise ValueError(f"unknown period type {period_type}")
    return facts if period_type == "all" else facts.where(period_shape(F.col("form"), F.col("start_date"), F.col("end_date")) == period_type)


def newest_facts(facts: DataFrame, keys: list[str], limit: int = 4) -> DataFrame:
    """The limit facts of each key with the latest end, of those the latest start."""
    order = Window.partitionBy(*keys).orderBy(F.desc("end_date"), F.desc_nulls_last("start_date"))
    return facts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def answered(requests: DataFrame, store: DataFrame, synced: DataFrame, source: DataFrame, ids: list[str], today: Column, limit: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The newest facts that requests may see, out of a store that is filled first where it doesn't reach; then the rows to add to the store, and the sync states.

    requests: request_id, company, concept, unit, as_of (a date). synced: company, concept, unit (unique), covered_through. A request is covered if its
    series was synced through its as_of or later; the series of the others are read from source whole, rows that the store has not (by ids)
    are added, and their state becomes today. store and source have the facts' columns and company. The answer has request_id,
    refreshed, whether its series was read anew, and up to limit facts with their rank, null without any.
    """
    series = ["company", "concept", "unit"]
    covered = F.coalesce(F.col("covered_through") >= F.col("as_of"), F.lit(False))
    asked = requests.join(synced, series, "left").withColumn("_covered", covered).drop("covered_through")
    due = asked.where("NOT _covered").select(*series).distinct()
    added = insert_ignore(store, source.join(due, series, "left_semi"), ids)
    states = synced.join(due, series, "left_anti").unionByName(due.withColumn("covered_through", today))
    whole = store.unionByName(added).join(asked.select("request_id", *series, "as_of"), series).where(F.col("filed_date") <= F.col("as_of"))
    latest = latest_per_period(whole.drop("as_of"), ["request_id"], ids)
    newest = newest_facts(latest, ["request_id"], limit)
    state = asked.join(due.withColumn("refreshed", F.lit(True)), series, "left").select("request_id", F.coalesce("refreshed", F.lit(False)).alias("refreshed"))
    return state.join(newest.select("request_id", "start_date", "end_date", "value", "rank"), "request_id", "left"), added, states
