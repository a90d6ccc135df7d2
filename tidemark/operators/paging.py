"""Histories that came in pages, newest first, each asked for with the oldest time of the page before as its cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.files import checkpointed

MAX_PAGES = 12


def chains(requests: DataFrame, pages: DataFrame, max_pages: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """Which pages a walk back from each request's end meets, with their place from 0, and how the walk ends.

    requests: request_id, start_at, end_at. pages: request_id, page_id (unique), cursor, oldest (null in an empty page). A page
    follows the one whose oldest time is its cursor; of several pages of one cursor the one of the smallest id counts and
    the others are repeats. Places are found by pointer doubling: each step doubles how far back a page looks, so
    that a chain of n pages takes the logarithm of n joins. Returns (request_id, page_id, place) and
    (request_id, pages, repeats, status); status, the first that holds: no_progress, a page not older than its cursor; complete, the start
    is covered or an empty page ends the history; page_limit; broken, the next page isn't there. A request without a page is broken.
    """
    key = ["request_id", "cursor"]
    first = pages.groupBy(*key).agg(F.min_by(F.struct("page_id", "oldest"), "page_id").alias("p"), (F.count("*") - 1).alias("again")).select(*key, "p.*", "again")
    moving = first.where("oldest IS NOT NULL AND oldest < cursor").select("request_id", F.col("oldest").alias("cursor"), F.col("page_id").alias("before"))
    roots = requests.select("request_id", F.col("end_at").alias("cursor"), F.lit(True).alias("is_root"))
    # jump: the page so many steps back that far counts, or null beyond the root; a page whose way doesn't end at a root never gets there
    now = first.join(moving, key, "left").join(roots, key, "left")
    now = now.select("request_id", "page_id", F.when(F.col("is_root"), None).otherwise(F.col("before")).alias("jump"), F.when(F.col("is_root"), 0).otherwise(1).alias("far"), (F.coalesce("is_root", F.lit(False)) | F.col("before").isNotNull()).alias("led"))
    now = checkpointed(now)
    while now.where("jump IS NOT NULL").limit(1).count():
        ahead = now.select(F.col("page_id").alias("jump"), F.col("jump").alias("_jump"), F.col("far").alias("_far"), F.col("led").alias("_led"))
        far, led = F.col("far") + F.coalesce("_far", F.lit(0)), F.col("led") & F.coalesce("_led", F.lit(True))
        now = checkpointed(now.join(ahead, "jump", "left").select("request_id", "page_id", F.col("_jump").alias("jump"), far.alias("far"), led.alias("led")))
    met = now.where(F.col("led") & (F.col("far") < max_pages)).select("request_id", "page_id", F.col("far").alias("place"))
    walked = met.join(first.drop("request_id"), "page_id")
    last = walked.groupBy("request_id").agg(
        F.count("*").alias("pages"), F.sum("again").alias("repeats"), F.max_by("oldest", "place").alias("oldest"), F.max("place").alias("place"), F.bool_or(F.coalesce(F.col("oldest") >= F.col("cursor"), F.lit(False))).alias("stuck"),
    )
    rows = requests.join(last, "request_id", "left")
    status = F.when(F.col("stuck"), "no_progress").when(F.col("pages").isNotNull() & (F.col("oldest").isNull() | (F.col("oldest") <= F.col("start_at"))), "complete").when(F.col("place") == max_pages - 1, "page_limit").otherwise("broken")
    return met, rows.select("request_id", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("repeats", F.lit(0)).alias("repeats"), status.alias("status"))


def collected(requests: DataFrame, pages: DataFrame, rows: DataFrame, payload: list[str], max_pages: int = MAX_PAGES) -> tuple[DataFrame, DataFrame]:
    """The rows (page_id, start_at, end_at and the payload) of the pages that a walk meets, once each within their request, and the requests.

    A row that two pages have with different payloads makes its request conflicting, before any other status but no_progress, and has
    conflict; the least payload is shown. Requests are those of chains(), with the number of rows.
    """
    met, walks = chains(requests, pages, max_pages)
    asked = requests.select("request_id", F.col("start_at").alias("_from"), F.col("end_at").alias("_to"))
    inside = rows.join(met, "page_id").join(asked, "request_id").where((F.col("start_at") >= F.col("_from")) & (F.col("end_at") <= F.col("_to")))
    value = F.struct(*payload)
    once = inside.groupBy("request_id", F.col("start_at").alias("at")).agg(F.min(value).alias("v"), (F.min(value) != F.max(value)).alias("conflict"))
    found = once.select("request_id", "at", "v.*", "conflict")
    counts = found.groupBy("request_id").agg(F.count("*").alias("rows"), F.bool_or("conflict").alias("odd"))
    judged = walks.join(counts, "request_id", "left")
    status = F.when(F.col("odd") & (F.col("status") != "no_progress"), "conflicting").otherwise(F.col("status"))
    return found, judged.select("request_id", "pages", "repeats", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))
