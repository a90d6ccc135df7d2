"""Vendor payloads to domain rows: quotes, bars, symbols, texts of numbers, JSON documents and calendars.

A value that can't be read becomes null with a status where a caller may want to know why; rows are
never dropped silently except where a scan says so. Lookup tables (units, event names) are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = "decimal(38,10)"
#: Texts that stand for no value.
BLANKS = ["", "-", "--"]
#: Forms whose exhibits count besides the primary file.
EXHIBIT_FORMS = ["6-K", "6-K/A", "8-K"]


def newest_session(sessions: Mapping[str, tuple[Column, Column]], as_of: Column) -> Column:
    """struct(price, session, quoted_at) of the newest of the sessions' (price, time); null if none has a price and a time, or if it is after as_of.

    A price of zero counts as missing. Of equal times the session named first wins.
    """
    offers = [
        F.when((price != 0) & at.isNotNull(), F.struct(at.alias("quoted_at"), F.lit(-k).alias("order"), price.alias("price"), F.lit(name).alias("session")))
        for k, (name, (price, at)) in enumerate(sessions.items())
    ]
    best = F.array_max(F.array_compact(F.array(*offers)))
    return F.when(best["quoted_at"] <= as_of, F.struct(best["price"].alias("price"), best["session"].alias("session"), best["quoted_at"].alias("quoted_at")))


def daily_bounds(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """Adds start_at and end_at of a bar's session; null on days without one. calendar: day, open_at, close_at, a row a day."""
    return bars.join(calendar.select("day", F.col("open_at").alias("start_at"), F.col("close_at").alias("end_at")), "day", "left")


def bar_state(bars: DataFrame, received_at: Column, as_of: Column) -> DataFrame:
    """Adds is_complete, updated_at (the bar's end, or the receipt of an open bar) and data_mode."""
    done = F.col("end_at") <= as_of
    return bars.withColumns({
        "is_complete": F.coalesce(done, F.lit(False)), "updated_at": F.when(done, F.col("end_at")).otherwise(received_at),
        "data_mode": F.when(done, "historical").otherwise("live"),
    })


def vendor_symbol(ticker: Column, region: Column) -> Column:
    return F.concat(F.upper(F.trim(ticker)), F.lit("."), F.upper(region))


def plain_symbol(code: Column) -> Column:
    """The ticker in ticker.REGION, cut at the last dot; the code itself if it has none."""
    return F.when(F.contains(code, F.lit(".")), F.regexp_extract(code, r"^(.*)\.[^.]*$", 1)).otherwise(code)


def monthly_points(raw: DataFrame) -> DataFrame:
    """series, year, code, text to series, period, value: monthly codes M01 to M12 only, without blanks and dashes."""
    text = F.trim(F.regexp_replace("text", ",", ""))
    month = F.regexp_extract("code", "^M(0[1-9]|1[0-2])$", 1)
    kept = raw.where((month != "") & ~text.isin(*BLANKS))
    return kept.select("series", F.make_date("year", month.cast("int"), F.lit(1)).alias("period"), text.try_cast("double").alias("value"))


def index_points(raw: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """code, time_period such as 2026M7, text with commas to series, period, value; other codes and NA texts are left out.

    A value that isn't a positive number is an error.
    """
    series = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("code"))
    value = F.regexp_replace("text", ",", "").try_cast("double")
    parts = [F.regexp_extract("time_period", r"^(\d{4})M(\d{1,2})$", k).try_cast("int") for k in (1, 2)]
    rows = raw.where(F.col("code").isin(*names) & ~F.upper(F.trim("text")).isin("NA", "N/A", "", "..."))
    good = (value > 0) & (value < float("inf"))
    checked = F.when(good, value).otherwise(F.raise_error(F.concat(F.lit("not a positive index: "), F.col("text"))).cast("double"))
    return rows.select(series.alias("series"), F.make_date(parts[0], parts[1], F.lit(1)).alias("period"), checked.alias("value"))


def vintages(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Adds realtime_start and realtime_end, the days from and to which a reported value stood; filed_date is unique within keys."""
    following = F.lead("filed_date").over(Window.partitionBy(*keys).orderBy("filed_date"))
    return observations.withColumns({"realtime_start": F.col("filed_date"), "realtime_end": F.coalesce(F.date_sub(following, 1), F.to_date(F.lit("9999-12-31")))})


def at_vintage(rows: DataFrame, day: Column) -> DataFrame:
    return rows.where((F.col("realtime_start") <= day) & (F.col("realtime_end") >= day))


def percent(text: Column) -> Column:
    """"1.5%" to 1.5; null for blanks, dashes and texts that aren't numbers."""
    bare = F.trim(F.regexp_replace(F.trim(text), "%$", ""))
    return F.when(~bare.isin("", "-"), bare.try_cast(NUMBER))


_COUNT = r"^([+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))\s*([KMB]?)$"


def count(text: Column) -> Column:
    """"1.8M" to 1800000; null where the text isn't a count or the result isn't whole."""
    raw = F.regexp_replace(F.upper(F.trim(text)), ",", "")
    unit = F.regexp_extract(raw, _COUNT, 2)
    times = F.when(unit == "K", 1_000).when(unit == "M", 1_000_000).when(unit == "B", 1_000_000_000).otherwise(1)
    value = F.regexp_extract(raw, _COUNT, 1).try_cast("decimal(26,8)") * times.cast("decimal(10,0)")
    return F.when(value == F.floor(value), value.cast(NUMBER))


def scaled(text: Column, scale: Column, whole: Column) -> Column:
    """struct(value, status): the text without commas times scale.

    status is missing (null, blank, dash), invalid (no number), not_whole (whole is true, the product isn't whole) or ok;
    value is null unless ok.
    """
    bare = F.regexp_replace(F.trim(text), ",", "")
    number = bare.try_cast("decimal(28,8)") * scale.cast("decimal(10,2)")
    status = (
        F.when(bare.isNull() | bare.isin(*BLANKS), "missing").when(number.isNull(), "invalid")
        .when(whole & (number != F.floor(number)), "not_whole").otherwise("ok")
    )
    return F.struct(F.when(status == "ok", number.cast("double")).alias("value"), status.alias("status"))


def calendar_rows(raw: DataFrame, names: DataFrame, country: str, counts: list[str]) -> DataFrame:
    """Economic calendar rows to forecasts: known event names of one country that span a single day.

    names: event, indicator, measure, weekly (a few rows). Weekly rows keep their day, others are about its month.
    """
    known = raw.where((F.col("country") == country) & (F.col("date_span") == 0)).join(names, "event")
    period = F.when(F.col("weekly"), F.col("reference_day")).otherwise(F.to_date(F.trunc("reference_day", "MM")))
    value = F.when(F.col("indicator").isin(*counts), count(F.col("text"))).otherwise(percent(F.col("text")))
    return known.withColumns({"period": period, "value": value.cast("double")})


FILINGS = "accession array<string>, form array<string>, accepted_at array<timestamp_ntz>, primary_name array<string>"


def filings(payloads: DataFrame) -> DataFrame:
    """company and a JSON text of parallel arrays to a row per filing."""
    parsed = payloads.select("company", F.from_json("payload", FILINGS).alias("p"))
    zipped = F.arrays_zip(*[F.col(f"p.{c}").alias(c) for c in ("accession", "form", "accepted_at", "primary_name")])
    return parsed.select("company", F.inline(zipped))


def recent_filings(rows: DataFrame, forms: list[str], as_of: Column, limit: int) -> DataFrame:
    """Each company's newest filings of these forms accepted by as_of, ties by accession."""
    seen = rows.where(F.col("form").isin(*forms) & (F.col("accepted_at") <= as_of))
    order = Window.partitionBy("company").orderBy(F.desc("accepted_at"), F.desc("accession"))
    return seen.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def relevant_file(form: Column, name: Column, kind: Column, is_primary: Column) -> Column:
    """The primary file always; HTML exhibits 99 of current reports too."""
    return is_primary | (form.isin(*EXHIBIT_FORMS) & F.lower(name).rlike(r"\.html?$") & F.upper(kind).startswith("EX-99"))


COMPANY_FACTS = "facts map<string,map<string,struct<units:map<string,array<struct<start:date,end:date,val:double,filed:date,form:string>>>>>>"


def concept_entries(payloads: DataFrame, taxonomy: str, concept: str, unit: str) -> DataFrame:
    """company and a company facts JSON to the entries of one concept and unit; no rows where any level is absent."""
    tree = F.from_json("payload", COMPANY_FACTS)["facts"]
    entries = F.try_element_at(F.try_element_at(F.try_element_at(tree, F.lit(taxonomy)), F.lit(concept))["units"], F.lit(unit))
    return payloads.select("company", F.inline(entries))


def securities(payloads: DataFrame) -> DataFrame:
    """A JSON object of numbered securities to rows: upper-case ticker, ten-digit id, title."""
    entry = F.explode(F.map_values(F.from_json("payload", "map<string,struct<cik_str:bigint,ticker:string,title:string>>")))
    return payloads.select(entry.alias("s")).select(F.upper(F.trim("s.ticker")).alias("ticker"), F.lpad(F.col("s.cik_str").cast("string"), 10, "0").alias("cik"), F.col("s.title").alias("title"))


def document_url(base: str, cik: Column, accession: Column, name: Column) -> Column:
    """The archive path: id without leading zeros, accession without dashes, file name."""
    return F.concat_ws("/", F.lit(base), cik.cast("bigint").cast("string"), F.replace(accession, F.lit("-"), F.lit("")), name)


def vendor_time(text: Column) -> Column:
    """Seconds since 1970 or ISO text to a timestamp; null if neither."""
    seconds = F.timestamp_seconds(text.try_cast("bigint")).cast("timestamp_ntz")
    return F.when(text.rlike(r"^\d+$"), seconds).otherwise(text.try_cast("timestamp_ntz"))
