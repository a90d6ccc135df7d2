"""Domain tables derived from the driver's tables, in Spark and, as `SQL`, in DuckDB's dialect.

Timestamps are UTC. Every ordering that a derivation relies on ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars: a symbol per nation, a bar per day with orders."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", F.to_date("o_orderdate").alias("day"))
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), symbol("c_nationkey").alias("symbol"))
    price = F.col("o_totalprice")
    return (
        orders.join(customers, "o_custkey")
        .groupBy("symbol", "day")
        .agg(
            F.min_by(price, "o_orderkey").alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, "o_orderkey").alias("close"),
            F.count("*").alias("volume"),
        )
    )


def symbol(nation: str) -> Column:
    return F.concat(F.lit("N"), F.lpad(F.col(nation).cast("string"), 2, "0"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades: a symbol per event type."""
    return read(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("symbol"), F.col("value").alias("price"), "user_id")


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-minute bars of the ticks, with the day for pruning and bucketing."""
    return ticks_to_bars(ticks(spark, sf_dir))


def ticks_to_bars(trades: DataFrame) -> DataFrame:
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return (
        trades.groupBy("symbol", minute.alias("start_at"))
        .agg(
            F.min_by("price", "event_id").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "event_id").alias("close"),
            F.count("*").alias("volume"),
        )
        .withColumn("end_at", F.expr("start_at + INTERVAL 1 MINUTE"))
    )


def monthly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly index levels: a series per return flag, seasonal variant by line status."""
    items = read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate", "l_extendedprice")
    value = F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.count("*"), 6)
    return items.groupBy(
        F.col("l_returnflag").alias("series"), F.col("l_linestatus").alias("variant"), F.to_date(F.trunc(F.to_date("l_shipdate"), "MM")).alias("period")
    ).agg(value.alias("value"), F.count("*").alias("persons"))


def weekly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders a week, by priority; weeks end on Saturday."""
    day = F.to_date("o_orderdate")
    return read(spark, sf_dir, "orders").groupBy(
        F.col("o_orderpriority").alias("series"), F.date_add(day, 7 - F.dayofweek(day)).alias("week")
    ).agg(F.count("*").alias("claims"))


#: Order priorities that stand for the four tenors.
TENORS = {"1-URGENT": "3m", "2-HIGH": "2y", "3-MEDIUM": "10y", "4-NOT SPECIFIED": "30y"}


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields: a day's mean price by tenor."""
    tenor = F.lit(None).cast("string")
    for priority, name in TENORS.items():
        tenor = F.when(F.col("o_orderpriority") == priority, name).otherwise(tenor)
    mean = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count("*")
    return (
        read(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin(*TENORS))
        .groupBy(F.to_date("o_orderdate").alias("day"), tenor.alias("tenor")).agg((mean / 100000).alias("yield_pct"))
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported facts: concept, unit, the quarter they are about, the day they were filed, and the value."""
    day = F.to_date("l_shipdate")
    start = F.to_date(F.trunc(day, "quarter"))
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("concept"), F.col("l_linestatus").alias("unit"), start.alias("start_date"),
        F.date_sub(F.add_months(start, 3), 1).alias("end_date"), day.alias("filed_date"), F.col("l_extendedprice").alias("value"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
    )


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Research events: a thread per conversation; the last turn ends it."""
    from pyspark.sql import Window

    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", "role", "text")
    last = F.row_number().over(Window.partitionBy("thread_id").orderBy(F.desc("turn"), F.desc("role"), F.desc("text"))) == 1
    kind = F.when(last, "completed").when(F.col("role") == "assistant", "answer_delta").otherwise("stage")
    return turns.select("thread_id", "turn", kind.alias("type"), F.coalesce("text", F.lit("")).alias("data"))


_TENOR_CASE = " ".join(f"WHEN '{p}' THEN '{t}'" for p, t in TENORS.items())

SQL = {
    "bars": """
SELECT 'N' || lpad(c_nationkey::VARCHAR, 2, '0') AS symbol, o_orderdate::DATE AS day, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*)::BIGINT AS volume
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "ticks": "SELECT event_id, ts, event_type AS symbol, value AS price, user_id FROM events",
    "minute_bars": """
SELECT event_type AS symbol, date_trunc('minute', ts)::TIMESTAMP AS start_at, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, event_id) AS close, count(*)::BIGINT AS volume, date_trunc('minute', ts)::TIMESTAMP + INTERVAL 1 MINUTE AS end_at
FROM events GROUP BY ALL""",
    "monthly_series": """
SELECT l_returnflag AS series, l_linestatus AS variant, date_trunc('month', l_shipdate)::DATE AS period,
  round(sum(l_extendedprice::DECIMAL(18,2))::DOUBLE / count(*), 6) AS value, count(*)::BIGINT AS persons
FROM lineitem GROUP BY ALL""",
    "weekly_counts": """
SELECT o_orderpriority AS series, o_orderdate::DATE + (6 - dayofweek(o_orderdate))::INT AS week, count(*)::BIGINT AS claims FROM orders GROUP BY ALL""",
    "curve_points": f"""
SELECT o_orderdate::DATE AS day, CASE o_orderpriority {_TENOR_CASE} END AS tenor, sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*) / 100000 AS yield_pct
FROM orders WHERE o_orderpriority IN ({', '.join(f"'{p}'" for p in TENORS)}) GROUP BY ALL""",
    "facts": """
SELECT l_returnflag AS concept, l_linestatus AS unit, date_trunc('quarter', l_shipdate)::DATE AS start_date,
  (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS end_date, l_shipdate::DATE AS filed_date, l_extendedprice AS value,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
FROM lineitem""",
    "event_log": """
SELECT conv_id AS thread_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 THEN 'completed'
  WHEN role = 'assistant' THEN 'answer_delta' ELSE 'stage' END AS type, coalesce(text, '') AS data
FROM conversations""",
}


def sql(views: str, body: str) -> str:
    """DuckDB SQL with these views (names with spaces between) ahead of body, which may start with CTEs of its own."""
    parts = [f"{name} AS ({SQL[name]})" for name in views.split()]
    own = body.strip()
    if own.upper().startswith("SELECT"):
        return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + own
    return "WITH RECURSIVE " + ",\n".join([*parts, own])
