"""Golden cases of indicators, structure, decisions and guards."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decision, indicators, macro, reaction, structure

SCHEMA = "symbol string, day date, open double, high double, low double, close double, volume long"


def bars(spark, rows):
    """rows: (high, low, close[, volume]) by day of one symbol."""
    start = dt.date(2026, 1, 1)
    return spark.createDataFrame([("A", start + dt.timedelta(i), float(r[2]), float(r[0]), float(r[1]), float(r[2]), int(r[3]) if len(r) > 3 else 1) for i, r in enumerate(rows)], SCHEMA)


def flat(spark, closes):
    return bars(spark, [(c, c, c) for c in closes])


def newest(df, column):
    return df.orderBy(F.desc("day")).first()[column]


def test_atr_of_widening_ranges(spark):
    rows = [(100 + k + k + 1, 100 + k - k - 1, 101 + k) for k in range(20)]
    assert indicators.atr(bars(spark, rows)).first()["atr14"] == pytest.approx(22.97469990182661986077, rel=1e-9)


def test_moving_averages_and_slope(spark):
    b = flat(spark, range(1, 52))
    assert [newest(b.withColumn("v", indicators.moving_average(n)), "v") for n in (5, 20, 50)] == [49, 41.5, 26.5]
    rise = [100] * 50 + [110] * 5
    for rows, want in ((rise, (2.5, 1.0)), (rise[1:], (2.5, None))):
        b = flat(spark, rows).withColumn("ma20", indicators.moving_average(20)).withColumn("ma50", indicators.moving_average(50))
        b = indicators.slope(indicators.slope(b, 20, 5, "s20"), 50, 5, "s50").orderBy(F.desc("day")).first()
        assert b["s20"] == pytest.approx(want[0]) if want[0] else b["s20"] is None
        assert b["s50"] == (pytest.approx(want[1]) if want[1] else None)


@pytest.mark.parametrize(("closes", "n", "want"), [([1, 2, 1, 3, 2], 2, 50), ([5] * 20, 14, 50), (range(1, 30), 14, 100), (range(30, 1, -1), 14, 0), (range(1, 15), 14, None)])
def test_rsi(spark, closes, n, want):
    row = indicators.rsi(flat(spark, closes), n).first()
    assert row[f"rsi{n}"] == (None if want is None else pytest.approx(want))


def test_volume_features(spark):
    row = indicators.volume_features(bars(spark, [(1, 1, 1, 100)] * 20 + [(1, 1, 1, 150)])).orderBy(F.desc("day")).first()
    assert (row["base20"], row["avg5"], row["rvol"], row["trend"]) == (100, 110, 1.5, 1.1)
    row = indicators.volume_features(bars(spark, [(1, 1, 1, 0)] * 20 + [(1, 1, 1, 100)])).orderBy(F.desc("day")).first()
    assert (row["base20"], row["rvol"], row["trend"]) == (0, None, None)


def test_last_of_equal_highs_is_the_pivot(spark):
    found = structure.pivots(bars(spark, [(h, 1, 5) for h in (10, 12, 14, 14, 13, 12)])).where("kind = 'high'").collect()
    assert [(r["day"].day, r["confirmed_day"].day) for r in found] == [(4, 6)]


def test_fibonacci_of_a_down_swing(spark):
    swing = spark.createDataFrame([("A", "down", 120.0, 100.0)], "symbol string, direction string, start_price double, end_price double")
    assert structure.fibonacci(swing).where("ratio = 0.236").first()["price"] == pytest.approx(104.72)


def test_level_candidates(spark):
    levels = spark.createDataFrame([("A", float(p), float(p), float(p), 2) for p in (60, 70, 80, 90, 110, 120, 130, 140)], "symbol string, price double, lower_bound double, upper_bound double, touches long")
    now = spark.createDataFrame([("A", 100.0, 10.0)], "symbol string, price double, atr double")
    rows = structure.level_candidates(levels, now).orderBy("role", "rank").collect()
    assert [(r["role"], r["price"], r["atr_distance"]) for r in rows] == [("resistance", 110, 1), ("resistance", 120, 2), ("resistance", 130, 3), ("support", 90, 1), ("support", 80, 2), ("support", 70, 3)]


def test_empty_bars(spark):
    none = bars(spark, [(1, 1, 1)]).limit(0)
    assert indicators.snapshot(none).count() == 0
    assert structure.gaps(none).count() == 0


SNAP = "symbol string, price double, ma20 double, ma50 double, ma200 double, slope20 double, slope50 double, return5 double, return20 double, rsi14 double, high20 double, low20 double, zone boolean, support_atr double, resistance_atr double, technical_quality string"


@pytest.mark.parametrize(
    ("row", "status", "view", "reasons"),
    [
        ((110, 105, 100, 90, 1, 1, 2, 3, 60, 120, 90, None, None, None, "usable"), "complete", "bullish", "primary_factors_aligned|level_no_directional_override"),
        ((110, 105, 100, 90, 1, 1, -2, -3, 40, 120, 90, None, None, None, "usable"), "complete", "mixed", "trend_momentum_conflict|level_no_directional_override"),
        ((80, 85, 90, None, -1, -1, -2, -3, 40, 120, 81, None, None, None, "usable"), "complete", "bearish", "primary_factors_aligned|level_confirms_primary_direction"),
        ((130, None, None, None, None, None, None, None, None, 120, 90, None, None, None, "degraded"), "partial", "bullish", "level_only_available"),
        ((130, None, None, None, None, None, None, None, None, 120, 90, None, None, None, "rejected"), "blocked", None, ""),
        ((None,) * 14 + ("usable",), "blocked", None, ""),
    ],
)
def test_decisions(spark, row, status, view, reasons):
    values = [float(v) if isinstance(v, int) else v for v in row]
    found = decision.decide(spark.createDataFrame([("A", *values)], SNAP)).first()
    assert (found["status"], found["view"], found["decision_reasons"]) == (status, view, reasons)


def test_shift_is_by_calendar(spark):
    rows = spark.createDataFrame([("s", dt.date(2026, m, 1), float(v)) for m, v in ((1, 10), (3, 30), (4, 33))], "series string, period date, value double")
    found = {r["period"].month: r["value_m1"] for r in macro.shifted(rows, ["series"], [1]).collect()}
    assert found == {1: None, 3: None, 4: 30}


def test_consensus_of_tied_forecasts_is_none(spark):
    at = dt.datetime(2026, 9, 11, 12, 30)
    metrics = spark.createDataFrame([("s", dt.date(2026, 8, 1), at, dt.date(2026, 9, 11))], "series string, period date, released_at timestamp_ntz, release_date date")

    def chosen(*times):
        rows = [("s", dt.date(2026, 8, 1), str(i), float(i), at, t) for i, t in enumerate(times)]
        f = spark.createDataFrame(rows, "series string, period date, forecast_id string, consensus double, scheduled_at timestamp_ntz, forecast_as_of timestamp_ntz")
        r = macro.match_consensus(metrics, f).first()
        return r["consensus"], r["pit_verified"]

    early, late, after = at - dt.timedelta(days=2), at - dt.timedelta(days=1), at + dt.timedelta(days=1)
    assert chosen(early, late, after) == (1.0, True)
    assert chosen(early, late, late) == (None, None)
    assert chosen(after, None) == (1.0, False)
    assert chosen(None, None) == (None, None)


def test_reference_gap_is_inclusive_and_lag_is_strict(spark):
    event = dt.datetime(2026, 9, 25, 12, 30)
    events = spark.createDataFrame([(1, event)], "event_id long, event_at timestamp_ntz")

    def one(end):
        return spark.createDataFrame([("A", end - dt.timedelta(minutes=1), end, 100.0)], "symbol string, start_at timestamp_ntz, end_at timestamp_ntz, close double")

    assert reaction.reference_bars(events, one(event - dt.timedelta(minutes=5))).count() == 1
    assert reaction.reference_bars(events, one(event - dt.timedelta(minutes=6))).count() == 0
    target = F.col("event_at") + F.expr("INTERVAL 5 MINUTES")
    targets = events.select("event_id", "event_at", F.lit("5m").alias("window"), target.alias("target_at"))
    far = F.to_timestamp_ntz(F.lit("2027-01-01 00:00:00"))
    assert reaction.observation_bars(targets, one(event + dt.timedelta(minutes=5)), far).count() == 1
    assert reaction.observation_bars(targets, one(event + dt.timedelta(minutes=4)), far).count() == 0


def test_reference_price_of_zero_gives_no_return(spark):
    event = dt.datetime(2026, 9, 25, 12, 30)
    events = spark.createDataFrame([(1, event)], "event_id long, event_at timestamp_ntz")
    minute = dt.timedelta(minutes=1)
    rows = [("A", event - minute, event, 0.0), ("A", event + 4 * minute, event + 5 * minute, 5.0)]
    bars_ = spark.createDataFrame(rows, "symbol string, start_at timestamp_ntz, end_at timestamp_ntz, close double")
    found = reaction.window_returns(events, bars_.select("symbol").distinct(), bars_, F.to_timestamp_ntz(F.lit("2027-01-01 00:00:00"))).where("window = '5m'").first()
    assert (found["status"], found["price"], found["return_pct"]) == ("usable", 5.0, None)


def test_minutes_around_events_give_what_bars_one_by_one_give(spark):
    import random

    draw = random.Random(3)
    starts = [dt.datetime(2024, 3, 1, 22), dt.datetime(1969, 12, 31, 22)]
    made = {(s, top + dt.timedelta(minutes=draw.randrange(300))) for top in starts for s, n in (("A", 40), ("B", 250), ("C", 3)) for _ in range(n)}
    bars_ = spark.createDataFrame([(s, t, t + dt.timedelta(minutes=1), 1.0) for s, t in sorted(made)], "symbol string, start_at timestamp_ntz, end_at timestamp_ntz, close double")
    at = [top + dt.timedelta(minutes=draw.randrange(-130, 430), microseconds=draw.choice([0, 0, 1, 30_000_000, 59_999_999])) for top in starts for _ in range(150)]
    events = spark.createDataFrame(list(enumerate(at)), "event_id long, event_at timestamp_ntz").cache()
    marked = reaction.classified(events, bars_).cache()

    def same(found, want):
        columns = want.columns
        assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, want.collect()))

    same(reaction.class_counts(events, bars_), marked.groupBy("event_id", "symbol", "kind").agg(F.count("*").alias("n")))
    same(reaction.bars_until(events, bars_), marked.where("kind != 'post'").select("event_id", "symbol", "start_at"))
    pairs = events.join(F.broadcast(spark.createDataFrame([("A",), ("B",), ("C",), ("none",)], "symbol string")), how="cross")
    now = F.to_timestamp_ntz(F.lit("2024-03-02 01:00:00"))
    same(reaction.minute_alignment(pairs, bars_, now), reaction.alignment(pairs, marked, now))


def test_alignment_does_not_meet_single_bars(spark, tmp_path):
    """Events of one minute with every bar around them: a row each that is joined, not one a bar."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidemark.plans import catalog

    top = dt.datetime(2024, 1, 2, 10)
    rows = [(k, top + dt.timedelta(minutes=k - 60, seconds=7), "click") for k in range(240)] + [(1000 + k, top + dt.timedelta(seconds=1), "signup") for k in range(20_000)]
    ids, ts, kinds = zip(*rows)
    pq.write_table(pa.table({"event_id": pa.array(ids), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array(ids), "event_type": kinds, "value": pa.array([1.0] * len(ids)), "props": [""] * len(ids)}), tmp_path / "events.parquet")
    for name, most in (("w24_alignment", 20_000), ("j06_bar_classes", 60_000), ("j07_event_window", 120_000)):
        found = catalog.queries()[name](spark, str(tmp_path))
        assert found.count() == most
        seen = max(_joined_rows(found))
        assert seen <= 20_000, (name, seen)


def _joined_rows(df):
    """Rows that each join of a query gives when it is run."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    todo, found = [plan], []
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found
