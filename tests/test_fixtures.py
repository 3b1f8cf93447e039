"""Hand-made arrivals with known answers."""

from pyspark.sql import functions as F

from ebbmark import params
from ebbmark.functions import scalars
from ebbmark.operators import mean_shift, speculative
from ebbmark.operators.timeline import with_scope
from ebbmark.plans import backtest
from dataclasses import replace


def flags(frame, strategy):
    return {r.event_id: r.accepted for r in backtest.flag_events(frame, strategy).collect()}


def test_late_event_is_kept_while_its_window_is_open(events):
    frame = events([(1, "a", 21_000, 21_000), (2, "a", 20_500, 21_500)])
    assert flags(frame, params.house_naive()) == {1: True, 2: True}


def test_late_event_is_dropped_once_its_window_is_closed(events):
    frame = events([(1, "a", 9_000, 9_000), (2, "a", 12_000, 12_000), (3, "a", 5_000, 13_000)])
    assert flags(frame, params.house_naive()) == {1: True, 2: True, 3: False}
    fixed = params.house_fixed(5)
    assert flags(frame, replace(fixed, slack_ms=2_000))[3] is False
    assert flags(frame, replace(fixed, slack_ms=2_001))[3] is True
    assert flags(frame, replace(fixed, slack_ms=0, lateness_ms=2_000))[3] is False
    assert flags(frame, replace(fixed, slack_ms=0, lateness_ms=2_001))[3] is True


def test_adaptive_watermark_closes_one_millisecond_earlier(events):
    # Newest event lies exactly one slack behind the last millisecond of the first window.
    frame = events([(1, "a", 9_999 + 5_000, 15_000), (2, "a", 3_000, 16_000)])
    assert flags(frame, params.house_fixed(5))[2] is True
    assert flags(frame, params.house_mean_shift())[2] is False
    frame = events([(1, "a", 10_000 + 5_000, 15_000), (2, "a", 3_000, 16_000)])
    assert flags(frame, params.house_fixed(5))[2] is False


def test_missing_reading_adds_nothing_but_counts(events):
    frame = events([(1, "a", 1_000, 1_000, 4.0), (2, "a", 2_000, 2_000, None), (3, "a", 3_000, 3_000, 2.0),
                    (4, "a", 30_000, 30_000, 1.0)])
    first = backtest.run(frame, [params.house_naive()]).windows.where("window_end = 10000").collect()
    assert [(r.event_count, r.avg_1) for r in first] == [(3, 2.0)]


def test_speculative_updates_and_initial_row(events):
    frame = events([(1, "a", 1_000, 1_000), (2, "a", 2_000, 2_000), (3, "a", 3_000, 30_000)])
    strategy = params.house_speculative()
    log = speculative.speculative_updates(with_scope(frame), backtest.timelines(frame, [strategy]), strategy)
    rows = speculative.with_initial_rows(log).orderBy("key", "event_count").collect()
    assert [(r.key, r.event_count, r.update_count, r.is_final) for r in rows] == [
        ("a", 1, 1, False), ("a", 2, 2, False), ("a", 3, 3, True), ("a-initial", 1, 1, False)]
    assert {r.decisional_latency_ms for r in rows} == {1_000 - 10_000}
    assert [r.update_kind for r in rows][:3] == ["INITIAL GUESS", "SPECULATIVE CORRECTION", "FINAL UPDATE"]


def test_drift_after_a_step_of_the_samples(events):
    rows = [(i, "a", 10_000 * i, 10_000 * i + (0 if i < 100 else 2000)) for i in range(200)]
    trace = mean_shift.slack_trace(with_scope(events(rows)), [params.house_mean_shift(500)], block_rows=200)
    last = trace.orderBy(F.desc("event_id")).first()
    assert (last.drift, last.slack) == (True, 1000 + 500)
    assert trace.where("event_id < 199").agg(F.max("slack")).first()[0] == 5000


def test_grid_cells(spark):
    # Bounds are inclusive. In double arithmetic the far longitude comes out at 10.00..., the far
    # latitude at 9.99..., so only the former leaves the grid.
    points = spark.createDataFrame(
        [(40.4774, -74.2591), (40.9176, -74.2591), (40.4774, -73.7004), (0.0, 0.0)], "lat double, lon double")
    cells = [r[0] for r in points.select(scalars.geo_cell(F.col("lat"), F.col("lon"))).collect()]
    assert cells == ["CELL_0_0", "CELL_0_9", "CELL_10_0", "CELL_OUT"]


def test_unpassed_window_stays_open_unless_flushed(events):
    frame = events([(1, "a", 1_000, 1_000), (2, "a", 12_000, 12_000)])
    assert [r.window_end for r in backtest.run(frame, [params.house_naive()]).windows.collect()] == [10_000]
    flushed = backtest.run(frame, [params.house_naive()], backtest.Settings(flush=True)).windows
    rows = {r.window_end: (r.fire_time, r.window_delay_ms) for r in flushed.collect()}
    assert rows[20_000] == (12_000, 0) and set(rows) == {10_000, 20_000}


def test_far_future_timestamp_costs_no_expansion(events):
    frame = events([(1, "a", 1_000, 1_000), (2, "a", 10 ** 13, 2_000), (3, "a", 3_000, 3_000)])
    result = backtest.run(frame, [params.house_naive()])
    assert [(r.window_end, r.event_count) for r in result.windows.collect()] == [(10_000, 1)]
    assert [r.dropped for r in result.late.collect()] == [1]


def test_strategy_ids_truncate_hundredths():
    assert params.house_adwin(0.29, 0.1).name == "adaptive_real_adwin_L28_dd10"
    assert params.taxi_fixed(2).slack_ms == 36_000 and params.taxi_fixed(3).slack_ms == 1_500_000
    assert params.taxi_speculative(1).lateness_ms == 120_000
    assert params.taxi_mean_shift(3, -1).threshold_ms == 60_000
    assert len({s.name for g in params.house_sensitivity().values() for s in g}) == 14
