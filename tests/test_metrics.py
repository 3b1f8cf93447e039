"""Metric queries on small hand-made metric tables."""

from datetime import datetime

import pytest

from ebbmark.plans import metrics
from ebbmark.schemas import HOUSE_METRICS, TAXI_METRICS


def at(minute, second=0):
    return datetime(2024, 1, 1, 0, minute, second)


@pytest.fixture(scope="module")
def house(spark):
    rows = [
        (at(1), "HOUSE_1", "speculative", 20.0, 2.0, -5000, 0, 4, True, 4),
        (at(1), "HOUSE_1-initial", "speculative", 90.0, 9.0, -5000, 0, 1, False, 1),
        (at(2), "HOUSE_2", "speculative", 40.0, 4.0, -3000, 0, 6, True, 6),
        (at(1), "HOUSE_1", "naive", 10.0, 1.0, 1000, 500, 2, True, 1),
        (at(3), "BARN", "speculative", 30.0, 3.0, 0, 0, 5, True, 5),
    ]
    return spark.createDataFrame(rows, HOUSE_METRICS)


@pytest.fixture(scope="module")
def taxi(spark):
    def row(minute, zone, strategy, count, distance, updates, end, delay=1.0):
        return (at(minute), zone, strategy, 100, delay, count, distance, distance * 2, updates, end)
    spec = "taxi_speculative_m3"
    rows = [row(1, "CELL_1_1", spec, 1, 1.0, 1, 60), row(1, "CELL_1_1", spec, 3, 2.0, 3, 60),
            row(2, "CELL_OUT", spec, 9, 9.0, 1, 60), row(2, "CELL_0_10", spec, 1, 1.0, 1, 60),
            row(3, "CELL_2_5", spec, 1, 0.0, 1, 60),
            row(1, "CELL_1_1", "taxi_naive", 1, 3.0, 1, 60), row(1, "CELL_OUT", "taxi_naive", 7, 1.0, 1, 60),
            row(1, "CELL_1_1", "taxi_naive", 50, 3.0, 1, 120, delay=90_000.0)]
    return spark.createDataFrame(rows, TAXI_METRICS)


def by(frame, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in frame.collect()}


def test_house_comparison(house):
    rows = by(metrics.house_comparison(house, labels={"naive": "Naive"}), "strategy")
    assert rows["speculative"].completeness_pct == 100.0 and rows["speculative"].avg_events == 5.0
    assert rows["naive"].completeness_pct == 40.0 and rows["naive"].label == "Naive"
    assert rows["naive"].true_latency_s == 0.5 and rows["speculative"].label == "speculative"


def test_without_reference_the_raw_mean_is_shown(house):
    rows = by(metrics.house_comparison(house.where("strategy = 'naive'")), "strategy")
    assert rows["naive"].completeness_pct == 2.0


def test_house_grid_lists_lost_houses_and_skips_other_names(house):
    rows = by(metrics.house_grid(house), "house_id")
    assert set(rows) == {"HOUSE_1", "HOUSE_2"}
    assert (rows["HOUSE_1"].grid_row, rows["HOUSE_1"].grid_col, rows["HOUSE_1"].completeness_pct) == (9, 1, 50.0)
    assert rows["HOUSE_2"].completeness_pct == 0.0


def test_house_errors_are_signed(house):
    row = by(metrics.house_errors(house), "strategy")["naive"]
    assert row.temp_error_pct == pytest.approx((10 - 30) / 30 * 100)


def test_series_needs_a_reference_in_the_bucket(house):
    rows = metrics.series_completeness(metrics.house_series(house), "speculative").collect()
    assert [(r.strategy, r.completeness_pct) for r in rows] == [("naive", 50.0)]


def test_final_versions_and_outlier_filter(taxi):
    finals = by(metrics.taxi_finals(taxi, "taxi_speculative_m3"), "zone_id")
    assert set(finals) == {"CELL_1_1", "CELL_0_10", "CELL_2_5"} and finals["CELL_1_1"].event_count == 3
    means = by(metrics.taxi_means(taxi), "strategy")
    assert means["taxi_naive"].avg_events == 4.0  # the delayed row is out, the outside cell is in


def test_zone_errors_count_missing_and_zero_references_as_100(taxi):
    rows = by(metrics.zone_errors(taxi), "zone_id")
    assert set(rows) == {"CELL_1_1", "CELL_2_5"}
    assert rows["CELL_1_1"].distance_error_pct == 50.0 and rows["CELL_2_5"].distance_error_pct == 100.0
    assert (rows["CELL_2_5"].grid_row, rows["CELL_2_5"].grid_col) == (4, 2)


def test_sensitivity_falls_back_to_the_best_variant(taxi):
    none = metrics.taxi_sensitivity(taxi.where("strategy = 'taxi_naive'"), ["taxi_naive"])
    assert none.first().completeness_pct == 100.0
    row = metrics.taxi_sensitivity(taxi.where("window_delay_s < 86400"), ["taxi_naive"]).first()
    assert row.completeness_pct == 100.0  # 4 per window against a final mean of 3.5


def test_monitor_reports_losses(taxi):
    rows = metrics.monitor(taxi.where("window_delay_s < 86400"), interval="10 minutes").collect()
    naive = [r for r in rows if r.strategy == "taxi_naive"][0]
    assert naive.lost_events_per_window == 0.0 and naive.windows_fired == 2 and len(rows) == 2
