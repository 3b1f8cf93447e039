"""Slices split into parts: a row costs the same however many parts its slice has, and no task takes a whole slice."""

import contextlib
import io
import re

import pytest

from ebbmark.operators.running import Slicing, running_max_by_arrival, with_units


@pytest.fixture
def frame(spark):
    rows = [("all", i, (i * 7919) % 5000, 40 if i < 300 else i // 3) for i in range(3000)]
    return spark.createDataFrame(rows, "scope string, event_id long, event_time long, arrival_time long").repartition(5)


def test_many_parts_in_one_slice(frame):
    slicing = Slicing(86_400_000, 10)
    out = {r.event_id: (r.newest, r.newest_before) for r in running_max_by_arrival(frame, ["scope"], slicing).collect()}
    newest, expected = None, {}
    for r in sorted(frame.collect(), key=lambda r: (r.arrival_time, r.event_id)):
        before, newest = newest, r.event_time if newest is None else max(newest, r.event_time)
        expected[r.event_id] = (newest, before)
    assert out == expected
    sized, unit = with_units(frame, ["scope"], ["arrival_time", "event_id"], slicing)
    sizes = sorted(r["count"] for r in sized.groupBy(*unit).count().collect())
    assert len(sizes) > 200 and sizes[-2] <= 13  # the one millisecond of 300 rows has one block of ids


def test_no_list_of_parts_travels_with_the_rows(frame):
    sized, _ = with_units(frame, ["scope"], ["arrival_time", "event_id"], Slicing(86_400_000, 10))
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        sized.explain()
    plan = text.getvalue()
    assert "collect_list" not in plan and "lambda" not in plan
    assert not re.search(r"hashpartitioning\(scope#\d+, _slice#\d+L?, \d+\)", plan)
