"""The detector's fold over blocks of events against the fold over single events."""

import numpy as np
import pytest

from ebbmark import params
from ebbmark.operators import adwin

STRATEGIES = [params.house_adwin(0.1, 0.1), params.house_adwin(0.01, 1.0), params.taxi_adwin(3, 0.1, 0.1), params.taxi_adwin(1, 1.0, 0.1)]


def arrivals(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    sent = np.sort(rng.integers(0, 40 * n, n))
    delay = np.where(rng.random(n) < 0.2, rng.integers(1000, 9000, n), rng.integers(0, 300, n)) * (1 + 3 * (sent // (8 * n) % 2))
    order = np.argsort(sent + delay, kind="stable")
    return sent[order], (sent + delay)[order]


def one_by_one(event_time, arrival_time, tick_ms=params.TICK_MS):
    controllers, rows, open_tick = [adwin.SlackController(s) for s in STRATEGIES], [], None
    for e, a in [*zip(event_time.tolist(), arrival_time.tolist()), (None, None)]:
        tick = None if a is None else a // tick_ms
        if tick != open_tick and open_tick is not None:
            before = [c.wm for c in controllers]
            for c in controllers:
                c.emit()
            rows.append((open_tick, *before, *(c.wm for c in controllers)))
        open_tick = tick
        if a is not None:
            for c in controllers:
                c.observe(e, a)
    return rows, controllers


def state(c):
    levels = [level for level in c.detector.levels if level]
    return (c.newest, c.slack, c.warm, c.late, c.seen, c.detector.delta, c.detector.count, c.detector.width, c.detector.total,
            c.detector.variance, levels)


@pytest.mark.parametrize("most", [40, 700, 50_000])
def test_many_events_at_a_time(most):
    event_time, arrival_time = arrivals(12_000, most)
    rng, at = np.random.default_rng(most), 0
    many = [adwin.SlackController(s) for s in STRATEGIES]
    while at < len(event_time):
        n = int(rng.integers(1, most))
        for c in many:
            c.observe_many(event_time[at:at + n], arrival_time[at:at + n], np.zeros(0, np.int64))
        at += n
    single = [adwin.SlackController(s) for s in STRATEGIES]
    cuts = 0
    for e, a in zip(event_time.tolist(), arrival_time.tolist()):
        for c in single:
            c.observe(e, a)
            cuts += c.drift
    assert cuts > 20 and [state(c) for c in many] == [state(c) for c in single]


def test_watermarks_from_blocks(spark):
    event_time, arrival_time = arrivals(9_000, 5)
    rows = [("all", i, int(e), int(a)) for i, (e, a) in enumerate(zip(event_time, arrival_time))]
    events = spark.createDataFrame(rows, "scope string, event_id long, event_time long, arrival_time long")
    assert adwin._packed(events).count() < len(rows) / 100
    wide = adwin.adwin_watermarks(events, STRATEGIES)
    names = [c for c in wide.columns if c != "scope"]
    assert sorted(tuple(r[n] for n in names) for r in wide.collect()) == one_by_one(event_time, arrival_time)[0]


@pytest.mark.parametrize("missing", [range(1500, 1501), range(2900, 3000), range(3), range(600, 1200, 7)])
def test_missing_times_are_taken_one_by_one(spark, missing):
    """A missing time turns up as NaN, as in a column of a pandas frame."""
    event_time, arrival_time = arrivals(3_000, 6)
    rows = [("all", i, None if i in missing else int(e), int(a)) for i, (e, a) in enumerate(zip(event_time, arrival_time))]
    events = spark.createDataFrame(rows, "scope string, event_id long, event_time long, arrival_time long")
    wide = adwin.adwin_watermarks(events, STRATEGIES)
    names = [c for c in wide.columns if c != "scope"]
    holed = event_time.astype(float)
    holed[list(missing)] = np.nan
    expected = [tuple(None if x is None or x != x else int(x) for x in r) for r in one_by_one(holed, arrival_time)[0]]
    assert sorted((tuple(r[n] for n in names) for r in wide.collect()), key=lambda r: r[0]) == expected
