"""Distributed forms against the sequential models, on random arrivals."""

import random

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from ebbmark import params
from ebbmark.operators import adwin, mean_shift
from ebbmark.operators.running import Slicing, running, running_max_by_arrival
from ebbmark.operators.timeline import with_scope
from ebbmark.plans import backtest
from tests import model


def arrivals(seed, n, keys=3, gap=300, calm=400, burst=9_000, swing=700):
    """Bursty delays: calm and congested stretches alternate."""
    rng = random.Random(seed)
    rows, now = [], 1_700_000_000_000
    for i in range(n):
        now += rng.randrange(gap)
        congested = (i // swing) % 2 == 1
        delay = rng.randrange(burst) if congested and rng.random() < 0.6 else rng.randrange(calm)
        rows.append((i, f"k{rng.randrange(keys)}", now, now + delay))
    return rows


def in_order(rows):
    return sorted(rows, key=lambda r: (r[3], r[0]))


@pytest.mark.parametrize("sample,build", [("network", params.house_adwin), ("disorder", params.taxi_adwin)])
@pytest.mark.parametrize("limit,step", [(0.01, 0.1), (0.1, 1.0)])
def test_adwin_trace_follows_the_model(events, sample, build, limit, step):
    rows = arrivals(7, 6_000)
    s = build(late_limit=limit, delta_step=step)
    expected = model.adwin_slack([(r[0], r[2], r[3]) for r in in_order(rows)], sample, limit, step, s.floor_ms,
                                 s.warmup_cap_ms, s.cap_ms, s.warmup_buffer_ms, s.buffer_ms, s.slack_ms)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    trace = adwin.adwin_trace(with_scope(events(shuffled)), [s]).collect()
    got = {r.event_id: (r.slack, r.drift, r.wm_before) for r in trace}
    assert got == {e[0]: e[1:] for e in expected}
    assert any(e[2] for e in expected)


@pytest.mark.parametrize("splits,named", [(1, False), (3, False), (3, True)])
def test_adwin_flags_follow_the_model(events, splits, named):
    """Every event moves its split's watermark; the stream's is the least over the splits heard from lately, and never falls."""
    rows, idle_ms = in_order(arrivals(13, 4_000)), 700
    s = params.house_adwin(0.1, 0.1)
    frame = events(rows)
    if named:
        frame = frame.withColumn("source_split", F.concat(F.lit("p"), F.col("event_id") % splits))
    split = {r.event_id: r.scope for r in with_scope(frame, "split", splits).collect()}
    assert len(set(split.values())) == splits
    after, slack = {}, {}
    for name in set(split.values()):
        own = [(r[0], r[2], r[3]) for r in rows if split[r[0]] == name]
        trace = model.adwin_slack(own, "network", 0.1, 0.1, s.floor_ms, s.warmup_cap_ms, s.cap_ms, s.warmup_buffer_ms, s.buffer_ms, s.slack_ms)
        newest = wm = None
        for count, ((event_id, event, _), row) in enumerate(zip(own, trace)):
            newest = event if newest is None else max(newest, event)
            if count >= 499 and (wm is None or newest - row[1] > wm):
                wm = newest - row[1]
            after[event_id], slack[event_id] = wm, row[1]
    expected, heard, whole = {}, {}, None
    for event_id, _, event, arrival in rows:
        end = (event // s.window_ms + 1) * s.window_ms
        expected[event_id] = (slack[event_id], whole, whole is None or end - 1 > whole)
        heard[split[event_id]] = (arrival, after[event_id])
        active = [wm for at, wm in heard.values() if arrival - at < idle_ms]
        if None not in active and (whole is None or min(active) > whole):
            whole = min(active)
    flagged = backtest.flag_events(frame, s, slicing=Slicing(60_000, 500), splits=splits, idle_ms=idle_ms).collect()
    assert {r.event_id: (r.slack, r.wm_before, r.accepted) for r in flagged} == expected
    assert 0 < sum(not e[2] for e in expected.values()) < len(rows)


def test_adwin_flags_per_key_are_those_of_the_trace(events):
    rows, s = arrivals(14, 2_500, keys=2), params.house_adwin(0.1, 0.1)
    trace = {r.event_id: r.wm_before for r in adwin.adwin_trace(with_scope(events(rows), "key"), [s]).collect()}
    assert {r.event_id: r.wm_before for r in backtest.flag_events(events(rows), s, "key").collect()} == trace


def test_adwin_checks_every_32_inputs_only():
    detector = adwin.Adwin(1.0)
    assert not any(detector.add(0.0 if i < 16 else 2.0) for i in range(31))


def test_adwin_slack_is_fixed_at_a_late_limit_of_one(events):
    trace = adwin.adwin_trace(with_scope(events(arrivals(3, 4_000))), [params.house_adwin(1.0, 0.1)])
    slacks = trace.orderBy("arrival_time", "event_id").select("slack").collect()
    assert len({r.slack for r in slacks[499:]}) == 1


@pytest.mark.parametrize("sample,strategy", [("network", params.house_mean_shift(500)),
                                             ("disorder", params.taxi_mean_shift(1))])
def test_mean_shift_follows_the_model(events, sample, strategy):
    rows = arrivals(11, 5_000)
    expected = model.mean_shift_slack([(r[0], r[2], r[3]) for r in in_order(rows)], sample, strategy.slack_ms,
                                      strategy.threshold_ms, strategy.buffer_ms, strategy.floor_ms, strategy.cap_ms)
    trace = mean_shift.slack_trace(with_scope(events(rows)), [strategy], block_rows=300, slicing=Slicing(60_000, 500))
    assert {r.event_id: r.slack for r in trace.collect()} == dict(expected)
    assert len({slack for _, slack in expected}) > 5


def test_windows_follow_the_model(events):
    rows = in_order(arrivals(5, 1_500))
    strategies = [params.house_naive(), params.house_fixed(3)]
    result = backtest.run(events(rows), strategies)
    for s in strategies:
        fired, dropped = model.per_tick_windows(
            rows, s.window_ms, 0, lambda seen: max(e for _, e, _ in seen) - s.slack_ms - 1)
        mine = {(r.key, r.window_end): r.event_count
                for r in result.windows.where(F.col("strategy") == s.name).collect()}
        late = result.late.where(F.col("strategy") == s.name).agg(F.sum("dropped")).first()[0]
        assert mine == fired and (late or 0) == dropped


def test_mean_shift_windows_follow_the_model(events):
    rows = in_order(arrivals(6, 1_200, swing=300))
    s = params.house_mean_shift(500)

    def propose(seen):
        slack = model.mean_shift_slack(seen, "network", s.slack_ms, s.threshold_ms, s.buffer_ms, None, s.cap_ms)[-1][1]
        return max(e for _, e, _ in seen) - slack

    fired, dropped = model.per_tick_windows(rows, s.window_ms, 0, propose)
    result = backtest.run(events(rows), [s])
    assert {(r.key, r.window_end): r.event_count for r in result.windows.collect()} == fired
    assert (result.late.agg(F.sum("dropped")).first()[0] or 0) == dropped and dropped > 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 60_000), st.integers(0, 20_000)), min_size=1, max_size=60))
def test_invariants(events, pairs):
    rows = [(i, f"k{i % 2}", e, e + d) for i, (e, d) in enumerate(pairs)]
    slacks = [params.house_fixed(s) for s in (0, 2, 5, 30)]
    result = backtest.run(events(rows), slacks + [params.house_speculative()])
    kept = {r.strategy: r for r in backtest.true_completeness(result.tallies).collect()}
    assert all(r.total == len(rows) for r in kept.values())
    counts = [kept[s.name].accepted for s in slacks]
    assert counts == sorted(counts)
    back = result.timeline.where("wm < wm_before").count()
    assert back == 0


def test_unlimited_lateness_equals_the_truth(events):
    from dataclasses import replace
    frame = events(arrivals(9, 800))
    s = replace(params.house_speculative(), lateness_ms=10 ** 12)
    finals = {(r.key, r.window_end): (r.event_count, r.avg_1) for r in backtest.run(frame, [s]).windows.collect()}
    truth = {(r.key, r.window_end): (r.event_count, r.avg_1)
             for r in backtest.ground_truth(frame, s.window_ms).collect()}
    assert finals == truth


def test_skew_in_one_millisecond_is_split_exactly(spark):
    """A third of the rows arrive in one millisecond; units stay bounded and the fold exact."""
    rng = random.Random(2)
    rows = [(i * 40_000, rng.randrange(10 ** 6), 5_000 if i % 3 == 0 else rng.randrange(10_000)) for i in range(3_000)]
    frame = spark.createDataFrame(rows, "event_id long, event_time long, arrival_time long").withColumn("scope", F.lit("all"))
    out = running_max_by_arrival(frame, ["scope"], Slicing(60_000, 100)).collect()
    newest, expected = None, {}
    for event_id, event, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        expected[event_id] = newest
        newest = event if newest is None else max(newest, event)
    assert {r.event_id: r.newest_before for r in out} == expected
    from ebbmark.operators.running import with_units
    sized, unit = with_units(frame, ["scope"], ["arrival_time", "event_id"], Slicing(60_000, 100))
    assert sized.groupBy(*unit).count().agg(F.max("count")).first()[0] <= 200


@pytest.mark.parametrize("coarse", [None, 3])
def test_running_folds_of_all_kinds(spark, coarse):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(3)}", rng.randrange(1000) * 10 + 5, i, rng.choice([None, rng.randrange(-50, 50)]))
            for i in range(600)]
    frame = spark.createDataFrame(rows, "scope string, at long, id long, v long")
    folds = {"hi": ("max", "v"), "lo": ("min", "v"), "total": ("sum", "v"), "n": ("count", "v"), "rows": ("count", "*"),
             "head": ("first", "v"), "tail": ("last", "v")}
    out = running(frame, ["scope"], ["at", "id"], folds, Slicing(500, 40, coarse))
    expected, state = {}, {}
    for scope, at, i, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        seen = state.setdefault(scope, [])
        def summary(values):
            some = [x for x in values if x is not None]
            return (max(some, default=None), min(some, default=None), sum(some) if some else None, len(some),
                    len(values), some[0] if some else None, some[-1] if some else None)
        before = summary(seen)
        seen.append(v)
        expected[i] = (summary(seen), before)
    for r in out.collect():
        assert tuple(r[n] for n in folds) == expected[r.id][0]
        assert tuple(r[f"{n}_before"] for n in folds) == expected[r.id][1]


def test_detect_drift_per_scope(spark):
    rng = random.Random(8)
    rows = [(f"s{i % 2}", i, (0.2 if i < 1000 else 1.5 * (i % 2)) + rng.random() * 0.1) for i in range(2_000)]
    frame = spark.createDataFrame(rows, "scope string, i long, v double").repartition(4, "v")
    out = {(r.scope, r.i): (r.drift, r.width) for r in adwin.detect_drift(frame, "scope", ["i"], "v", 0.05).collect()}
    for scope in ("s0", "s1"):
        detector = model.WindowedDetector()
        for s, i, v in rows:
            if s == scope:
                assert out[(s, i)] == (detector.feed(v, 0.05), detector.n)
    assert any(drift for drift, _ in out.values())
