"""Watermarks, lateness samples, drift tests and per-event flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ebbmark import params
from ebbmark.functions import scalars
from ebbmark.operators import adwin, mean_shift
from ebbmark.operators.running import Slicing, running_max_by_arrival
from ebbmark.operators.timeline import combine_scopes, fixed_timeline, widened, with_scope
from ebbmark.plans import backtest
from oracles import adwin as adwin_sql, base
from registry.core import house, query, run_house, taxi

# Small units, so that the tables exercise many of them.
MINUTE = Slicing(60_000)
SPLIT_SLICES = Slicing(86_400_000, 2_000)
SMALL_BLOCK = 1_000


@query("running_max_by_arrival", base.statement([base.taxi_events(), base.TICKS],
                                                "SELECT event_id, newest, newest_before FROM ordered"))
def running_max(spark, folder):
    rows = running_max_by_arrival(with_scope(taxi(spark, folder)), ["scope"], MINUTE)
    return rows.select("event_id", "newest", "newest_before")


@query("running_max_split_slices", base.statement([base.house_events(), base.TICKS],
                                                  "SELECT event_id, newest, newest_before FROM ordered"))
def running_max_split(spark, folder):
    """Slices far above the part size: every unit comes from an exact split."""
    rows = running_max_by_arrival(with_scope(house(spark, folder)), ["scope"], SPLIT_SLICES)
    return rows.select("event_id", "newest", "newest_before")


@query("running_max_per_key", base.statement([base.taxi_events()], """SELECT event_id,
    max(event_time) OVER (PARTITION BY key ORDER BY arrival_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS newest_before FROM ev"""))
def running_max_per_key(spark, folder):
    rows = running_max_by_arrival(with_scope(taxi(spark, folder), "key"), ["scope"], Slicing(3_600_000))
    return rows.select("event_id", "newest_before")


_LATENESS = """SELECT event_id, arrival_time - event_time AS network, greatest(0, arrival_time - event_time) AS network_clamped,
    CASE WHEN newest_before IS NULL THEN 0 ELSE greatest(0, newest_before - event_time) END AS disorder,
    least(CAST(2 AS DOUBLE), greatest(0, arrival_time - event_time) / CAST(2000 AS DOUBLE)) AS normalised FROM ordered"""


def _lateness(rows):
    clamped = F.greatest(mean_shift.network_lateness(), F.lit(0))
    seen = running_max_by_arrival(with_scope(rows), ["scope"], MINUTE)
    return seen.select("event_id", mean_shift.network_lateness().alias("network"), clamped.alias("network_clamped"),
                       mean_shift.disorder_lateness().alias("disorder"),
                       scalars.normalised_lateness(clamped, F.lit(2000)).alias("normalised"))


@query("lateness_samples_house", base.statement([base.house_events(), base.TICKS], _LATENESS))
def lateness_house(spark, folder):
    return _lateness(house(spark, folder))


@query("lateness_samples_taxi", base.statement([base.taxi_events(), base.TICKS], _LATENESS))
def lateness_taxi(spark, folder):
    return _lateness(taxi(spark, folder))


# Per-event flags, a watermark on every event ---------------------------------------

def _flags(name: str, strategy: params.Strategy, watermark: str, events: str, rows, extra: list[str] = ()) -> None:
    end = f"(event_time // {strategy.window_ms} + 1) * {strategy.window_ms}"
    sql = base.statement(
        [events, base.TICKS, *extra, f"marked AS ({watermark})"],
        f"SELECT event_id, wm_before, wm_before IS NULL OR {end} - 1 + {strategy.lateness_ms} > wm_before AS accepted FROM marked")
    query(name, sql)(lambda spark, folder: backtest.flag_events(rows(spark, folder), strategy, slicing=MINUTE)
                     .select("event_id", "wm_before", "accepted"))


def _bounded(slack: int) -> str:
    return f"SELECT event_id, event_time, newest_before - {slack} - 1 AS wm_before FROM ordered"


def _shifting(start: int, threshold: int, buffer: int, low: int | None, high: int) -> str:
    return f"""SELECT event_id, event_time, pos, max(newest - slack) OVER
    (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm_before, slack, newest FROM (
    SELECT *, coalesce(last_value(cand IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    {start}) AS slack FROM (SELECT *, {base.proposed_slack(threshold, buffer, low, high)} AS cand FROM halves))"""


_flags("flags_house_naive", params.house_naive(), _bounded(0), base.house_events(), house)
_flags("flags_house_fixed_slack", params.house_fixed(5), _bounded(5000), base.house_events(), house)
_flags("flags_house_speculative", params.house_speculative(), _bounded(0), base.house_events(), house)
_flags("flags_house_mean_shift", params.house_mean_shift(500), _shifting(5000, 500, 500, None, 12000),
       base.house_events(), house, [base.mean_shift_ctes("network")])
_flags("flags_taxi_fixed_slack", params.taxi_fixed(3, 900), _bounded(900_000), base.taxi_events(), taxi)
_flags("flags_taxi_mean_shift", params.taxi_mean_shift(3, 30), _shifting(600_000, 30_000, 60_000, 10_000, 3_600_000),
       base.taxi_events(), taxi, [base.mean_shift_ctes("disorder")])


@query("taxi_in_order_flags", base.statement([base.taxi_events()], "SELECT true AS accepted, count(*) AS events FROM ev GROUP BY 1"))
def taxi_in_order(spark, folder):
    """The reference run: a topic sorted by pickup loses nothing without any slack."""
    trips = taxi(spark, folder).withColumn("arrival_time", F.col("event_time"))
    flagged = backtest.flag_events(trips, params.taxi_in_order(), slicing=MINUTE)
    return flagged.groupBy("accepted").agg(F.count(F.lit(1)).alias("events"))


@query("taxi_in_order_windows", base.statement(
    [base.taxi_events(arrival="event_time"), base.TICKS, base.timeline([base.fixed("taxi_in_order", 0)]), base.results(60_000, "", 0)],
    """SELECT w.key, w.window_end, coalesce(r.event_count, 0) AS event_count, w.dropped, r.avg_1, r.fire_time
    FROM (SELECT key, window_end, count(*) FILTER (NOT accepted) AS dropped FROM judged GROUP BY 1, 2) w
    LEFT JOIN results r ON r.key = w.key AND r.window_end = w.window_end"""))
def taxi_in_order_windows(spark, folder):
    """The reference run's windows: every event of a sorted topic in its window, each closed by the first tick after its end, and the losses counted."""
    trips = taxi(spark, folder).withColumn("arrival_time", F.col("event_time"))
    done = backtest.run(trips, [params.taxi_in_order()])
    truth = backtest.ground_truth(trips, params.TAXI_WINDOW_MS).select("key", "window_end")
    lost = done.late.select("key", "window_end", "dropped")
    shown = done.windows.select("key", "window_end", "event_count", "avg_1", "fire_time")
    return truth.join(shown, ["key", "window_end"], "left").join(lost, ["key", "window_end"], "left").na.fill(0, ["event_count", "dropped"])


# Drift tests and slack ---------------------------------------------------------------

@query("mean_shift_test", base.statement([base.house_events("short_cycle"), base.TICKS, base.mean_shift_ctes("network")],
       """SELECT event_id, pos AS position,
       CASE WHEN full_buffer THEN abs(CAST(older AS DOUBLE) / 100 - CAST(newer AS DOUBLE) / 100) END AS shift,
       CASE WHEN full_buffer THEN CAST(older + newer AS BIGINT) // 200 END AS mean_sample FROM halves"""))
def mean_shift_test(spark, folder):
    rows = mean_shift.shift_test(with_scope(house(spark, folder, "short_cycle")), "network", SMALL_BLOCK)
    return rows.select("event_id", "position", "shift", "mean_sample")


def _slack(name: str, strategy, trace: str, events: str, rows, sample: str) -> None:
    sql = base.statement([events, base.TICKS, base.mean_shift_ctes(sample), f"marked AS ({trace})"],
                         "SELECT event_id, slack, newest FROM marked")
    query(name, sql)(lambda spark, folder: mean_shift.slack_trace(
        with_scope(rows(spark, folder)), [strategy], SMALL_BLOCK).select("event_id", "slack", "newest"))


_slack("mean_shift_slack_house", params.house_mean_shift(1000), _shifting(5000, 1000, 500, None, 12000),
       base.house_events("long_cycle"), lambda spark, folder: house(spark, folder, "long_cycle"), "network")
_slack("mean_shift_slack_taxi", params.taxi_mean_shift(3), _shifting(600_000, 60_000, 60_000, 10_000, 3_600_000),
       base.taxi_events(), taxi, "disorder")


SPLITS = 4


def _splits(rows):
    return with_scope(rows, "split", SPLITS)


@query("adwin_settled_slack", base.statement([base.house_events(), base.split_ctes("network", SPLITS)],
       f"""SELECT event_id, CASE WHEN pos < 500 THEN 2000 ELSE slack END AS slack FROM split_ordered
       JOIN {base.settled_slack(1000, 1000, 8000, 'split_')} ON scope = slack_scope"""))
def adwin_settled_slack(spark, folder):
    rows = _splits(house(spark, folder))
    return adwin.adwin_trace(rows, [params.house_adwin(1.0, 0.1)]).select("event_id", "slack")


TRACED = [params.house_adwin(0.1, 0.1), params.house_adwin(0.01, 1.0)]


@query("adwin_trace", base.statement(
    [base.house_events("short_cycle"), base.split_ctes("network", SPLITS), adwin_sql.controller_ctes(TRACED, per_event=True)],
    """SELECT t.strategy, s.event_id, t.slack, t.delta, t.drift, t.late_seen, t.wm_before
    FROM traced t JOIN split_sampled s ON s.scope = t.scope AND s.pos = t.pos"""))
def adwin_trace(spark, folder):
    """The feedback loop at late limits of 0.1 and 0.01."""
    trace = adwin.adwin_trace(_splits(house(spark, folder, "short_cycle")), TRACED)
    return trace.select("strategy", "event_id", "slack", "delta", "drift", "late_seen", "wm_before")


@query("adwin_drift_per_group", base.statement(["""
    seq AS MATERIALIZED (SELECT user_id % 5 AS scope, event_id, row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS pos,
        CASE WHEN day(ts) % 10 < 5 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END * least(value / 100, 2.0::DOUBLE) AS x FROM events)""",
    adwin_sql.drift_ctes("seq", 0.05)],
    "SELECT scope AS user_group, event_id, x AS value, drift, round(estimate, 9) AS estimate, width FROM found JOIN seq USING (scope, pos)"))
def adwin_drift(spark, folder):
    """The change detector on a plain numeric column whose level changes every five days, one detector per user group."""
    level = F.when(F.day("ts") % 10 < 5, F.lit(1.0)).otherwise(F.lit(0.25))
    rows = spark.read.parquet(f"{folder}/events.parquet").select(
        (F.col("user_id") % 5).alias("user_group"), "event_id", (level * F.least(F.col("value") / 100, F.lit(2.0))).alias("value"))
    found = adwin.detect_drift(rows, "user_group", ["event_id"], "value", 0.05)
    return found.withColumn("estimate", F.round("estimate", 9))


# Timelines ----------------------------------------------------------------------------

@query("fixed_timeline", base.statement(
    [base.house_events(), base.TICKS, base.timeline([base.fixed(f"watermark_{s}s", s * 1000) for s in params.HOUSE_SLACKS_S])],
    "SELECT strategy, tick, wm_before, wm FROM timeline"))
def fixed_watermarks(spark, folder):
    timeline = fixed_timeline(with_scope(house(spark, folder)), params.house_sensitivity()["slack"])
    return timeline.select("strategy", "tick", "wm_before", "wm")


_SPLIT = base.draw("event_id", 71, 4)


@query("combined_split_watermark", base.statement([base.house_events(), f"""
    split_ticks AS (SELECT {_SPLIT} AS scope, arrival_time // 200 AS tick, max(event_time) AS newest FROM ev GROUP BY 1, 2),
    split_wm AS (SELECT scope, tick, max(newest) OVER (PARTITION BY scope ORDER BY tick) - 5001 AS wm FROM split_ticks),
    held AS (SELECT scope, tick + ahead AS tick, max(wm) AS wm FROM split_wm, (SELECT unnest(range(0, 5)) AS ahead) GROUP BY 1, 2),
    least_wm AS (SELECT tick, min(wm) AS wm FROM held GROUP BY tick)"""],
    """SELECT tick, max(wm) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm_before,
    max(wm) OVER (ORDER BY tick) AS wm FROM least_wm"""))
def combined_split_watermark(spark, folder):
    """Four source splits with their own watermarks, combined with a one-second idle timeout."""
    strategies = [params.house_fixed(5)]
    splits = fixed_timeline(with_scope(house(spark, folder), "split", 4), strategies)
    return combine_scopes(widened(splits, strategies), strategies, 1000).select("tick", "wm_before", "wm")


DEFAULT = params.house_adwin(0.1, 0.1)


def _adwin_flags(name: str, strategy, events: str, rows, sample: str, splits: int, idle_ms: int) -> None:
    sql = base.statement(
        [events, base.split_ctes(sample, splits), adwin_sql.controller_ctes([strategy], per_event=True), adwin_sql.flagged_ctes(strategy, splits, idle_ms)],
        f"""SELECT event_id, slack, wm_before, wm_before IS NULL OR (event_time // {strategy.window_ms} + 1) * {strategy.window_ms} - 1 > wm_before AS accepted FROM marked""")
    query(name, sql)(lambda spark, folder: backtest.flag_events(
        rows(spark, folder), strategy, slicing=MINUTE, splits=splits, idle_ms=idle_ms).select("event_id", "slack", "wm_before", "accepted"))


# Splits are heard from every three seconds or so here, so an idle time of five seconds lets them hold each other back and drop out.
_adwin_flags("flags_house_adwin", DEFAULT, base.house_events("short_cycle"), lambda spark, folder: house(spark, folder, "short_cycle"), "network", SPLITS, 5000)
_adwin_flags("flags_taxi_adwin", params.taxi_adwin(3, 0.1, 0.1), base.taxi_events(), taxi, "disorder", 1, 5000)


@query("adwin_split_windows", base.statement(
    base.house_ctes([adwin_sql.combined(DEFAULT, 5)], adaptive=[DEFAULT], splits=SPLITS), f"SELECT {', '.join(backtest.RESULT)} FROM results"))
def adwin_split_windows(spark, folder):
    """ADWIN at a late limit of 0.1, per source split and combined."""
    return run_house(spark, folder, [DEFAULT], splits=SPLITS).windows


@query("late_events", base.statement(base.house_ctes(), """SELECT strategy, key, window_end, count(*) AS dropped
    FROM judged WHERE NOT accepted GROUP BY strategy, key, window_end"""))
def late_events(spark, folder):
    return run_house(spark, folder).late


@query("true_completeness", base.statement(base.house_ctes(), """SELECT strategy,
    CAST(sum(CASE WHEN accepted THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
    CAST(sum(CASE WHEN accepted THEN 0 ELSE 1 END) AS BIGINT) AS dropped, count(*) AS total,
    sum(CASE WHEN accepted THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) * 100 AS completeness_pct
    FROM judged GROUP BY strategy"""))
def true_completeness(spark, folder):
    return backtest.true_completeness(run_house(spark, folder).tallies)
