"""Window results, losses and update logs of the strategies."""

from __future__ import annotations

from ebbmark import params
from ebbmark.operators.speculative import speculative_updates, with_initial_rows
from ebbmark.operators.timeline import with_scope
from ebbmark.plans import backtest
from oracles import base
from registry.core import house, query, run_house, run_taxi, settings, taxi

RESULT_COLUMNS = ", ".join(backtest.RESULT)


def _only(strategy: params.Strategy):
    run = run_taxi if strategy.window_ms == params.TAXI_WINDOW_MS else run_house
    return lambda spark, folder: run(spark, folder, [strategy]).windows


def _one(name: str, strategy: params.Strategy, proposal: str) -> None:
    ctes = base.taxi_ctes([proposal]) if strategy.window_ms == params.TAXI_WINDOW_MS else base.house_ctes([proposal])
    query(name, base.statement(ctes, f"SELECT {RESULT_COLUMNS} FROM results"))(_only(strategy))


_one("house_naive_windows", params.house_naive(), base.fixed("naive", 0))
_one("house_fixed_slack_windows", params.house_fixed(5), base.fixed("watermark_5s", 5000))
_one("house_mean_shift_windows", params.house_mean_shift(1000), base.HOUSE_STRATEGIES[2])
_one("house_adwin_settled_windows", params.house_adwin(1.0, 0.1),
     base.adwin_combined("adaptive_real_adwin_L100_dd10", 1000, 1000, 8000, 5))
_one("house_speculative_final_windows", params.house_speculative(), base.fixed("speculative", 0))
_one("taxi_naive_windows", params.taxi_naive(), base.fixed("taxi_naive", 0))
_one("taxi_fixed_slack_windows", params.taxi_fixed(3), base.fixed("taxi_watermark_m3", 1_500_000))
_one("taxi_mean_shift_windows", params.taxi_mean_shift(3), base.mean_shift(
    "taxi_adaptive_adwin_m3", 600_000, 60_000, 60_000, 10_000, 3_600_000))
_one("taxi_mean_shift_short_windows", params.taxi_mean_shift(1), base.mean_shift(
    "taxi_adaptive_adwin_m1", 36_000, 500, 5000, 1000, 250_000))
_one("taxi_adwin_settled_windows", params.taxi_adwin(3, 1.0, 0.1),
     base.adwin_combined("taxi_real_adwin_m3_L100_dd10", 60_000, 10_000, 3_600_000, 25))
_one("taxi_speculative_final_windows", params.taxi_speculative(3), base.fixed("taxi_speculative_m3", 0))


# Several strategies, truth and update logs ---------------------------------------------

@query("ground_truth_windows", base.statement([base.house_events()], """SELECT key, (event_time // 10000 + 1) * 10000 AS window_end,
    count(*) AS event_count, sum(reading_1) / count(*) AS avg_1, sum(reading_2) / count(*) AS avg_2,
    max(arrival_time) AS last_arrival FROM ev GROUP BY 1, 2"""))
def ground_truth(spark, folder):
    return backtest.ground_truth(house(spark, folder), params.HOUSE_WINDOW_MS)


@query("per_key_fixed_windows", base.statement([base.taxi_events(), """
    ordered AS (SELECT *, arrival_time // 200 AS tick, (event_time // 60000 + 1) * 60000 AS window_end FROM ev),
    key_ticks AS (SELECT key, tick, max(event_time) AS newest FROM ordered GROUP BY key, tick),
    marked AS (SELECT key, tick, max(newest) OVER (PARTITION BY key ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        - 900001 AS wm_before, max(newest) OVER (PARTITION BY key ORDER BY tick) - 900001 AS wm FROM key_ticks),
    kept AS (SELECT o.key, o.window_end, count(*) AS event_count, max(arrival_time) AS last_arrival
        FROM ordered o JOIN marked m ON o.key = m.key AND o.tick = m.tick
        WHERE wm_before IS NULL OR window_end - 1 > wm_before GROUP BY 1, 2),
    steps AS (SELECT key, wm, min(tick) AS tick FROM marked GROUP BY key, wm)"""],
    """SELECT k.key, k.window_end, k.event_count, (s.tick + 1) * 200 AS fire_time FROM kept k
    ASOF JOIN steps s ON k.key = s.key AND k.window_end - 1 <= s.wm"""))
def per_key_windows(spark, folder):
    """A watermark per key instead of one for the stream."""
    windows = run_taxi(spark, folder, [params.taxi_fixed(3, 900)], scope="key").windows
    return windows.select("key", "window_end", "event_count", "fire_time")


@query("flushed_windows", base.statement(base.house_ctes(flush=True), f"SELECT {RESULT_COLUMNS} FROM results"))
def flushed_windows(spark, folder):
    """All five strategies, windows that are still open at the end of input flushed."""
    return run_house(spark, folder, flush=True).windows


_KIND = ("CASE WHEN is_final THEN 'FINAL UPDATE' WHEN update_count = 1 THEN 'INITIAL GUESS' "
         "ELSE 'SPECULATIVE CORRECTION' END AS update_kind")
# Taxi results know no final update.
_TAXI_KIND = "CASE WHEN update_count = 1 THEN 'INITIAL GUESS' ELSE 'SPECULATIVE CORRECTION' END AS update_kind"
_LOG = ("key, window_end, event_count, avg_1, avg_2, fire_time, decisional_latency_ms, window_delay_ms, update_count, "
        "is_final, is_closed, update_kind")


def _updates(rows, strategy):
    return speculative_updates(with_scope(rows), backtest.timelines(rows, [strategy]), strategy,
                               names_final=strategy.window_ms == params.HOUSE_WINDOW_MS)


@query("house_speculative_updates", base.statement(
    base.house_ctes([base.fixed("speculative", 0)]) + [base.updates("speculative"), f"kinds AS (SELECT *, {_KIND} FROM updates)"],
    f"""SELECT {_LOG} FROM kinds UNION ALL SELECT {_LOG.replace('key', "key || '-initial'", 1).replace('is_final', 'false')}
    FROM kinds WHERE update_count = 1"""))
def house_updates(spark, folder):
    updates = with_initial_rows(_updates(house(spark, folder), params.house_speculative()))
    return updates.select(*_LOG.split(", "))


@query("taxi_speculative_updates", base.statement(
    base.taxi_ctes([base.fixed("taxi_speculative_m3", 0)]) + [f"kinds AS (SELECT *, {_TAXI_KIND} FROM updates)"],
    f"SELECT {_LOG} FROM kinds"))
def taxi_updates(spark, folder):
    return _updates(taxi(spark, folder), params.taxi_speculative(3)).select(*_LOG.split(", "))


_SWEEP = {
    "slack": [base.fixed(f"watermark_{s}s", s * 1000) for s in params.HOUSE_SLACKS_S],
    "threshold": [base.mean_shift(f"adaptive_adwin_dt{t}", 5000, t, 500, None, 12000) for t in params.HOUSE_THRESHOLDS_MS],
    "adwin": [base.combined(s, 5) for s in params.house_sensitivity()["adwin"]],
}


@query("house_sweep", base.statement(base.house_ctes(sum(_SWEEP.values(), []), adaptive=params.house_sensitivity()["adwin"]), f"""SELECT {RESULT_COLUMNS},
    CASE WHEN strategy LIKE 'watermark%' THEN 'slack' WHEN strategy LIKE '%real%' THEN 'adwin' ELSE 'threshold' END AS family FROM results"""))
def house_sweep(spark, folder):
    """All fourteen variants from one pass over the events."""
    return backtest.sweep(house(spark, folder), params.house_sensitivity(), settings())


def _family(family: str) -> None:
    adaptive = params.house_sensitivity()["adwin"] if family == "adwin" else []

    @query(f"house_sweep_{family}", base.statement(
        base.house_ctes(_SWEEP[family], adaptive=adaptive), f"SELECT {RESULT_COLUMNS}, '{family}' AS family FROM results"))
    def build(spark, folder):
        return backtest.sweep(house(spark, folder), {family: params.house_sensitivity()[family]}, settings())


for _name in _SWEEP:
    _family(_name)
