"""Common table expressions: derived events, watermark timelines, window results, metric tables."""

from __future__ import annotations

from ebbmark import params
from oracles.adwin import combined, controller_ctes

START = 1_704_067_200_000
HOUSE_SPEEDUP, TAXI_SPEEDUP = 360, 60
TICK = 200


def scramble(identity: str, salt: int) -> str:
    x = f"(({identity}) % 2147483647 + {salt * 7919 + 1})"
    for multiplier in (48271, 69621, 16807):
        x = f"(({x} * {multiplier} + {salt}) % 2147483647)"
    return x


def draw(identity: str, salt: int, choices: int | str) -> str:
    return f"({scramble(identity, salt)} % {choices})"


def minute(period: int, start: int = START) -> str:
    return f"(((event_time - {start}) // 60000) % {period})"


def delay(regime: str, start: int = START) -> str:
    d = lambda low, n: f"(chance // 10000 % {n} + {low})"
    coin = "chance % 10000"
    if regime == "stationary":
        return (f"CASE WHEN {coin} < 1500 THEN {d(5, 7)} * 1000 WHEN {coin} < 3000 THEN {d(0, 2000)} "
                f"ELSE {d(50, 200)} END")
    if regime == "short_cycle":
        m = minute(6, start)
        return (f"CASE WHEN {m} < 2 THEN {d(50, 150)} WHEN {m} < 4 AND {coin} < 5000 THEN {d(5000, 5000)} "
                f"WHEN {m} < 4 THEN {d(100, 300)} ELSE {d(500, 1500)} END")
    m = minute(45, start)
    return (f"CASE WHEN {m} < 15 THEN {d(50, 150)} WHEN {m} < 30 AND {coin} < 7500 THEN {d(8000, 10000)} "
            f"WHEN {m} < 30 THEN {d(100, 300)} ELSE {d(1000, 4000)} END")


def _clock(speedup: int) -> str:
    return f"CAST({START} + (epoch_us(ts) // 1000 - {START}) // {speedup} AS BIGINT)"


def house_events(regime: str = "stationary", speedup: int = HOUSE_SPEEDUP, scope: str = "'all'", houses: int = 100) -> str:
    return f"""
raw AS (SELECT event_id, 'HOUSE_' || CAST(user_id % {houses} AS VARCHAR) AS key, round(value * 100) AS reading_1,
    CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS reading_2,
    CAST({draw('event_id', 31, 100)} AS DOUBLE) AS reading_3, {_clock(speedup)} AS event_time,
    {scramble('event_id', 1)} AS chance FROM events),
ev AS (SELECT * EXCLUDE (chance), event_time + {delay(regime)} AS arrival_time, {scope} AS scope FROM raw)"""


def cell(lat: str, lon: str) -> str:
    d = lambda x: f"CAST('{x}' AS DOUBLE)"
    x = f"CAST(trunc(({lon} - {d('-74.2591')}) / {d('0.5587')} * 10) AS INTEGER)"
    y = f"CAST(trunc(({lat} - {d('40.4774')}) / {d('0.4402')} * 10) AS INTEGER)"
    outside = (f"{lat} < {d('40.4774')} OR {lat} > {d('40.9176')} OR {lon} < {d('-74.2591')} "
               f"OR {lon} > {d('-73.7004')}")
    return f"CASE WHEN {outside} THEN 'CELL_OUT' ELSE 'CELL_' || {x} || '_' || {y} END"


def taxi_events(speedup: int = TAXI_SPEEDUP, scope: str = "'all'", arrival: str = "event_time + seconds * 1000") -> str:
    lat = f"(CAST('40.4774' AS DOUBLE) + {draw('user_id % 1000', 41, 1000)} * CAST('0.00046' AS DOUBLE))"
    lon = f"(CAST('-74.2591' AS DOUBLE) + {draw('user_id % 1000', 42, 1000)} * CAST('0.00058' AS DOUBLE))"
    return f"""
raw AS (SELECT event_id, value, {lat} AS lat, {lon} AS lon, ({draw('event_id', 43, 248)} + 4) * 15 AS seconds,
    {draw('event_id', 44, 6)} + 1 AS passengers, {_clock(speedup)} AS event_time FROM events),
ev AS (SELECT event_id, {cell('lat', 'lon')} AS key, round(value * 100) AS reading_1, seconds / 60.0 AS reading_2,
    CAST(passengers AS DOUBLE) AS reading_3, event_time, {arrival} AS arrival_time, {scope} AS scope
    FROM (SELECT *, {cell('lat', 'lon')} AS key FROM raw))"""


# Watermark timelines: one row per strategy, scope and tick ------------------------

def ticks(source: str = "ev", prefix: str = "") -> str:
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
    w = "PARTITION BY scope ORDER BY arrival_time, event_id"
    return f"""
{prefix}ordered AS (SELECT *, arrival_time // {TICK} AS tick, row_number() OVER ({w}) AS pos,
    max(event_time) OVER ({w} {rows} CURRENT ROW) AS newest,
    max(event_time) OVER ({w} {rows} 1 PRECEDING) AS newest_before FROM {source}),
{prefix}ticks AS (SELECT scope, tick, max(newest) AS newest, max(pos) AS pos FROM {prefix}ordered GROUP BY scope, tick)"""


TICKS = ticks()


def fixed(name: str, slack: int) -> str:
    return f"SELECT '{name}' AS strategy, scope, tick, newest - {slack} - 1 AS proposed FROM ticks"


def sampled(sample: str, prefix: str = "") -> str:
    """sample: 'network' or 'disorder'."""
    if sample == "network":
        value = "arrival_time - event_time"
    else:
        value = "CASE WHEN newest_before IS NULL THEN 0 ELSE greatest(0, newest_before - event_time) END"
    return f"{prefix}sampled AS (SELECT *, {value} AS sample FROM {prefix}ordered)"


def mean_shift_ctes(sample: str) -> str:
    skip = 0 if sample == "network" else 1
    return f"""
{sampled(sample)},
halves AS (SELECT *, pos - {skip} >= 200 AS full_buffer,
    sum(sample) OVER (PARTITION BY scope ORDER BY pos ROWS BETWEEN 199 PRECEDING AND 100 PRECEDING) AS older,
    sum(sample) OVER (PARTITION BY scope ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS newer FROM sampled)"""


def proposed_slack(threshold: int, buffer: int, low: int | None, high: int) -> str:
    value = f"CAST(older + newer AS BIGINT) // 200 + {buffer}"
    if low is not None:
        value = f"greatest({low}, {value})"
    return (f"CASE WHEN full_buffer AND abs(CAST(older AS DOUBLE) / 100 - CAST(newer AS DOUBLE) / 100) > {threshold} "
            f"THEN least({high}, {value}) END")


def mean_shift(name: str, start: int, threshold: int, buffer: int, low: int | None, high: int) -> str:
    return f"""SELECT '{name}' AS strategy, scope, tick, newest - coalesce(last_value(cand IGNORE NULLS) OVER
    (PARTITION BY scope ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), {start}) AS proposed
    FROM (SELECT scope, tick, max(newest) AS newest, arg_max(cand, pos) FILTER (WHERE cand IS NOT NULL) AS cand
        FROM (SELECT *, {proposed_slack(threshold, buffer, low, high)} AS cand FROM halves) GROUP BY scope, tick)"""


def settled_slack(buffer: int, low: int, high: int, prefix: str = "") -> str:
    """With a late limit of 1 the slack never moves after the 500 warm-up events of a scope."""
    return f"""(SELECT scope AS slack_scope, least({high}, greatest({low}, CAST(sum(greatest(0, sample)) AS BIGINT) // 500 + {buffer}))
     AS slack FROM {prefix}sampled WHERE pos <= 500 GROUP BY scope)"""


def adwin_settled(name: str, buffer: int, low: int, high: int, prefix: str = "") -> str:
    return f"""SELECT '{name}' AS strategy, scope, tick, CASE WHEN pos >= 500 THEN newest - slack END AS proposed
    FROM {prefix}ticks JOIN {settled_slack(buffer, low, high, prefix)} ON scope = slack_scope"""


def split_ctes(sample: str, splits: int = 1, salt: int = 71) -> str:
    """The same stream seen as source splits, for policies that run per split."""
    return f"""
split_ev AS (SELECT * EXCLUDE (scope), {draw('event_id', salt, splits)} AS scope FROM ev),{ticks('split_ev', 'split_')},
{sampled(sample, 'split_')}"""


def adwin_combined(name: str, buffer: int, low: int, high: int, hold: int) -> str:
    """Per split, then the least watermark over the splits heard from within ``hold`` ticks."""
    return f"""SELECT '{name}' AS strategy, 'all' AS scope, tick,
    CASE WHEN count(wm) = count(*) THEN min(wm) END AS proposed FROM (
        SELECT scope, tick + ahead AS tick, max(wm) AS wm FROM (
            SELECT scope, tick, max(proposed) OVER (PARTITION BY scope ORDER BY tick) AS wm
            FROM ({adwin_settled(name, buffer, low, high, 'split_')})),
        (SELECT unnest(range(0, {hold})) AS ahead) GROUP BY 1, 2) GROUP BY tick"""


def timeline(proposals: list[str]) -> str:
    rows = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
proposals AS ({' UNION ALL '.join(proposals)}),
timeline AS (SELECT strategy, scope, tick,
    max(proposed) OVER (PARTITION BY strategy, scope ORDER BY tick {rows} 1 PRECEDING) AS wm_before,
    max(proposed) OVER (PARTITION BY strategy, scope ORDER BY tick {rows} CURRENT ROW) AS wm FROM proposals)"""


def results(window: int, speculative: str, lateness: int, flush: bool = False) -> str:
    """Judged events, window results of the strategies that emit once, and final speculative versions."""
    # The bounded watermark already lies one millisecond behind, as the window's last millisecond does.
    fire_join = f"""
steps AS (SELECT strategy, scope, wm, min(tick) AS tick FROM timeline WHERE wm IS NOT NULL GROUP BY strategy, scope, wm),
fired AS (SELECT w.*, (s.tick + 1) * {TICK} AS fire_time, s.wm AS fire_wm
    FROM windows w ASOF LEFT JOIN steps s
    ON w.strategy = s.strategy AND w.scope = s.scope AND w.window_end - 1 <= s.wm
    WHERE w.strategy <> '{speculative}')"""
    emitted = "fired" if flush else "(SELECT * FROM fired WHERE fire_time IS NOT NULL)"
    fire_time = "coalesce(fire_time, (SELECT max(arrival_time) FROM ev))" if flush else "fire_time"
    return f"""
judged AS (SELECT t.strategy, o.*, (o.event_time // {window} + 1) * {window} AS window_end, t.wm_before,
    t.wm_before IS NULL OR (o.event_time // {window} + 1) * {window} - 1
        + CASE WHEN t.strategy = '{speculative}' THEN {lateness} ELSE 0 END > t.wm_before AS accepted
    FROM ordered o JOIN timeline t ON o.tick = t.tick AND o.scope = t.scope),
windows AS (SELECT strategy, scope, key, window_end, count(*) AS event_count,
    sum(coalesce(reading_1, 0)) / count(*) AS avg_1, sum(coalesce(reading_2, 0)) / count(*) AS avg_2,
    max(arrival_time) AS last_arrival, min(arrival_time) AS first_arrival, max(wm_before) AS last_wm_before
    FROM judged WHERE accepted GROUP BY strategy, scope, key, window_end), {fire_join},
results AS (
    SELECT strategy, key, window_end, event_count, avg_1, avg_2, {fire_time} AS fire_time,
        {fire_time} - window_end AS decisional_latency_ms, {fire_time} - last_arrival AS true_latency_ms,
        coalesce(greatest(0, fire_wm - window_end), 0) AS window_delay_ms, CAST(1 AS BIGINT) AS update_count,
        true AS is_final FROM {emitted}
    UNION ALL
    SELECT strategy, key, window_end, event_count, avg_1, avg_2, last_arrival, first_arrival - window_end, 0,
        coalesce(greatest(0, last_wm_before - window_end), 0), event_count, last_arrival - window_end > 15000
    FROM windows WHERE strategy = '{speculative}')"""


def updates(speculative: str) -> str:
    w = "(PARTITION BY key, window_end ORDER BY arrival_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""
updates AS (SELECT strategy, key, window_end, event_id, count(*) OVER {w} AS event_count,
    sum(coalesce(reading_1, 0)) OVER {w} / count(*) OVER {w} AS avg_1,
    sum(coalesce(reading_2, 0)) OVER {w} / count(*) OVER {w} AS avg_2,
    arrival_time AS fire_time, min(arrival_time) OVER {w} - window_end AS decisional_latency_ms,
    CAST(0 AS BIGINT) AS true_latency_ms, coalesce(greatest(0, wm_before - window_end), 0) AS window_delay_ms,
    count(*) OVER {w} AS update_count, arrival_time - window_end > 15000 AS is_final,
    coalesce(wm_before >= window_end - 1, false) AS is_closed
    FROM judged WHERE accepted AND strategy = '{speculative}')"""


HOUSE_METRICS = """
metrics AS (SELECT window_end AS time_ms, key AS house_id, strategy, avg_1 AS avg_temp, avg_2 AS avg_energy,
    decisional_latency_ms, true_latency_ms, event_count AS pachete_count, is_final, update_count FROM results)"""


def taxi_metrics(speculative: str) -> str:
    columns = ("fire_time AS time_ms, key AS zone_id, strategy, true_latency_ms, window_delay_ms / 1000.0 AS window_delay_s, "
               "event_count, avg_1 AS avg_distance, avg_2 AS avg_duration, update_count, window_end")
    return f"""
metrics AS (SELECT {columns} FROM results WHERE strategy <> '{speculative}'
    UNION ALL SELECT {columns} FROM updates)"""


def statement(ctes: list[str], final: str) -> str:
    return "WITH RECURSIVE " + ",".join(ctes) + "\n" + final


HOUSE_ADWIN, TAXI_ADWIN = params.house_adwin(0.1, 0.1), params.taxi_adwin(3, 0.1, 0.1)
HOUSE_STRATEGIES = [
    fixed("naive", 0), fixed("watermark_5s", 5000),
    mean_shift("adaptive_adwin_dt1000", 5000, 1000, 500, None, 12000),
    combined(HOUSE_ADWIN, 5),
    fixed("speculative", 0),
]
TAXI_STRATEGIES = [
    fixed("taxi_naive", 0), fixed("taxi_watermark_m3_s1500", 1_500_000),
    mean_shift("taxi_adaptive_adwin_m3_dt60", 600_000, 60_000, 60_000, 10_000, 3_600_000),
    combined(TAXI_ADWIN, 25),
    fixed("taxi_speculative_m3", 0),
]


def house_ctes(strategies: list[str] | None = None, regime: str = "stationary", flush: bool = False, scope: str = "'all'",
               houses: int = 100, adaptive: list[params.Strategy] = (), splits: int = 1, salt: int = 71) -> list[str]:
    """``adaptive``: the ADWIN strategies whose feedback the statement follows; those of the default set if none is given."""
    adaptive = adaptive or ([] if strategies else [HOUSE_ADWIN])
    return [house_events(regime, scope=scope, houses=houses), TICKS, mean_shift_ctes("network"), split_ctes("network", splits, salt),
            *([controller_ctes(adaptive)] if adaptive else []),
            timeline(strategies or HOUSE_STRATEGIES), results(10_000, "speculative", 15_000, flush)]


def taxi_ctes(strategies: list[str] | None = None, lateness: int = 3_600_000, scope: str = "'all'",
              adaptive: list[params.Strategy] = ()) -> list[str]:
    adaptive = adaptive or ([] if strategies else [TAXI_ADWIN])
    return [taxi_events(scope=scope), TICKS, mean_shift_ctes("disorder"), split_ctes("disorder"),
            *([controller_ctes(adaptive)] if adaptive else []),
            timeline(strategies or TAXI_STRATEGIES), results(60_000, "taxi_speculative_m3", lateness),
            updates("taxi_speculative_m3")]
