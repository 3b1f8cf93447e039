"""The ADWIN detector and its slack controller as recursive SQL, written from the behaviour survey (section 2.5).

One iteration takes the next event of every (strategy, scope) at once, or, where a check is due, tests the window and
drops one bucket. ``lv`` holds the bucket sums by level: level i stands for 2^(i-1) samples, oldest first within a level.
"""

from __future__ import annotations

from ebbmark.params import Strategy

LEVELS = 20
EMPTY = "[" + ", ".join(["[]::DOUBLE[]"] * LEVELS) + "]"

#: Append x to the first level; while a level holds more than five, its two oldest become one of the next.
INSERT = f"""list_reduce(range(1, {LEVELS}), lambda acc, d: CASE WHEN len(acc[d]) > 5 THEN list_transform(acc, lambda b, i:
    CASE WHEN i = d THEN b[3:] WHEN i = d + 1 THEN list_append(b, acc[d][1] + acc[d][2]) ELSE b END) ELSE acc END,
    list_transform(lv, lambda b, i: CASE WHEN i = 1 THEN list_append(b, x) ELSE b END))"""

_SIZES = "flatten(list_transform(lv, lambda b, i: list_transform(b, lambda y: 1 << (i - 1))))"
_SIDES = f"""list_transform(range(1, len(flatten(lv)) + 1), lambda k: {{'n1': list_sum(({_SIZES})[1:k]),
    's1': list_sum((flatten(lv))[1:k]), 's0': list_reduce((flatten(lv))[1:k], lambda a, b: a - b, total)}})"""
_BOUND = """sqrt(2 * (1 / c.n1 + 1 / (width - c.n1)) * (variance / width) * ln(2 / delta))
    + 2.0::DOUBLE / 3 * (1 / c.n1 + 1 / (width - c.n1)) * ln(2 / delta)"""
DIFFER = f"""len(list_filter({_SIDES}, lambda c: c.n1 > 5 AND width - c.n1 > 5
    AND abs(c.s1 / c.n1 - c.s0 / (width - c.n1)) > {_BOUND})) > 0"""
_OLDEST = f"list_max(list_filter(range(1, {LEVELS + 1}), lambda i: len(lv[i]) > 0))"
DROPPED = "list_transform(lv, lambda b, i: CASE WHEN i = oldest THEN b[2:] ELSE b END)"


def drift_ctes(source: str, delta: float) -> str:
    """``found``: one row per scope and pos of ``source (scope, pos, x)`` with drift, estimate and width."""
    return f"""
run AS (SELECT scope, 0::BIGINT AS pos, {EMPTY} AS lv, 0::BIGINT AS width, 0.0::DOUBLE AS total, 0.0::DOUBLE AS variance, 0::BIGINT AS cnt,
    CAST({delta} AS DOUBLE) AS delta, false AS checking, false AS cut FROM (SELECT DISTINCT scope FROM {source})
  UNION ALL
  SELECT scope, CASE WHEN checking THEN pos ELSE pos + 1 END,
    CASE WHEN NOT checking THEN {INSERT} WHEN differ THEN {DROPPED} ELSE lv END,
    CASE WHEN NOT checking THEN width + 1 WHEN differ THEN width - (1 << (oldest - 1)) ELSE width END,
    CASE WHEN NOT checking THEN total + x WHEN differ THEN total - lv[oldest][1] ELSE total END,
    CASE WHEN NOT checking THEN variance + (x - (total + x) / (width + 1)) * (x - (total + x) / (width + 1)) ELSE variance END,
    CASE WHEN checking THEN cnt ELSE cnt + 1 END, delta,
    CASE WHEN checking THEN differ ELSE (cnt + 1) % 32 = 0 AND width + 1 > 10 END,
    CASE WHEN checking THEN cut OR differ ELSE false END
  FROM (SELECT r.*, e.x, CASE WHEN checking THEN {DIFFER} ELSE false END AS differ,
        CASE WHEN checking THEN {_OLDEST} END AS oldest
    FROM run r LEFT JOIN {source} e ON e.scope = r.scope AND e.pos = CASE WHEN r.checking THEN -1 ELSE r.pos + 1 END
    WHERE r.checking OR e.pos IS NOT NULL)),
found AS (SELECT scope, pos, cut AS drift, CASE WHEN width > 0 THEN total / width ELSE 0.0 END AS estimate, width
    FROM run WHERE NOT checking AND pos > 0)"""


def controller_ctes(strategies: list[Strategy], per_event: bool = False) -> str:
    """Over the events of ``base.split_ctes``, ``traced``: per strategy, scope and event the slack after it and the watermark before it. Watermarks are emitted when
    the tick of the next event differs, or before every event."""
    limits = ", ".join(
        f"('{s.name}', {s.slack_ms}, {s.floor_ms}, {s.cap_ms}, {s.warmup_cap_ms}, {s.warmup_buffer_ms}, {s.buffer_ms}, "
        f"CAST({s.late_limit} AS DOUBLE), CAST({s.delta_step} AS DOUBLE))" for s in strategies)
    moved = "true" if per_event else "e_tick <> tick"
    lower = "CASE WHEN late = 0 THEN least(1.0, delta + step) ELSE delta END"
    drifted = "checking AND NOT differ AND cut"
    kept = "late / CAST(seen AS DOUBLE) < late_limit"
    is_late = "CASE WHEN wm_now IS NOT NULL AND moment < wm_now THEN 1 ELSE 0 END"
    return f"""
limits(strategy, start, low, high, warm_high, warm_buffer, buffer, late_limit, step) AS (VALUES {limits}),
seq AS MATERIALIZED (SELECT scope, pos, tick AS e_tick, event_time AS e_time, greatest(0, sample) AS lateness FROM split_sampled),
run AS (SELECT strategy, scope, 0::BIGINT AS pos, -1::BIGINT AS tick, NULL::BIGINT AS newest, NULL::BIGINT AS wm, 0::BIGINT AS moment,
    start::BIGINT AS slack, 0::BIGINT AS warm_sum, 0::BIGINT AS late, 0::BIGINT AS seen, 1.0::DOUBLE AS delta, {EMPTY} AS lv,
    0::BIGINT AS width, 0.0::DOUBLE AS total, 0.0::DOUBLE AS variance, 0::BIGINT AS cnt, false AS checking, false AS cut
    FROM limits, (SELECT DISTINCT scope FROM seq)
  UNION ALL
  SELECT strategy, scope, pos_now, CASE WHEN checking THEN tick ELSE e_tick END, newest_now, wm_now, moment,
    CASE WHEN NOT checking AND pos_now = 500 THEN least(warm_high, greatest(low, (warm_sum + lateness) // 500 + warm_buffer))
        WHEN {drifted} AND NOT {kept} THEN least(high, greatest(low, CAST(trunc(total / width * slack) AS BIGINT) + buffer)) ELSE slack END,
    CASE WHEN NOT checking AND pos_now <= 500 THEN warm_sum + lateness ELSE warm_sum END,
    CASE WHEN {drifted} AND {kept} THEN 0 WHEN {drifted} THEN late WHEN checking AND differ THEN late
        WHEN checking OR (feed AND NOT due) THEN late + {is_late} ELSE late END,
    CASE WHEN {drifted} AND {kept} THEN 0 WHEN feed THEN seen + 1 ELSE seen END,
    CASE WHEN {drifted} AND {kept} THEN {lower} WHEN {drifted} THEN greatest(0.01, {lower} - step) ELSE delta END,
    CASE WHEN feed THEN {INSERT} WHEN checking AND differ THEN {DROPPED} ELSE lv END,
    CASE WHEN feed THEN width + 1 WHEN checking AND differ THEN width - (1 << (oldest - 1)) ELSE width END,
    CASE WHEN feed THEN total + x WHEN checking AND differ THEN total - lv[oldest][1] ELSE total END,
    CASE WHEN feed THEN variance + (x - (total + x) / (width + 1)) * (x - (total + x) / (width + 1)) ELSE variance END,
    CASE WHEN feed THEN cnt + 1 ELSE cnt END,
    CASE WHEN checking THEN differ ELSE due END, CASE WHEN checking THEN cut OR differ ELSE false END
  FROM (SELECT *, feed AND (cnt + 1) % 32 = 0 AND width + 1 > 10 AS due FROM (
    SELECT r.* EXCLUDE (moment), l.* EXCLUDE (strategy), e.e_tick, e.lateness,
        CASE WHEN checking THEN moment ELSE e_time END AS moment,
        CASE WHEN checking THEN r.pos ELSE r.pos + 1 END AS pos_now,
        CASE WHEN checking THEN newest ELSE greatest(newest, e_time) END AS newest_now,
        NOT checking AND r.pos >= 500 AS feed,
        CASE WHEN slack > 0 THEN least(2.0, CAST(lateness AS DOUBLE) / slack) ELSE 0.0 END AS x,
        CASE WHEN NOT checking AND r.pos >= 500 AND {moved} THEN greatest(coalesce(wm, newest - slack), newest - slack) ELSE wm END AS wm_now,
        CASE WHEN checking THEN {DIFFER} ELSE false END AS differ, CASE WHEN checking THEN {_OLDEST} END AS oldest
    FROM run r JOIN limits l ON l.strategy = r.strategy
    LEFT JOIN seq e ON e.scope = r.scope AND e.pos = CASE WHEN r.checking THEN -1 ELSE r.pos + 1 END
    WHERE r.checking OR e.pos IS NOT NULL))),
traced AS (SELECT strategy, scope, pos, slack, delta, cut AS drift, late AS late_seen, wm AS wm_before FROM run WHERE NOT checking AND pos > 0)"""


def combined(strategy: Strategy, hold: int) -> str:
    """Proposals for ``timeline`` from ``traced``: per split, then the least over the splits heard from within ``hold`` ticks."""
    return f"""SELECT '{strategy.name}' AS strategy, 'all' AS scope, tick,
    CASE WHEN count(wm) = count(*) THEN min(wm) END AS proposed FROM (
        SELECT scope, tick + ahead AS tick, max(wm) AS wm FROM (
            SELECT scope, tick, max(proposed) OVER (PARTITION BY scope ORDER BY tick) AS wm FROM (
                SELECT k.scope, k.tick, CASE WHEN k.pos >= 500 THEN k.newest - t.slack END AS proposed
                FROM split_ticks k JOIN traced t ON t.scope = k.scope AND t.pos = k.pos AND t.strategy = '{strategy.name}')),
        (SELECT unnest(range(0, {hold})) AS ahead) GROUP BY 1, 2) GROUP BY tick"""


def flagged_ctes(strategy: Strategy, splits: int, idle_ms: int) -> str:
    """``marked``: per event of the stream the least watermark before it, over splits that emit on each of their events (``traced`` per event)."""
    over = "OVER (ORDER BY arrival_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    heard = [f"coalesce(arrival_time - at_{i} < {idle_ms}, false)" for i in range(splits)]
    return f"""
moved AS (SELECT s.event_id, s.event_time, s.arrival_time, s.scope, t.slack,
    CASE WHEN t.pos >= 500 THEN greatest(coalesce(t.wm_before, s.newest - t.slack), s.newest - t.slack) END AS wm
    FROM traced t JOIN split_sampled s ON s.scope = t.scope AND s.pos = t.pos WHERE t.strategy = '{strategy.name}'),
folded AS (SELECT event_id, event_time, arrival_time, slack, {', '.join(
        f"max(wm) FILTER (scope = {i}) {over} AS wm_{i}, max(arrival_time) FILTER (scope = {i}) {over} AS at_{i}" for i in range(splits))} FROM moved),
least_wm AS (SELECT *, CASE WHEN NOT ({' OR '.join(f"({h} AND wm_{i} IS NULL)" for i, h in enumerate(heard))})
    THEN least({', '.join(f"CASE WHEN {h} THEN wm_{i} END" for i, h in enumerate(heard))}, NULL) END AS wm FROM folded),
marked AS (SELECT *, max(wm) OVER (ORDER BY arrival_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wm_before FROM least_wm)"""
