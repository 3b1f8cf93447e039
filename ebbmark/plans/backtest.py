"""Backtests: what each lateness policy would have produced over stored events.

Events need ``event_id, key, reading_1, reading_2, event_time, arrival_time`` (times in epoch
milliseconds; ids unique integers that break arrival ties).
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ebbmark.functions.scalars import window_end
from ebbmark.operators import adwin, mean_shift, speculative, windows
from ebbmark.operators.running import Slicing, running, running_max_by_arrival
from ebbmark.operators.timeline import combine_scopes, fixed_timeline, widened, with_scope
from ebbmark.params import Strategy, TICK_MS
from ebbmark.session import stored

RESULT = ["strategy", "key", "window_end", "event_count", "avg_1", "avg_2", "fire_time",
          "decisional_latency_ms", "true_latency_ms", "window_delay_ms", "update_count", "is_final"]


TALLY = ["strategy", "scope", "key", "window_end", "event_count", "avg_1", "avg_2", "last_arrival", "first_arrival", "dropped"]


@dataclass(frozen=True)
class Settings:
    """How watermarks are scoped and emitted.

    ``scope`` is ``global`` (one watermark for the stream), ``key`` or ``split``. The feedback of an
    ADWIN strategy is sequential, so under a global scope it runs per source split, as a reader with
    ``splits`` partitions would, and the split watermarks are combined. ``splits`` is a property of the
    source, its number of partitions, and never derived from the data: each split has a warm-up of its
    own, so the number decides the answer. ``idle_ms`` is the silence after which a split is left out of
    the combination.
    """

    scope: str = "global"
    splits: int = 64
    tick_ms: int = TICK_MS
    idle_ms: int = 1000
    flush: bool = False


def _union(parts: Iterable[DataFrame]) -> DataFrame:
    result = None
    for part in parts:
        result = part if result is None else result.unionByName(part)
    return result


_CLOCK = ("scope", "event_id", "event_time", "arrival_time")


def timelines(events: DataFrame, strategies: list[Strategy], settings: Settings = Settings()) -> DataFrame:
    """Watermark timelines of all strategies, with ``scope`` as ``events`` of ``scoped`` carry it."""
    clock = with_scope(events, settings.scope, settings.splits).select(*_CLOCK)
    steady = [s for s in strategies if s.kind in ("fixed", "speculative")]
    shifting = [s for s in strategies if s.kind == "mean_shift"]
    adaptive = [s for s in strategies if s.kind == "adwin"]
    parts = []
    if steady:
        parts.append(fixed_timeline(clock, steady, settings.tick_ms))
    if shifting:
        parts.append(mean_shift.mean_shift_timeline(clock, shifting, settings.tick_ms))
    if adaptive:
        if settings.scope == "global":
            by_split = with_scope(events, "split", settings.splits).select(*_CLOCK)
            apart = adwin.adwin_watermarks(by_split, adaptive, settings.tick_ms)
            parts.append(combine_scopes(stored(apart, "split-watermarks"), adaptive, settings.idle_ms, settings.tick_ms))
        else:
            parts.append(adwin.adwin_timeline(clock, adaptive, settings.tick_ms))
    timeline = _union(parts)
    if settings.scope == "split":
        timeline = combine_scopes(widened(timeline, strategies), strategies, settings.idle_ms, settings.tick_ms)
    return timeline


def scoped(events: DataFrame, settings: Settings) -> DataFrame:
    """Events with the scope whose timeline judges them."""
    return with_scope(events, "key" if settings.scope == "key" else "global")


@dataclass(frozen=True)
class Backtest:
    """Frames of one backtest. The timeline and the tallies are stored, the rest is lazy over them."""

    timeline: DataFrame
    tallies: DataFrame
    windows: DataFrame
    late: DataFrame


def run(events: DataFrame, strategies: list[Strategy], settings: Settings = Settings()) -> Backtest:
    """Run every strategy in one job; all must share a window size.

    Raw events are read for the watermark timelines (four integer columns), for the window ends (two) and once more for the
    per-tick window sums. A policy without an allowed lateness is decided by the closing tick of each window end, so its variants
    multiply no rows before the result; speculative ones are judged tick by tick.
    """
    sizes = {s.window_ms for s in strategies}
    if len(sizes) != 1:
        raise ValueError("strategies of one backtest must share a window size")
    size = sizes.pop()
    timeline = stored(timelines(events, strategies, settings), "timeline")
    rows = scoped(events, settings)
    partials = windows.per_tick_windows(rows, size, settings.tick_ms)
    once = [s for s in strategies if s.kind != "speculative"]
    repeated = [s for s in strategies if s.kind == "speculative"]
    parts, tallies = [], []
    if once:
        steps = timeline.where(F.col("strategy").isin([s.name for s in once]))
        ends = rows.select("scope", window_end("event_time", size).alias("window_end")).distinct()
        closings = stored(windows.closing_ticks(ends, steps, once, size, settings.tick_ms), "closings")
        tallies.append(stored(windows.tallied_by_closing(partials, closings), "tallies"))
        flush_at = None
        if settings.flush:
            flush_at = rows.groupBy("scope").agg(F.max("arrival_time").alias("flush_time"))
        parts.append(windows.fired_windows(windows.accepted_windows(tallies[-1]), flush_at))
    if repeated:
        steps = timeline.where(F.col("strategy").isin([s.name for s in repeated]))
        tallies.append(stored(windows.tallied(windows.judged(partials, steps, repeated)), "tallies"))
        parts.append(speculative.final_speculative(windows.accepted_windows(tallies[-1])))
    whole = _union(t.select(*TALLY) for t in tallies)
    return Backtest(timeline, whole, _union(parts), windows.late_counts(whole))


def sweep(events: DataFrame, groups: dict[str, list[Strategy]], settings: Settings = Settings()) -> DataFrame:
    """Window results of every variant of a parameter study, with the variant's ``family``."""
    families = {s.name: family for family, members in groups.items() for s in members}
    result = run(events, [s for members in groups.values() for s in members], settings).windows
    table = F.create_map(*[F.lit(x) for pair in families.items() for x in pair])
    return result.withColumn("family", F.element_at(table, F.col("strategy")))


def ground_truth(events: DataFrame, window_ms: int) -> DataFrame:
    """Every event in its window, nothing late: the true 100 percent."""
    rows = events.withColumn("window_end", window_end("event_time", window_ms))
    return rows.groupBy("key", "window_end").agg(
        F.count(F.lit(1)).alias("event_count"),
        (F.sum(F.coalesce("reading_1", F.lit(0.0))) / F.count(F.lit(1))).alias("avg_1"),
        (F.sum(F.coalesce("reading_2", F.lit(0.0))) / F.count(F.lit(1))).alias("avg_2"),
        F.max("arrival_time").alias("last_arrival"))


def true_completeness(tallies: DataFrame) -> DataFrame:
    """Share of all events a strategy kept, also counting windows it lost entirely."""
    return tallies.groupBy("strategy").agg(
        F.sum("event_count").alias("accepted"), F.sum("dropped").alias("dropped")) \
        .withColumn("total", F.col("accepted") + F.col("dropped")) \
        .withColumn("completeness_pct", F.col("accepted") / F.col("total") * 100)


def _combined_before(trace: DataFrame, names: list[str], idle_ms: int, slicing: Slicing) -> DataFrame:
    """Per event of ``trace`` (one row per event, ``scope`` the split) the stream's watermark before it.

    One running fold carries the last arrival and the last watermark of every split, two columns a split, so it is meant for
    as many splits as a source has partitions. The stream's watermark is the least over the splits heard from within ``idle_ms``; a
    split that was heard but has emitted nothing holds it back; it never falls.
    """
    order, slots = ["arrival_time", "event_id"], range(len(names))
    own = [F.when(F.col("scope") == name, F.col(c)).alias(f"{c}_{i}")
           for i, name in enumerate(names) for c in ("arrival_time", "wm")]
    rows = trace.select(F.lit("all").alias("scope"), *order, *own)
    carried = {f"{c}_{i}": ("max", f"{c}_{i}") for i in slots for c in ("arrival_time", "wm")}
    seen = running(rows, ["scope"], order, carried, slicing, exclusive=False, suffix="_now")
    heard = [F.coalesce(F.col("arrival_time") - F.col(f"arrival_time_{i}_now") < idle_ms, F.lit(False)) for i in slots]
    marks = [F.when(heard[i], F.col(f"wm_{i}_now")) for i in slots]
    silent = F.exists(F.array(*[heard[i] & marks[i].isNull() for i in slots]), lambda held: held)
    least = seen.select("scope", *order, F.when(~silent, F.array_min(F.array(*marks))).alias("wm"))
    moved = running(stored(least, "least-watermarks"), ["scope"], order, {"wm": ("max", "wm")}, slicing, inclusive=False)
    return moved.select("event_id", "wm_before")


def _adwin_flags(rows: DataFrame, strategy: Strategy, scope: str, splits: int, idle_ms: int, slicing: Slicing) -> DataFrame:
    if scope != "global":
        trace = adwin.adwin_trace(rows, [strategy])
        return rows.join(trace.select("event_id", "strategy", "slack", "wm_before"), "event_id")
    apart = with_scope(rows, "split", splits)
    trace = stored(adwin.adwin_trace(apart, [strategy]), "split-trace")
    # The splits of a source, not of its rows: as few as its partitions.
    names = sorted(r.scope for r in trace.select("scope").distinct().collect())
    before = _combined_before(trace, names, idle_ms, slicing)
    return rows.join(trace.select("event_id", "strategy", "slack"), "event_id").join(before, "event_id")


def flag_events(events: DataFrame, strategy: Strategy, scope: str = "global", slicing: Slicing = Slicing(60_000),
                splits: int = 1, idle_ms: int = 1000) -> DataFrame:
    """Per event: the watermark before it, and whether it is accepted, when a watermark is emitted on
    every event instead of on ticks.

    An ADWIN strategy with a global scope runs per source split, as in ``run``; ``splits`` and ``idle_ms`` are those of ``Settings`` and
    matter to it alone.
    """
    rows = with_scope(events, scope, splits).withColumn("window_end", window_end("event_time", strategy.window_ms))
    if strategy.kind == "mean_shift":
        rows = mean_shift.slack_trace(rows, [strategy], slicing=slicing)
    elif strategy.kind == "adwin":
        rows = _adwin_flags(rows, strategy, scope, splits, idle_ms, slicing)
    else:
        rows = (running_max_by_arrival(rows, ["scope"], slicing)
                .withColumn("slack", F.lit(strategy.slack_ms).cast("long"))
                .withColumn("strategy", F.lit(strategy.name))
                .withColumn("wm_before", F.col("newest_before") - F.lit(strategy.slack_ms + strategy.offset_ms)))
    is_open = F.col("wm_before").isNull() | (
        F.col("window_end") - 1 + F.lit(strategy.lateness_ms) > F.col("wm_before"))
    return rows.withColumn("accepted", is_open)
