"""Watermark timelines: what the watermark was before and after every periodic tick.

A watermark moves only on a tick, so it needs one row per scope and tick that saw events, not one per
event. Rows of a timeline: ``strategy, scope, tick, wm_before, wm``; both watermarks are null until
the first emission. Events of a tick are judged against ``wm_before``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbmark.functions.delays import draw
from ebbmark.functions.scalars import bucket
from ebbmark.operators.running import Slicing, running
from ebbmark.params import Strategy, TICK_MS

TICKS_PER_SLICE = 4096  # a timeline slice holds at most this many rows of one scope
SPLIT_SALT = 71
TIMELINE = ["strategy", "scope", "tick", "wm_before", "wm"]


def with_scope(events: DataFrame, by: str = "global", splits: int = 64) -> DataFrame:
    """Add ``scope``: the set of events that share one watermark.

    ``global`` is one watermark for the stream; ``key`` one per key; ``split`` one per source split: the
    one that the source names in ``source_split``, else events are spread evenly over ``splits`` by id, so no split can be hot.
    """
    if by == "global":
        return events.withColumn("scope", F.lit("all"))
    if by == "key":
        return events.withColumn("scope", F.col("key"))
    if by == "split":
        spread = draw(F.col("event_id"), SPLIT_SALT, splits).cast("string")
        named = "source_split" in events.columns
        return events.withColumn("scope", F.coalesce("source_split", spread) if named else spread)
    raise ValueError(f"unknown scope: {by}")


def with_tick(events: DataFrame, tick_ms: int = TICK_MS) -> DataFrame:
    return events.withColumn("tick", bucket("arrival_time", tick_ms))


def fixed_timeline(events: DataFrame, strategies: list[Strategy], tick_ms: int = TICK_MS) -> DataFrame:
    """Timelines of all fixed-slack policies from one pass: they differ only by a constant."""
    newest = (with_tick(events, tick_ms).groupBy("scope", "tick")
              .agg(F.max("event_time").alias("event_time")))
    seen = running(newest, ["scope"], ["tick"], {"newest": ("max", "event_time")},
                   Slicing(TICKS_PER_SLICE, None))
    behind = [F.lit(s.slack_ms + s.offset_ms).cast("long") for s in strategies]
    return lengthened(seen, strategies, [F.col("newest_before") - b for b in behind],
                      [F.col("newest") - b for b in behind])


def lengthened(wide: DataFrame, strategies: list[Strategy], before: list[Column], after: list[Column]) -> DataFrame:
    """One timeline row per strategy from a row that holds the watermarks of all of them.

    Steps that come before work on the wide form, so several strategies cost columns, not rows.
    """
    entries = [F.struct(F.lit(s.name).alias("strategy"), b.alias("wm_before"), a.alias("wm"))
               for s, b, a in zip(strategies, before, after)]
    return wide.select("scope", "tick", F.inline(F.array(*entries))).select(*TIMELINE)


def slots(strategies: list[Strategy]) -> list[str]:
    """Column names of the wide form, one per strategy."""
    return [f"wm_{i}" for i in range(len(strategies))]


def monotone(proposals: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Emitted watermarks from proposed ones (wide, per scope and tick): a watermark never goes back."""
    names = slots(strategies)
    out = running(proposals, ["scope"], ["tick"], {n: ("max", n) for n in names}, Slicing(TICKS_PER_SLICE, None),
                  suffix="_now")
    return lengthened(out, strategies, [F.col(f"{n}_now_before") for n in names], [F.col(f"{n}_now") for n in names])


def widened(timeline: DataFrame, strategies: list[Strategy]) -> DataFrame:
    return timeline.groupBy("scope", "tick").agg(*[
        F.max(F.when(F.col("strategy") == s.name, F.col("wm"))).alias(n) for s, n in zip(strategies, slots(strategies))])


def least_over_scopes(wide: DataFrame, strategies: list[Strategy], idle_ms: int, tick_ms: int = TICK_MS) -> DataFrame:
    """Per tick the least watermark over the scopes that are not idle, before it is made monotone.

    ``wide`` has the watermark of each strategy after each tick of a scope. A scope holds it for
    ``idle_ms`` after its last event and is then left out until it speaks again, so a row covers at
    most idle/tick ticks, which bounds the expansion. A scope that is active but has emitted nothing
    yet holds the combined watermark back.
    """
    names = slots(strategies)
    hold = held_ticks(idle_ms, tick_ms)
    # A scope's watermark never falls, so the greatest one still held is also its latest. Each row holds until the scope's next.
    following = F.lead("tick").over(Window.partitionBy("scope").orderBy("tick"))
    until = F.least(F.col("tick") + F.lit(hold - 1), F.coalesce(following - 1, F.col("tick") + F.lit(hold - 1)))
    covered = wide.withColumn("_until", until).select(*names, F.explode(F.sequence("tick", "_until")).alias("tick"))
    return covered.groupBy("tick").agg(*[
        F.when(F.count(n) == F.count(F.lit(1)), F.min(n)).alias(n) for n in names])


def held_ticks(idle_ms: int, tick_ms: int = TICK_MS) -> int:
    return max(1, -(-idle_ms // tick_ms))


def combine_scopes(wide: DataFrame, strategies: list[Strategy], idle_ms: int, tick_ms: int = TICK_MS) -> DataFrame:
    """One watermark for the stream: the least over its scopes, leaving out idle ones, never going back."""
    least = least_over_scopes(wide, strategies, idle_ms, tick_ms)
    return monotone(least.withColumn("scope", F.lit("all")), strategies)
