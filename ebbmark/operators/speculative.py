"""Speculative results: every accepted event updates its window at once, later ones correct it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ebbmark.functions.scalars import window_end
from ebbmark.operators.running import Slicing, running
from ebbmark.operators.timeline import with_tick
from ebbmark.params import Strategy, TICK_MS

FINAL_AFTER_MS = 15_000
UPDATE_SLICE_MS = 86_400_000


def update_kind(update_count: Column, is_final: Column | None = None) -> Column:
    # Update names: fixed values.
    first = F.when(update_count == 1, "INITIAL GUESS").otherwise("SPECULATIVE CORRECTION")
    return first if is_final is None else F.when(is_final, "FINAL UPDATE").otherwise(first)


def final_speculative(windows: DataFrame) -> DataFrame:
    """Last version of every speculative window, straight from the window aggregate.

    Each event is one update, the latencies are those of the first one, and on the replay clock the
    first result is out the moment its event arrives.
    """
    delay = F.coalesce(F.greatest(F.lit(0).cast("long"), F.col("last_wm_before") - F.col("window_end")),
                       F.lit(0).cast("long"))
    return windows.select(
        "strategy", "key", "window_end", "event_count", "avg_1", "avg_2",
        F.col("last_arrival").alias("fire_time"),
        (F.col("first_arrival") - F.col("window_end")).alias("decisional_latency_ms"),
        F.lit(0).cast("long").alias("true_latency_ms"),
        delay.alias("window_delay_ms"),
        F.col("event_count").alias("update_count"),
        (F.col("last_arrival") - F.col("window_end") > FINAL_AFTER_MS).alias("is_final"))


def speculative_updates(events: DataFrame, timeline: DataFrame, strategy: Strategy, tick_ms: int = TICK_MS,
                        slicing: Slicing = Slicing(UPDATE_SLICE_MS), names_final: bool = True,
                        carried: DataFrame | None = None) -> DataFrame:
    """The whole update log: one row per accepted event with the window as of that event.

    ``carried``: windows as earlier events left them (``scope, key, window_end, n, sum_1, sum_2, first_arrival``), which the updates go on from.

    ``is_final`` follows the wall-clock rule and may never become true; ``is_closed`` says whether
    the watermark had passed the window when the update came. ``names_final``: whether updates past that rule
    are named as final, as smart-home results are and taxi results are not.
    """
    rows = with_tick(events, tick_ms).withColumn("window_end", window_end("event_time", strategy.window_ms))
    rows = rows.join(timeline.where(F.col("strategy") == strategy.name)
                     .select("strategy", "scope", "tick", "wm_before"), ["scope", "tick"])
    rows = rows.where(F.col("wm_before").isNull() |
                      (F.col("window_end") - 1 + F.lit(strategy.lateness_ms) > F.col("wm_before")))
    rows = (rows.withColumn("_r1", F.coalesce("reading_1", F.lit(0.0)))
            .withColumn("_r2", F.coalesce("reading_2", F.lit(0.0))))
    seen = running(rows, ["strategy", "key", "window_end"], ["arrival_time", "event_id"],
                   {"update_count": ("count", "*"), "_s1": ("sum", "_r1"), "_s2": ("sum", "_r2"),
                    "_first": ("first", "arrival_time")}, slicing, exclusive=False)
    if carried is not None:
        before = carried.select("scope", "key", "window_end", F.col("n").alias("_n0"), F.col("sum_1").alias("_p1"), F.col("sum_2").alias("_p2"),
                                F.col("first_arrival").alias("_first0"))
        seen = seen.join(before, ["scope", "key", "window_end"], "left").withColumns({
            "update_count": F.col("update_count") + F.coalesce("_n0", F.lit(0)), "_s1": F.col("_s1") + F.coalesce("_p1", F.lit(0.0)),
            "_s2": F.col("_s2") + F.coalesce("_p2", F.lit(0.0)), "_first": F.coalesce("_first0", "_first")})
    delay = F.coalesce(F.greatest(F.lit(0).cast("long"), F.col("wm_before") - F.col("window_end")),
                       F.lit(0).cast("long"))
    is_final = F.col("arrival_time") - F.col("window_end") > FINAL_AFTER_MS
    return seen.select(
        "strategy", "key", "window_end", "event_id",
        F.col("update_count").alias("event_count"),
        (F.col("_s1") / F.col("update_count")).alias("avg_1"),
        (F.col("_s2") / F.col("update_count")).alias("avg_2"),
        F.col("arrival_time").alias("fire_time"),
        (F.col("_first") - F.col("window_end")).alias("decisional_latency_ms"),
        F.lit(0).cast("long").alias("true_latency_ms"),
        delay.alias("window_delay_ms"),
        "update_count",
        is_final.alias("is_final"),
        F.coalesce(F.col("wm_before") >= F.col("window_end") - 1, F.lit(False)).alias("is_closed"),
        update_kind(F.col("update_count"), is_final if names_final else None).alias("update_kind"))


def with_initial_rows(updates: DataFrame) -> DataFrame:
    """Add the first guess of every window a second time under ``<key>-initial``, never final."""
    first = (updates.where(F.col("update_count") == 1)
             .withColumn("key", F.concat("key", F.lit("-initial")))
             .withColumn("is_final", F.lit(False)))
    return updates.unionByName(first)
