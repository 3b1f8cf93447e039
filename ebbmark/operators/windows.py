"""Tumbling windows judged against a watermark timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ebbmark.functions.scalars import bucket_start, safe_divide, window_end
from ebbmark.operators.running import Slicing, running
from ebbmark.operators.timeline import with_tick
from ebbmark.params import Strategy, TICK_MS

ENDS_PER_SLICE = 4096


def per_tick_windows(events: DataFrame, window_ms: int, tick_ms: int = TICK_MS) -> DataFrame:
    """Partial window aggregates per tick.

    All events of one scope, tick and window meet the same fate, so they are combined before any
    lateness decision and before any strategy multiplies the rows. A missing reading adds zero to the
    sum and still counts.
    """
    rows = with_tick(events, tick_ms).withColumn("window_end", window_end("event_time", window_ms))
    return rows.groupBy("scope", "tick", "key", "window_end").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.coalesce("reading_1", F.lit(0.0))).alias("sum_1"),
        F.sum(F.coalesce("reading_2", F.lit(0.0))).alias("sum_2"),
        F.max("arrival_time").alias("last_arrival"),
        F.min("arrival_time").alias("first_arrival"))


def judged(partials: DataFrame, timeline: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Partial windows per strategy with ``accepted``.

    A window is closed once the watermark has reached its last millisecond plus the allowed lateness;
    lateness is judged per window, so an event behind the watermark is kept while its window is open.
    """
    lateness = {s.lateness_ms for s in strategies}
    allowed = F.lit(0).cast("long")
    for ms in sorted(lateness - {0}):
        names = [s.name for s in strategies if s.lateness_ms == ms]
        allowed = F.when(F.col("strategy").isin(names), F.lit(ms).cast("long")).otherwise(allowed)
    joined = partials.join(timeline.select("strategy", "scope", "tick", "wm_before"), ["scope", "tick"])
    is_open = F.col("wm_before").isNull() | (F.col("window_end") - 1 + allowed > F.col("wm_before"))
    return joined.withColumn("accepted", is_open)


def closing_ticks(ends: DataFrame, timeline: DataFrame, strategies: list[Strategy], window_ms: int, tick_ms: int = TICK_MS) -> DataFrame:
    """Per ``scope, window_end`` the array ``closings``: for every strategy the tick whose watermark passes the window, null where none does.

    For strategies without an allowed lateness, which keep a window open exactly until it fires.
    """
    names = F.explode(F.array(*[F.lit(s.name) for s in strategies])).alias("strategy")
    wanted = ends.select(names, "scope", "window_end")
    fires = firings(wanted, timeline, window_ms, tick_ms)
    entry = F.struct("strategy", F.expr(f"fire_time div {tick_ms}L - 1").alias("closing"), "fire_time", "fire_wm")
    return (wanted.join(fires, ["strategy", "scope", "window_end"], "left")
            .groupBy("scope", "window_end").agg(F.collect_list(entry).alias("closings")))


def tallied_by_closing(partials: DataFrame, closings: DataFrame) -> DataFrame:
    """As ``tallied`` over ``judged``, with ``fire_time`` and ``fire_wm``, for strategies without an allowed lateness.

    The closing ticks of a window end cut its ticks into intervals. Partials are combined per interval whatever the number of strategies,
    and running totals over a window's few intervals hold the answer of each strategy: those of the last interval that
    ends by its closing tick. Rows are multiplied by strategies only in the result.
    """
    rows = partials.join(closings, ["scope", "window_end"])
    slot = F.size(F.filter(F.array_distinct(F.col("closings.closing")), lambda c: c < F.col("tick")))
    window = ["scope", "key", "window_end"]
    cells = rows.withColumn("_slot", slot).groupBy(*window, "_slot").agg(
        F.sum("n").alias("n"), F.sum("sum_1").alias("sum_1"), F.sum("sum_2").alias("sum_2"), F.max("last_arrival").alias("last_arrival"),
        F.min("first_arrival").alias("first_arrival"), F.max("tick").alias("_last"), F.first("closings").alias("_closings"))
    order = Window.partitionBy(*window).orderBy("_slot")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running_totals = cells.select(
        *window, "_last", "_closings", *[F.sum(c).over(so_far).alias(c) for c in ("n", "sum_1", "sum_2")],
        F.max("last_arrival").over(so_far).alias("last_arrival"), F.min("first_arrival").over(so_far).alias("first_arrival"),
        F.sum("n").over(Window.partitionBy(*window)).alias("_all"),
        F.lead("_last").over(order).alias("_next"), (F.row_number().over(order) == 1).alias("_is_first"))
    each = running_totals.select("*", F.inline("_closings"))
    # An interval lies wholly on one side of each closing tick.
    open_here = F.col("closing").isNull() | (F.col("_last") <= F.col("closing"))
    open_next = F.col("_next").isNotNull() & (F.col("closing").isNull() | (F.col("_next") <= F.col("closing")))
    lost = F.col("_is_first") & ~open_here
    kept = lambda column: F.when(open_here, F.col(column))
    return each.where((open_here & ~open_next) | lost).select(
        "strategy", *window, F.coalesce(kept("n"), F.lit(0).cast("long")).alias("event_count"),
        safe_divide(kept("sum_1"), kept("n")).alias("avg_1"), safe_divide(kept("sum_2"), kept("n")).alias("avg_2"),
        F.greatest(kept("last_arrival"), F.lit(0).cast("long")).alias("last_arrival"), kept("first_arrival").alias("first_arrival"),
        (F.col("_all") - F.coalesce(kept("n"), F.lit(0).cast("long"))).alias("dropped"), "fire_time", "fire_wm")


def tallied(judged_rows: DataFrame) -> DataFrame:
    """Per strategy and window: the result over accepted events, and how many events were dropped."""
    kept = F.col("accepted")

    def over_kept(fold, column: str):
        return fold(F.when(kept, F.col(column)))

    return (judged_rows.groupBy("strategy", "scope", "key", "window_end")
            .agg(F.coalesce(over_kept(F.sum, "n"), F.lit(0)).alias("event_count"),
                 safe_divide(over_kept(F.sum, "sum_1"), over_kept(F.sum, "n")).alias("avg_1"),
                 safe_divide(over_kept(F.sum, "sum_2"), over_kept(F.sum, "n")).alias("avg_2"),
                 F.greatest(over_kept(F.max, "last_arrival"), F.lit(0).cast("long")).alias("last_arrival"),
                 over_kept(F.min, "first_arrival").alias("first_arrival"),
                 over_kept(F.max, "wm_before").alias("last_wm_before"),
                 F.coalesce(F.sum(F.when(~kept, F.col("n"))), F.lit(0)).alias("dropped")))


def accepted_windows(tallies: DataFrame) -> DataFrame:
    """Window results; a window that lost all its events has no row."""
    return tallies.where(F.col("event_count") > 0).drop("dropped")


def late_counts(tallies: DataFrame) -> DataFrame:
    """Dropped events per window: the side table that makes losses visible."""
    return tallies.where(F.col("dropped") > 0).select("strategy", "key", "window_end", "dropped")


def firings(ends: DataFrame, timeline: DataFrame, window_ms: int, tick_ms: int = TICK_MS) -> DataFrame:
    """When each window end fires: the first tick whose watermark passes it.

    The timeline is reduced to the newest window end each step passes; an end then fires with the
    smallest passed end at or after it. Ends that no watermark reaches have no row.
    """
    passed = (timeline.where(F.col("wm").isNotNull() &
                             (F.col("wm_before").isNull() | (F.col("wm") > F.col("wm_before"))))
              .withColumn("_next", F.col("wm") + 1)
              .groupBy("strategy", "scope", bucket_start("_next", window_ms).alias("window_end"))
              .agg(F.min(F.col("tick")).alias("_tick"), F.min("wm").alias("_wm")))
    wanted = ends.select("strategy", "scope", "window_end").distinct()
    points = (passed.withColumn("_end", F.lit(0))
              .unionByName(wanted.withColumn("_end", F.lit(1)), allowMissingColumns=True)
              .groupBy("strategy", "scope", "window_end")
              .agg(F.max("_end").alias("_end"), F.min("_tick").alias("_tick"), F.min("_wm").alias("_wm"))
              .withColumn("_back", -F.col("window_end")))
    seen = running(points, ["strategy", "scope"], ["_back"],
                   {"fire_tick": ("min", "_tick"), "fire_wm": ("min", "_wm")},
                   Slicing(window_ms * ENDS_PER_SLICE, None), exclusive=False)
    return (seen.where((F.col("_end") == 1) & F.col("fire_tick").isNotNull())
            .select("strategy", "scope", "window_end",
                    ((F.col("fire_tick") + 1) * F.lit(tick_ms)).alias("fire_time"), "fire_wm"))


def fired_windows(windows: DataFrame, flush_at: DataFrame | None = None) -> DataFrame:
    """Emitted results with their latencies on the replay clock, of windows with ``fire_time`` and ``fire_wm``.

    A window whose end the watermark never passes stays unemitted. With ``flush_at`` (scope,
    flush_time) it is emitted at the end of input, where the terminal watermark means no delay.
    """
    if flush_at is not None:
        out = (windows.join(flush_at, "scope", "left")
               .withColumn("fire_time", F.coalesce("fire_time", "flush_time")).drop("flush_time"))
    else:
        out = windows.where(F.col("fire_time").isNotNull())
    delay = F.coalesce(F.greatest(F.lit(0).cast("long"), F.col("fire_wm") - F.col("window_end")),
                       F.lit(0).cast("long"))
    return out.select(
        "strategy", "key", "window_end", "event_count", "avg_1", "avg_2", "fire_time",
        (F.col("fire_time") - F.col("window_end")).alias("decisional_latency_ms"),
        (F.col("fire_time") - F.col("last_arrival")).alias("true_latency_ms"),
        delay.alias("window_delay_ms"),
        F.lit(1).cast("long").alias("update_count"),
        F.lit(True).alias("is_final"))
