"""Adaptive slack from a mean-shift test over the last 200 lateness samples.

The test compares the mean of the older half of the buffer with the mean of the newer half. It needs
events in exact order with 199 predecessors at hand, so events are numbered in order and cut into
blocks of equal row count; the last 200 rows of a block are repeated at the head of the next. A block
is the same size whatever the scope, so a hot scope only means more blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ebbmark.functions.scalars import bucket, clamp
from ebbmark.operators.running import Slicing, running
from ebbmark.operators.timeline import TICKS_PER_SLICE, monotone, slots, with_tick
from ebbmark.params import SAMPLES, Strategy, TICK_MS
from ebbmark.session import stored

BLOCK_ROWS = 200_000
ARRIVAL_SLICE_MS = 60_000
NUMBERED = Slicing(ARRIVAL_SLICE_MS)


def numbered(events: DataFrame, slicing: Slicing = NUMBERED) -> DataFrame:
    """Add ``position`` (1, 2, ... by arrival within the scope), ``newest`` and ``newest_before``."""
    out = running(events, ["scope"], ["arrival_time", "event_id"],
                  {"position": ("count", "*"), "newest": ("max", "event_time")}, slicing)
    return out.drop("position_before")


def network_lateness() -> Column:
    return F.col("arrival_time") - F.col("event_time")


def disorder_lateness() -> Column:
    """Distance behind the newest earlier event time; the first event has nothing to be behind."""
    return F.greatest(F.lit(0).cast("long"), F.col("newest_before") - F.col("event_time"))


def sample_of(kind: str) -> tuple[Column, int]:
    """The lateness sample and the number of leading events that yield none."""
    if kind == "network":
        return network_lateness(), 0
    if kind == "disorder":
        return disorder_lateness(), 1
    raise ValueError(f"unknown sample: {kind}")


def shift_test(events: DataFrame, sample: str, block_rows: int = BLOCK_ROWS,
               slicing: Slicing = NUMBERED) -> DataFrame:
    """Add ``shift`` (distance of the half means) and ``mean_sample`` (integer mean of the buffer).

    Both are null until the buffer is full. Sums come from differences of running sums, so the cost
    per row does not depend on the buffer length.
    """
    if block_rows < SAMPLES:
        raise ValueError("a block must hold at least one buffer of samples")
    half = SAMPLES // 2
    value, skipped = sample_of(sample)
    rows = numbered(events, slicing).withColumn("_sample", value)
    rows = rows.withColumn("_index", F.col("position") - 1).withColumn("_block", bucket("_index", block_rows))
    into = F.pmod(F.col("_index"), F.lit(block_rows))
    homes = F.when(into >= block_rows - SAMPLES, F.array(F.col("_block"), F.col("_block") + 1)) \
        .otherwise(F.array(F.col("_block")))
    rows = rows.withColumn("_home", F.explode(homes))
    order = Window.partitionBy("scope", "_home").orderBy("position")
    total = F.sum(F.coalesce(F.col("_sample"), F.lit(0))).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_s0", total)
    rows = rows.withColumn("_s1", F.lag("_s0", half, 0).over(order))
    rows = rows.withColumn("_s2", F.lag("_s0", SAMPLES, 0).over(order))
    full = F.col("position") - skipped >= SAMPLES
    older = (F.col("_s1") - F.col("_s2")) / F.lit(float(half))
    newer = (F.col("_s0") - F.col("_s1")) / F.lit(float(half))
    return (rows.where(F.col("_home") == F.col("_block"))
            .withColumn("shift", F.when(full, F.abs(older - newer)))
            .withColumn("mean_sample", F.when(full, F.expr(f"(_s0 - _s2) div {SAMPLES}L")))
            .drop("_sample", "_index", "_block", "_home", "_s0", "_s1", "_s2"))


def by_sample(strategies: list[Strategy]) -> dict[str, list[Strategy]]:
    groups: dict[str, list[Strategy]] = {}
    for s in strategies:
        groups.setdefault(s.sample, []).append(s)
    return groups


def _proposed_slack(s: Strategy) -> Column:
    """The slack an event proposes: null unless the strategy's test detects a shift."""
    return F.when(F.col("shift") > s.threshold_ms,
                  clamp(F.col("mean_sample") + F.lit(s.buffer_ms), s.floor_ms, s.cap_ms))


def mean_shift_timeline(events: DataFrame, strategies: list[Strategy], tick_ms: int = TICK_MS,
                        block_rows: int = BLOCK_ROWS, slicing: Slicing = NUMBERED) -> DataFrame:
    """Timelines of several thresholds from one pass over the samples."""
    skinny = events.select("scope", "event_id", "event_time", "arrival_time")
    result = None
    for sample, group in by_sample(strategies).items():
        names = slots(group)
        tested = with_tick(shift_test(skinny, sample, block_rows, slicing), tick_ms)
        tested = tested.select("scope", "tick", "position", "newest",
                               *[_proposed_slack(s).alias(n) for s, n in zip(group, names)])
        last = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("position"))).alias(n) for n in names]
        per_tick = tested.groupBy("scope", "tick").agg(F.max("newest").alias("newest"), *last)
        per_tick = stored(per_tick, "slack-proposals")  # two running folds follow on this small table
        held = running(per_tick, ["scope"], ["tick"], {n: ("last", n) for n in names},
                       Slicing(TICKS_PER_SLICE, None), exclusive=False, suffix="_slack")
        proposals = held.select("scope", "tick", *[
            (F.col("newest") - F.coalesce(F.col(f"{n}_slack"), F.lit(s.slack_ms).cast("long"))).alias(n)
            for s, n in zip(group, names)])
        timeline = monotone(proposals, group)
        result = timeline if result is None else result.unionByName(timeline)
    return result


def slack_trace(events: DataFrame, strategies: list[Strategy], block_rows: int = BLOCK_ROWS,
                slicing: Slicing = NUMBERED) -> DataFrame:
    """Per event and strategy: the drift flag, the slack in force after it, and the watermark around it
    when one is emitted on every event."""
    blocks = Slicing(block_rows, None, coarse=4096)
    result = None
    for sample, group in by_sample(strategies).items():
        rows = (shift_test(events, sample, block_rows, slicing)
                .select("*", F.inline(F.array(*[
                    F.struct(F.lit(s.name).alias("strategy"), F.lit(s.slack_ms).cast("long").alias("_start"),
                             _proposed_slack(s).alias("_proposed")) for s in group]))))
        rows = running(rows, ["strategy", "scope"], ["position"], {"slack": ("last", "_proposed")}, blocks,
                       exclusive=False)
        rows = (rows.withColumn("slack", F.coalesce("slack", "_start"))
                .withColumn("drift", F.col("_proposed").isNotNull())
                .withColumn("_wm", F.col("newest") - F.col("slack")))
        rows = running(rows, ["strategy", "scope"], ["position"], {"wm": ("max", "_wm")}, blocks)
        rows = rows.drop("_proposed", "_start", "_wm", "mean_sample", "shift")
        result = rows if result is None else result.unionByName(rows)
    return result
