"""Adaptive slack driven by an ADWIN change detector.

The slack decides how lateness is normalised, the normalised lateness feeds the detector and the
detector moves the slack, so the events of one scope must be taken in order. Spark shuffles and sorts
by scope and streams each scope through one fold in Arrow batches: memory holds one batch and a
detector of logarithmic size, never a whole scope. Parallelism comes from the number of scopes; use
``with_scope(events, "split", n)`` where keys are skewed, then ``combine_scopes``. Several strategies
share one pass, and only four integer columns per event reach Python.

The watermarks per tick need no row per event in that pass: ranges of the order are sorted and packed into blocks of
two integers an event by all tasks, and the fold takes a block at a time. Slack and delta only change where the detector
cuts, so between two cuts samples, sums and the tests of a whole run are arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from ebbmark.operators.timeline import lengthened, slots
from ebbmark.params import Strategy, TICK_MS, WARMUP_EVENTS

SLOTS = 5            # sums a level may hold before its two oldest merge
CHECK_EVERY = 32
MIN_WIDTH = 10
MIN_SIDE = 5
INPUT_CAP = 2.0
MIN_DELTA = 0.01
BLOCK_EVENTS, BLOCKS_AT_ONCE = 1000, 32
SHORTEST_RUN, LONGEST_RUN = 1024, 8192  # samples tested at a time: few after a cut, then twice as many each time

TRACE_DDL = ("strategy string, scope string, event_id long, event_time long, arrival_time long, "
             "slack long, delta double, drift boolean, late_seen long, wm_before long, wm long")


class Adwin:
    """Adaptive window over a stream of numbers, kept as sums of 1, 2, 4, ... samples.

    The window's variance term only grows: dropping the oldest samples does not reduce it.
    """

    __slots__ = ("delta", "levels", "width", "total", "variance", "count")

    def __init__(self, delta: float):
        self.delta = delta
        self.levels: list[list[float]] = [[]]
        self.width = 0
        self.total = 0.0
        self.variance = 0.0
        self.count = 0

    @property
    def estimate(self) -> float:
        return self.total / self.width if self.width > 0 else 0.0

    def add(self, value: float) -> bool:
        """Take one sample; True when the window was cut because its two sides differ."""
        self.count += 1
        self.width += 1
        self.total += value
        off = value - self.total / self.width
        self.variance += off * off
        level = self.levels[0]
        level.append(value)
        if len(level) > SLOTS:
            self._merge_full_levels()
        if self.count % CHECK_EVERY or self.width <= MIN_WIDTH:
            return False
        cut = False
        while self._sides_differ():
            self._drop_oldest()
            cut = True
        return cut

    def _merge_full_levels(self) -> None:
        depth = 0
        while len(self.levels[depth]) > SLOTS:
            level = self.levels[depth]
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].append(level[0] + level[1])
            del level[:2]
            depth += 1

    def run(self, values: np.ndarray) -> tuple[int, bool]:
        """Take samples as ``add`` would, up to the first one at which the window is cut, or all: (samples taken, whether cut)."""
        n = len(values)
        widths = np.arange(self.width + 1, self.width + n + 1)
        totals = np.cumsum(np.concatenate([[self.total], values]))[1:]
        off = values - totals / widths
        variances = np.cumsum(np.concatenate([[self.variance], off * off]))[1:]
        at = np.arange(CHECK_EVERY - self.count % CHECK_EVERY, n + 1, CHECK_EVERY)  # samples taken at each test
        at = np.append(at[widths[at - 1] > MIN_WIDTH], n)  # and in the end
        # A level's sums come in a fixed order: what it holds, then those of the level below, two by two. Of each level: its sums, how
        # many it has been given and how many it has passed on.
        levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        given, new = at, values
        while len(levels) < len(self.levels) or len(new):
            held = self.levels[len(levels)] if len(levels) < len(self.levels) else []
            sums = np.concatenate((held, new)) if held else new
            given = given + len(held)
            passed = (np.maximum(given, SLOTS) - (SLOTS - 1)) >> 1
            levels.append((sums, given, passed << 1))
            given, new = passed, _pairs(sums[:2 * passed[-1]])
        taken, cut = n, False
        if len(at) > 1:
            flat = np.concatenate([stream for stream, _, _ in levels] + [np.zeros(SLOTS)])
            starts = np.cumsum([0] + [len(stream) for stream, _, _ in levels[:-1]])
            given, gone = (np.array([level[i][:-1] for level in levels]).T for i in (1, 2))  # a row per test
            place = gone[:, :, None] + np.arange(SLOTS)
            there = place < given[:, :, None]
            sums = np.where(there, flat[np.minimum(place + starts[:, None], len(flat) - 1)], 0.0)
            sizes = there * (2.0 ** np.arange(len(levels)))[:, None]
            tests = at[:-1] - 1
            differ = _differ(sums.reshape(len(tests), -1), sizes.reshape(len(tests), -1), widths[tests], totals[tests], variances[tests], self.delta)
            if differ.any():
                taken, cut = int(at[np.argmax(differ)]), True
        point = int(np.searchsorted(at, taken))
        self.levels = [stream[gone[point]:given[point]].tolist() for stream, given, gone in levels]
        self.count += taken
        self.width += taken
        self.total, self.variance = float(totals[taken - 1]), float(variances[taken - 1])
        if cut:
            while self._sides_differ():
                self._drop_oldest()
        return taken, cut

    def _sides_differ(self) -> bool:
        sums = [s for level in self.levels for s in level]
        if not sums:
            return False
        sizes = [1 << depth for depth, level in enumerate(self.levels) for _ in level]
        near = np.cumsum(np.array(sizes, dtype=np.float64))
        far = self.width - near
        usable = (near > MIN_SIDE) & (far > MIN_SIDE)
        if not usable.any():
            return False
        near_sum = np.cumsum(np.array(sums))[usable]
        far_sum = np.subtract.accumulate(np.array([self.total, *sums]))[1:][usable]
        near, far = near[usable], far[usable]
        spread = 1.0 / near + 1.0 / far
        odds = math.log(2 / self.delta)
        bound = np.sqrt(2 * spread * (self.variance / self.width) * odds) + (2.0 / 3.0) * spread * odds
        return bool((np.abs(near_sum / near - far_sum / far) > bound).any())

    def _drop_oldest(self) -> None:
        for depth in range(len(self.levels) - 1, -1, -1):
            if self.levels[depth]:
                self.width -= 1 << depth
                self.total -= self.levels[depth].pop(0)
                return


def _pairs(sums: np.ndarray) -> np.ndarray:
    return sums[0::2] + sums[1::2]


def _differ(sums: np.ndarray, sizes: np.ndarray, width: np.ndarray, total: np.ndarray, variance: np.ndarray, delta: float) -> np.ndarray:
    """``Adwin._sides_differ`` for a row of sums per test; a sum of size 0 repeats the split before it."""
    near = np.cumsum(sizes, axis=1)
    far = width[:, None] - near
    usable = (near > MIN_SIDE) & (far > MIN_SIDE)
    near_sum = np.cumsum(sums, axis=1)
    far_sum = np.subtract.accumulate(np.concatenate([total[:, None], sums], axis=1), axis=1)[:, 1:]
    near, far = np.where(usable, near, 1.0), np.where(usable, far, 1.0)
    spread = 1.0 / near + 1.0 / far
    odds = math.log(2 / delta)
    bound = np.sqrt(2 * spread * (variance / width)[:, None] * odds) + (2.0 / 3.0) * spread * odds
    return (usable & (np.abs(near_sum / near - far_sum / far) > bound)).any(axis=1)


class SlackController:
    """State of one strategy in one scope: newest event time, slack, detector and last watermark."""

    def __init__(self, strategy: Strategy):
        self.s = strategy
        self.newest: int | None = None
        self.wm: int | None = None
        self.slack = strategy.slack_ms
        self.warm = 0
        self.warm_sum = 0
        self.late = 0
        self.seen = 0
        self.detector = Adwin(1.0)
        self.drift = False

    @property
    def lost(self) -> bool:
        """Whether a missing time has left NaN in the state, which arrays of integers cannot hold."""
        return any(x != x for x in (self.newest, self.wm, self.warm_sum, self.slack))

    def observe(self, event_time: int, arrival_time: int) -> None:
        s = self.s
        if s.sample == "network":
            lateness = arrival_time - event_time
        else:
            lateness = 0 if self.newest is None else self.newest - event_time
        if lateness < 0:
            lateness = 0
        if self.newest is None or event_time > self.newest:
            self.newest = event_time
        self.drift = False
        if self.warm < WARMUP_EVENTS:
            self.warm += 1
            self.warm_sum += lateness
            if self.warm == WARMUP_EVENTS:
                mean = self.warm_sum // WARMUP_EVENTS
                self.slack = min(s.warmup_cap_ms, max(s.floor_ms, mean + s.warmup_buffer_ms))
            return
        self.seen += 1
        scaled = lateness / self.slack if self.slack > 0 else 0.0
        if self.detector.add(scaled if scaled < INPUT_CAP else INPUT_CAP):
            self.drift = True
            self._adapt()
        elif self.wm is not None and event_time < self.wm:
            self.late += 1

    def _adapt(self) -> None:
        s, detector = self.s, self.detector
        late_rate = self.late / self.seen
        if self.late == 0:
            detector.delta = min(1.0, detector.delta + s.delta_step)
        if late_rate < s.late_limit:
            self.late = self.seen = 0
            return
        self.slack = min(s.cap_ms, max(s.floor_ms, int(detector.estimate * self.slack) + s.buffer_ms))
        detector.delta = max(MIN_DELTA, detector.delta - s.delta_step)

    def observe_many(self, event_time: np.ndarray, arrival_time: np.ndarray, closing: np.ndarray) -> tuple[list, list]:
        """As ``observe`` for each event, after an ``emit`` before each event of ``closing``: the watermarks before and after those."""
        s, n = self.s, len(event_time)
        newest = np.maximum.accumulate(event_time)
        if self.newest is not None:
            newest = np.maximum(newest, int(self.newest))
        earlier = np.concatenate([[newest[0] if self.newest is None else int(self.newest)], newest[:-1]])
        # The first event has nothing to be behind.
        lateness = arrival_time - event_time if s.sample == "network" else earlier - event_time
        lateness = np.maximum(lateness, 0)
        before: list = []
        after: list = []
        at, step = 0, SHORTEST_RUN
        while at < n:
            if self.warm < WARMUP_EVENTS:
                end = min(n, at + WARMUP_EVENTS - self.warm)
                closed = int(np.searchsorted(closing, end) - np.searchsorted(closing, at))
                before += [self.wm] * closed
                after += [self.wm] * closed
                self.warm += end - at
                self.warm_sum += int(lateness[at:end].sum())
                if self.warm == WARMUP_EVENTS:
                    mean = self.warm_sum // WARMUP_EVENTS
                    self.slack = min(s.warmup_cap_ms, max(s.floor_ms, mean + s.warmup_buffer_ms))
                at = end
                continue
            end = min(n, at + step)
            scaled = np.minimum(lateness[at:end] / self.slack, INPUT_CAP) if self.slack > 0 else np.zeros(end - at)
            taken, cut = self.detector.run(scaled)
            end = at + taken
            closes = closing[np.searchsorted(closing, at):np.searchsorted(closing, end)]
            marks = earlier[closes] - self.slack  # they only rise, as the newest event time does
            if self.wm is not None:
                marks = np.maximum(marks, int(self.wm))
            if len(closes):
                before.append(self.wm)
                before += marks[:-1].tolist()
                after += marks.tolist()
            # The watermark an event meets, and whether it is behind; the event of a cut is not counted.
            counted = np.arange(at, end - cut)
            met = np.searchsorted(closes, counted, side="right")
            known = met > 0
            start = np.iinfo(np.int64).min if self.wm is None else int(self.wm)
            wm = np.where(known, marks[np.maximum(met, 1) - 1], start) if len(closes) else start
            self.late += int((event_time[counted] < wm).sum())
            self.seen += taken
            if len(closes):
                self.wm = int(marks[-1])
            if cut:
                self._adapt()
            step = SHORTEST_RUN if cut else min(2 * step, LONGEST_RUN)
            at = end
        self.newest = int(newest[-1])
        return before, after

    def emit(self) -> None:
        """Periodic emission: nothing during warm-up, and never backwards."""
        if self.warm < WARMUP_EVENTS:
            return
        proposed = self.newest - self.slack
        if self.wm is None or proposed > self.wm:
            self.wm = proposed


def _ordered(events: DataFrame, *columns: str):
    """Group by scope with the rows of each scope in arrival order.

    The number of partitions is explicit: the fold is bound by computation, and partitions merged by
    size would leave cores idle.
    """
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (events.select("scope", "arrival_time", "event_id", *columns)
            .repartition(tasks, "scope").sortWithinPartitions("scope", "arrival_time", "event_id")
            .groupBy("scope"))


def _packed(events: DataFrame) -> DataFrame:
    """Blocks of up to ``BLOCK_EVENTS`` consecutive events of a scope: ``scope``, where the block lies in the order, whether a time is
    missing in it (``holes``) and the bytes of its times (integers, or doubles with NaN where times are missing).

    Sorting and packing is spread over ranges of the order, of which a range holds several scopes or a part of one.
    """
    order, times = ["scope", "arrival_time", "event_id"], ["event_time", "arrival_time"]
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = events.select(*order, "event_time").repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = "scope string, arrival_time long, event_id long, part int, block int, holes boolean, event_times binary, arrivals binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            code = batch.column("scope").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else []
            for i, j in zip(starts, [*starts[1:], len(code)]):
                for k in range(i, j, BLOCK_EVENTS):
                    some = batch.slice(k, min(BLOCK_EVENTS, j - k))
                    values = [some.column(c) for c in times]
                    holes = any(v.null_count for v in values)
                    packed = [v.to_numpy(zero_copy_only=False).astype(np.float64 if holes else np.int64).tobytes() for v in values]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(c).slice(0, 1) for c in order]
                        + [pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int32()), (holes, pa.bool_()))]
                        + [pa.array([x], pa.binary()) for x in packed], names)
                    number += 1

    return ranged.mapInArrow(pack, schema)


def adwin_watermarks(events: DataFrame, strategies: list[Strategy], tick_ms: int = TICK_MS) -> DataFrame:
    """Watermarks of ADWIN policies around each tick of a scope, wide: ``before_i`` and ``wm_i``."""
    names = [f"before_{i}" for i in range(len(strategies))] + slots(strategies)

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        controllers = [SlackController(s) for s in strategies]
        open_tick = None
        rows: list[tuple] = []

        def close(tick: int) -> None:
            before = [c.wm for c in controllers]
            for c in controllers:
                c.emit()
            rows.append((key[0], tick, *before, *(c.wm for c in controllers)))

        def one_by_one(event_times: np.ndarray, arrivals: np.ndarray) -> None:
            nonlocal open_tick
            for event_time, arrival in zip(event_times.tolist(), arrivals.tolist()):
                tick = arrival // tick_ms
                if tick != open_tick:
                    if open_tick is not None:
                        close(open_tick)
                    open_tick = tick
                for c in controllers:
                    c.observe(event_time, arrival)

        def together(event_times: np.ndarray, arrivals: np.ndarray) -> None:
            nonlocal open_tick
            ticks = arrivals // tick_ms
            previous = np.concatenate([[ticks[0] if open_tick is None else int(open_tick)], ticks[:-1]])
            closing = np.flatnonzero(ticks != previous)
            marks = [c.observe_many(event_times, arrivals, closing) for c in controllers]
            rows.extend(zip([key[0]] * len(closing), previous[closing].tolist(), *[m[0] for m in marks], *[m[1] for m in marks]))
            open_tick = int(ticks[-1])

        for batch in batches:
            # Runs of blocks without missing times, some at a time.
            turn = (batch["holes"].ne(batch["holes"].shift()).cumsum() * len(batch) + np.arange(len(batch)) // BLOCKS_AT_ONCE)
            for _, some in batch.groupby(turn, sort=False):
                holes = bool(some["holes"].iloc[0])
                event_times, arrivals = (np.frombuffer(b"".join(some[c]), np.float64 if holes else np.int64) for c in ("event_times", "arrivals"))
                missing = holes or open_tick != open_tick or any(c.lost for c in controllers)
                (one_by_one if missing else together)(event_times, arrivals)
            if rows:
                yield _frame(rows, ["scope", "tick", *names])
                rows.clear()
        if open_tick is not None:
            close(open_tick)
            yield _frame(rows, ["scope", "tick", *names])

    schema = "scope string, tick long, " + ", ".join(f"{n} long" for n in names)
    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (_packed(events).repartition(tasks, "scope").sortWithinPartitions("scope", "arrival_time", "event_id", "part", "block")
            .groupBy("scope").applyInPandas(fold, schema))


def adwin_timeline(events: DataFrame, strategies: list[Strategy], tick_ms: int = TICK_MS) -> DataFrame:
    """Timelines of ADWIN policies, one row per strategy, scope and tick with events."""
    wide = adwin_watermarks(events, strategies, tick_ms)
    return lengthened(wide, strategies, [F.col(f"before_{i}") for i in range(len(strategies))],
                      [F.col(n) for n in slots(strategies)])


def adwin_trace(events: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """Per event: slack, delta, drift flag, late counter and the watermark when one is emitted on every event."""
    names = [c.split()[0] for c in TRACE_DDL.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        controllers = [SlackController(s) for s in strategies]
        for batch in batches:
            rows = []
            for event_id, event_time, arrival in zip(batch["event_id"].tolist(), batch["event_time"].tolist(),
                                                     batch["arrival_time"].tolist()):
                for c in controllers:
                    before = c.wm
                    c.observe(event_time, arrival)
                    c.emit()
                    rows.append((c.s.name, key[0], event_id, event_time, arrival, c.slack, c.detector.delta,
                                 c.drift, c.late, before, c.wm))
            yield _frame(rows, names)

    return _ordered(events, "event_time").applyInPandas(fold, TRACE_DDL)


def detect_drift(df: DataFrame, scope: str, order: list[str], value: str, delta: float = 1.0) -> DataFrame:
    """Run the change detector over a numeric column, in order within each scope.

    Adds ``drift`` (the window was cut at this row), ``estimate`` (mean of the window after the row)
    and ``width`` (samples in the window).
    """
    kept = df.select(scope, *[c for c in order if c != scope], value)
    schema = StructType([*kept.schema.fields, StructField("drift", BooleanType()),
                         StructField("estimate", DoubleType()), StructField("width", LongType())])

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = Adwin(delta)
        for batch in batches:
            seen = [(detector.add(v), detector.estimate, detector.width) for v in batch[value].tolist()]
            drift, estimate, width = zip(*seen) if seen else ((), (), ())
            yield batch.assign(drift=list(drift), estimate=list(estimate), width=list(width))

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (kept.repartition(tasks, scope).sortWithinPartitions(scope, *order)
            .groupBy(scope).applyInPandas(fold, schema))


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame.from_records(rows, columns=names)
    for name in names:
        if name.startswith(("wm", "before")):
            frame[name] = frame[name].astype("Int64")
    return frame

