"""Windows under any policy over a stream, micro-batch by micro-batch, equal to the backtest tick for tick.

A native watermark has one fixed delay per query and drops late rows one by one, so adaptive slack cannot use it. Here a
stream's micro-batches pass through ``foreachBatch`` and the same frames as in a backtest: the policy's controller follows each scope (a source split, or a
key) in order, which is the only Python code; the least watermark over the splits that are not idle is carried from tick to tick; events are combined
per tick and window, judged, merged into the table of open windows, and windows that the watermark passed are emitted. A speculative policy
emits every update, numbered on from the window's earlier ones, with the latencies of its first.

What has to outlive a micro-batch is a set of small tables, one version per batch: controllers, watermarks that idleness may still need, the events of the tick
that has not ended, open windows. A batch reads the version before its own and writes its own, so a batch that is repeated after a failure gives the same
answer, and a restarted query goes on. Versions before the last may be deleted.

Order: the clock is the arrival time of events. Ticks before the newest arrival have ended when a micro-batch has been read; an event that turns up later
with an arrival time in an ended tick is taken as arriving in the first tick that has not ended.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbmark.operators.adwin import Adwin, SlackController
from ebbmark.operators.speculative import speculative_updates
from ebbmark.operators.timeline import held_ticks, least_over_scopes, monotone, with_scope, with_tick
from ebbmark.operators.windows import fired_windows, firings, judged, per_tick_windows
from ebbmark.params import SAMPLES, Strategy, TICK_MS

OUTPUT = ("kind string, strategy string, key string, window_end long, event_count long, avg_1 double, avg_2 double, "
          "fire_time long, decisional_latency_ms long, true_latency_ms long, window_delay_ms long, "
          "update_count long, is_final boolean")
_NAMES = [c.split()[0] for c in OUTPUT.split(", ")]
EVENTS = "event_id long, key string, reading_1 double, reading_2 double, event_time long, arrival_time long, source_split string"
_EVENT = [c.split()[0] for c in EVENTS.split(", ")]
#: The tables that outlive a micro-batch.
STATE = {
    "events": EVENTS,                                           # of the tick that has not ended
    "control": "scope string, state string",
    "held": "scope string, tick long, wm_0 long",               # watermarks of splits that may still hold the others back
    "clock": "done long, wm long",                              # the last ended tick and the combined watermark after it
    "open": "scope string, key string, window_end long, n long, sum_1 double, sum_2 double, last_arrival long, first_arrival long, last_wm_before long",
}


class SteadyController:
    """Constant slack."""

    def __init__(self, strategy: Strategy):
        self.behind = strategy.slack_ms + strategy.offset_ms
        self.newest: int | None = None
        self.wm: int | None = None

    def observe(self, event_time: int, arrival_time: int) -> None:
        if self.newest is None or event_time > self.newest:
            self.newest = event_time

    def slack_now(self) -> int:
        return self.behind

    def emit(self) -> None:
        proposed = self.newest - self.slack_now()
        if self.wm is None or proposed > self.wm:
            self.wm = proposed

    def save(self) -> dict:
        return {"newest": self.newest, "wm": self.wm}

    def load(self, state: dict) -> None:
        self.newest, self.wm = state["newest"], state["wm"]


class MeanShiftController(SteadyController):
    """Slack from the mean-shift test, with running half sums instead of a rescan per event."""

    def __init__(self, strategy: Strategy):
        super().__init__(strategy)
        self.s = strategy
        self.slack = strategy.slack_ms
        self.samples: deque[int] = deque()
        self.older = self.newer = 0

    def slack_now(self) -> int:
        return self.slack

    def observe(self, event_time: int, arrival_time: int) -> None:
        before = self.newest
        super().observe(event_time, arrival_time)
        if self.s.sample == "network":
            self._sample(arrival_time - event_time)
        elif before is not None:
            self._sample(max(0, before - event_time))

    def _sample(self, value: int) -> None:
        half = SAMPLES // 2
        self.samples.append(value)
        self.newer += value
        if len(self.samples) > half:
            crossing = self.samples[-half - 1]
            self.newer -= crossing
            self.older += crossing
        if len(self.samples) > SAMPLES:
            self.older -= self.samples.popleft()
        if len(self.samples) == SAMPLES and abs(self.older / half - self.newer / half) > self.s.threshold_ms:
            # Integer mean, rounded towards zero.
            self.slack = self.s.clamp(int((self.older + self.newer) / SAMPLES) + self.s.buffer_ms)

    def save(self) -> dict:
        return {**super().save(), "slack": self.slack, "samples": list(self.samples)}

    def load(self, state: dict) -> None:
        super().load(state)
        self.slack = state["slack"]
        self.samples = deque(state["samples"])
        values, half = state["samples"], SAMPLES // 2
        self.newer = sum(values[-half:])
        self.older = sum(values[:-half])


class AdwinController(SlackController):
    _PLAIN = ("newest", "wm", "slack", "warm", "warm_sum", "late", "seen")

    def save(self) -> dict:
        detector = {name: getattr(self.detector, name) for name in Adwin.__slots__}
        return {**{name: getattr(self, name) for name in self._PLAIN}, "detector": detector}

    def load(self, state: dict) -> None:
        for name in self._PLAIN:
            setattr(self, name, state[name])
        for name, value in state["detector"].items():
            setattr(self.detector, name, value)


def controller_of(strategy: Strategy):
    kinds = {"fixed": SteadyController, "speculative": SteadyController, "mean_shift": MeanShiftController,
             "adwin": AdwinController}
    return kinds[strategy.kind](strategy)


TICKS = "scope string, tick long, before long, wm_0 long, state string"


def controlled(events: DataFrame, control: DataFrame, strategy: Strategy) -> DataFrame:
    """Watermarks of a policy around each tick of a scope, going on from ``control``; one more row per scope (without tick) has the
    controller's state after its events."""
    saved = control.select("scope", F.lit(-1).cast("long").alias("tick"), F.lit(None).cast("long").alias("event_time"),
                           F.lit(None).cast("long").alias("arrival_time"), F.lit(-1).cast("long").alias("event_id"), "state")
    rows = events.select("scope", "tick", "event_time", "arrival_time", "event_id", F.lit(None).cast("string").alias("state")).unionByName(saved)

    def fold(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        control, tick, rows = controller_of(strategy), None, []

        def close() -> None:
            before = control.wm
            control.emit()
            rows.append((key[0], tick, before, control.wm, None))

        seen = False
        for batch in batches:
            for now, event_time, arrival, state in zip(batch["tick"].tolist(), batch["event_time"].tolist(), batch["arrival_time"].tolist(), batch["state"].tolist()):
                if now == -1:  # sorted first
                    control.load(json.loads(state))
                    continue
                if tick is not None and now != tick:
                    close()
                tick, seen = now, True
                control.observe(int(event_time), int(arrival))
            if rows:
                yield _tick_frame(rows)
                rows.clear()
        if seen:
            close()
        rows.append((key[0], None, None, None, json.dumps(control.save())))
        yield _tick_frame(rows)

    tasks = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "scope").sortWithinPartitions("scope", "tick", "arrival_time", "event_id") \
        .groupBy("scope").applyInPandas(fold, TICKS)


def _tick_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame.from_records(rows, columns=[c.split()[0] for c in TICKS.split(", ")])
    for name in ("tick", "before", "wm_0"):
        frame[name] = frame[name].astype("Int64")
    return frame


@dataclass(frozen=True)
class TickStream:
    """One policy over a stream of events, with its state under ``folder``.

    ``by`` is ``split`` (one watermark for the stream, the least over its source splits, where a split is idle after ``idle_ms`` without an event)
    or ``key`` (a watermark per key). Splits are those of the column ``source_split``; events without one are spread over ``splits`` by id.
    """

    spark: SparkSession
    strategy: Strategy
    folder: str
    by: str = "split"
    splits: int = 64
    idle_ms: int = 1000
    tick_ms: int = TICK_MS

    def writer(self, sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``: results (``kind = 'result'``) and dropped events per window (``'late'``) of each micro-batch go to ``sink``."""
        return lambda batch, number: sink(self.step(batch, number), number)

    def _read(self, spark: SparkSession, name: str, number: int) -> DataFrame:
        if number < 0:
            return spark.createDataFrame([], STATE[name])
        return spark.read.schema(STATE[name]).parquet(f"{self.folder}/{name}/batch={number}")

    def _write(self, frame: DataFrame, name: str, number: int, schema: str | None = None) -> DataFrame:
        path = f"{self.folder}/{name}/batch={number}"
        frame.write.mode("overwrite").parquet(path)
        return frame.sparkSession.read.schema(schema or STATE.get(name) or frame.schema).parquet(path)

    def step(self, batch: DataFrame, number: int) -> DataFrame:
        """The output rows of micro-batch ``number``."""
        spark, s = batch.sparkSession, self.strategy
        before = {name: self._read(spark, name, number - 1) for name in STATE}
        clock = before["clock"].first()
        done, last_wm = (clock.done, clock.wm) if clock else (None, None)
        if "source_split" not in batch.columns:
            batch = batch.withColumn("source_split", F.lit(None).cast("string"))
        rows = batch.select(*_EVENT)
        if done is not None:
            rows = rows.withColumn("arrival_time", F.greatest("arrival_time", F.lit((done + 1) * self.tick_ms)))
        rows = self._write(with_tick(rows.unionByName(before["events"]), self.tick_ms), "read", number)
        newest = rows.agg(F.max("tick")).first()[0]
        now = newest if newest is not None else (done + 1 if done is not None else 0)
        ended = with_scope(rows.where(F.col("tick") < now), self.by, self.splits)
        self._write(rows.where(F.col("tick") >= now).select(*_EVENT), "events", number)

        ticks = self._write(controlled(ended, before["control"], s), "ticks", number)
        self._write(ticks.where(F.col("tick").isNull()).select("scope", "state"), "control", number)
        steps = ticks.where(F.col("tick").isNotNull())
        if self.by == "key":
            self._write(before["held"], "held", number)
            timeline = steps.select(F.lit(s.name).alias("strategy"), "scope", "tick", F.col("before").alias("wm_before"), F.col("wm_0").alias("wm"))
        else:
            timeline = self._combined(steps, before["held"], done, last_wm, now, number)
        timeline = self._write(timeline, "timeline", number)
        end = last_wm if self.by == "key" else timeline.agg(F.max("wm")).first()[0]
        end = last_wm if end is None else end
        self._write(spark.createDataFrame([(now - 1, end)], STATE["clock"]), "clock", number)

        events = ended if self.by == "key" else ended.withColumn("scope", F.lit("all"))
        decided = judged(per_tick_windows(events, s.window_ms, self.tick_ms), timeline, [s])
        names = [c for c in before["open"].columns if c not in ("scope", "key", "window_end")]
        kept = decided.where("accepted").withColumn("last_wm_before", F.col("wm_before")).select("scope", "key", "window_end", *names)
        total = {"n": F.sum, "sum_1": F.sum, "sum_2": F.sum, "last_arrival": F.max, "first_arrival": F.min, "last_wm_before": F.max}
        merged = self._write(kept.unionByName(before["open"]).groupBy("scope", "key", "window_end").agg(*[f(n).alias(n) for n, f in total.items()]), "merged", number)
        late = decided.where("NOT accepted").groupBy("key", "window_end").agg(F.sum("n").alias("event_count"), F.max("last_arrival").alias("fire_time")) \
            .withColumn("kind", F.lit("late")).withColumn("strategy", F.lit(s.name))
        if s.kind == "speculative":
            reached = timeline.groupBy("scope").agg(F.max("wm").alias("_wm"))
            left = merged.join(reached, "scope", "left").where(F.col("_wm").isNull() | (F.col("window_end") - 1 + s.lateness_ms > F.col("_wm")))
            out = speculative_updates(events, timeline, s, self.tick_ms, carried=before["open"])
        else:
            windows = merged.select(F.lit(s.name).alias("strategy"), "scope", "key", "window_end", F.col("n").alias("event_count"),
                                    (F.col("sum_1") / F.col("n")).alias("avg_1"), (F.col("sum_2") / F.col("n")).alias("avg_2"), "last_arrival")
            fires = self._write(firings(windows, timeline, s.window_ms, self.tick_ms), "fires", number)
            left = merged.join(fires.select("scope", "window_end"), ["scope", "window_end"], "left_anti")
            out = fired_windows(windows.join(fires, ["strategy", "scope", "window_end"]))
        self._write(left.select(*before["open"].columns), "open", number)
        shown = out.withColumn("kind", F.lit("result")).unionByName(late, allowMissingColumns=True)
        return shown.select(*_NAMES)

    def _combined(self, steps: DataFrame, held: DataFrame, done: int | None, last_wm: int | None, now: int, number: int) -> DataFrame:
        """The stream's watermark around each ended tick: the least over splits, which goes on from the last batch."""
        known = self._write(steps.select("scope", "tick", "wm_0").unionByName(held), "known", number, STATE["held"])
        # A split is looked back for as long as it may hold the others back.
        self._write(known.where(F.col("tick") >= now - held_ticks(self.idle_ms, self.tick_ms)), "held", number)
        least = least_over_scopes(known, [self.strategy], self.idle_ms, self.tick_ms).where((F.col("tick") < now) & (F.col("tick") > (-1 if done is None else done)))
        if done is not None:
            least = least.unionByName(steps.sparkSession.createDataFrame([(done, last_wm)], "tick long, wm_0 long"))
        whole = monotone(least.withColumn("scope", F.lit("all")), [self.strategy])
        return whole if done is None else whole.where(F.col("tick") > done)
