"""Fixed-slack and speculative windows on the built-in streaming aggregate.

Spark keeps one watermark per query and judges lateness per window. Its late filter uses the
watermark of the previous micro-batch, so an event may still be counted one batch after its window
closes by the formula; exact per-tick behaviour is what the backtests and ``adaptive.TickStream`` give.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ebbmark.functions.scalars import safe_divide
from ebbmark.operators.speculative import FINAL_AFTER_MS
from ebbmark.params import Strategy
from ebbmark.session import shared_folder


RECEIVED = "received"


def windowed(events: DataFrame, window_ms: int, delay_ms: int) -> DataFrame:
    """Tumbling windows per key with partial aggregation; state is a few numbers per window."""
    received = F.count(F.lit(1)).alias("events")
    rows = events.observe(RECEIVED, received).withColumn("_at", F.timestamp_millis("event_time")).withWatermark("_at", f"{delay_ms} milliseconds")
    total = F.count(F.lit(1))
    return (rows.groupBy("key", F.window("_at", f"{window_ms} milliseconds").alias("_w"))
            .agg(total.alias("event_count"),
                 safe_divide(F.sum(F.coalesce("reading_1", F.lit(0.0))), total).alias("avg_1"),
                 safe_divide(F.sum(F.coalesce("reading_2", F.lit(0.0))), total).alias("avg_2"),
                 F.max("arrival_time").alias("last_arrival"))
            .select("key", F.unix_millis("_w.end").alias("window_end"), "event_count", "avg_1", "avg_2", "last_arrival"))


def stream_windows(events: DataFrame, strategy: Strategy) -> tuple[DataFrame, str]:
    """The streaming frame of a fixed or speculative strategy and the output mode it needs.

    Fixed: each window once, when the watermark passes it (append). Speculative: every window that
    changed, once per micro-batch (update), kept for the allowed lateness.
    """
    if strategy.kind == "fixed":
        return windowed(events, strategy.window_ms, strategy.slack_ms), "append"
    if strategy.kind == "speculative":
        return windowed(events, strategy.window_ms, strategy.lateness_ms), "update"
    raise ValueError("adaptive strategies stream through adaptive.TickStream")


def with_latencies(batch: DataFrame, strategy: Strategy) -> DataFrame:
    """Result columns of one micro-batch, measured on its wall clock."""
    now = F.unix_millis(F.current_timestamp())
    final = now - F.col("window_end") > FINAL_AFTER_MS if strategy.kind == "speculative" else F.lit(True)
    return batch.select(
        F.lit(strategy.name).alias("strategy"), "key", "window_end", "event_count", "avg_1", "avg_2",
        now.alias("fire_time"), (now - F.col("window_end")).alias("decisional_latency_ms"),
        (now - F.greatest(F.col("last_arrival"), F.lit(0).cast("long"))).alias("true_latency_ms"),
        F.lit(0).cast("long").alias("window_delay_ms"), F.lit(1).cast("long").alias("update_count"),
        final.alias("is_final"))


class ProgressLog(StreamingQueryListener):
    """A table under ``path`` of the micro-batches of the query ``name``: the watermark that each was judged with, and the events it read.

    For ``spark.streams.addListener``. Rows are written by ``rows_per_flush`` and when the query ends, which ``wait`` waits for. Events are those
    that the batch's own run read, so the writer must take its frame once.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, rows_per_flush: int = 100):
        self.spark, self.path, self.name, self.rows_per_flush = spark, path, name, rows_per_flush
        self.rows: list[tuple] = []
        self.run = None
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.run = event.runId
            self.ended.clear()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if progress.name != self.name:
            return
        seen = progress.observedMetrics.get(RECEIVED)
        self.rows.append((progress.batchId, progress.timestamp, progress.eventTime.get("watermark"), seen.events if seen else 0))
        if len(self.rows) >= self.rows_per_flush:
            self._flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.runId == self.run:
            self._flush()
            self.ended.set()

    def _flush(self) -> None:
        if self.rows:
            frame = self.spark.createDataFrame(self.rows, "batch long, at string, watermark string, events long")
            frame.select("batch", "at", F.unix_millis(F.to_timestamp("watermark")).alias("watermark"), "events") \
                .coalesce(1).write.mode("append").parquet(self.path)
            self.rows = []

    def wait(self, seconds: float = 60) -> None:
        if not self.ended.wait(seconds):
            raise TimeoutError(f"no end of {self.name} was reported")

    def batches(self) -> DataFrame:
        """``batch, watermark, events``: a batch that ran again after a failure counts as it ran last. An idle batch may report more than once."""
        return self.spark.read.parquet(self.path).groupBy("batch").agg(
            F.max_by("watermark", "at").alias("watermark"), F.max("events").alias("events"))


def with_delays(results: DataFrame, batches: DataFrame) -> DataFrame:
    """Results of ``into_folder`` with the true window delay: how far the watermark that let them out lay behind their end."""
    delay = F.greatest(F.col("watermark") - F.col("window_end"), F.lit(0).cast("long"))
    return results.join(batches.select("batch", "watermark"), "batch", "left").withColumn(
        "window_delay_ms", F.coalesce(delay, F.lit(0).cast("long"))).drop("watermark")


def losses(results: DataFrame, batches: DataFrame, checkpoint: str) -> DataFrame:
    """One row ``received, emitted, open, dropped`` of a stopped stream in append mode: dropped events are those that were read and are
    neither in an emitted window nor in one that the state still holds."""
    spark = results.sparkSession
    held = spark.read.format("statestore").load(checkpoint)
    parts = {"received": batches.select("events"), "emitted": results.select("event_count"), "open": held.select("value.count")}
    counted = None
    for name, frame in parts.items():
        one = frame.toDF("n").groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("part", F.lit(name))
        counted = one if counted is None else counted.unionByName(one)
    return (counted.groupBy().agg(*[F.sum(F.when(F.col("part") == name, F.col("n"))).alias(name) for name in parts])
            .withColumn("dropped", F.col("received") - F.col("emitted") - F.col("open")))


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None,
          every: str | None = None, name: str | None = None) -> StreamingQuery:
    """Run a stream into a ``foreachBatch`` writer; without ``every`` it drains what is there and stops.

    The interval plays the part of a sink's flush interval: one write per micro-batch.
    """
    folder = checkpoint or shared_folder(stream.sparkSession, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", folder).foreachBatch(write)
    if name:
        writer = writer.queryName(name)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def into_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Writer with one folder per batch, so a retried batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return write

