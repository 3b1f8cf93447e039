"""The strategies as Structured Streaming queries over the events table, drained to a stored result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ebbmark import params
from ebbmark.functions.delays import draw
from ebbmark.plans import backtest, metrics
from ebbmark.session import shared_folder, stored
from ebbmark.sources import sinks, streams, tables
from ebbmark.streaming import adaptive, native
from oracles import adwin as adwin_sql, base
from registry.core import query
from registry.watermarks import DEFAULT, SPLITS


def _drained(stream: DataFrame, mode: str) -> DataFrame:
    spark = stream.sparkSession
    path = shared_folder(spark, "stream-out")
    native.start(stream, native.into_folder(path), mode).awaitTermination()
    return spark.read.parquet(path).select(*stream.columns)


# Native streams get the table in deliveries of five days each; one event in ten comes a delivery late. The
# stream is stopped after each delivery and resumed from its checkpoint.
DELIVERY_MS, DELIVERIES, LATE_ONE_IN, LATE_SALT = 5 * 86_400_000, 6, 10, 91


def _deliveries(events: DataFrame) -> DataFrame:
    slot = F.expr(f"(unix_millis(CAST(ts AS TIMESTAMP)) - {tables.REPLAY_START_MS}L) div {DELIVERY_MS}L")
    late = (draw(F.col("event_id"), LATE_SALT, LATE_ONE_IN) == 0).cast("long")
    return events.withColumn("_delivery", F.least(slot, F.lit(DELIVERIES - 1).cast("long")) + late)


def _deliver(spark: SparkSession, folder: str, to_readings, strategy: params.Strategy, write, checkpoint: str | None = None,
             log: native.ProgressLog | None = None) -> DataFrame:
    """Run the stream delivery by delivery into ``write``; the streaming frame is returned for its columns."""
    events = tables.events_table(spark, folder)
    inbox = shared_folder(spark, "stream-inbox")
    checkpoint = checkpoint or shared_folder(spark, "stream-checkpoint")
    marked = _deliveries(events)
    for number in range(DELIVERIES + 1):
        marked.where(F.col("_delivery") == number).drop("_delivery").write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1_000_000).parquet(inbox)
        frame, mode = native.stream_windows(to_readings(stream), strategy)
        native.start(frame, write, mode, checkpoint, name=log.name if log else None).awaitTermination()
        if log:
            log.wait()
    return frame


def _delivered(spark: SparkSession, folder: str, to_readings, strategy: params.Strategy) -> DataFrame:
    """Last version of every window the stream emitted."""
    out = shared_folder(spark, "stream-out")
    frame = _deliver(spark, folder, to_readings, strategy, native.into_folder(out))
    versions = spark.read.parquet(out)
    rest = [c for c in frame.columns if c not in ("key", "window_end")]
    return versions.groupBy("key", "window_end").agg(
        F.max_by(F.struct(*rest), F.struct("batch", "event_count")).alias("_n")).select("key", "window_end", "_n.*")


_DELIVERED = f"""
arrived AS (SELECT ev.*, least({DELIVERIES - 1}, (epoch_ms(ts) - {base.START}) // {DELIVERY_MS})
    + CASE WHEN {base.draw('event_id', LATE_SALT, LATE_ONE_IN)} = 0 THEN 1 ELSE 0 END AS delivery
    FROM ev JOIN (SELECT event_id, ts FROM events) USING (event_id)),
marks AS (SELECT n AS delivery, (SELECT max(event_time) FROM arrived WHERE delivery < n) AS newest FROM range(0, {DELIVERIES + 1}) t(n))"""

_PLAIN = """SELECT key, (event_time // {w} + 1) * {w} AS window_end, count(*) AS event_count, sum(reading_1) / count(*) AS avg_1,
    sum(reading_2) / count(*) AS avg_2, max(arrival_time) AS last_arrival
    FROM arrived JOIN marks USING (delivery)
    WHERE newest IS NULL OR (event_time // {w} + 1) * {w} > newest - {delay} GROUP BY 1, 2 {having}"""


def _native(name: str, strategy: params.Strategy, to_readings, events: str) -> None:
    having = ("" if strategy.kind == "speculative" else
              f"HAVING (event_time // {strategy.window_ms} + 1) * {strategy.window_ms} <= (SELECT max(event_time) FROM ev) - {strategy.slack_ms}")

    delay = strategy.lateness_ms if strategy.kind == "speculative" else strategy.slack_ms

    @query(name, base.statement([events, _DELIVERED], _PLAIN.format(w=strategy.window_ms, delay=delay, having=having)))
    def build(spark, folder):
        return _delivered(spark, folder, to_readings, strategy)


_native("stream_house_naive", params.house_naive(), tables.sensor_readings, base.house_events())
_native("stream_house_fixed_slack", params.house_fixed(5), tables.sensor_readings, base.house_events())
_native("stream_house_speculative", params.house_speculative(), tables.sensor_readings, base.house_events())
_native("stream_taxi_fixed_slack", params.taxi_fixed(3), tables.taxi_trips, base.taxi_events())


_MEASURED = f"""
judged AS (SELECT key, (event_time // 60000 + 1) * 60000 AS window_end, newest IS NULL OR (event_time // 60000 + 1) * 60000 > newest - {{slack}} AS accepted
    FROM arrived JOIN marks USING (delivery)),
ended AS (SELECT n, (SELECT max(event_time) FROM arrived WHERE delivery <= n) - {{slack}} AS wm FROM range(0, {DELIVERIES + 1}) t(n)),
counted AS (SELECT key, window_end, count(*) AS event_count, (SELECT min(wm) FROM ended WHERE wm >= window_end) AS wm FROM judged WHERE accepted GROUP BY 1, 2)"""


def _measured(name: str, strategy: params.Strategy) -> None:
    def run(spark, folder):
        out, checkpoint, path = (shared_folder(spark, f"stream-{n}") for n in ("out", "checkpoint", "progress"))
        log = native.ProgressLog(spark, path, f"{name}-{path.rsplit('/', 1)[-1]}")
        spark.streams.addListener(log)
        try:
            _deliver(spark, folder, tables.taxi_trips, strategy, native.into_folder(out), checkpoint, log)
        finally:
            spark.streams.removeListener(log)
        return spark.read.parquet(out), stored(log.batches(), "stream-batches"), checkpoint

    ctes = [base.taxi_events(), _DELIVERED, _MEASURED.format(slack=strategy.slack_ms)]

    @query(f"{name}_delays", base.statement(ctes, "SELECT key, window_end, event_count, wm - window_end AS window_delay_ms FROM counted WHERE wm IS NOT NULL"))
    def delays(spark, folder):
        """The true window delay of each result, from the watermark of the micro-batch that let it out."""
        results, batches, _ = run(spark, folder)
        return native.with_delays(results, batches).select("key", "window_end", "event_count", "window_delay_ms")

    @query(f"{name}_losses", base.statement(ctes, """SELECT (SELECT count(*) FROM judged) AS received,
        CAST(coalesce((SELECT sum(event_count) FROM counted WHERE wm IS NOT NULL), 0) AS BIGINT) AS emitted,
        CAST(coalesce((SELECT sum(event_count) FROM counted WHERE wm IS NULL), 0) AS BIGINT) AS open,
        (SELECT count(*) FROM judged WHERE NOT accepted) AS dropped"""))
    def losses(spark, folder):
        """What became of every event that the stream read."""
        return native.losses(*run(spark, folder))


_measured("stream_taxi_naive", params.taxi_naive())
_measured("stream_taxi_slack", params.taxi_fixed(3))


LOG_SET = [params.taxi_naive(), params.taxi_fixed(3)]
ROWS_PER_FLUSH = 1_000
_LOGGED = " UNION ALL ".join(f"""SELECT '{s.name}' AS strategy, key, window_end, event_count, avg_1, avg_2 FROM ({_PLAIN.format(
    w=s.window_ms, delay=s.slack_ms, having=f"HAVING (event_time // {s.window_ms} + 1) * {s.window_ms} <= (SELECT max(event_time) FROM ev) - {s.slack_ms}")})"""
    for s in LOG_SET)


@query("taxi_append_log", base.statement([base.taxi_events(), _DELIVERED], _LOGGED))
def taxi_append_log(spark, folder):
    """Two streams write one log, each stopped and resumed after every delivery; the last batch of each is written once more, as after a failure."""
    path = shared_folder(spark, "append-log")
    for strategy in LOG_SET:
        append, last = sinks.append_taxi_metrics(path, strategy.name, rows_per_flush=ROWS_PER_FLUSH), []

        def write(batch, number):
            results = stored(native.with_latencies(batch, strategy), "batch-results")
            append(results, number)
            last[:] = [results, number]
        _deliver(spark, folder, tables.taxi_trips, strategy, write)
        append(*last)
    return spark.read.parquet(path).where("time IS NOT NULL").select("strategy", "key", "window_end", "event_count", "avg_1", "avg_2")


@query("stream_json_folder", base.statement([base.house_events()], """SELECT key, (event_time // 10000 + 1) * 10000 AS window_end,
    count(*) AS event_count, sum(reading_1) / count(*) AS avg_1, sum(reading_2) / count(*) AS avg_2, max(arrival_time) AS last_arrival
    FROM ev GROUP BY 1, 2 HAVING (event_time // 10000 + 1) * 10000 <= (SELECT max(event_time) FROM ev)"""))
def stream_json_folder(spark, folder):
    """Readings written as JSON records to a folder, then read from there by the streaming source."""
    inbox = shared_folder(spark, "json-inbox")
    sinks.keyed_records(tables.sensor_readings(tables.events_table(spark, folder))).select("value").write.text(inbox)
    frame, mode = native.stream_windows(streams.as_readings(streams.json_folder_events(spark, inbox)), params.house_naive())
    return _drained(frame, mode)


_COLUMNS = "key, window_end, event_count, avg_1, avg_2, fire_time, decisional_latency_ms, true_latency_ms, window_delay_ms, update_count"
# Streams by ticks take the readings in arrival order, in deliveries of ten days; the query stops after each and a new one goes on from the
# checkpoint. A heartbeat behind the last event ends its tick; it is never counted itself.
ARRIVALS_MS, ARRIVALS, HEARTBEAT_MS = 10 * 86_400_000, 3, 60_000
EVENT = ["event_id", "key", "reading_1", "reading_2", "event_time", "arrival_time"]


def _arrival_slot():
    return F.least(F.expr(f"(arrival_time - {tables.REPLAY_START_MS}L) div {ARRIVALS_MS}L"), F.lit(ARRIVALS - 1).cast("long"))


def _by_ticks(spark: SparkSession, folder: str, strategy: params.Strategy, to_readings, write, **how) -> None:
    readings = stored(to_readings(tables.events_table(spark, folder)).select(*EVENT), "stream-readings")
    inbox, checkpoint, state = (shared_folder(spark, f"stream-{n}") for n in ("inbox", "checkpoint", "state"))
    heartbeat = readings.groupBy().agg(F.max("event_id") + 1, F.lit("heartbeat"), F.lit(0.0), F.lit(0.0), F.max("event_time"), F.max("arrival_time") + HEARTBEAT_MS).toDF(*EVENT)
    for number in range(ARRIVALS):
        part = readings.where(_arrival_slot() == number)
        (part.unionByName(heartbeat) if number == ARRIVALS - 1 else part).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(readings.schema).option("maxFilesPerTrigger", 1_000_000).parquet(inbox)
        ticks = adaptive.TickStream(spark, strategy, state, **how)
        native.start(stream, ticks.writer(write), "append", checkpoint).awaitTermination()


def _ticked(name: str, strategy: params.Strategy, to_readings, sql: str, columns: list[str], **how) -> None:
    @query(name, sql)
    def build(spark, folder):
        out = shared_folder(spark, "stream-out")
        _by_ticks(spark, folder, strategy, to_readings, native.into_folder(out), **how)
        return spark.read.parquet(out).where(F.col("kind") == "result").select(*columns)


def _stateful(name: str, strategy: params.Strategy, to_readings, ctes: list[str], source: str) -> None:
    _ticked(name, strategy, to_readings, base.statement(ctes, f"SELECT {_COLUMNS} FROM {source}"), _COLUMNS.split(", "), by="key")


_stateful("stream_house_mean_shift", params.house_mean_shift(1000), tables.sensor_readings,
          base.house_ctes([base.HOUSE_STRATEGIES[2]], scope="key"), "results")
_stateful("stream_taxi_mean_shift", params.taxi_mean_shift(3, 60), tables.taxi_trips,
          base.taxi_ctes([base.TAXI_STRATEGIES[2]], scope="key"), "results")
# Few houses, so that each outlasts its warm-up of 500 events.
_stateful("stream_house_adwin_settled", params.house_adwin(1.0, 0.1), lambda events: tables.sensor_readings(events, houses=10),
          base.house_ctes([base.adwin_settled("adaptive_real_adwin_L100_dd10", 1000, 1000, 8000)], scope="key", houses=10), "results")
_stateful("stream_taxi_speculative_updates", params.taxi_speculative(3), tables.taxi_trips,
          base.taxi_ctes([base.fixed("taxi_speculative_m3", 0)], scope="key"), "updates")


@query("stream_house_upsert", base.statement(
    base.house_ctes([base.fixed("speculative", 0)], scope="key") + [base.HOUSE_METRICS],
    "SELECT time_ms, house_id, pachete_count, avg_temp, update_count FROM metrics"))
def stream_house_upsert(spark, folder):
    """Speculative updates streamed into the upsert table; the view shows the last version of each window."""
    path = shared_folder(spark, "upsert-stream")
    upsert = sinks.upsert_house_metrics(path)
    _by_ticks(spark, folder, params.house_speculative(), tables.sensor_readings,
              lambda batch, number: upsert(metrics.to_house_metrics(batch.where("kind = 'result'").drop("kind")), number), by="key")
    return sinks.latest_house_metrics(spark, path).select(
        F.unix_millis("time").alias("time_ms"), "house_id", "pachete_count", "avg_temp", "update_count")


# One watermark for the stream: the least over source splits, each with its own controller, windows across splits.
_ticked("stream_house_adwin_splits", DEFAULT, tables.sensor_readings, base.statement(
    base.house_ctes([adwin_sql.combined(DEFAULT, 5)], adaptive=[DEFAULT], splits=SPLITS), f"SELECT {', '.join(backtest.RESULT)} FROM results"),
    backtest.RESULT, by="split", splits=SPLITS, idle_ms=1000)


# A log of two topics with two partitions each. The consumer is stopped and started anew after each delivery.
LOG_TOPICS, LOG_SALT = ("house-a", "house-b"), 72
_ID = StructType([StructField("event_id", LongType())])


@query("stream_partitioned_log", base.statement(
    base.house_ctes([adwin_sql.combined(DEFAULT, 5)], adaptive=[DEFAULT], splits=2 * len(LOG_TOPICS), salt=LOG_SALT), f"SELECT {', '.join(backtest.RESULT)} FROM results"))
def stream_partitioned_log(spark, folder):
    """ADWIN with one controller per partition of the log, which the records name, at a late limit of 0.1."""
    readings = stored(tables.sensor_readings(tables.events_table(spark, folder)), "log-readings")
    log, checkpoint, state, out = (shared_folder(spark, f"log-{n}") for n in ("records", "checkpoint", "state", "out"))
    place = draw(F.col("event_id"), LOG_SALT, 2 * len(LOG_TOPICS))
    topic = F.when(place < 2, LOG_TOPICS[0]).otherwise(LOG_TOPICS[1])
    newest = F.struct("arrival_time", "event_id")
    # A repeated last event, a minute on, ends the last tick.
    heartbeat = readings.groupBy().agg(F.max_by(F.struct(*readings.columns), newest).alias("_n")).select("_n.*") \
        .withColumn("arrival_time", F.col("arrival_time") + HEARTBEAT_MS)
    for number in range(ARRIVALS):
        part = readings.where(_arrival_slot() == number)
        part = part.unionByName(heartbeat) if number == ARRIVALS - 1 else part
        sinks.log_records(part, log, topic, place % 2, ["event_id"])
        events = streams.as_readings(streams.log_events(spark, log, list(LOG_TOPICS), "earliest", fields=_ID))
        ticks = adaptive.TickStream(spark, DEFAULT, state, by="split", idle_ms=1000)
        native.start(events, ticks.writer(native.into_folder(out)), "append", checkpoint).awaitTermination()
    return spark.read.parquet(out).where(F.col("kind") == "result").select(*backtest.RESULT)
