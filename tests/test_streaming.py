"""Streams over pinned file batches."""


import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ebbmark import params
from ebbmark.operators.timeline import with_scope
from ebbmark.plans import backtest, metrics
from ebbmark.session import shared_folder
from ebbmark.sources import sinks, streams
from ebbmark.streaming import adaptive, native
from tests.test_models import arrivals, in_order

SCHEMA = "event_id long, key string, reading_1 double, reading_2 double, event_time long, arrival_time long"


def batches(spark, events, rows, sizes):
    """One parquet file per micro-batch, written in arrival order."""
    folder = shared_folder(spark, "batches")
    start = 0
    for size in sizes:
        events(rows[start:start + size]).coalesce(1).write.mode("append").parquet(folder)
        start += size
    return folder


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream, mode, checkpoint=None, path=None):
    path = path or shared_folder(stream.sparkSession, "out")
    native.start(stream, native.into_folder(path), mode, checkpoint).awaitTermination()
    return stream.sparkSession.read.parquet(path), path


def test_native_lateness_is_judged_per_window(spark, events):
    rows = [(1, "a", 21_000, 1), (2, "a", 20_500, 2), (3, "a", 3_000, 3), (4, "a", 45_000, 4)]
    stream, mode = native.stream_windows(source(spark, batches(spark, events, rows, [1, 1, 1, 1])), params.house_naive())
    out, _ = drain(stream, mode)
    assert {(r.window_end, r.event_count) for r in out.collect()} == {(30_000, 2)}


def test_native_delays_and_losses_are_measured_over_a_restart(spark, events):
    """The watermark of the batch that lets a window out, and what became of each event."""
    folder, cp, out, path = (shared_folder(spark, n) for n in ("in", "cp", "out", "progress"))
    log = native.ProgressLog(spark, path, f"measured-{cp[-32:]}", rows_per_flush=1)
    spark.streams.addListener(log)
    for rows in ([(1, "a", 21_000, 1), (2, "b", 23_000, 1)], [(3, "a", 3_000, 3), (4, "a", 4_000, 3), (5, "a", 45_000, 4)]):
        events(rows).coalesce(1).write.mode("append").parquet(folder)
        stream, mode = native.stream_windows(spark.readStream.schema(SCHEMA).parquet(folder), params.house_naive())
        native.start(stream, native.into_folder(out), mode, cp, name=log.name).awaitTermination()
        log.wait()
    spark.streams.removeListener(log)
    delays = native.with_delays(spark.read.parquet(out), log.batches())
    assert {(r.key, r.window_end, r.window_delay_ms) for r in delays.collect()} == {("a", 30_000, 15_000), ("b", 30_000, 15_000)}
    assert native.losses(spark.read.parquet(out), log.batches(), cp).first().asDict() == {"received": 5, "emitted": 2, "open": 1, "dropped": 2}


def test_speculative_stream_updates_each_batch(spark, events):
    rows = [(1, "a", 1_000, 1), (2, "a", 2_000, 2), (3, "a", 3_000, 3)]
    stream, mode = native.stream_windows(source(spark, batches(spark, events, rows, [1, 1, 1])), params.house_speculative())
    out, _ = drain(stream, mode)
    assert sorted(r.event_count for r in out.where("window_end = 10000").collect()) == [1, 2, 3]
    shown = native.with_latencies(out, params.house_speculative()).first()
    assert shown.strategy == "speculative" and shown.decisional_latency_ms > 0


def run_ticks(spark, strategy, folder, places, sink=None, **how):
    """Drain what is in the folder through a query that may be a restart."""
    state, checkpoint, path = places
    stream = adaptive.TickStream(spark, strategy, state, **how)
    write = stream.writer(sink or native.into_folder(path))
    native.start(source(spark, folder), write, "append", checkpoint).awaitTermination()


def places(spark):
    return [shared_folder(spark, n) for n in ("state", "cp", "out")]


def _expected(frame, strategy, rows, settings):
    last = max(r[3] for r in rows) // 200 * 200
    run = backtest.run(frame, [strategy], settings)
    windows = {(r.key, r.window_end): (r.event_count, r.avg_1, r.fire_time, r.window_delay_ms, r.true_latency_ms) for r in run.windows.collect() if r.fire_time <= last}
    return windows


def _got(out):
    results = out.where("kind = 'result'").collect()
    got = {(r.key, r.window_end): (r.event_count, r.avg_1, r.fire_time, r.window_delay_ms, r.true_latency_ms) for r in results}
    assert len(got) == len(results)
    return got


@pytest.mark.parametrize("by", ["key", "split"])
def test_adaptive_streams_equal_the_backtest_across_batches_and_restart(spark, events, by):
    rows = in_order(arrivals(21, 3_000, keys=2))
    scope = backtest.Settings(scope="key") if by == "key" else backtest.Settings(scope="split", splits=3)
    for strategy in (params.house_adwin(0.01, 0.1), params.house_mean_shift(500)):
        folder, at = batches(spark, events, rows[:2_000], [700, 1_300]), places(spark)
        run_ticks(spark, strategy, folder, at, by=by, splits=3)
        # More data arrives; a new query goes on from the checkpoint.
        events(rows[2_000:]).coalesce(1).write.mode("append").parquet(folder)
        run_ticks(spark, strategy, folder, at, by=by, splits=3)
        out = spark.read.parquet(at[2])
        assert _got(out) == _expected(events(rows), strategy, rows, scope) != {}
        late = out.where("kind = 'late'").agg(F.sum("event_count")).first()[0]
        last = max(r[3] for r in rows) // 200 * 200
        assert late == backtest.run(events([r for r in rows if r[3] < last]), [strategy], scope).late.agg(F.sum("dropped")).first()[0]


def test_a_repeated_batch_gives_the_same_answer(spark, events):
    rows = in_order(arrivals(22, 900, keys=2))
    seen = []

    def write(batch, number):
        seen.append((number, sorted(map(str, batch.collect()))))
    stream = adaptive.TickStream(spark, params.house_mean_shift(500), shared_folder(spark, "state"), splits=3)
    for number in (0, 1, 1):
        stream.writer(write)(events(rows[450 * number:450 * (number + 1)]), number)
    assert seen[1] == seen[2] and seen[1][1]


def test_a_silent_split_holds_the_others_back_until_it_is_idle(spark, events):
    split = {r.event_id: r.scope for r in with_scope(events([(i, "a", 0, 0) for i in range(400)]), "split", 2).collect()}
    busy = [i for i in range(400) if split[i] == split[0]][:150]
    quiet = next(i for i in range(400) if split[i] != split[0])
    rows = sorted([(quiet, "a", 1_000, 1_000)] + [(i, "a", 1_000 + 100 * k, 1_000 + 100 * k) for k, i in enumerate(busy)], key=lambda r: (r[3], r[0]))
    naive = params.Strategy("naive", "fixed", 1_000, offset_ms=1)
    for idle_ms in (1_000, 5_000):
        folder, at = batches(spark, events, rows, [30, 60, len(rows) - 90]), places(spark)
        run_ticks(spark, naive, folder, at, splits=2, idle_ms=idle_ms)
        first = spark.read.parquet(at[2]).where("kind = 'result'").agg(F.min("fire_time")).first()[0]
        # The window of the silent split's event fires in the first tick in which that split no longer counts.
        assert first == 1_000 + idle_ms + 200, (idle_ms, first)


def test_speculative_updates_are_numbered_over_batches(spark, events):
    rows = in_order(arrivals(5, 300, keys=2))
    folder, at = batches(spark, events, rows, [100, 100]), places(spark)
    run_ticks(spark, params.house_speculative(), folder, at, splits=1)
    events(rows[200:]).coalesce(1).write.mode("append").parquet(folder)
    run_ticks(spark, params.house_speculative(), folder, at, splits=1)
    by = {}
    for r in spark.read.parquet(at[2]).where("kind = 'result'").collect():
        by.setdefault((r.key, r.window_end), []).append(r)
    assert max(map(len, by.values())) > 5
    for found in by.values():
        assert sorted(r.update_count for r in found) == list(range(1, len(found) + 1))
        assert len({r.decisional_latency_ms for r in found}) == 1


def test_upsert_view_keeps_the_last_version(spark, events):
    rows = in_order(arrivals(5, 300, keys=2))
    rows.append((9_999, "zz", rows[-1][3], rows[-1][3] + 10_000))  # ends the tick of the others
    folder, at = batches(spark, events, rows, [100, 100, 101]), places(spark)
    path = shared_folder(spark, "upsert")
    write = sinks.upsert_house_metrics(path)
    run_ticks(spark, params.house_speculative(), folder, at, by="key", sink=lambda batch, number: write(metrics.to_house_metrics(batch.where("kind = 'result'").drop("kind")), number))
    view = sinks.latest_house_metrics(spark, path)
    finals = backtest.run(events(rows[:-1]), [params.house_speculative()], backtest.Settings(scope="key")).windows
    assert {(r.house_id, r.pachete_count) for r in view.collect()} == {(r.key, r.event_count) for r in finals.collect()}
    assert view.count() == view.select("house_id", "time").distinct().count()


def test_taxi_log_is_stamped_with_the_write_time(spark):
    path = shared_folder(spark, "log")
    frame = spark.createDataFrame([("z", "s", 1)], "zone_id string, strategy string, event_count long")
    sinks.append_taxi_metrics(path)(frame, 0)
    assert spark.read.parquet(path).where(F.col("time").isNotNull()).count() == 1


def test_the_log_is_flushed_by_rows_and_a_repeated_batch_replaces_itself(spark):
    path = shared_folder(spark, "log")
    frame = spark.range(10).selectExpr("CAST(id AS STRING) AS zone_id", "'s' AS strategy", "id AS event_count").coalesce(1)
    for writer, number in (("a", 0), ("b", 0), ("a", 1), ("a", 1)):
        sinks.append_taxi_metrics(path, writer, rows_per_flush=3)(frame, number)
    log = spark.read.parquet(path)
    assert log.groupBy("writer", "batch").count().collect() and log.count() == 30
    files = log.groupBy(F.input_file_name()).count().collect()
    assert len(files) == 12 and max(r["count"] for r in files) == 3


def test_json_folder_source_quarantines(spark, tmp_path):
    lines = ['{"house_id":"h","temperature":1.5,"event_time":1,"arrival_time":2,"other":9}', "{oops"]
    (tmp_path / "a.json").write_text("\n".join(lines))
    decoded = streams.json_folder_events(spark, str(tmp_path), strict=False)
    out = shared_folder(spark, "json")
    native.start(decoded, native.into_folder(out), "append").awaitTermination()
    good, bad = streams.quarantine(spark.read.parquet(out).drop("batch"))
    assert [(r.key, r.reading_1, r.reading_2) for r in streams.as_readings(good).collect()] == [("h", 1.5, None)]
    assert [r[0] for r in bad.collect()] == ["{oops"]


LOG_FIELDS = StructType([StructField("event_id", LongType())])


def to_log(events, rows, log, topic="t", parts=2):
    """Rows by parity of the event id into partitions of a topic."""
    frame = events(rows).withColumn("reading_3", F.lit(0.0))
    sinks.log_records(frame, log, F.lit(topic), F.col("event_id") % parts, ["event_id"])


def read_log(spark, log, at, **how):
    frame = streams.as_readings(streams.log_events(spark, log, fields=LOG_FIELDS, **how))
    native.start(frame, native.into_folder(at[1]), "append", at[0]).awaitTermination()
    return sorted((r.event_id, r.source_split) for r in spark.read.schema("event_id long, source_split string").parquet(at[1]).collect())


def test_a_partitioned_log_is_read_once_over_a_restart(spark, events):
    log, at = shared_folder(spark, "log"), [shared_folder(spark, n) for n in ("cp", "out")]
    rows = [(i, "a", i, i) for i in range(12)]
    how = {"topics": ["t", "u"], "starting": "earliest"}
    to_log(events, rows[:4], log)
    to_log(events, rows[4:6], log, "u")
    to_log(events, rows[6:8], log, "other")
    first = [(i, f"{'t' if i < 4 else 'u'}-{i % 2}") for i in range(6)]
    assert read_log(spark, log, at, **how) == first
    to_log(events, rows[8:], log, "u", parts=3)
    assert read_log(spark, log, at, **how) == first + [(i, f"u-{i % 3}") for i in range(8, 12)]


def test_a_consumer_that_starts_at_latest_skips_what_was_there_and_loses_nothing_later(spark, events):
    log, at = shared_folder(spark, "log"), [shared_folder(spark, n) for n in ("cp", "out")]
    rows = [(i, "a", i, i) for i in range(12)]
    how = {"topics": "t", "starting": "latest", "position": shared_folder(spark, "position")}
    to_log(events, rows[:4], log)
    assert read_log(spark, log, at, **how) == []
    to_log(events, rows[4:6], log)
    # A partition that is new to the consumer is read from its start.
    to_log(events, [(8, "a", 8, 8)], log, parts=9)
    assert read_log(spark, log, at, **how) == [(4, "0"), (5, "1"), (8, "8")]
    to_log(events, rows[9:], log)
    assert read_log(spark, log, at, **how) == [(4, "0"), (5, "1"), (8, "8"), (9, "1"), (10, "0"), (11, "1")]
    with pytest.raises(ValueError):
        streams.log_events(spark, log, "t")


def test_splits_are_those_the_source_names(events):
    rows = events([(i, "a", i, i) for i in range(6)]).withColumn("source_split", F.when(F.col("event_id") < 4, F.concat(F.lit("p"), F.col("event_id") % 2)))
    scopes = {r.event_id: r.scope for r in with_scope(rows, "split", 1).collect()}
    assert scopes == {0: "p0", 1: "p1", 2: "p0", 3: "p1", 4: "0", 5: "0"}


def test_streams_take_the_splits_of_the_source(spark, events):
    rows = in_order(arrivals(21, 2_400, keys=2))
    named = events(rows).withColumn("source_split", F.concat(F.lit("p"), F.col("event_id") % 3))
    folder, at = shared_folder(spark, "batches"), places(spark)
    cut = rows[1_200][3]
    stream = adaptive.TickStream(spark, params.house_adwin(0.01, 0.1), at[0])
    for number, part in enumerate((named.where(F.col("arrival_time") < cut), named.where(F.col("arrival_time") >= cut))):
        stream.writer(native.into_folder(at[2]))(part, number)
    expected = _expected(named, params.house_adwin(0.01, 0.1), rows, backtest.Settings(splits=1))
    assert _got(spark.read.parquet(at[2])) == expected != {}
