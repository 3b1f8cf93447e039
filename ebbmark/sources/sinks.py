"""Sinks: metric tables, keyed JSON records, exported reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ebbmark.schemas import HOUSE_METRICS
from ebbmark.sources.streams import as_wire


def write_metrics(metrics: DataFrame, path: str, mode: str = "append") -> None:
    metrics.write.mode(mode).partitionBy("strategy").parquet(path)


def keyed_records(readings: DataFrame, now=None) -> DataFrame:
    """Key and JSON value per event. ``now`` stamps the arrival time at send; by default it is kept."""
    wire = as_wire(readings)
    if now is not None:
        wire = wire.withColumn("arrival_time", now)
    return wire.select(F.col("house_id").alias("key"), F.to_json(F.struct(*wire.columns)).alias("value"))


def log_records(readings: DataFrame, folder: str, topic, partition, fields: list[str] = ()) -> None:
    """Add records to a partitioned log, see ``streams.log_events``. ``topic`` and ``partition`` are columns; ``fields`` go into the record besides the event's."""
    wire = as_wire(readings.withColumn("_at", F.struct(topic.alias("topic"), partition.cast("string").alias("partition"))), ["_at", *fields])
    record = F.to_json(F.struct(*[c for c in wire.columns if c != "_at"]))
    wire.select(record.alias("value"), "_at.topic", "_at.partition").write.mode("append").partitionBy("topic", "partition").text(folder)


def send_to_kafka(readings: DataFrame, servers: str, topic: str) -> None:
    """Batch producer; needs the Kafka connector package."""
    (keyed_records(readings, F.unix_millis(F.current_timestamp())).write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("topic", topic).save())


def upsert_house_metrics(path: str, writer: str = "main", run: int = 0):
    """``foreachBatch`` writer of an upsert table kept as versions.

    A batch replaces its own folder, so a retried batch leaves no duplicates. Streams that write one table
    at the same time need different ``writer`` names, and a stream that starts anew, with a new checkpoint, a higher ``run``;
    so no batch can replace another's. ``latest_house_metrics`` is the read view that keeps the newest version of
    each point.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("strategy").parquet(
            f"{path}/run={run}/version={batch_id}/writer={writer}")
    return write


def latest_house_metrics(spark: SparkSession, path: str) -> DataFrame:
    """One row per (house, strategy, window end): the last written one.

    A batch may hold several updates of one window, so ties within a version go to the highest count.
    """
    order = [StructField("run", LongType()), StructField("version", LongType())]
    versions = spark.read.schema(StructType([*HOUSE_METRICS.fields, *order])).option("basePath", path).parquet(path)
    keys = ["time", "house_id", "strategy"]
    rest = [c for c in HOUSE_METRICS.fieldNames() if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct("run", "version", "update_count"))
    return versions.groupBy(*keys).agg(newest.alias("_n")).select(*keys, "_n.*").select(*HOUSE_METRICS.fieldNames())


def compacted_house_metrics(spark: SparkSession, path: str, into: str) -> None:
    """Write the newest versions as one version of a new table, which readers and writers then use."""
    upsert_house_metrics(into, "compaction")(latest_house_metrics(spark, path), 0)


def append_taxi_metrics(path: str, writer: str = "main", run: int = 0, rows_per_flush: int = 0):
    """``foreachBatch`` writer of the append log; each row is stamped with the write time. ``writer`` and ``run``
    keep streams apart as in ``upsert_house_metrics``. A file is closed after ``rows_per_flush`` rows (0: no bound) and, with the
    stream's trigger interval, after that time."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("time", F.current_timestamp()).write.mode("overwrite")
         .option("maxRecordsPerFile", rows_per_flush).partitionBy("strategy")
         .parquet(f"{path}/run={run}/batch={batch_id}/writer={writer}"))
    return write


def export_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small result table as CSV with a header line; ``append`` keeps a log of interval reports."""
    report.write.mode(mode).csv(path, header=True)
