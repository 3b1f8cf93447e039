"""Unbounded sources of sensor events, and the shared JSON decoding."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ebbmark.schemas import SENSOR_EVENT

DEFAULT_TOPIC = "iot-sensor-data"
IN_ORDER_TOPIC = "iot-sensor-data-inorder"
CORRUPT = "_corrupt"


def kafka_events(spark: SparkSession, servers: str, topic: str = DEFAULT_TOPIC, starting: str = "latest",
                 group: str | None = None, strict: bool = True) -> DataFrame:
    """Events of a Kafka topic under a fresh consumer group. Needs the Kafka connector package."""
    raw = (spark.readStream.format("kafka")
           .option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic)
           .option("startingOffsets", starting)
           .option("kafka.group.id", group or f"ebbmark-{uuid.uuid4().hex}")
           .load())
    return decode(raw.select(F.col("value").cast("string").alias("value"),
                             F.col("partition").cast("string").alias("source_split")), strict)


def json_folder_events(spark: SparkSession, folder: str, files_per_batch: int | None = None,
                       strict: bool = True) -> DataFrame:
    """The same interface over a folder of JSON-lines files."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return decode(reader.text(folder), strict)


def log_events(spark: SparkSession, folder: str, topics: str | list[str] = DEFAULT_TOPIC, starting: str = "latest",
               position: str | None = None, files_per_batch: int | None = None, strict: bool = True,
               fields: StructType | None = None) -> DataFrame:
    """Events of a partitioned log on shared storage: ``folder/topic=<topic>/partition=<partition>/`` holds files of JSON lines, which
    are only ever added. ``log_records`` writes it.

    The same interface as ``kafka_events``: ``source_split`` names the partition (of one topic, or topic and partition of several), the offsets are in the
    query's checkpoint, and ``starting`` matters to a new consumer only. With ``latest`` it skips what each partition held when it first
    started; that place, the newest file time per partition by the storage's own clock, is kept in the folder ``position``, so
    a consumer that starts again loses nothing that came while it was away. ``fields`` are further fields of a record.
    """
    if starting not in ("latest", "earliest"):
        raise ValueError(f"unknown start: {starting}")
    names = [topics] if isinstance(topics, str) else list(topics)
    reader = spark.readStream.schema("value string, topic string, partition string").option("basePath", folder)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    pattern = f"{folder}/topic={{{','.join(names)}}}/partition=*"
    raw = reader.text(pattern).withColumn("_at", F.col("_metadata.file_modification_time"))
    if starting == "latest":
        if position is None:
            raise ValueError("a consumer that starts at the latest record needs a folder for its position")
        # One row per partition of the source.
        first = _first_position(spark, pattern, folder, position)
        raw = raw.join(first, ["topic", "partition"], "left").where(F.col("_from").isNull() | (F.col("_at") > F.col("_from")))
    split = F.col("partition") if len(names) == 1 else F.concat_ws("-", "topic", "partition")
    return decode(raw.select("value", split.alias("source_split")), strict, fields)


def _first_position(spark: SparkSession, pattern: str, folder: str, position: str) -> DataFrame:
    """``topic, partition, _from``: the newest file of each partition when this consumer first started."""
    schema = "topic string, partition string, _from timestamp"
    try:
        return spark.read.schema(schema).parquet(position)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    try:
        # Lists the files; without their content nothing is read.
        held = spark.read.format("binaryFile").option("basePath", folder).load(pattern)
        now = held.groupBy(F.col("topic").cast("string").alias("topic"), F.col("partition").cast("string").alias("partition")) \
            .agg(F.max("modificationTime").alias("_from"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        now = spark.createDataFrame([], schema)
    now.write.parquet(position)
    return spark.read.schema(schema).parquet(position)


def decode(raw: DataFrame, strict: bool = True, fields: StructType | None = None) -> DataFrame:
    """Parse the JSON column ``value``; fields beyond the event record and ``fields`` are ignored.

    ``strict`` fails the job on a malformed record. Otherwise the record text is kept in ``_corrupt``
    and the event columns are null; see ``quarantine``.
    """
    record = StructType(SENSOR_EVENT.fields + (fields.fields if fields else []))
    schema = StructType(record.fields + [StructField(CORRUPT, StringType())])
    options = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = raw.withColumn("_e", F.from_json("value", record if strict else schema, options))
    extra = [c for c in raw.columns if c != "value"]
    return parsed.select("_e.*", *extra)


def quarantine(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split non-strictly decoded records into events and malformed records."""
    good = decoded.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    return good, decoded.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def as_readings(events: DataFrame) -> DataFrame:
    """Wire record to the column names the operators use."""
    extra = [c for c in events.columns if c not in SENSOR_EVENT.fieldNames()]
    return events.select(
        F.col("house_id").alias("key"), F.col("temperature").alias("reading_1"),
        F.col("energy_usage").alias("reading_2"), F.col("humidity").alias("reading_3"),
        "event_time", "arrival_time", *extra)


def as_wire(readings: DataFrame, extra: list[str] = ()) -> DataFrame:
    return readings.select(
        F.col("key").alias("house_id"), F.col("reading_1").alias("temperature"),
        F.col("reading_2").alias("energy_usage"), F.col("reading_3").alias("humidity"),
        "event_time", "arrival_time", *extra)
