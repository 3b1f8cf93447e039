"""Record shapes: raw events, window results and the two metric tables."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType,
)


def _struct(*fields) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


# The event record on the wire; both data sets use it. Unknown JSON fields are ignored.
SENSOR_EVENT = _struct(
    ("house_id", StringType(), True),
    ("temperature", DoubleType(), True),
    ("energy_usage", DoubleType(), True),
    ("humidity", DoubleType(), True),
    ("event_time", LongType(), True),
    ("arrival_time", LongType(), True),
)

HOUSE_METRICS = _struct(
    ("time", TimestampType(), True),
    ("house_id", StringType(), True),
    ("strategy", StringType(), True),
    ("avg_temp", DoubleType(), True),
    ("avg_energy", DoubleType(), True),
    ("decisional_latency_ms", LongType(), True),
    ("true_latency_ms", LongType(), True),
    ("pachete_count", LongType(), True),
    ("is_final", BooleanType(), True),
    ("update_count", LongType(), True),
)

TAXI_METRICS = _struct(
    ("time", TimestampType(), True),
    ("zone_id", StringType(), True),
    ("strategy", StringType(), True),
    ("true_latency_ms", LongType(), True),
    ("window_delay_s", DoubleType(), True),
    ("event_count", LongType(), True),
    ("avg_distance", DoubleType(), True),
    ("avg_duration", DoubleType(), True),
    ("update_count", LongType(), True),
    ("window_end", LongType(), True),
)
