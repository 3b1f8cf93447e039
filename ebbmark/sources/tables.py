"""Sensor readings and taxi trips derived from a generic ``events`` table.

The table has ``event_id, ts, user_id, event_type, value, props`` and spreads its rows thinly over a
month. Its clock is divided by a constant, as in a replay that runs faster than real time, so that
the standard window sizes and slacks of both data sets apply unchanged. All derived numbers are
integers held in doubles, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbmark.functions.delays import draw, with_arrival
from ebbmark.functions.scalars import LAT_MIN, LON_MIN, geo_cell

REPLAY_START_MS = 1_704_067_200_000  # 2024-01-01 00:00:00 UTC
HOUSE_SPEEDUP = 360
TAXI_SPEEDUP = 60
# Users map to the houses and pickup spots of a full grid.
HOUSES = 100
PICKUP_SPOTS = 1000


def events_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def _replayed(events: DataFrame, speedup: int) -> DataFrame:
    clock = F.unix_millis(F.col("ts").cast("timestamp"))
    return (events.withColumn("_clock", clock - F.lit(REPLAY_START_MS))
            .withColumn("event_time", F.expr(f"{REPLAY_START_MS}L + _clock div {speedup}L")))


def sensor_readings(events: DataFrame, regime: str = "stationary", speedup: int = HOUSE_SPEEDUP,
                    houses: int = HOUSES) -> DataFrame:
    """Smart-home readings: ``event_id, key, reading_1 (temperature), reading_2 (energy), reading_3
    (humidity), event_time, arrival_time``."""
    k = F.get_json_object("props", "$.k").cast("double")
    rows = _replayed(events, speedup).select(
        "event_id",
        F.concat(F.lit("HOUSE_"), (F.col("user_id") % houses).cast("string")).alias("key"),
        F.round(F.col("value") * 100).alias("reading_1"),
        k.alias("reading_2"),
        draw(F.col("event_id"), 31, 100).cast("double").alias("reading_3"),
        "event_time")
    return with_arrival(rows, regime, REPLAY_START_MS)


def taxi_trips(events: DataFrame, speedup: int = TAXI_SPEEDUP) -> DataFrame:
    """Taxi trips in drop-off order: a trip arrives when it ends, so disorder is the trip duration."""
    spot = F.col("user_id") % PICKUP_SPOTS
    lat = F.lit(LAT_MIN) + draw(spot, 41, 1000) * F.lit(0.00046)
    lon = F.lit(LON_MIN) + draw(spot, 42, 1000) * F.lit(0.00058)
    seconds = (draw(F.col("event_id"), 43, 248) + 4) * 15
    return _replayed(events, speedup).select(
        "event_id",
        geo_cell(lat, lon).alias("key"),
        F.round(F.col("value") * 100).alias("reading_1"),
        (seconds / 60).alias("reading_2"),
        (draw(F.col("event_id"), 44, 6) + 1).cast("double").alias("reading_3"),
        "event_time",
        (F.col("event_time") + seconds * 1000).alias("arrival_time"))
