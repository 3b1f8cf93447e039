"""CSV traces and stored metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ebbmark.functions.delays import draw
from ebbmark.functions.scalars import geo_cell

PICKUP_FORMAT = "yyyy-MM-dd HH:mm:ss"
HOUSES = 100

# Column positions in the two trace files: fixed values.
HOUSE_COLUMNS = {"energy": 1, "temperature": 19, "humidity": 21}
TAXI_COLUMNS = {"pickup": 5, "passengers": 7, "seconds": 8, "distance": 9, "lon": 10, "lat": 11}


def _by_position(spark: SparkSession, path: str, last: int) -> DataFrame:
    """Text columns ``_0`` ... ``_last`` of a CSV with a header line; a short line yields nulls."""
    schema = StructType([StructField(f"_{i}", StringType()) for i in range(last + 1)])
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, mode="PERMISSIVE")


def _number(position: int) -> Column:
    return F.expr(f"try_cast(`_{position}` as double)")


def read_house_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with all three numbers; a row with an unparsable one is dropped."""
    rows = _by_position(spark, path, max(HOUSE_COLUMNS.values()))
    return rows.select(*[_number(i).alias(name) for name, i in HOUSE_COLUMNS.items()]).dropna()


def read_taxi_csv(spark: SparkSession, path: str) -> DataFrame:
    rows = _by_position(spark, path, max(TAXI_COLUMNS.values()))
    numbers = [_number(i).alias(name) for name, i in TAXI_COLUMNS.items() if name != "pickup"]
    pickup = F.try_to_timestamp(F.col(f"_{TAXI_COLUMNS['pickup']}"), F.lit(PICKUP_FORMAT))
    return rows.select(pickup.alias("pickup"), *numbers).dropna()


def taxi_events(trips: DataFrame) -> DataFrame:
    """Trip rows as events: key is the pickup cell, readings are distance, minutes and passengers."""
    return trips.select(
        geo_cell(F.col("lat"), F.col("lon")).alias("key"),
        F.col("distance").alias("reading_1"),
        (F.col("seconds") / 60.0).alias("reading_2"),
        F.col("passengers").alias("reading_3"),
        F.unix_millis("pickup").alias("event_time"))


def fan_out(rows: DataFrame, identity: str, houses: int = HOUSES) -> DataFrame:
    """One trace row becomes a reading of each synthetic house, with a small jitter that is a fixed
    function of the row id and the house."""
    spread = rows.withColumn("house", F.explode(F.sequence(F.lit(0), F.lit(houses - 1))))
    event = F.col(identity) * houses + F.col("house")

    def unit(salt: int) -> Column:
        return draw(event, salt, 1_000_000) / 1_000_000.0

    return spread.select(
        event.alias("event_id"),
        F.format_string("HOUSE_%d", F.col("house")).alias("key"),
        (F.col("temperature") + unit(51) - 0.5).alias("reading_1"),
        (F.col("energy") + unit(52) * 0.05).alias("reading_2"),
        (F.col("humidity") + unit(53) * 0.02).alias("reading_3"),
        *[c for c in rows.columns if c in ("event_time",)])


def sort_trips(spark: SparkSession, source: str, target: str, pickup: str = "pickup_datetime") -> DataFrame:
    """Rewrite a trip file in pickup order and report row count and first and last pickup.

    The sort is a range exchange; files of the target hold consecutive ranges in name order.
    """
    rows = spark.read.csv(source, header=True)
    clean = rows.withColumn(pickup, F.to_timestamp(F.trim(pickup), PICKUP_FORMAT))
    ordered = clean.orderBy(pickup).withColumn(pickup, F.date_format(pickup, PICKUP_FORMAT))
    ordered.write.mode("overwrite").csv(target, header=True)
    return spark.read.csv(target, header=True).agg(
        F.count(F.lit(1)).alias("trips"), F.min(pickup).alias("first_pickup"), F.max(pickup).alias("last_pickup"))


def read_metrics(spark: SparkSession, path: str, strategies: list[str] | None = None,
                 newer_than: str | None = None) -> DataFrame:
    """Stored metrics; the strategy filter prunes partitions, the time filter reaches the scan."""
    rows = spark.read.parquet(path)
    if strategies:
        rows = rows.where(F.col("strategy").isin(strategies))
    if newer_than:
        rows = rows.where(F.col("time") > F.to_timestamp(F.lit(newer_than)))
    return rows
