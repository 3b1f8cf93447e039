from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ebbmark import params
from ebbmark.operators.speculative import speculative_updates
from ebbmark.operators.timeline import with_scope
from ebbmark.plans import backtest, metrics
from ebbmark.session import SETTINGS, ship_package, stored
from ebbmark.sources.tables import events_table, sensor_readings, taxi_trips


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def prepared(spark: SparkSession) -> SparkSession:
    for name in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
        spark.conf.set(name, SETTINGS[name])
    return ship_package(spark)


def query(name: str, sql: str | None = None):
    """Register ``build(spark, folder)`` under ``name``."""
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = Query(lambda spark, folder: build(prepared(spark), folder), sql)
        return build
    return add


# Traces and metric tables are written once and then read by many queries.
_TABLES: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, kind: str, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, kind, folder)
    if key not in _TABLES:
        _TABLES[key] = stored(build(), kind)
    return _TABLES[key]


def house(spark: SparkSession, folder: str, regime: str = "stationary") -> DataFrame:
    return _once(spark, f"house-{regime}", folder, lambda: sensor_readings(events_table(spark, folder), regime))


def taxi(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, "taxi-trips", folder, lambda: taxi_trips(events_table(spark, folder)))


def approx(name: str, digits: int = 6):
    """Round a mean of inexact doubles, whose last digits depend on the order of addition."""
    return F.round(F.col(name), digits).alias(name)


HOUSE_SET = [params.house_naive(), params.house_fixed(5), params.house_mean_shift(1000),
             params.house_adwin(0.1, 0.1), params.house_speculative()]
TAXI_SET = [params.taxi_naive(), params.taxi_fixed(3, 1500), params.taxi_mean_shift(3, 60),
            params.taxi_adwin(3, 0.1, 0.1), params.taxi_speculative(3)]


# Partitions of the source whose stream is compared: one, as in the published runs. All policies of a
# comparison then share one watermark scope. Queries about several splits name their number.
SOURCE_SPLITS = 1


def settings(idle_ms: int = 1000, splits: int = SOURCE_SPLITS, **more) -> backtest.Settings:
    return backtest.Settings(splits=splits, idle_ms=idle_ms, **more)


def run_house(spark: SparkSession, folder: str, strategies=None, regime: str = "stationary", **more) -> backtest.Backtest:
    return backtest.run(house(spark, folder, regime), strategies or HOUSE_SET, settings(1000, **more))


def run_taxi(spark: SparkSession, folder: str, strategies=None, **more) -> backtest.Backtest:
    return backtest.run(taxi(spark, folder), strategies or TAXI_SET, settings(5000, **more))


def house_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, "house-metrics", folder, lambda: metrics.to_house_metrics(
        run_house(spark, folder).windows))


def taxi_log(run: backtest.Backtest, trips: DataFrame, speculative: params.Strategy) -> DataFrame:
    """Append log: one row per result, and for the speculative strategy one per update."""
    updates = speculative_updates(with_scope(trips), run.timeline, speculative, names_final=False)
    once = run.windows.where(F.col("strategy") != speculative.name)
    return stored(metrics.to_taxi_metrics(once.unionByName(updates.select(*backtest.RESULT))), "taxi-log")


def taxi_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _once(spark, "taxi-metrics", folder,
                 lambda: taxi_log(run_taxi(spark, folder), taxi(spark, folder), TAXI_SET[-1]))
