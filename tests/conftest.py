import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from ebbmark.session import session, ship_package  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    yield ship_package(spark)
    spark.stop()


@pytest.fixture(scope="session")
def events(spark):
    """(id, key, event time, arrival time[, reading 1, reading 2]) tuples to an events frame."""
    def build(rows):
        full = [(r[0], r[1], r[4] if len(r) > 4 else 1.0, r[5] if len(r) > 5 else 2.0, r[2], r[3]) for r in rows]
        return spark.createDataFrame(
            full, "event_id long, key string, reading_1 double, reading_2 double, event_time long, arrival_time long")
    return build
