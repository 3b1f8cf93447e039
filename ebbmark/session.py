"""Session settings the package relies on, and the shared folder for durable intermediates."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

import ebbmark

# Event time is epoch milliseconds in UTC; adaptive streaming keeps state in RocksDB; AQE splits skewed
# join partitions and coalesces small ones. HotSpot does not compile methods above 8000 bytes of
# bytecode: a stage whose fused loop would be longer runs faster as separate generated projections.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "ebbmark", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SETTINGS, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's ``spark.checkpoint.dir``, which executors on other machines can read.

    Without the setting, a temporary folder serves a single-machine session; a cluster is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_folder()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="ebbmark-")


def stored(df: DataFrame, purpose: str, free_shuffles: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of a frame that several branches use, survives lost executors, and gives the
    planner the true size of what follows. With ``free_shuffles`` the shuffle files of the writing job go
    when it ends, not when the driver collects its garbage.
    """
    path = shared_folder(df.sparkSession, purpose)
    before = df.sparkSession.conf.get(FREE_SHUFFLES, "false")
    try:
        if free_shuffles:
            df.sparkSession.conf.set(FREE_SHUFFLES, "true")
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> SparkSession:
    """Let functions of this package travel to the Python workers by value.

    Only the adaptive operators run Python on executors. Not needed where the package is installed on
    the workers. Streaming workers do not see added Python files, so those would not do.
    """
    cloudpickle.register_pickle_by_value(ebbmark)
    return spark
