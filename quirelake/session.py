"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on a document id meet documents of any size: let AQE split them.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Sizes are measured compressed and before rows are exploded; what is broadcast is built in
    # the driver, there many times as large. More than this is shuffled.
    "spark.sql.autoBroadcastJoinThreshold": "256k",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "256k",
    # A folder per document is not a listing task per document.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "100",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Outlines stop at depth 100 in the recursion itself, not at these limits.
    "spark.sql.cteRecursionLevelLimit": "110",
    "spark.sql.cteRecursionRowLimit": "-1",
}

STREAM_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Scratch space of a session on one machine (tests, bench) that names none.
LOCAL_SHARED = "file:///tmp/checkpoints/quirelake"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(name: str = "quirelake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared space, named by ``spark.checkpoint.dir``.

    Only a session whose executors live in the driver's own process may do
    without the setting; on a cluster a missing one is an error, as each executor
    would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return base.rstrip("/")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the cluster's shared space."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared space and read it back.

    For a costly result that is read several times over: it is computed once,
    later passes scan only the columns they need, and a lost executor costs a
    reread instead of a recomputation.
    """
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
