"""Session helper used by tests and the bench; a cluster job normally brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# The JVM compiles no method of more than 8,000 bytes, so a wide projection fused into one method stays interpreted, several
# times slower. Beyond this limit Spark splits the expressions over small methods instead.
WIDE_PROJECTIONS = {"spark.sql.codegen.hugeMethodLimit": "8000"}

# Starting point for a large cluster. Initial shuffle partitions are many and small tasks are merged
# at run time; a partition of a skewed join is split from 256 MB up.
CLUSTER_CONF = {
    **WIDE_PROJECTIONS,
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "20000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
    "spark.sql.sources.fileCompressionFactor": "4.0",   # size estimates for broadcasts count unpacked bytes
}

# Joins are left to the planner: it broadcasts a side only when its measured size is under
# autoBroadcastJoinThreshold, and skew-splits a sort-merge join otherwise.
CONF = {
    **WIDE_PROJECTIONS,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def compile_wide(spark: SparkSession) -> None:
    """Let wide projections be compiled in a session that somebody else made; results stay the same."""
    for key, value in WIDE_PROJECTIONS.items():
        spark.conf.set(key, value)


def local_session(cpus: int | None = None, memory: str = "8g", **extra: str) -> SparkSession:
    cpus = cpus or os.cpu_count() or 4
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("caremeter").config("spark.driver.memory", memory)
    for key, value in {**CONF, "spark.sql.shuffle.partitions": str(cpus), **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
