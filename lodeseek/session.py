"""A session with the settings that the library expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # Recording where each column expression was built costs more driver time than building it.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("lodeseek").config(map=SETTINGS | settings)
    return (builder.master(master) if master else builder).getOrCreate()


def spread(frame: DataFrame) -> DataFrame:
    """frame, dealt to every core where its scan has fewer partitions than there are cores, as a small file of one row group has.

    Meant for work that costs far more than moving its rows. Tables of many partitions are not moved.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, spark.checkpoint.dir; local sessions without one get a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodeseek-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
