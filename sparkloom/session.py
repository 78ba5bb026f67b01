"""Session settings and the few driver-side helpers every module needs."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: Rows that a Python worker is handed at a time.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Bytes of such a batch: a thousand short rows, or fewer long ones (one row may be larger).
BATCH_BYTES, BATCH_BYTES_SET = "spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20)
#: Settings of Python workers: what they free goes back to the system instead of staying with the worker.
WORKER_MEMORY = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 18), "MALLOC_TRIM_THRESHOLD_": str(1 << 20)}
#: What a session of ours sets; a cluster's own values win where they are already there.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: str = "*", memory: str = "4g", partitions: int = 8, name: str = "sparkloom") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name).config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":  # Spark's own default: ten thousand long texts at once
        spark.conf.set(BATCH_ROWS, "1000")
    if spark.conf.get(BATCH_BYTES, "67108864b") == "67108864b":  # Spark's own default
        spark.conf.set(BATCH_BYTES, BATCH_BYTES_SET)
    for key, value in WORKER_MEMORY.items():
        env.setdefault(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Spark resolves the path, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
