"""Session settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# AQE coalesces small shuffles and splits skewed join partitions at run time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}

#: The JVM compiles no method above 8000 bytes of bytecode. A stage whose generated method is larger
#: runs its operators one by one instead, each in methods that are compiled.
METHOD_BYTES = {"spark.sql.codegen.hugeMethodLimit": "8000"}
SETTINGS |= METHOD_BYTES


def small_methods(spark: SparkSession) -> None:
    """The method limit for a session that was built elsewhere."""
    for key, value in METHOD_BYTES.items():
        spark.conf.set(key, value)


def local_session(cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """Small local session for tests and the benchmark."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("carespark")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
