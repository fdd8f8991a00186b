"""Streaming job: telemetry to alert history and notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.alerts import alert_history_transform
from ..sources.events import telemetry_readings
from ..sources.lakehouse import with_day


def start_alert_history(raw: DataFrame, table: str, checkpoint: str, once: bool = False):
    """Append row-level breaches of a telemetry stream to the history table, partitioned by day."""
    return start_history(alert_history_transform(telemetry_readings(raw)), table, checkpoint, once)


def start_history(alerts: DataFrame, table: str, checkpoint: str, once: bool = False):
    """Append alerts to a table partitioned by the day of their time."""
    writer = (
        with_day(alerts, "alert_time").writeStream.format("parquet").outputMode("append").partitionBy("day")
        .option("path", table).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def compact_history(spark: SparkSession, table: str, target: str, before: str, files_per_day: int = 1) -> DataFrame:
    """Copy of the days before `before` with few files each, and a frame that reads the table so compacted.

    A stream leaves a file per batch and day. Closed days are read once (the
    others are pruned) and written to `target`; days from `before` on are still
    read from the table. Repeating the copy replaces the same days.
    """
    rows = spark.read.parquet(table)
    closed = rows.where(F.col("day") < F.lit(before).cast("date"))
    spread = F.pmod(F.xxhash64("alert_id"), F.lit(files_per_day))
    closed.repartition("day", spread).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(target)
    copied = spark.read.schema(rows.schema).parquet(target).where(F.col("day") < F.lit(before).cast("date"))
    return copied.unionByName(rows.where(F.col("day") >= F.lit(before).cast("date")))
