"""Streaming forms of the live operators, on the batch column logic.

Bounded input gives the same rows as the batch operators. State is bounded by
watermarks; use the RocksDB state store on a cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.numbers import mean
from ..functions.tiers import pulse_tier, spo2_tier
from ..operators.alerts import notice_times
from ..operators.telemetry import VITALS, latest_columns, vitals_trend_columns

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def watermarked(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as a zoned timestamp, which watermarks require."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def dedupe_events(events: DataFrame, ts: str = "ts", delay: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """First copy of each event; the state forgets ids behind the watermark."""
    return watermarked(events, ts, delay).dropDuplicatesWithinWatermark([key])


def binned_metric(
    readings: DataFrame, metric: str, bin: str = "30 seconds", delay: str = "10 minutes", digits: int = 1
) -> DataFrame:
    """Average per device and closed time bin."""
    return (
        watermarked(readings, "ts", delay)
        .groupBy("device_id", F.window("ts", bin).alias("w"))
        .agg(mean(metric, digits).alias(f"avg_{metric}"))
        .select("device_id", F.col("w.start").alias("ts"), f"avg_{metric}")
    )


def sliding_vitals(
    readings: DataFrame, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes"
) -> DataFrame:
    """Trend statistics and both alert tiers per device and sliding window."""
    return (
        watermarked(readings, "ts", delay)
        .groupBy("device_id", F.window("ts", window, slide).alias("w"))
        .agg(*vitals_trend_columns())
        .select(
            "device_id",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *["readings", "avg_spo2", "min_spo2", "max_spo2", "avg_pr", "min_pr", "max_pr", "last_reading"],
            spo2_tier(F.col("min_spo2")).alias("spo2_tier"),
            pulse_tier(F.col("min_pr"), F.col("max_pr")).alias("pr_tier"),
        )
    )


def latest_per_device(readings: DataFrame, delay: str = "1 day") -> DataFrame:
    """Newest reading per device and day; run in update mode into `upsert_sink`.

    A batch gives only the devices that it changes. The state holds the days
    that the watermark has not passed, so a silent device is forgotten; its
    newest reading stays in the table that the rows are upserted into.
    """
    return (
        watermarked(readings, "ts", delay)
        .groupBy("device_id", F.window("ts", "1 day").alias("d"))
        .agg(F.max("ts").alias("timestamp"), *latest_columns(VITALS))
        .drop("d")
    )


def breach_sessions(readings: DataFrame, gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Runs of saturation or pulse breaches without a pause longer than `gap`.

    The watermark follows all readings, so a run closes as time goes on, also
    when no further breach comes: the condition names the event time, which
    keeps it above the watermark in the plan.
    """
    breach = spo2_tier(F.col("spo2")).isNotNull() | pulse_tier(F.col("pr"), F.col("pr")).isNotNull()
    return (
        watermarked(readings, "ts", delay)
        .where(F.when(F.col("ts").isNotNull(), breach).otherwise(False))
        .groupBy("device_id", F.session_window("ts", gap).alias("s"))
        .agg(F.count("*").alias("breaches"), F.min("spo2").alias("min_spo2"), F.max("pr").alias("max_pr"))
        .select(
            "device_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
            "breaches", "min_spo2", "max_pr",
        )
    )


class Cooldown(StatefulProcessor):
    """Per key: the last notice, and the times that wait for the watermark, each with its smallest alert.

    A timer at a waiting time fires when the watermark has passed it; then all
    earlier times are known and the walk goes on in event-time order, whatever
    the order of arrival. A second timer one cooldown after the last notice
    clears the key: from then on it suppresses nothing, so idle keys leave no state.
    """

    def __init__(self, key: str, cooldown_seconds: int):
        self.key, self.span = key, cooldown_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint")
        self.waiting = handle.getMapState("waiting", "at bigint", "alert_id string, alert_tier string")

    def handleInputRows(self, key, rows, timerValues):
        last = self.last.get()[0] if self.last.exists() else None
        known = timerValues.getCurrentWatermarkInMs() * 1000 + 999  # all of the watermark's millisecond
        timer = None
        for chunk in rows:  # one chunk of rows in memory at a time
            at = chunk["alert_time"].astype("datetime64[us]").astype("int64")
            fresh = chunk.assign(at=at)[(at > known) & ((at >= last + self.span) if last is not None else True)]
            for t, alert, tier in fresh.sort_values(["at", "alert_id"]).drop_duplicates("at")[["at", "alert_id", "alert_tier"]].itertuples(index=False):
                if not self.waiting.containsKey((t,)) or alert < self.waiting.getValue((t,))[0]:
                    self.waiting.updateValue((t,), (alert, tier))
                    timer = t if timer is None else min(timer, t)
        if timer is not None:
            self.handle.registerTimer(timer // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import numpy as np
        import pandas as pd

        known = timerValues.getCurrentWatermarkInMs() * 1000 + 999  # all of the watermark's millisecond
        last = self.last.get()[0] if self.last.exists() else None
        times = np.sort(np.fromiter((k[0] for k in self.waiting.keys()), np.int64))
        ready, later = times[times <= known], times[times > known]
        sent = [int(ready[i]) for i in notice_times(ready, self.span, last)]
        told = [(t, *self.waiting.getValue((t,))) for t in sent]
        last = sent[-1] if sent else last
        for t in ready.tolist():
            self.waiting.removeKey((t,))
        if last is not None and last + self.span <= known:
            last = None
            self.last.clear()
        elif sent:
            self.last.update((last,))
        if last is not None:
            for t in later[later < last + self.span].tolist():  # never to be notified
                self.waiting.removeKey((t,))
            later = later[later >= last + self.span]
            self.handle.registerTimer((last + self.span) // 1000)
        if len(later):
            self.handle.registerTimer(int(later[0]) // 1000)
        if told:
            yield pd.DataFrame({
                self.key: [key[0]] * len(told), "alert_time": pd.to_datetime([t for t, _, _ in told], unit="us"),
                "alert_id": [a for _, a, _ in told], "alert_tier": [b for _, _, b in told],
            })

    def close(self) -> None:
        pass


def cooldown_notifications(alerts: DataFrame, cooldown_seconds: int, key: str = "device_id", delay: str = "0 seconds") -> DataFrame:
    """CRITICAL / URGENT alerts, at most one per key and rolling cooldown, in event-time order.

    An alert is decided once the watermark has passed it, `delay` behind the
    newest alert; rows that come later than that are left out. The session gets
    the RocksDB state store, which keyed state with timers needs.
    """
    spark = alerts.sparkSession
    for name, value in ROCKSDB.items():
        spark.conf.set(name, value)
    kind = alerts.schema[key].dataType.simpleString()
    chosen = watermarked(
        alerts.where(F.col("alert_tier").isin("CRITICAL", "URGENT")).select(key, F.col("alert_time").cast("timestamp").alias("alert_time"), "alert_id", "alert_tier"),
        "alert_time", delay,
    )
    return chosen.groupBy(key).transformWithStateInPandas(
        Cooldown(key, cooldown_seconds),
        outputStructType=f"{key} {kind}, alert_time timestamp, alert_id string, alert_tier string",
        outputMode="append",
        timeMode="eventTime",
    )
