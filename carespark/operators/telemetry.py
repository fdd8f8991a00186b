"""Pulse-oximeter telemetry: trends, status, freshness, series.

Readings are flat rows
`(event_id, device_id, ts, spo2, pr, pi, pvi, sphb, signal_iq)`.
All operators are one filter plus one hash aggregation by device or time bin;
map-side combine keeps a hot device from reaching one task as raw rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import count_if, distinct_if, exact, mean, percent
from ..functions.text import cascade
from ..functions.timing import (
    as_column,
    back,
    minutes_between,
    recency_key,
    recent,
    seconds_between,
)

VITALS = ["spo2", "pr", "pi", "pvi", "sphb", "signal_iq"]


def vitals_trend_columns() -> list[Column]:
    """Window statistics, shared with the streaming form."""
    rounded = lambda c, digits: F.round(c, digits).cast("double")
    return [
        F.count("*").alias("readings"),
        mean("spo2", 1).alias("avg_spo2"),
        rounded(F.min("spo2"), 1).alias("min_spo2"),
        rounded(F.max("spo2"), 1).alias("max_spo2"),
        F.round(F.stddev_samp("spo2"), 2).alias("stddev_spo2"),
        mean("pr", 0).alias("avg_pr"),
        F.min("pr").alias("min_pr"),
        F.max("pr").alias("max_pr"),
        mean("pi", 2).alias("avg_pi"),
        mean("pvi", 0).alias("avg_pvi"),
        mean("sphb", 1).alias("avg_sphb"),
        mean("signal_iq", 0).alias("avg_signal_iq"),
        F.max("ts").alias("last_reading"),
    ]


def vitals_trend(readings: DataFrame, as_of, window_minutes: int = 5) -> DataFrame:
    """Per-device statistics over the look-back window."""
    return (
        recent(readings, "ts", as_of, minutes=window_minutes)
        .groupBy("device_id")
        .agg(*vitals_trend_columns())
        .withColumn(
            "minutes_since_last", seconds_between(as_column(as_of), "last_reading") / F.lit(60.0)
        )
    )


def device_status(readings: DataFrame, as_of, online: int = 30, stale: int = 120) -> DataFrame:
    """ONLINE / STALE / OFFLINE by age of the newest reading."""
    age = F.col("seconds_ago")
    return (
        readings.groupBy("device_id")
        .agg(F.max("ts").alias("last_seen"))
        .withColumn("seconds_ago", seconds_between(as_column(as_of), "last_seen"))
        .withColumn("status", cascade([(age < online, "ONLINE"), (age < stale, "STALE")], "OFFLINE"))
    )


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("devices"))


def connectivity_report(status: DataFrame) -> DataFrame:
    """Age bucket and follow-up action per device."""
    age = F.col("seconds_ago")
    return status.select(
        "status",
        "device_id",
        "last_seen",
        "seconds_ago",
        cascade([(age < 30, "<30s"), (age < 120, "30s-2m")], ">2m").alias("age_bucket"),
        cascade(
            [
                (F.col("status") == "ONLINE", "No action"),
                (F.col("status") == "STALE", "Check telemetry path"),
            ],
            "Escalate device connectivity",
        ).alias("connection_action"),
    )


def latest_columns(names: list[str]) -> list[Column]:
    """Values of the newest reading (ties: highest event id)."""
    key = recency_key("ts", "event_id")
    return [F.max_by(n, key).alias(n) for n in names]


def latest_readings(readings: DataFrame) -> DataFrame:
    return readings.groupBy("device_id").agg(
        F.max("ts").alias("timestamp"), *latest_columns(VITALS)
    )


def telemetry_by_device(
    readings: DataFrame, as_of, device: str | list[str] | None = None, lookback_minutes: int = 60
) -> DataFrame:
    """Raw series for chosen devices, or for all."""
    rows = recent(readings, "ts", as_of, minutes=lookback_minutes)
    if device is not None:
        rows = rows.where(F.col("device_id").isin([device] if isinstance(device, str) else device))
    return rows.select("device_id", F.col("ts").alias("timestamp"), *VITALS)


def binned_metric(
    readings: DataFrame,
    metric: str,
    as_of,
    bin: str = "30 seconds",
    window_minutes: int = 60,
    digits: int = 1,
) -> DataFrame:
    """Average of one metric per device and time bin."""
    return (
        recent(readings, "ts", as_of, minutes=window_minutes)
        .groupBy("device_id", F.window("ts", bin).alias("w"))
        .agg(mean(metric, digits).alias(f"avg_{metric}"))
        .select("device_id", F.col("w.start").alias("ts"), f"avg_{metric}")
    )


def threshold_overlay(
    readings: DataFrame,
    alerts: DataFrame,
    as_of,
    bin: str = "30 seconds",
    window_minutes: int = 60,
) -> DataFrame:
    """Chart rows: readings, alert markers, and a constant line per threshold.

    The three lines come from exploding a literal array over the distinct bins.
    """
    series = binned_metric(readings, "spo2", as_of, bin, window_minutes).select(
        F.col("device_id").alias("series"), "ts", F.col("avg_spo2").alias("value")
    )
    markers = alerts.select(
        F.concat(F.lit("Alert "), "alert_tier").alias("series"),
        F.window("alert_time", bin).start.alias("ts"),
        F.col("spo2").cast("double").alias("value"),
    )
    lines = F.array(
        *[
            F.struct(F.lit(name).alias("series"), F.lit(level).alias("value"))
            for name, level in [
                ("Warning threshold 94", 94.0),
                ("Urgent threshold 90", 90.0),
                ("Critical threshold 85", 85.0),
            ]
        ]
    )
    constants = (
        series.select("ts").distinct().select("ts", F.explode(lines).alias("line"))
    ).select("line.series", "ts", "line.value")
    return series.unionByName(markers).unionByName(constants)


def events_per_minute(readings: DataFrame, as_of, window_minutes: int = 60) -> DataFrame:
    return (
        recent(readings, "ts", as_of, minutes=window_minutes)
        .groupBy(F.window("ts", "1 minute").alias("w"))
        .agg(F.count("*").alias("events"), F.count_distinct("device_id").alias("devices"))
        .select(F.col("w.start").alias("ts"), "events", "devices")
    )


def ingestion_lag(readings: DataFrame, as_of) -> DataFrame:
    return readings.agg(F.max("ts").alias("last_time")).select(
        seconds_between(as_column(as_of), "last_time").alias("ingestion_lag_seconds")
    )


def throughput_freshness(
    readings: DataFrame, as_of, minute_seconds: int = 60, active_seconds: int = 30
) -> DataFrame:
    """Freshness and throughput against one event per device and second, in one pass."""
    in_minute = F.col("ts") > back(as_of, seconds=minute_seconds)
    active = F.col("ts") > back(as_of, seconds=active_seconds)
    expected = F.col("total_devices") * 60
    return (
        readings.groupBy("device_id")
        .agg(
            F.max("ts").alias("last_time"),
            count_if(in_minute).alias("n"),
            F.max(active.cast("int")).alias("active"),
        )
        .agg(
            F.max("last_time").alias("last_time"),
            F.sum("n").alias("events_last_minute"),
            F.sum("active").alias("active_devices_30s"),
            F.count("*").alias("total_devices"),
        )
        .select(
            "last_time",
            seconds_between(as_column(as_of), "last_time").alias("ingestion_lag_seconds"),
            "events_last_minute",
            expected.alias("expected_events_per_minute"),
            percent(F.col("events_last_minute"), expected).alias("observed_pct"),
            "active_devices_30s",
            "total_devices",
        )
    )


def vitals_status_snapshot(latest: DataFrame) -> DataFrame:
    """Status words for the newest reading of each device."""
    pr, spo2 = F.col("pr"), F.col("spo2")
    return latest.select(
        "device_id",
        "timestamp",
        cascade(
            [(spo2 < 85, "Critical"), (spo2 < 90, "Urgent"), (spo2 < 94, "Warning")], "Normal"
        ).alias("spo2_status"),
        "spo2",
        cascade(
            [
                ((pr > 150) | (pr < 40), "Critical"),
                ((pr > 130) | (pr < 45), "Urgent"),
                ((pr > 110) | (pr < 50), "Warning"),
            ],
            "Normal",
        ).alias("pr_status"),
        "pr",
        "pi",
        "pvi",
        "sphb",
        cascade([(F.col("signal_iq") < 95, "Check sensor")], "Good").alias("signal_status"),
        "signal_iq",
    )


def _signal_bucket(default: str) -> Column:
    poor, low = F.col("signal_iq") < 95, F.col("spo2") < 94
    return cascade(
        [
            (poor & low, "Low SpO2 + poor signal"),
            (poor, "Poor signal only"),
            (low, "Low SpO2 + good signal"),
        ],
        default,
    )


def signal_vs_risk(latest: DataFrame) -> DataFrame:
    return (
        latest.groupBy(_signal_bucket("Vitals/signal normal").alias("signal_quality"))
        .agg(
            F.count("*").alias("devices"),
            F.min("spo2").alias("min_spo2"),
            mean("signal_iq", 1).alias("avg_signal_iq"),
        )
    )


def sensor_review_list(latest: DataFrame, limit: int = 100) -> DataFrame:
    """Devices that need a sensor or clinical check, worst first."""
    poor, low = F.col("signal_iq") < 95, F.col("spo2") < 94
    return (
        latest.where(poor | low)
        .select(
            "device_id",
            _signal_bucket("Low SpO2 + good signal").alias("signal_quality"),
            "signal_iq",
            "spo2",
            "pr",
            cascade(
                [
                    (poor & low, "Check probe placement, then assess patient"),
                    (poor, "Check probe placement"),
                ],
                "Assess patient oxygenation",
            ).alias("action"),
            "timestamp",
        )
        .orderBy("signal_iq", "spo2", "device_id")
        .limit(limit)
    )


def local_time_shift(df: DataFrame, ts: str, hours: int, out: str = "local_time") -> DataFrame:
    return df.withColumn(out, F.col(ts) + F.expr(f"make_dt_interval(0, {hours}, 0, 0)"))


def operations_freshness(
    readings: DataFrame, claims: DataFrame, as_of, stale_minutes: int = 5
) -> DataFrame:
    """Stale devices plus one row when the claim stream is stale."""
    now = as_column(as_of)

    def finding(df: DataFrame, condition: str, device: Column, source: str) -> DataFrame:
        age = minutes_between(now, "last_event_time")
        return df.where(age > stale_minutes).select(
            F.lit(condition).alias("condition_name"),
            device.alias("device_id"),
            "last_event_time",
            age.alias("age_minutes"),
            F.lit(source).alias("source_table"),
            F.lit("WARNING").alias("severity"),
        )

    devices = readings.groupBy("device_id").agg(F.max("ts").alias("last_event_time"))
    claim = claims.agg(F.max("event_timestamp").alias("last_event_time"))
    return finding(devices, "STALE_TELEMETRY", F.col("device_id"), "TelemetryRaw").unionByName(
        finding(claim, "STALE_CLAIMS", F.lit(""), "claims_events")
    )


def stream_health(streams: dict[str, tuple[DataFrame, str]], as_of) -> DataFrame:
    """One row per stream: last event, age, recent volume, severity.

    Severity: over 30 minutes or no event in five minutes CRITICAL, over 15
    URGENT, over 5 WARNING, otherwise HEALTHY. A silent stream is CRITICAL.
    """
    age = F.col("age_minutes")
    out = None
    for name, (df, ts) in streams.items():
        row = (
            df.agg(
                F.max(ts).alias("last_event_time"),
                count_if(F.col(ts) > back(as_of, minutes=5)).alias("events_last_5m"),
            )
            .withColumn("age_minutes", minutes_between(as_column(as_of), "last_event_time"))
            .select(
                F.lit(name).alias("stream"),
                "last_event_time",
                "age_minutes",
                "events_last_5m",
                cascade(
                    [
                        (age.isNull() | (age > 30), "CRITICAL"),
                        (age > 15, "URGENT"),
                        (age > 5, "WARNING"),
                        (F.col("events_last_5m") == 0, "CRITICAL"),
                    ],
                    "HEALTHY",
                ).alias("severity"),
            )
        )
        out = row if out is None else out.unionByName(row)
    return out


def deterioration_trend(
    readings: DataFrame, as_of, recent_minutes: int = 15, baseline_minutes: int = 60
) -> DataFrame:
    """Recent mean against the preceding baseline mean, in one pass.

    The source states the outputs and tiers but not the body: WATCH for a
    saturation drop over 1 or a pulse rise over 10, CONCERN over 2 / 15,
    ESCALATE over 4 / 25 or when both metrics reach CONCERN.
    """
    is_recent = F.col("ts") > back(as_of, minutes=recent_minutes)
    part = lambda cond, c: F.avg(F.when(cond, exact(c)))
    drop, rise = F.col("spo2_drop"), F.col("pr_rise")
    multi = (drop > 2) & (rise > 15)
    return (
        recent(readings, "ts", as_of, minutes=recent_minutes + baseline_minutes)
        .groupBy("device_id")
        .agg(
            F.round(part(~is_recent, "spo2") - part(is_recent, "spo2"), 2)
            .cast("double")
            .alias("spo2_drop"),
            F.round(part(is_recent, "pr") - part(~is_recent, "pr"), 2)
            .cast("double")
            .alias("pr_rise"),
            F.round(F.stddev_samp(F.when(is_recent, F.col("pr"))), 2).alias("pr_stdev"),
            count_if(is_recent).alias("recent_readings"),
            count_if(~is_recent).alias("baseline_readings"),
        )
        .where(drop.isNotNull() & rise.isNotNull())
        .withColumn("multi_metric", multi)
        .withColumn(
            "trend",
            cascade(
                [
                    ((drop > 4) | (rise > 25) | multi, "ESCALATE"),
                    ((drop > 2) | (rise > 15), "CONCERN"),
                    ((drop > 1) | (rise > 10), "WATCH"),
                ],
                "STABLE",
            ),
        )
    )


def current_device_summary(readings: DataFrame, as_of, window_minutes: int = 5) -> DataFrame:
    return recent(readings, "ts", as_of, minutes=window_minutes).agg(
        F.count_distinct("device_id").alias("currently_reporting_devices"),
        F.max("ts").alias("latest_event_time_utc"),
    )


def low_oxygen(
    readings: DataFrame, as_of, window_minutes: int = 30, threshold: float = 94.0
) -> DataFrame:
    low = F.col("spo2") < F.lit(threshold)
    return recent(readings, "ts", as_of, minutes=window_minutes).agg(
        distinct_if(low, F.col("device_id")).alias("device_count"),
        F.max(F.when(low, F.col("ts"))).alias("latest_event_time_utc"),
        F.lit(window_minutes).alias("window_minutes"),
        F.lit(threshold).alias("threshold"),
    )


def telemetry_seven_day_summary(readings: DataFrame, as_of, days: int = 7) -> DataFrame:
    return recent(readings, "ts", as_of, days=days).agg(
        F.count_distinct("device_id").alias("device_count"),
        F.count("*").alias("event_count"),
        F.max("ts").alias("latest_event_time_utc"),
        F.lit("TelemetryRaw").alias("source_name"),
    )
