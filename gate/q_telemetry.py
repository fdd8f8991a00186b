"""Telemetry queries. Windows are a day or a week: the data holds 30 days."""

from pyspark.sql import functions as F

from carespark.operators import telemetry as t

from .registry import CTES, avg_dec, query, rdiv, ts_text

DAY, WEEK = 1440, 10080


def window(minutes: int, table: str = "v_telemetry", col: str = "ts", as_of: str = "v_as_of") -> str:
    return f"select * from {table} where {col} > (select as_of from {as_of}) - interval {minutes} minute"


CTES["v_day"] = window(DAY)
CTES["v_week"] = window(WEEK)
CTES["v_latest"] = (
    "select * from v_telemetry qualify row_number() over (partition by device_id order by ts desc, event_id desc) = 1"
)
CTES["v_status"] = (
    "select device_id, last_seen, seconds_ago, case when seconds_ago < 30 then 'ONLINE' when seconds_ago < 120 then 'STALE' "
    "else 'OFFLINE' end as status from (select device_id, max(ts) as last_seen, "
    "date_diff('second', max(ts), (select as_of from v_as_of)) as seconds_ago from v_telemetry group by 1)"
)

TREND = f"""count(*) as readings, {avg_dec('spo2', 4, 1)} as avg_spo2,
 cast(round(min(spo2), 1) as double) as min_spo2, cast(round(max(spo2), 1) as double) as max_spo2,
 round(stddev_samp(cast(spo2 as double)), 2) as stddev_spo2, {avg_dec('pr', 0, 0)} as avg_pr,
 min(pr) as min_pr, max(pr) as max_pr, {avg_dec('pi', 2, 2)} as avg_pi, {avg_dec('pvi', 0, 0)} as avg_pvi,
 {avg_dec('sphb', 1, 1)} as avg_sphb, {avg_dec('signal_iq', 0, 0)} as avg_signal_iq"""

query(
    "vitals_trend",
    f"select device_id, {TREND}, {ts_text('max(ts)')} as last_reading, "
    "date_diff('second', max(ts), (select as_of from v_as_of)) / 60.0 as minutes_since_last from v_day group by device_id",
)(lambda k: t.vitals_trend(k.telemetry, k.as_of, DAY))

query(
    "device_status",
    f"select device_id, {ts_text('last_seen')} as last_seen, seconds_ago, status from v_status",
)(lambda k: t.device_status(k.telemetry, k.as_of))

query("status_counts", "select status, count(*) as devices from v_status group by 1")(
    lambda k: t.status_counts(t.device_status(k.telemetry, k.as_of))
)

query(
    "connectivity_report",
    f"select status, device_id, {ts_text('last_seen')} as last_seen, seconds_ago, "
    "case when seconds_ago < 30 then '<30s' when seconds_ago < 120 then '30s-2m' else '>2m' end as age_bucket, "
    "case status when 'ONLINE' then 'No action' when 'STALE' then 'Check telemetry path' else 'Escalate device connectivity' end as connection_action from v_status",
)(lambda k: t.connectivity_report(t.device_status(k.telemetry, k.as_of)))

DBL = "cast(spo2 as double) as spo2, pr, cast(pi as double) as pi, pvi, cast(sphb as double) as sphb, signal_iq"
query("latest_readings", f"select device_id, {ts_text('ts')} as timestamp, {DBL} from v_latest")(
    lambda k: t.latest_readings(k.telemetry)
)
query(
    "telemetry_by_device",
    f"select device_id, {ts_text('ts')} as timestamp, {DBL} from v_week where device_id = 'DEV-00003'",
)(lambda k: t.telemetry_by_device(k.telemetry, k.as_of, "DEV-00003", WEEK))
query("telemetry_all_devices", f"select device_id, {ts_text('ts')} as timestamp, {DBL} from v_week")(
    lambda k: t.telemetry_by_device(k.telemetry, k.as_of, None, WEEK)
)

BIN = "time_bucket(interval {s} second, ts)"


def binned(metric: str, scale: int, digits: int, table: str) -> str:
    return (
        f"select device_id, {ts_text(BIN.format(s=30))} as ts, {avg_dec(metric, scale, digits)} as avg_{metric} "
        f"from {table} group by device_id, {BIN.format(s=30)}"
    )


query("binned_spo2", binned("spo2", 4, 1, "v_week"))(lambda k: t.binned_metric(k.telemetry, "spo2", k.as_of, window_minutes=WEEK))
query("binned_pulse", binned("pr", 0, 0, "v_week"))(
    lambda k: t.binned_metric(k.telemetry, "pr", k.as_of, window_minutes=WEEK, digits=0)
)
query("binned_signal", binned("signal_iq", 0, 1, "v_week"))(
    lambda k: t.binned_metric(k.telemetry, "signal_iq", k.as_of, window_minutes=WEEK)
)
query(
    "events_per_minute",
    f"select {ts_text(BIN.format(s=60))} as ts, count(*) as events, count(distinct device_id) as devices from v_week group by {BIN.format(s=60)}",
)(lambda k: t.events_per_minute(k.telemetry, k.as_of, WEEK))
query(
    "ingestion_lag",
    "select date_diff('second', max(ts), (select as_of from v_as_of) + interval 90 second) as ingestion_lag_seconds from v_telemetry",
)(lambda k: t.ingestion_lag(k.telemetry, k.as_of + F.expr("interval 90 seconds")))
query(
    "throughput_freshness",
    f"""select {ts_text('last_time')} as last_time, lag as ingestion_lag_seconds, e as events_last_minute,
 d * 60 as expected_events_per_minute, {rdiv('100 * e', '(d * 60)', 1)} as observed_pct, a as active_devices_30s, d as total_devices
 from (select max(ts) as last_time, date_diff('second', max(ts), (select as_of from v_as_of)) as lag,
 count(*) filter (where ts > (select as_of from v_as_of) - interval 1 day) as e,
 count(distinct device_id) filter (where ts > (select as_of from v_as_of) - interval 12 hour) as a,
 count(distinct device_id) as d from v_telemetry)""",
)(lambda k: t.throughput_freshness(k.telemetry, k.as_of, 86400, 43200))
query(
    "vitals_status_snapshot",
    f"""select device_id, {ts_text('ts')} as timestamp, case when spo2 < 85 then 'Critical' when spo2 < 90 then 'Urgent'
 when spo2 < 94 then 'Warning' else 'Normal' end as spo2_status, case when pr > 150 or pr < 40 then 'Critical'
 when pr > 130 or pr < 45 then 'Urgent' when pr > 110 or pr < 50 then 'Warning' else 'Normal' end as pr_status,
 case when signal_iq < 95 then 'Check sensor' else 'Good' end as signal_status, {DBL} from v_latest""",
)(lambda k: t.vitals_status_snapshot(t.latest_readings(k.telemetry)))
BUCKET = (
    "case when signal_iq < 95 and spo2 < 94 then 'Low SpO2 + poor signal' when signal_iq < 95 then 'Poor signal only' "
    "when spo2 < 94 then 'Low SpO2 + good signal' else 'Vitals/signal normal' end"
)
query(
    "signal_vs_risk",
    f"select {BUCKET} as signal_quality, count(*) as devices, cast(min(spo2) as double) as min_spo2, "
    f"{avg_dec('signal_iq', 0, 1)} as avg_signal_iq from v_latest group by 1",
)(lambda k: t.signal_vs_risk(t.latest_readings(k.telemetry)))
query(
    "sensor_review_list",
    f"""select device_id, {BUCKET} as signal_quality, signal_iq, cast(spo2 as double) as spo2, pr,
 case when signal_iq < 95 and spo2 < 94 then 'Check probe placement, then assess patient' when signal_iq < 95
 then 'Check probe placement' else 'Assess patient oxygenation' end as action, {ts_text('ts')} as timestamp
 from v_latest where signal_iq < 95 or spo2 < 94 order by signal_iq, v_latest.spo2, device_id limit 100""",
)(lambda k: t.sensor_review_list(t.latest_readings(k.telemetry)))
query(
    "local_time_shift",
    f"select device_id, {ts_text('max(ts)')} as last_seen, {ts_text('max(ts) - interval 5 hour')} as local_time from v_telemetry group by 1",
)(
    lambda k: t.local_time_shift(
        t.device_status(k.telemetry, k.as_of).select("device_id", "last_seen"), "last_seen", -5
    )
)
def freshness_sql(minutes: int) -> str:
    now = "(select as_of from v_as_of)"
    return f"""select * from (select 'STALE_TELEMETRY' as condition_name, device_id, {ts_text('max(ts)')} as last_event_time,
 date_diff('minute', max(ts), {now}) as age_minutes, 'TelemetryRaw' as source_table, 'WARNING' as severity
 from v_telemetry group by device_id union all select 'STALE_CLAIMS', '', {ts_text('max(event_timestamp)')},
 date_diff('minute', max(event_timestamp), {now}), 'claims_events', 'WARNING' from v_claims) where age_minutes > {minutes}"""


query("operations_freshness", freshness_sql(5))(lambda k: t.operations_freshness(k.telemetry, k.claims, k.as_of))
query("operations_freshness_recent", freshness_sql(600))(lambda k: t.operations_freshness(k.telemetry, k.claims, k.as_of, 600))
query(
    "stream_health",
    f"""with s as (select 'telemetry' as stream, max(ts) as m, count(*) filter (where ts > (select as_of from v_as_of) - interval 5 minute) as n from v_telemetry
 union all select 'errors', max(ts), count(*) filter (where ts > (select as_of from v_as_of) - interval 5 minute) from v_telemetry where pr > 110
 union all select 'silent', max(ts), count(*) from v_telemetry where pr > 100000),
 a as (select *, date_diff('minute', m, (select as_of from v_as_of)) as age from s)
 select stream, {ts_text('m')} as last_event_time, age as age_minutes, n as events_last_5m,
 case when age is null or age > 30 then 'CRITICAL' when age > 15 then 'URGENT' when age > 5 then 'WARNING' when n = 0 then 'CRITICAL' else 'HEALTHY' end as severity from a""".replace("with s as", "select * from (with s as", 1)
    + ")",
)(
    lambda k: t.stream_health(
        {
            "telemetry": (k.telemetry, "ts"),
            "errors": (k.telemetry.where("pr > 110"), "ts"),
            "silent": (k.telemetry.where("pr > 100000"), "ts"),
        },
        k.as_of,
    )
)
REC = "ts > (select as_of from v_as_of) - interval 1440 minute"
query(
    "deterioration_trend",
    f"""select device_id, spo2_drop, pr_rise, pr_stdev, recent_readings, baseline_readings, spo2_drop > 2 and pr_rise > 15 as multi_metric,
 case when spo2_drop > 4 or pr_rise > 25 or (spo2_drop > 2 and pr_rise > 15) then 'ESCALATE' when spo2_drop > 2 or pr_rise > 15 then 'CONCERN'
 when spo2_drop > 1 or pr_rise > 10 then 'WATCH' else 'STABLE' end as trend from (
 select device_id, round(avg(cast(spo2 as double)) filter (where not ({REC})) - avg(cast(spo2 as double)) filter (where {REC}), 2) as spo2_drop,
 round(avg(pr) filter (where {REC}) - avg(pr) filter (where not ({REC})), 2) as pr_rise,
 round(stddev_samp(pr) filter (where {REC}), 2) as pr_stdev, count(*) filter (where {REC}) as recent_readings,
 count(*) filter (where not ({REC})) as baseline_readings from v_telemetry
 where ts > (select as_of from v_as_of) - interval {DAY + WEEK} minute group by device_id) where spo2_drop is not null and pr_rise is not null""",
)(lambda k: t.deterioration_trend(k.telemetry, k.as_of, DAY, WEEK))
query(
    "current_device_summary",
    f"select count(distinct device_id) as currently_reporting_devices, {ts_text('max(ts)')} as latest_event_time_utc from v_day",
)(lambda k: t.current_device_summary(k.telemetry, k.as_of, DAY))
query(
    "low_oxygen",
    f"select count(distinct device_id) as device_count, {ts_text('max(ts)')} as latest_event_time_utc, 1440 as window_minutes, cast(94 as double) as threshold from v_day where spo2 < 94",
)(lambda k: t.low_oxygen(k.telemetry, k.as_of, DAY))
query(
    "telemetry_seven_day_summary",
    f"select count(distinct device_id) as device_count, count(*) as event_count, {ts_text('max(ts)')} as latest_event_time_utc, 'TelemetryRaw' as source_name from v_week",
)(lambda k: t.telemetry_seven_day_summary(k.telemetry, k.as_of))


def overlay(k):
    from carespark.operators.alerts import clinical_alerts

    return t.threshold_overlay(k.telemetry, clinical_alerts(k.telemetry, k.as_of, DAY), k.as_of, window_minutes=DAY)


query(
    "threshold_overlay",
    f"""with r as (select device_id as series, {BIN.format(s=30)} as b, {avg_dec('spo2', 4, 1)} as value from v_day group by 1, 2),
 m as (select 'Alert ' || alert_tier as series, time_bucket(interval 30 second, alert_time) as b, cast(spo2 as double) as value from v_alerts),
 l as (select t.series, b, t.value from (select distinct b from r), (values ('Warning threshold 94', cast(94 as double)), ('Urgent threshold 90', 90), ('Critical threshold 85', 85)) t(series, value))
 select series, {ts_text('b')} as ts, value from (select * from r union all select * from m union all select * from l)""".replace("with r as", "select * from (with r as", 1)
    + ")",
)(overlay)
