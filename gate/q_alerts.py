"""Alert queries and their enrichment."""

from functools import partial

from pyspark.sql import functions as F

from carespark.operators import alerts as a
from carespark.operators import silver
from carespark.operators.telemetry import telemetry_seven_day_summary  # noqa: F401

from .q_telemetry import DAY, WEEK, window
from .registry import CTES, avg_dec, num_text, query, rdiv, ts_text

TIER_S = "case when {c} < 85 then 'CRITICAL' when {c} < 90 then 'URGENT' when {c} < 94 then 'WARNING' end"
TIER_P = "case when {hi} > 150 or {lo} < 40 then 'CRITICAL' when {hi} > 130 or {lo} < 45 then 'URGENT' when {hi} > 110 or {lo} < 50 then 'WARNING' end"
CTES["v_alert_stats"] = f"""select device_id, count(*) as readings, cast(round(min(spo2), 1) as double) as min_spo2, cast(min(spo2) as double) as exact_min,
 {avg_dec('spo2', 4, 1)} as avg_spo2, min(pr) as min_pr, max(pr) as max_pr, max(ts) as alert_time from v_day group by device_id"""
CTES["v_spo2_alerts"] = f"""select *, 'SPO2_LOW' as alert_type from (select *, {TIER_S.format(c='min_spo2')} as alert_tier from v_alert_stats) where alert_tier is not null"""
CTES["v_pulse_alerts"] = f"""select *, case when max_pr > 110 and min_pr < 50 then 'PR_BOTH' when max_pr > 110 then 'PR_HIGH' else 'PR_LOW' end as alert_type,
 (case when max_pr > 110 then 'high=' || max_pr else '' end) || (case when max_pr > 110 and min_pr < 50 then ' / ' else '' end) || (case when min_pr < 50 then 'low=' || min_pr else '' end) as words
 from (select *, {TIER_P.format(lo='min_pr', hi='max_pr')} as alert_tier from v_alert_stats) where alert_tier is not null"""
MSG_S = "alert_tier || ': Device ' || device_id || ' — SpO2 min=' || " + num_text("min_spo2") + " || '%, avg=' || " + num_text("avg_spo2") + " || '% over last 1440 min'"
MSG_P = "alert_tier || ': Device ' || device_id || ' — PR ' || words || ' bpm over last 1440 min'"
LIMIT_S = "cast(case alert_tier when 'CRITICAL' then 85 when 'URGENT' then 90 else 94 end as double)"
LIMIT_P = "cast(case alert_tier when 'CRITICAL' then (case when max_pr > 110 then 150 else 40 end) when 'URGENT' then (case when max_pr > 110 then 130 else 45 end) else (case when max_pr > 110 then 110 else 50 end) end as double)"

query(
    "spo2_alerts",
    f"select {ts_text('alert_time')} as alert_time, device_id, alert_tier, alert_type, 'spo2' as metric_name, min_spo2 as metric_value, {LIMIT_S} as threshold_value, {MSG_S} as message, readings from v_spo2_alerts",
)(lambda k: a.spo2_alerts(k.telemetry, k.as_of, DAY))
query(
    "spo2_alerts_plausible",
    f"""select {ts_text('alert_time')} as alert_time, device_id, alert_tier, 'SPO2_LOW' as alert_type, 'spo2' as metric_name, exact_min as metric_value, {LIMIT_S} as threshold_value,
 alert_tier || ' Dev:' || device_id || ' SpO2=' || {num_text('exact_min')} as message, readings from (select *, {TIER_S.format(c='exact_min')} as alert_tier from v_alert_stats) where alert_tier is not null""",
)(lambda k: a.spo2_alerts(k.telemetry, k.as_of, DAY, "plausible"))
PR_VALUE = "cast(case when max_pr > 110 then max_pr else min_pr end as double) as metric_value"
query(
    "pulse_alerts",
    f"select {ts_text('alert_time')} as alert_time, device_id, alert_tier, alert_type, 'pr' as metric_name, {PR_VALUE}, {LIMIT_P} as threshold_value, {MSG_P} as message, readings from v_pulse_alerts",
)(lambda k: a.pulse_alerts(k.telemetry, k.as_of, DAY))
query(
    "pulse_alerts_short",
    f"select {ts_text('alert_time')} as alert_time, device_id, alert_tier, alert_type, 'pr' as metric_name, {PR_VALUE}, {LIMIT_P} as threshold_value, alert_tier || ' Dev:' || device_id || ' PR:' || max_pr as message, readings from v_pulse_alerts",
)(lambda k: a.pulse_alerts(k.telemetry, k.as_of, DAY, True))


def alert_sql(minutes: int, suffix: str) -> str:
    """Names of the CTEs for one window; registers them."""
    day = f"v_day{suffix}"
    CTES[day] = window(minutes)
    CTES[f"v_stats{suffix}"] = CTES["v_alert_stats"].replace("v_day", day)
    CTES[f"v_s{suffix}"] = CTES["v_spo2_alerts"].replace("v_alert_stats", f"v_stats{suffix}")
    CTES[f"v_p{suffix}"] = CTES["v_pulse_alerts"].replace("v_alert_stats", f"v_stats{suffix}")
    CTES[f"v_vitals{suffix}"] = (
        f"select * from {day} qualify row_number() over (partition by device_id order by ts desc, event_id desc) = 1"
    )
    ms, mp = (m.replace("1440", str(minutes)) for m in (MSG_S, MSG_P))
    CTES[f"v_alerts{suffix}"] = f"""select 'ALERT-' || v.device_id || '-' || strftime((select as_of from v_as_of), '%Y%m%d%H%M%S') as alert_id, st.alert_time, v.device_id,
 case when s.alert_tier = 'CRITICAL' or p.alert_tier = 'CRITICAL' then 'CRITICAL' when s.alert_tier = 'URGENT' or p.alert_tier = 'URGENT' then 'URGENT' else 'WARNING' end as alert_tier,
 case when s.alert_tier is not null and p.alert_tier is not null then 'MULTI_METRIC' when s.alert_tier is not null then 'SPO2_LOW' else 'PR_ABNORMAL' end as alert_type,
 v.spo2, v.pr, v.pi, v.sphb, v.signal_iq, coalesce(' | ' || s.msg, '') || coalesce(' | ' || p.msg, '') as tail
 from v_vitals{suffix} v join v_stats{suffix} st using (device_id) left join (select device_id, alert_tier, {ms} as msg from v_s{suffix}) s using (device_id)
 left join (select device_id, alert_tier, {mp} as msg from v_p{suffix}) p using (device_id) where s.alert_tier is not null or p.alert_tier is not null"""
    return f"v_alerts{suffix}"


alert_sql(DAY, "")
alert_sql(WEEK, "_week")
VIT = "cast(spo2 as double) as spo2, pr, cast(pi as double) as pi, cast(sphb as double) as sphb, signal_iq"
HEAD = f"alert_tier || ' ALERT | Device: ' || device_id || ' | SpO2: ' || {num_text('spo2')} || '% | PR: ' || pr || ' bpm'"
query(
    "clinical_alerts",
    f"select alert_id, {ts_text('alert_time')} as alert_time, device_id, '' as patient_id, '' as patient_name, alert_tier, alert_type, {VIT}, '' as qualifying_conditions, {HEAD} || tail as message from v_alerts",
)(lambda k: a.clinical_alerts(k.telemetry, k.as_of, DAY))
query(
    "clinical_alerts_plausible",
    f"select alert_id, {ts_text('alert_time')} as alert_time, device_id, '' as patient_id, '' as patient_name, alert_tier, alert_type, {VIT}, '' as qualifying_conditions, {HEAD} as message from v_alerts",
)(lambda k: a.clinical_alerts(k.telemetry, k.as_of, DAY, "plausible"))

# --- enrichment ---
CTES["v_assoc"] = (
    "select distinct 'DEV-' || lpad(cast(user_id as varchar), 5, '0') as device_id, 'pat-' || user_id as patient_id from events where user_id % 7 <> 3"
)
CTES["v_names"] = "select patient_id, given || ' ' || family as patient_name from v_patients"
CTES["v_high_risk"] = (
    "select patient_id, string_agg(distinct display, ', ' order by display) as conditions from v_conditions "
    "where code in ('13645005','84114007','195967001','233604007','59621000') group by 1"
)


def enriched_sql(suffix: str) -> None:
    CTES[f"v_enriched{suffix}"] = f"""select alert_id, alert_time, device_id, coalesce(m.patient_id, '') as patient_id, coalesce(n.patient_name, '(not linked)') as patient_name,
 case when h.conditions is not null and alert_tier = 'URGENT' then 'CRITICAL' when h.conditions is not null and alert_tier = 'WARNING' then 'URGENT' else alert_tier end as alert_tier,
 alert_type, spo2, pr, pi, sphb, signal_iq, coalesce(h.conditions, '') as qualifying_conditions, (h.conditions is not null and alert_tier <> 'CRITICAL') as escalated,
 n.patient_name as pn, h.conditions as hc from v_alerts{suffix} left join v_assoc m using (device_id) left join v_names n on n.patient_id = m.patient_id left join v_high_risk h on h.patient_id = m.patient_id"""


enriched_sql("")
enriched_sql("_week")
EMSG = (
    "alert_tier || ' ALERT' || (case when escalated then ' (ESCALATED)' else '' end) || ' | Patient: ' || coalesce(pn, 'Unknown') || ' | Device: ' || device_id || ' | SpO2: ' || "
    + num_text("v_e.spo2") + " || '% | PR: ' || pr || ' bpm' || coalesce(' | Conditions: ' || hc, '')"
)


def named_patients(k):
    return k.patients.select("patient_id", a.pick_name(F.col("name")).alias("patient_name"))


def enriched(k, minutes=DAY):
    return a.enriched_clinical_alerts(
        a.clinical_alerts(k.telemetry, k.as_of, minutes), a.device_patient_map(k.basics), named_patients(k), k.conditions
    )


query("device_patient_map", "select * from v_assoc")(lambda k: a.device_patient_map(k.basics))
query("patient_names", "select * from v_names")(named_patients)
query("high_risk_conditions", "select * from v_high_risk")(lambda k: a.high_risk_conditions(k.conditions))
query(
    "enriched_clinical_alerts",
    f"select alert_id, {ts_text('alert_time')} as alert_time, device_id, patient_id, patient_name, alert_tier, alert_type, {VIT}, qualifying_conditions, escalated, {EMSG} as message from v_enriched v_e",
)(enriched)

CTES["v_place"] = """select e.patient_id, coalesce(l.name, 'Unknown (no Encounter Location match)') as location_name, coalesce(l.city, 'Unknown') as city, coalesce(l.state, '') as state, l.latitude, l.longitude
 from (select patient_id, location_id from v_encounters qualify row_number() over (partition by patient_id order by start_time desc, location_id desc) = 1) e
 left join (select * from v_locations where latitude is not null) l on l.location_id = e.location_id or l.id_orig = e.location_id"""


def places(k):
    loc = k.typed("locations").withColumnRenamed("location_id", "id")
    return a.patient_location(silver.encounter_locations(silver.encounters(k.silver("encounter"), with_locations=True)), loc)


query("patient_location", "select * from v_place")(places)
CTES["v_located"] = """select e.*, coalesce(p.location_name, 'Unknown (no Encounter Location match)') as location_name, coalesce(p.city, 'Unknown') as city, coalesce(p.state, '') as state, p.latitude, p.longitude
 from v_enriched_week e left join v_place p using (patient_id)"""


def located(k):
    return a.alert_location_map(enriched(k, WEEK), places(k))


LMSG = EMSG.replace("v_e.", "v_located.")
query(
    "alert_location_map",
    f"select {ts_text('alert_time')} as alert_time, device_id, patient_id, patient_name, alert_tier, alert_type, cast(spo2 as double) as spo2, pr, location_name, city, state, latitude, longitude, qualifying_conditions, escalated, {LMSG} as message from v_located",
)(located)
SITE = {"location_name": "General Hospital", "city": "Nashville", "state": "TN", "latitude": 36.1627, "longitude": -86.7816}
query(
    "alert_default_site",
    f"select {ts_text('alert_time')} as alert_time, device_id, alert_tier, alert_type, cast(spo2 as double) as spo2, pr, 'General Hospital' as location_name, 'Nashville' as city, 'TN' as state, cast(36.1627 as double) as latitude, cast(-86.7816 as double) as longitude, {HEAD.replace('(spo2', '(v_alerts.spo2')} || ' | Nashville, TN' as message from v_alerts",
)(lambda k: a.alert_default_site(a.clinical_alerts(k.telemetry, k.as_of, DAY, "plausible"), SITE))

# --- history ---
CTES["v_history"] = f"""select * from (
 select 'SPO2-' || device_id || '-' || strftime(ts, '%Y%m%d%H%M%S') as alert_id, ts as alert_time, device_id, {TIER_S.format(c='spo2')} as alert_tier, 'SPO2_LOW' as alert_type, 'spo2' as metric_name, cast(spo2 as double) as metric_value,
 cast(case when spo2 < 85 then 85 when spo2 < 90 then 90 else 94 end as double) as threshold_value,
 {TIER_S.format(c='spo2')} || ': Device ' || device_id || ' SpO2=' || {num_text('round(spo2, 1)')} || '% (threshold: ' || (case when spo2 < 85 then 85 when spo2 < 90 then 90 else 94 end) || '%)' as message from v_telemetry where spo2 < 94
 union all
 select 'PR-' || device_id || '-' || strftime(ts, '%Y%m%d%H%M%S'), ts, device_id, {TIER_P.format(lo='pr', hi='pr')}, case when pr > 110 then 'PR_HIGH' else 'PR_LOW' end, 'pr', cast(pr as double), cast(lim as double),
 {TIER_P.format(lo='pr', hi='pr')} || ': Device ' || device_id || ' PR=' || pr || ' bpm (threshold: ' || lim || ')' from
 (select *, case when pr > 150 then 150 when pr > 130 then 130 when pr > 110 then 110 when pr < 40 then 40 when pr < 45 then 45 else 50 end as lim from v_telemetry) where pr > 110 or pr < 50)"""


def history(k):
    return a.alert_history_transform(k.telemetry)


query(
    "alert_history_transform",
    f"select alert_id, {ts_text('alert_time')} as alert_time, device_id, '' as patient_id, '' as patient_name, alert_tier, alert_type, metric_name, metric_value, threshold_value, '' as qualifying_conditions, message, false as acknowledged, '' as acknowledged_by, cast(null as varchar) as acknowledged_at from v_history",
)(history)
CTES["v_history_day"] = window(DAY, "v_history", "alert_time")
CTES["v_history_week"] = window(WEEK, "v_history", "alert_time")
TIERS = "count(*) filter (where alert_tier = 'CRITICAL') as critical, count(*) filter (where alert_tier = 'URGENT') as urgent, count(*) filter (where alert_tier = 'WARNING') as warning"
query("tier_counts", f"select count(*) as open_alerts, {TIERS} from v_alerts_week")(
    lambda k: a.tier_counts(a.clinical_alerts(k.telemetry, k.as_of, WEEK))
)
query(
    "alerts_by_bin",
    f"select alert_tier, {ts_text('time_bucket(interval 15 minute, alert_time)')} as ts, count(*) as alert_count from v_history_day group by alert_tier, time_bucket(interval 15 minute, alert_time)",
)(lambda k: a.alerts_by_bin(history(k), k.as_of))
query(
    "noisy_devices",
    f"select device_id, count(*) as total_alerts, {TIERS}, {ts_text('max(alert_time)')} as last_alert, 1 as patients from v_history_week group by device_id order by total_alerts desc, device_id limit 10",
)(lambda k: a.noisy_devices(history(k), k.as_of, 168).withColumn("patients", F.col("patients").cast("int")))
query(
    "current_alert_severity",
    f"select alert_tier as severity, count(*) as alert_count, 1440 as window_minutes, {ts_text('(select as_of from v_as_of)')} as as_of_utc from v_history_day group by 1",
)(lambda k: a.current_alert_severity(history(k), k.as_of, DAY))
query(
    "clinical_aggregate_summary",
    f"""select * from (select count(*) as alert_count, {TIERS} from v_history_day), (select count(distinct device_id) as currently_reporting_devices, {ts_text('max(ts)')} as latest_event_time_utc from v_day),
 (select count(distinct device_id) as low_oxygen_devices from v_week where spo2 < 94)""",
)(lambda k: a.clinical_aggregate_summary(k.telemetry, history(k), k.as_of, DAY, DAY, WEEK))

# --- reports ---
AGE = rdiv("date_diff('second', alert_time, (select as_of from v_as_of))", "60", 1) + " as alert_age_minutes"
ACTION = "case alert_tier when 'CRITICAL' then 'Immediate bedside assessment / escalation' when 'URGENT' then 'Nurse review within 5 minutes' else 'Monitor trend and verify sensor placement' end as recommended_action"
RISK = "case when escalated then 'Escalated by clinical context' when qualifying_conditions = '' then 'No condition escalation' else 'Conditions: ' || qualifying_conditions end as risk_context"
ORDER = "order by case alert_tier when 'CRITICAL' then 1 when 'URGENT' then 2 when 'WARNING' then 3 else 4 end, v_e.alert_time desc, device_id limit"
query(
    "alert_feed",
    f"select alert_tier, {AGE}, {ts_text('alert_time')} as alert_time, device_id, patient_name, alert_type, cast(spo2 as double) as spo2, pr, signal_iq, {RISK}, {ACTION}, {EMSG} as message from v_enriched_week v_e {ORDER} 20",
)(lambda k: a.alert_feed(enriched(k, WEEK), k.as_of))
query(
    "triage_queue",
    f"""select alert_tier, {AGE}, {ts_text('alert_time')} as alert_time, device_id, patient_name, patient_id, alert_type, cast(spo2 as double) as spo2, pr, signal_iq,
 case when qualifying_conditions = '' then 'Vital-sign threshold only' else qualifying_conditions end as condition_summary, {RISK}, {ACTION}, 'New' as is_repeat_alert, {EMSG} as message from v_enriched v_e {ORDER} 100""",
)(lambda k: a.triage_queue(enriched(k), a.clinical_alerts(k.telemetry, k.as_of, WEEK), k.as_of))
query(
    "triage_queue_repeat",
    f"""select device_id, case when n > 1 then 'Repeat' else 'New' end as is_repeat_alert from v_enriched left join (select device_id, count(*) as n from v_history_week group by 1) using (device_id)""",
)(lambda k: a.triage_queue(enriched(k), a.alert_history_transform(k.telemetry).where(F.col("alert_time") > k.as_of - F.expr("interval 10080 minutes")), k.as_of, 100000).select("device_id", "is_repeat_alert"))
query(
    "alert_reasons",
    f"""select {ts_text('alert_time')} as alert_time, alert_tier, device_id, patient_name, case alert_type when 'SPO2_LOW' then 'SpO2 ' || {num_text('spo2')} || '% below threshold'
 when 'PR_ABNORMAL' then 'Pulse ' || pr || ' bpm outside threshold' else 'Multiple vital-sign thresholds breached' end as reason,
 case when escalated then 'Escalated by conditions: ' || qualifying_conditions when qualifying_conditions = '' then 'Vital-sign threshold only' else 'Conditions: ' || qualifying_conditions end as context, {ACTION} from v_enriched_week v_e {ORDER} 50""",
)(lambda k: a.alert_reasons(enriched(k, WEEK)))
CTES["v_both_windows"] = "select * from v_enriched union all select * from v_enriched_week"
CTES["v_risk_rows"] = """select device_id, patient_name, patient_id, max(alert_time) as latest, count(*) as n, count(*) filter (where alert_tier = 'CRITICAL') as critical, count(*) filter (where alert_tier = 'URGENT') as urgent, bool_or(escalated) as escalated,
 coalesce(array_to_string((list_sort(list_distinct(list(qualifying_conditions) filter (where qualifying_conditions <> ''))))[1:5], ', '), '') as conditions from v_both_windows group by 1, 2, 3"""
query(
    "patient_risk_context",
    f"""select device_id, patient_name, patient_id, {ts_text('latest')} as latest_alert, n as alert_count, critical, urgent,
 case when escalated then 'Escalated by conditions: ' || conditions when conditions = '' then 'Vital-sign threshold only' else 'Conditions: ' || conditions end as risk_context from v_risk_rows""",
)(lambda k: a.patient_risk_context(enriched(k).unionByName(enriched(k, WEEK))))
query(
    "alerts_by_point",
    f"select location_name, latitude, longitude, city, state, count(*) as alert_count, {TIERS}, count(distinct patient_name) as patients, count(distinct device_id) as devices from v_located group by 1, 2, 3, 4, 5",
)(lambda k: a.alerts_by_point(located(k)))
query("alerts_by_site", f"select location_name, count(*) as total, {TIERS} from v_located group by 1")(
    lambda k: a.alerts_by_site(located(k))
)
query(
    "alert_detail_device",
    f"select {ts_text('alert_time')} as alert_time, alert_tier, device_id, patient_name, cast(spo2 as double) as spo2, pr, alert_type, {EMSG} as message from v_enriched_week v_e where device_id in ('DEV-00001','DEV-00002','DEV-00005') order by v_e.alert_time desc, device_id limit 25",
)(lambda k: a.alert_detail_device(enriched(k, WEEK), ["DEV-00001", "DEV-00002", "DEV-00005"]))
query(
    "alert_detail_facility",
    f"select {ts_text('alert_time')} as alert_time, alert_tier, device_id, patient_name, alert_type, cast(spo2 as double) as spo2, pr, location_name, city, state, qualifying_conditions, {EMSG} as message from v_located v_e {ORDER} 100",
)(lambda k: a.alert_detail_facility(located(k)))


def triage(k):
    alerts = located(k).withColumn("acknowledged", F.col("alert_type") == "SPO2_LOW").withColumn("alert_tier", F.lower("alert_tier"))
    return a.triage_view(alerts, k.as_of, ["CRITICAL", "URGENT"], None, None, 60)


query(
    "triage_view",
    f"""select {ts_text('alert_time')} as alert_time, device_id, location_name, severity, status, is_stale from v_triage""",
)(lambda k: triage(k).select("alert_time", "device_id", "location_name", "severity", "status", "is_stale"))
CTES["v_triage"] = """select *, alert_tier as severity, date_diff('second', alert_time, (select as_of from v_as_of)) > 3600 as is_stale, case when alert_type = 'SPO2_LOW' then 'ACKNOWLEDGED' else 'OPEN' end as status
 from v_located where alert_tier in ('CRITICAL', 'URGENT')"""
query(
    "triage_totals",
    f"select count(*) as total, count(*) filter (where status = 'OPEN') as open, count(*) filter (where status = 'OPEN') as unresolved_urgent, count(*) filter (where is_stale) as stale, {ts_text('max(alert_time)')} as latest_alert from v_triage",
)(lambda k: a.triage_totals(triage(k)))
query(
    "notify_candidates",
    f"""select device_id, {ts_text('alert_time')} as alert_time, alert_id, alert_tier, coalesce(lead(r) over (partition by device_id order by r), n + 1) - r as suppressed_from
 from (select *, (select count(*) from v_ranked_alerts a where a.device_id = v_notified.device_id) as n from v_notified) where sent""",
)(lambda k: a.notify_candidates(history(k), 21600))
