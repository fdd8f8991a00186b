"""Payer stream queries: 30-day fraud window, 90-day cost window."""

from pyspark.sql import functions as F

from carespark.operators import payer as p

from .registry import CTES, num_text, query, ts_text

MONTH = 43200
VEL = (0.012, 0.008)
CTES["v_recent_claims"] = "select * from v_claims where event_timestamp > (select as_of from v_claims_as_of) - interval 43200 minute"
CTES["v_provider_stats"] = """select provider_id, count(*) as provider_claims, count(*) * 60.0::double / 43200.0::double as claims_per_hour,
 cast(sum(claim_amount) as double) / count(*) as avg_amount, stddev_samp(cast(claim_amount as double)) as stdev_amount,
 100.0::double * count(*) filter (where procedure_code = '99215') / count(*) as upcode_rate from v_recent_claims group by 1"""
CTES["v_fraud_points"] = """select c.*, s.claims_per_hour, case when stdev_amount > 0 then (cast(claim_amount as double) - avg_amount) / stdev_amount else 0 end as z from v_recent_claims c join v_provider_stats s using (provider_id)"""
HAS = "list_contains(string_split(injected_fraud_flags, '|'), '{}')"
CTES["v_fraud_slots"] = f"""select *, case when claims_per_hour >= 0.012 then 30 when claims_per_hour >= 0.008 then 15 else 0 end as pv,
 case when z >= 3 or {HAS.format('amount_outlier')} then 25 else 0 end as pa, case when {HAS.format('denial_pattern')} then 25 else 0 end as pd,
 case when procedure_code = '99215' or {HAS.format('upcoding')} then 20 else 0 end as pu from v_fraud_points"""
CTES["v_fraud"] = """select 'FRAUD-' || claim_id as score_id, (select as_of from v_claims_as_of) as score_timestamp, claim_id, patient_id, provider_id, cast(pv + pa + pd + pu as double) as fraud_score,
 replace((case when pv > 0 then 'velocity_burst' else '' end) || '|' || (case when pa > 0 then 'amount_outlier' else '' end) || '|' || (case when pd > 0 then 'denial_pattern' else '' end) || '|' ||
 (case when pu > 0 then 'upcoding' else '' end) || '|' || injected_fraud_flags, '||', '|') as fraud_flags,
 case when pv + pa + pd + pu >= 80 then 'CRITICAL' when pv + pa + pd + pu >= 50 then 'HIGH' when pv + pa + pd + pu >= 25 then 'MEDIUM' else 'LOW' end as risk_tier,
 latitude, longitude, cast(claim_amount as double) as claim_amount, diagnosis_code, procedure_code, claims_per_hour, round(z, 6) as amount_zscore from v_fraud_slots"""


def fraud(k):
    return p.fraud_risk(k.claims, k.claims_as_of, MONTH, VEL)


query(
    "provider_window_stats",
    "select provider_id, provider_claims, round(claims_per_hour, 8) as claims_per_hour, round(avg_amount, 3) as avg_amount, round(stdev_amount, 4) as stdev_amount, round(upcode_rate, 6) as upcode_rate from v_provider_stats",
)(
    lambda k: p.provider_window_stats(k.claims, k.claims_as_of, MONTH).select(
        "provider_id", "provider_claims", F.round("claims_per_hour", 8).alias("claims_per_hour"), F.round("avg_amount", 3).alias("avg_amount"),
        F.round("stdev_amount", 4).alias("stdev_amount"), F.round("upcode_rate", 6).alias("upcode_rate"),
    )
)
FCOLS = f"score_id, {ts_text('score_timestamp')} as score_timestamp, claim_id, patient_id, provider_id, fraud_score, fraud_flags, risk_tier, latitude, longitude, claim_amount, diagnosis_code, procedure_code, round(claims_per_hour, 8) as claims_per_hour, amount_zscore"
query("fraud_risk", f"select {FCOLS} from v_fraud")(
    lambda k: fraud(k).withColumn("amount_zscore", F.round("amount_zscore", 6)).withColumn("claims_per_hour", F.round("claims_per_hour", 8))
)
CTES["v_cost"] = """select *, case when s90 > 0 and s30 * 3 > s90 * 1.25 then 'ACCELERATING' when s90 > 0 and s30 >= s90 * 0.40 then 'RISING' else 'STABLE' end as cost_trend,
 'HIGHCOST-' || patient_id || '-' || strftime((select as_of from v_claims_as_of), '%Y%m%d%H%M%S') as alert_id from (
 select *, case when s30 > 100000 or ed >= 5 then 'CRITICAL' when s30 > 50000 or ed >= 3 then 'HIGH' when s30 > 15000 then 'MEDIUM' else 'LOW' end as risk_tier from (
 select patient_id, coalesce(sum(claim_amount) filter (where new), 0) as s30, sum(claim_amount) as s90,
 cast(count(*) filter (where new and (lower(claim_type) = 'emergency' or procedure_code in ('99281','99282','99283','99284','99285'))) as int) as ed, max(event_timestamp) as last_claim_time,
 arg_max(latitude, row(event_timestamp, substr(md5(claim_id), 1, 12))) as latitude, arg_max(longitude, row(event_timestamp, substr(md5(claim_id), 1, 12))) as longitude
 from (select *, event_timestamp > (select as_of from v_claims_as_of) - interval 30 day as new from v_claims where event_timestamp > (select as_of from v_claims_as_of) - interval 90 day) group by 1)) where risk_tier <> 'LOW'"""


def cost(k):
    return p.high_cost_trajectory(k.claims, k.claims_as_of)


query(
    "high_cost_trajectory",
    f"select alert_id, {ts_text('(select as_of from v_claims_as_of)')} as alert_timestamp, patient_id, cast(s30 as double) as rolling_spend_30d, cast(s90 as double) as rolling_spend_90d, ed as ed_visits_30d, false as readmission_flag, risk_tier, cost_trend, {ts_text('last_claim_time')} as last_claim_time, latitude, longitude from v_cost",
)(cost)
query(
    "top_fraud_providers",
    f"""select provider_id, fraud_score, risk_tier, fraud_flags, claim_id, patient_id, {ts_text('score_timestamp')} as score_timestamp from
 (select * from v_fraud qualify row_number() over (partition by provider_id order by score_timestamp desc, fraud_score desc, claim_id desc) = 1) order by fraud_score desc, provider_id limit 10""",
)(lambda k: p.top_fraud_providers(fraud(k)))
query(
    "high_cost_members",
    f"""select patient_id, risk_tier, cost_trend, cast(s30 as double) as rolling_spend_30d, cast(s90 as double) as rolling_spend_90d, case when s30 * 12 >= 1000000 then 'CATASTROPHIC' when s30 * 12 >= 500000 then 'VERY_HIGH' when s30 * 12 >= 100000 then 'HIGH' else 'MODERATE' end as projected_cost_band,
 cast(case risk_tier when 'CRITICAL' then 60 when 'HIGH' then 40 else 20 end + case cost_trend when 'ACCELERATING' then 25 when 'RISING' then 15 else 0 end + least(ed * 3, 15) as int) as high_cost_score,
 ed as ed_visits_30d, false as readmission_flag, {ts_text('(select as_of from v_claims_as_of)')} as refreshed_at from v_cost""",
)(lambda k: p.high_cost_members(cost(k)))
CTES["v_top_provider"] = "select * from (select * from v_fraud qualify row_number() over (partition by provider_id order by score_timestamp desc, fraud_score desc, claim_id desc) = 1) order by fraud_score desc, provider_id limit 1"
query(
    "provider_fraud_claims",
    f"""select c.provider_id, t.fraud_score as current_fraud_score, t.risk_tier as current_risk_tier, t.fraud_flags, c.claim_id, c.patient_id, c.claim_type, cast(c.claim_amount as double) as claim_amount, c.diagnosis_code, {ts_text('c.event_timestamp')} as event_timestamp, c.injected_fraud_flags
 from v_recent_claims c join v_top_provider t using (provider_id)""",
)(lambda k: p.provider_fraud_claims(fraud(k), k.claims, k.claims_as_of, MONTH))
query(
    "highest_priority_claim",
    f"select claim_id, patient_id, provider_id, fraud_score, risk_tier, fraud_flags, claim_amount, 'Score ' || {num_text('fraud_score')} || ' (' || risk_tier || ') from ' || fraud_flags as priority_reason, 'Route to SIU review' as recommended_action from v_fraud order by v_fraud.fraud_score desc, claim_amount desc, claim_id limit 1",
)(lambda k: p.highest_priority_claim(fraud(k)))
