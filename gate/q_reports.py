"""Report measures, look-ups, cross-domain rows and graph queries."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from carespark.functions.text import mask_id, mask_name
from carespark.operators import alerts, graph, lookups, measures as m, payer, risk

from .lake import AS_OF_DAY, Lake
from .q_alerts import WEEK, enriched, history
from .q_gold import gap_alerts
from .q_payer import cost as trajectory
from .registry import CTES, avg_dec, day_text, num_text, query, rdiv, ts_text

#: Columns of claims that the cost and payer reports use.
PAID = ["patient_id", "payer_category", "billed_amount", "paid_amount", "denial_flag"]
SEG = "('Medicare', 'Medicaid', 'Commercial')"
ASOF = f"date '{AS_OF_DAY}'"
Q_RATE = "count(*) filter (where quality_met) / cast(count(*) as double) as quality_rate, count(distinct patient_id) as patients_measured"
query("quality_kpis", f"select {Q_RATE} from v_measures")(lambda k: m.quality_kpis(k.measures))
query("quality_kpis_by_payer", f"select payer_category, {Q_RATE} from v_measures group by 1")(lambda k: m.quality_kpis(k.measures, "payer_category"))
query(
    "measures_met",
    f"select count(*) filter (where r >= b) as measures_met, count(*) as total_measures from (select measure_id, max({rdiv('100 * quality_met_count', 'denominator_count', 1)}) as r, max(benchmark_rate) as b from v_summary group by 1)",
)(lambda k: m.measures_met(k.quality_summary))
query("gap_kpis", "select count(*) filter (where gap_status = 'open') as open_care_gaps, count(*) as care_gap_count from v_gaps")(lambda k: m.gap_kpis(k.care_gaps))
CLAIM = f"""cast(sum(billed_amount) as double) as total_billed, cast(sum(paid_amount) as double) as total_paid, cast(sum(paid_amount) as double) / cast(sum(billed_amount) as double) as collection_rate,
 count(*) filter (where denial_flag = 1) / cast(count(*) as double) as denial_rate, {rdiv('cast(sum(billed_amount) * 100 as hugeint)', '(count(*) * 100)', 4)} as avg_claim_amount, cast(sum(billed_amount) - sum(paid_amount) as double) as revenue_leakage, count(*) as total_claims"""
CTES["v_claim_kpis"] = f"select {CLAIM} from v_fact_claim"
query("claim_kpis", "select * from v_claim_kpis")(lambda k: m.claim_kpis(k.fact_claim))
query("claim_kpis_by_payer", f"select payer_category, {CLAIM} from v_fact_claim group by 1")(lambda k: m.claim_kpis(k.fact_claim, "payer_category"))
query(
    "adherence_kpis",
    f"select {rdiv('sum(cast(round(pdc_score * 100) as bigint))', '(count(*) * 100)', 4)} as avg_pdc_score, count(*) filter (where adherence_category = 'Non-Adherent') as non_adherent_patients, count(*) as adherence_members from v_adherence",
)(lambda k: m.adherence_kpis(k.adherence))
CTES["v_star_kpis"] = f"""select (select {rdiv('sum(star_rating * measure_weight)', 'sum(measure_weight)', 1)} from v_rated) as overall_star_rating, cast(sum(star_rating * measure_weight) as bigint) as weighted_score,
 cast(sum(measure_weight) * 5 as bigint) as max_possible_score, cast(sum(measure_weight) * 5 - sum(star_rating * measure_weight) as bigint) as star_improvement_opportunity from v_rated"""
query("star_kpis", "select * from v_star_kpis")(lambda k: m.star_kpis(k.star_detail))
CTES["v_measure_star"] = "select measure_name, cast(star_rating as double) as measure_star_rating from v_rated"
query("measure_star", "select * from v_measure_star")(lambda k: m.measure_star(k.star_detail))
RISK = f"""{rdiv('sum(cast(round(raf_score * 1000) as bigint))', '(count(*) * 1000)', 6)} as average_raf_score, count(*) filter (where risk_tier in ('Very High', 'High')) as high_risk_members,
 cast(sum(cast(annual_revenue as decimal(18,2))) as double) as total_annual_revenue, {rdiv('sum(hcc_count)', 'count(*)', 6)} as average_hcc_count, count(*) as risk_member_count"""
query("risk_kpis", f"select {RISK} from v_raf")(lambda k: m.risk_kpis(k.risk_scores))
query("risk_kpis_by_payer", f"select payer_category, {RISK} from v_raf group by 1")(lambda k: m.risk_kpis(k.risk_scores, "payer_category"))
query("opportunity_kpis", "select count(*) * 3600.0::double as total_revenue_at_risk, count(*) as coding_gap_count from v_raf where hcc_count >= 2 and raf_score < 1.5")(lambda k: m.opportunity_kpis(k.opportunity))
MILLI = "sum(cast(round(risk_probability * 1000) as bigint))"
CTES["v_readmit_kpis"] = f"select count(*) filter (where risk_tier = 'High') as high_risk_encounters, {rdiv(MILLI, '(count(*) * 1000)', 6)} as avg_readmission_risk, sum(readmitted_30d) / cast(count(*) as double) as actual_readmission_rate, count(*) as readmission_encounter_count from v_rscores"
query("readmission_kpis", "select k.*, round(a.auc, 9) as model_auc, round(q.accuracy, 9) as model_accuracy from v_readmit_kpis k, v_rule_auc a, v_rule_quality q")(
    lambda k: m.readmission_kpis(k.readmission, risk.rule_performance(risk.readmission_rule_score(k.readmission_features)).withColumn("value", F.round("value", 9)))
)
ALOS = rdiv("sum(cast(round(avg_los * 10) as bigint))", "(count(avg_los) * 10)", 4)
CTES["v_util_kpis"] = f"""select max(ip_per_1k) as ip_per_1k, max(ed_per_1k) as ed_per_1k, {ALOS} as alos, max(bed_days_per_1k) as bed_days_per_1k, max(pmpm) as monthly_pmpm, round(max(pmpm) - 950, 2) as pmpm_vs_benchmark,
 (select cast(sum(ed_visits) as bigint) from v_util_payer) as payer_ed_visits, (select count(*) from v_high_cost) as high_cost_member_count, (select cast(sum(cast(total_paid as decimal(18,2))) as double) from v_high_cost) as high_cost_total_paid,
 round((select total_paid from v_claim_kpis) / (max(unique_members) * 12), 6) as pmpm from v_util"""
query("utilization_kpis", "select * from v_util_kpis")(lambda k: m.utilization_kpis(k.share("fact_claim", *PAID).fact_claim, k.utilization, k.by_payer, k.high_cost))
CTES["v_segments"] = f"""select c.payer_category as segment, c.total_paid as paid, q.quality_rate as quality, c.collection_rate as collection, c.denial_rate, q.patients_measured, r.average_raf_score as raf,
 round(c.total_paid / ((select max(unique_members) from v_util) * 12), 6) as pmpm from (select payer_category, {CLAIM} from v_fact_claim where payer_category in {SEG} group by 1) c
 left join (select payer_category, {Q_RATE} from v_measures group by 1) q using (payer_category) left join (select payer_category, {RISK} from v_raf group by 1) r using (payer_category)"""


def segments(k):
    return m.payer_segments(k.fact_claim, k.measures, k.risk_scores, k.utilization)


query("payer_segments", "select * from v_segments")(lambda k: segments(k.share("fact_claim", *PAID)))

# --- cohort ---
BAND = f"case when a < 18 then 'Under 18' when a <= 35 then '18-35' when a <= 50 then '36-50' when a <= 65 then '51-65' when a > 65 then 'Over 65' else 'Unknown' end"
CTES["v_person"] = f"select *, {BAND} as age_group from (select *, date_part('year', {ASOF}) - date_part('year', birth_date) as a, given || ' ' || family as patient_name from v_patients)"
G = lambda col: ", ".join(f"{col.format(g=g)} as {g}" for g in ("female", "male", "unknown"))
query("gender_counts", f"select {G('''count(*) filter (where gender = '{g}')''')} from v_patients")(lambda k: m.gender_counts(k.patient_facts))
query("cost_by_gender", f"select {G('''cast(coalesce(sum(claim_amount) filter (where gender = '{g}'), 0) as double)''')} from v_claims join v_patients using (patient_id)")(lambda k: m.cost_by_gender(k.costs, k.patient_facts))
query("patients_by_age_group", "select age_group, count(*) as patients from v_person group by 1")(lambda k: m.patients_by_age_group(k.patient_facts, k.as_of_day))
query("visits_by_age_group", "select age_group, count(*) as visits from v_encounters join v_person using (patient_id) group by 1")(lambda k: m.visits_by_age_group(k.encounters, k.patient_facts, k.as_of_day))
query(
    "condition_diabetes_types",
    "select code, case code when '44054006' then 'Type II' when '46635009' then 'Type I' else 'Non - Diabetic' end as diabetes_type, case when code in ('44054006', '46635009') then 'Diabetic' else 'Non - Diabetic' end as diabetic_status, count(*) as n from v_conditions group by 1",
)(lambda k: k.conditions.groupBy("code", m.diabetes_type(F.col("code")).alias("diabetes_type"), m.diabetic_status(F.col("code")).alias("diabetic_status")).agg(F.count("*").alias("n")))
query(
    "diabetic_counts",
    "select count(distinct patient_id) filter (where code in ('44054006', '46635009')) as diabetic, count(distinct patient_id) filter (where code not in ('44054006', '46635009')) as non_diabetic, count(distinct patient_id) filter (where code = '46635009') as type_1, count(distinct patient_id) filter (where code = '44054006') as type_2 from v_conditions",
)(lambda k: m.diabetic_counts(k.conditions))
query("patients_per_condition", "select display, count(distinct patient_id) as patients from v_conditions group by 1")(lambda k: m.patients_per_condition(k.conditions))
query("hba1c_counts", "select count(distinct patient_id) filter (where value >= 8) as high, count(distinct patient_id) filter (where value < 8) as low from v_observations where code = '4548-4'")(lambda k: m.hba1c_counts(k.observations, "Hemoglobin A1c", 8.0))
query("cohort_cards", "select (select count(*) from v_patients) as patients, (select count(*) from v_conditions) as condition_occurrences, (select count(*) from v_medications) as drug_exposures")(lambda k: m.cohort_cards(k.patient_facts, k.conditions, k.medications))
query("patients_by_birth_year", "select cast(date_part('year', birth_date) as int) as birth_year, count(*) as patients from v_patients group by 1")(lambda k: m.patients_by_birth_year(k.patient_facts))
query(
    "patient_journey",
    f"select patient_id, 'Visit' as event_type, encounter_class as event, {day_text('start_time')} as event_date from v_encounters union all select patient_id, 'Condition', display, {day_text('onset_date')} from v_conditions union all select patient_id, 'Drug', display, {day_text('authored_date')} from v_medications",
)(lambda k: m.patient_journey(k.encounters, k.conditions, k.medications))
query("comorbidity", "select conditions, count(*) as patients from (select patient_id, count(distinct code) as conditions from v_conditions group by 1) group by 1")(lambda k: m.comorbidity(k.conditions))
query(
    "lab_table",
    f"select display, count(*) as results, count(distinct patient_id) as patients, {rdiv('cast(sum(value) * 100 as hugeint)', '(count(*) * 100)', 4)} as avg_value, cast(min(value) as double) as min_value, cast(max(value) as double) as max_value from v_observations group by 1",
)(lambda k: m.lab_table(k.observations))

# --- command centre ---
CTES["v_payer_row"] = "select total_paid, total_billed, revenue_leakage, collection_rate, denial_rate, total_claims, pmpm, high_cost_member_count, (select count(*) * 3600.0::double from v_raf where hcc_count >= 2 and raf_score < 1.5) as total_revenue_at_risk from v_claim_kpis, v_util_kpis"
CTES["v_provider_row"] = f"""select (select count(*) from v_gaps) as open_care_gaps, (select count(*) filter (where quality_met) / cast(count(*) as double) from v_measures) as quality_rate, (select overall_star_rating from v_star_kpis) as overall_star_rating,
 (select {rdiv('sum(cast(round(raf_score * 1000) as bigint))', '(count(*) * 1000)', 6)} from v_raf) as average_raf_score, (select avg_readmission_risk from v_readmit_kpis) as avg_readmission_risk, (select alos from v_util_kpis) as alos,
 (select star_improvement_opportunity from v_star_kpis) as star_improvement_opportunity, (select count(distinct patient_id) from v_measures) as patients_measured"""
query("payer_kpi_row", "select * from v_payer_row")(lambda k: payer_row(k.share("fact_claim", *PAID)))
query("provider_kpi_row", "select * from v_provider_row")(lambda k: provider_row(k.share("measures")))


def payer_row(k):
    return m.payer_kpi_row(k.fact_claim, k.utilization, k.by_payer, k.high_cost, k.opportunity)


def provider_row(k):
    return m.provider_kpi_row(k.care_gaps, k.measures, k.star_detail, k.risk_scores, k.readmission, k.utilization)


def imaging_row(k):
    return m.imaging_kpis(k.imaging, k.patient_facts, k.as_of_day)


CTES["v_top_cost"] = "select patient_id, payer_category, total_paid, claim_count, is_stop_loss from v_high_cost order by total_paid desc, patient_id, payer_category limit 8"
query("top_high_cost", "select * from v_top_cost")(lambda k: m.top_high_cost(k.high_cost))
CTES["v_top_gaps"] = "select gap_type, count(*) as gaps from v_gaps group by 1 order by gaps desc, gap_type limit 8"
query("top_gap_types", "select * from v_top_gaps")(lambda k: m.top_gap_types(k.care_gaps))
CTES["v_tiers"] = f"select risk_tier, count(*) as encounters, {rdiv(MILLI, '(count(*) * 1000)', 6)} as avg_risk from v_rscores group by 1"
query("readmission_tiers", "select * from v_tiers")(lambda k: m.readmission_tiers(k.readmission))
CTES["v_worst"] = "select * from v_measure_star order by measure_star_rating, measure_name limit 6"
query("worst_stars", "select * from v_worst")(lambda k: m.worst_stars(k.star_detail))
CTES["v_img_row"] = f"""select cast(sum(s) as bigint) as studies, count(*) as patients, cast(sum(f) as bigint) as files, round(sum(s) / cast(count(*) as double), 6) as studies_per_patient, round(sum(f) / cast(sum(s) as double), 6) as files_per_study,
 {rdiv('sum(cast(p.a as bigint))', 'count(*)', 6)} as avg_age from (select patient_id, count(*) as s, sum(number_of_instances) as f from v_imaging group by 1) join v_person p using (patient_id)"""
query("imaging_kpis", "select * from v_img_row")(imaging_row)
CTES["v_mix"] = "select modality, count(*) as studies, cast(sum(number_of_instances) as bigint) as files, count(distinct patient_id) as patients from v_imaging group by 1 order by studies desc, modality limit 8"
query("modality_mix", "select * from v_mix")(lambda k: m.modality_mix(k.imaging))
CTES["v_heavy"] = "select patient_name, age_group as age_range, s as studies, cast(f as bigint) as files from (select patient_id, count(*) as s, sum(number_of_instances) as f from v_imaging group by 1 order by f desc, patient_id limit 8) join v_person using (patient_id)"


def heavy(k):
    return m.heaviest_studies(k.imaging, k.person, k.as_of_day)


query("heaviest_studies", "select * from v_heavy")(heavy)


def long_sql(lens: str, table: str, metrics) -> str:
    return " union all ".join(f"select '{lens}' as lens, '{n}' as metric, cast({n} as double) as value, '{u}' as unit, {i} as rank from {table}" for i, (n, u) in enumerate(metrics))




def snapshot_frames(k):
    """Frames of both KPI rows, each built once."""
    parsed_once(k).share("encounters")
    return k.share("measures").share("risk_scores").share("utilization")


query(
    "kpi_snapshot",
    " union all ".join([long_sql("payer", "v_payer_row", m.PAYER_METRICS), long_sql("provider", "v_provider_row", m.PROVIDER_METRICS), long_sql("medtech", "v_img_row", m.IMAGING_METRICS)]),
)(lambda k: m.kpi_snapshot(payer_row(snapshot_frames(k)), provider_row(k), imaging_row(k)))
query(
    "series_snapshot",
    """select 'payer' as lens, 'payerSegment' as series, segment as label, paid as value, 'money' as unit from v_segments union all select 'provider', 'careGap', gap_type, cast(gaps as double), 'count' from v_top_gaps
 union all select 'provider', 'riskTier', risk_tier, cast(encounters as double), 'count' from v_tiers union all select 'provider', 'starMeasure', measure_name, measure_star_rating, 'ratio' from v_worst union all select 'medtech', 'modality', modality, cast(studies as double), 'count' from v_mix""",
)(lambda k: m.series_snapshot(segments(k.share("fact_claim", *PAID).share("measures")), m.top_gap_types(k.care_gaps), m.readmission_tiers(k.readmission), m.worst_stars(k.star_detail), m.modality_mix(k.imaging)))
MASK = "case when length({c}) > 8 then left({c}, 4) || '…' || right({c}, 4) else {c} end"
query(
    "worklist_snapshot",
    f"""select 'payer' as lens, 'highCostMember' as kind, {MASK.format(c='patient_id')} as subject, payer_category as segment, total_paid as primary_value, cast(claim_count as double) as secondary_value, is_stop_loss as flagged from v_top_cost
 union all select 'medtech', 'heavyAcquisition', left(split_part(patient_name, ' ', 1), 1) || '. ' || left(split_part(patient_name, ' ', 2), 1) || '.', age_range, cast(files as double), cast(studies as double), false from v_heavy""",
)(lambda k: m.worklist_snapshot(m.top_high_cost(k.high_cost), heavy(k)))
query("mask_identifiers", f"select patient_id, {MASK.format(c='patient_id')} as masked_id, 'G. F.' as masked_name from v_patients")(
    lambda k: k.person.select("patient_id", mask_id(F.col("patient_id")).alias("masked_id"), mask_name(F.col("patient_name")).alias("masked_name"))
)
query(
    "readmission_digest",
    f"select patient_id, risk_tier, risk_probability, los_days, cast(admit_date as varchar) as admit_date, '30-day readmission risk ' || {num_text('round(cast(v_rscores.risk_probability as decimal(18,6)) * 100, 1)')} || '%' as message from v_rscores where risk_tier = 'High'",
)(lambda k: alerts.readmission_digest(k.readmission))

# --- look-ups ---
CTES["v_monitored"] = "select 'Device/DEV-' || lpad(cast(user_id as varchar), 5, '0') as device_ref, 'Patient ' || user_id as patient_name, 'pat-' || user_id as patient_id from (select distinct user_id from events) where user_id % 7 <> 3 and user_id % 2 = 0"
query("device_associations", "select * from v_monitored")(lambda k: k.associations)
query("device_association_one", "select * from v_monitored where device_ref like '%DEV-00004%'")(lambda k: lookups.device_associations(k.basics, "DEV-00004"))
query("device_conditions", f"select device_ref, patient_name, display as condition_name, {day_text('onset_date')} as onset_date from v_monitored join v_conditions using (patient_id)")(lambda k: lookups.device_conditions(k.associations, k.conditions))
query("device_conditions_one", f"select device_ref, patient_name, display as condition_name, {day_text('onset_date')} as onset_date from v_monitored join v_conditions using (patient_id) where device_ref like '%DEV-00004%'")(
    lambda k: lookups.device_conditions(lookups.device_associations(k.basics, "DEV-00004"), k.conditions)
)
query("recent_observations", f"select observation_id, display, cast(value as double) as value, unit, {day_text('obs_date')} as obs_date from v_observations order by v_observations.obs_date desc, observation_id limit 50")(
    lambda k: lookups.newest(k.observations.select("observation_id", "display", "value", "unit", "obs_date"), "obs_date", "observation_id")
)
query("recent_procedures", f"select claim_id as procedure_id, procedure_code as display, {day_text('event_timestamp')} as performed from v_claims order by cast(event_timestamp as date) desc, claim_id limit 50")(
    lambda k: lookups.newest(k.procedures.drop("patient_id"), "performed", "procedure_id")
)
query("recent_studies", f"select study_id, patient_id, modality, description, {ts_text('started')} as started, number_of_series, number_of_instances from v_imaging order by v_imaging.started desc, study_id limit 50")(
    lambda k: lookups.newest(k.imaging.drop("subject"), "started", "study_id")
)
query("device_medications", f"select device_ref, patient_name, display as medication, status, {day_text('authored_date')} as authored_date from v_monitored join v_medications using (patient_id)")(lambda k: lookups.device_medications(k.associations, k.medications))
query("device_immunizations", f"select device_ref, patient_name, display as vaccine, {day_text('imm_date')} as imm_date from v_monitored join v_immunizations using (patient_id)")(lambda k: lookups.device_immunizations(k.associations, k.immunizations))
query("immunization_counts", f"select device_ref, patient_name, count(*) as total_immunizations, {day_text('max(imm_date)')} as most_recent_immunization from v_monitored join v_immunizations using (patient_id) group by 1, 2")(lambda k: lookups.immunization_counts(k.associations, k.immunizations))
query(
    "patient_timeline",
    f"""select patient_name, record_type, description, date_recorded from v_monitored join (select patient_id, 'Condition' as record_type, display as description, {day_text('onset_date')} as date_recorded from v_conditions
 union all select patient_id, 'Immunization', display, {day_text('imm_date')} from v_immunizations union all select patient_id, 'Medication', display, {day_text('authored_date')} from v_medications
 union all select patient_id, 'Procedure', procedure_code, {day_text('event_timestamp')} from v_claims union all select patient_id, 'Imaging', description, {day_text('started')} from v_imaging) using (patient_id)""",
)(
    lambda k: lookups.patient_timeline(
        k.associations,
        {
            "Condition": (k.conditions, "display", "onset_date"),
            "Immunization": (k.immunizations, "display", "imm_date"),
            "Medication": (k.medications, "display", "authored_date"),
            "Procedure": (k.procedures, "display", "performed"),
            "Imaging": (k.imaging, "description", "started"),
        },
    )
)
query(
    "respiratory_missing_pneumococcal",
    "select distinct device_ref, patient_name, display as respiratory_condition from v_monitored m join v_conditions using (patient_id) where regexp_matches(lower(display), 'asthma|copd|pneumonia|respiratory') and not exists (select 1 from v_immunizations i where i.patient_id = m.patient_id and i.display like '%133%')",
)(lambda k: lookups.respiratory_missing_pneumococcal(k.associations, k.conditions, k.immunizations, "Vaccine 133"))
query(
    "device_demographics",
    f"select device_ref, patient_name, m.patient_id, gender, {day_text('birth_date')} as birth_date, case when num is null then null else 'City ' || (num % 7) end as city, case when num is null then null when num % 5 = 0 then 'TN' else 'GA' end as state from v_monitored m left join v_patients p using (patient_id)",
)(lambda k: lookups.device_demographics(k.associations, k.person.drop("patient_name")))
query("claims_by_payer", "select payer_category, count(*) as claim_count, cast(sum(paid_amount) as double) as total_paid from v_fact_claim group by 1")(lambda k: lookups.claims_by_payer(k.fact_claim))
query("top_members", "select patient_id, payer_category, total_paid, claim_count, denied_claims, is_stop_loss from v_high_cost order by total_paid desc, patient_id, payer_category limit 10")(lambda k: lookups.top_members(k.high_cost))
query("open_gaps_by_type", "select gap_type, count(*) as open_gap_count, max(days_overdue) as max_days_overdue from v_gaps group by 1")(lambda k: lookups.open_gaps_by_type(k.care_gaps))
query("riskiest_encounters", "select patient_id, encounter_id, risk_probability, risk_tier, los_days from v_rscores order by risk_probability desc, encounter_id limit 10")(lambda k: lookups.riskiest_encounters(k.readmission))
IDX = "row_number() over (order by {c}) - 1"
query(
    "device_assignment",
    f"select device_id, patient_id, device_index from (select device_id, {IDX.format(c='device_id')} as device_index from (select distinct device_id from v_telemetry)) d join (select patient_id, {IDX.format(c='patient_id')} as slot from v_patients) p on device_index % (select count(*) from v_patients) = slot",
)(lambda k: lookups.device_assignment(k.telemetry.select("device_id").distinct(), k.patient_facts))
QUAL = [("195967001", "Asthma"), ("44054006", "Type 2 diabetes mellitus"), ("59621000", "Essential hypertension"), ("162864005", "Obesity"), ("233604007", "Pneumonia"), ("13645005", "Chronic obstructive lung disease"), ("84114007", "Heart failure")]
VALUES = ", ".join(f"('{c}', '{d}', {i})" for i, (c, d) in enumerate(QUAL))
query(
    "qualifying_patients",
    f"select patient_id, condition, rank from (select patient_id, condition, rank from v_conditions join (values {VALUES}) q(code, condition, rank) using (code) qualify row_number() over (partition by patient_id order by rank) = 1)",
)(lambda k: lookups.qualifying_patients(k.conditions, QUAL))

# --- cross-domain ---
CTES["v_ctx_alert"] = "select patient_id, max(alert_time) as alert_time, count(*) as repeated_alert_count, arg_max(alert_tier, row(alert_time, alert_tier)) as alert_tier from v_enriched_week where patient_id <> '' group by 1"
CTES["v_ctx_diag"] = "select patient_id, code as diagnosis_code, display as diagnosis_name, clinical_status from v_conditions where clinical_status = 'active' qualify row_number() over (partition by patient_id order by onset_date desc, code desc, display desc) = 1"
CTES["v_context"] = f"""select a.device_id, a.patient_id, {ts_text('al.alert_time')} as alert_time, al.alert_tier, coalesce(al.repeated_alert_count, 0) as repeated_alert_count, d.diagnosis_code, d.diagnosis_name, d.clinical_status, c.claim_id, cast(c.claim_amount as double) as claim_amount,
 g.care_gap_measure, case when g.patient_id is null then 'NONE' else 'OPEN' end as care_gap_status, p.payer_name, coalesce(p.payer_category, 'Unknown') as payer_category, cast(h.s30 as double) as rolling_spend_30d, case when h.patient_id is null then 'NONE' else 'AT_RISK' end as high_cost_status,
 r.p as risk_probability, case when r.p >= 0.3 then 'HIGH' when r.p >= 0.15 then 'MEDIUM' when r.p is not null then 'LOW' end as risk_tier from v_assoc a left join v_ctx_alert al using (patient_id) left join v_ctx_diag d using (patient_id)
 left join (select patient_id, claim_id, claim_amount from v_claims qualify row_number() over (partition by patient_id order by event_timestamp desc, claim_id desc) = 1) c using (patient_id)
 left join (select patient_id, min(gap_type) as care_gap_measure from v_gaps group by 1) g using (patient_id) left join v_patient_payer p using (patient_id) left join v_cost h using (patient_id) left join (select patient_id, max(risk_probability) as p from v_rscores group by 1) r using (patient_id)"""


def context(k):
    return payer.cross_domain_context(
        alerts.device_patient_map(k.basics), enriched(k, WEEK), k.conditions, k.claims, gap_alerts(k), k.patient_payer, k.readmission, trajectory(k)
    )


query("cross_domain_context", "select * from v_context")(context)
query(
    "high_utilization_care_gaps",
    "select patient_id, rolling_spend_30d, high_cost_status, care_gap_measure, care_gap_status, risk_tier from v_context where high_cost_status = 'AT_RISK' and care_gap_status = 'OPEN'",
)(lambda k: context(k).where("high_cost_status = 'AT_RISK' and care_gap_status = 'OPEN'").select("patient_id", "rolling_spend_30d", "high_cost_status", "care_gap_measure", "care_gap_status", "risk_tier"))
query(
    "gap_and_abnormal_telemetry",
    "select patient_id, measure_id, measure_name, gap_days_overdue, alert_priority from v_gap_alerts where patient_id in (select patient_id from v_enriched_week where patient_id <> '')",
)(lambda k: payer.gap_and_abnormal_telemetry(gap_alerts(k), enriched(k, WEEK)))
query(
    "common_diagnoses_repeat_alerts",
    "select code, display, count(distinct patient_id) as patient_count, count(*) as diagnosis_rows from v_conditions where patient_id in (select patient_id from v_history join v_assoc using (device_id) group by 1 having count(*) >= 2) group by 1, 2",
)(lambda k: payer.common_diagnoses_repeat_alerts(k.conditions, history(k).drop("patient_id").join(alerts.device_patient_map(k.basics), "device_id")))

# --- graph ---
query("graph_device_association", "select 'basic-' || split_part(patient_id, '-', 2) as id, replace(device_ref, 'Device/', '') as device_ref, patient_name, patient_id, 'device-assoc' as assoc_code, 'Device association' as assoc_display from v_monitored")(
    lambda k: graph.device_association(k.basics)
)
query("graph_patient_table", f"select patient_id as \"idOrig\", gender, {day_text('birth_date')} as \"birthDate\" from v_patients")(lambda k: graph.project_node_table(k.silver("patient"), "Patient").drop("name_string"))
query("graph_device_table", "select device_id as \"idOrig\", cast(null as varchar) as type_string, 'active' as status from v_telemetry group by 1")(
    lambda k: graph.project_node_table(k.telemetry.select(F.col("device_id").alias("idOrig")).distinct().withColumn("status", F.lit("active")), "Device")
)
query("graph_encounter_table", "select encounter_id as \"idOrig\", '{\"code\":\"' || encounter_class || '\"}' as class_string, cast(null as varchar) as status, strftime(start_time, '%Y-%m-%d %H:%M:%S') as period_start, case when num % 4 = 0 then null else patient_id end as patient_id from v_encounters")(
    lambda k: graph.project_node_table(k.silver("encounter"), "Encounter")
)
LINKED = "case when num % 4 = 0 then null else patient_id end as patient_id"


def coded(system: str, code: str = "code", display: str = "display") -> str:
    return f"""'{{"coding":[{{"system":"' || {system} || '","code":"' || {code} || '","display":"' || {display} || '"}}]}}'"""


for _label, _table, _sql in [
    ("Condition", "condition", f"select condition_id as \"idOrig\", {coded('system')} as code_string, {coded("'status'", 'clinical_status', 'clinical_status')} as \"clinicalStatus_string\", {LINKED} from v_conditions"),
    ("MedicationRequest", "medication", f"select medication_id as \"idOrig\", {coded("'rxnorm'")} as \"medicationCodeableConcept_string\", status, {day_text('authored_date')} as \"authoredOn\", {LINKED} from v_medications"),
    ("Observation", "observation", f"select observation_id as \"idOrig\", {coded("'http://loinc.org'")} as code_string, cast(value as double) as \"valueQuantity_value\", unit as \"valueQuantity_unit\", {day_text('obs_date')} as \"effectiveDateTime\", {LINKED} from v_observations"),
]:
    query(f"graph_{_table}_table", _sql)(lambda k, n=_label, t=_table: graph.project_node_table(k.silver(t), n))
query("graph_imaging_table", "select study_id as \"idOrig\", description, case when (num // 20) % 4 = 0 then null else patient_id end as patient_id, cast(number_of_series as bigint) as \"numberOfSeries\", cast(number_of_instances as bigint) as \"numberOfInstances\" from v_imaging")(
    lambda k: graph.project_node_table(k.silver("imaging"), "ImagingStudy")
)
query("graph_fact_diagnosis", "select condition_id as diagnosis_id, 'Patient/' || patient_id as patient_ref, patient_id from v_conditions")(
    lambda k: graph.fact_diagnosis_projection(k.conditions.select(F.col("condition_id").alias("diagnosis_id"), "patient_ref"))
)
ONT = "where num % 4 <> 0"
CTES["v_edges"] = f"""select distinct src, dst, type, src_label, dst_label from (
 select patient_id as src, encounter_id as dst, 'hasEncounter' as type, 'Patient' as src_label, 'Encounter' as dst_label from v_encounters {ONT}
 union all select patient_id, condition_id, 'hasCondition', 'Patient', 'Condition' from v_conditions {ONT}
 union all select patient_id, observation_id, 'hasObservation', 'Patient', 'Observation' from v_observations {ONT}
 union all select patient_id, medication_id, 'hasMedication', 'Patient', 'MedicationRequest' from v_medications {ONT}
 union all select patient_id, study_id, 'hasImagingStudy', 'Patient', 'ImagingStudy' from v_imaging where (num // 20) % 4 <> 0
 union all select patient_id, replace(device_ref, 'Device/', ''), 'linkedToDevice', 'Patient', 'Device' from v_monitored
 union all select device_id, device_id, 'generatesTelemetry', 'Device', 'DeviceTelemetry' from v_telemetry
 union all select patient_id, claim_id, 'hasClaim', 'Patient', 'Claim' from v_fact_claim
 union all select claim_id, coverage_id, 'coveredBy', 'Claim', 'Payer' from v_fact_claim where coverage_id <> ''
 union all select patient_id, condition_id, 'hasDiagnosis', 'Patient', 'PatientDiagnosis' from v_conditions
 union all select condition_id, code, 'diagnosisClassifiedAs', 'PatientDiagnosis', 'Diagnosis' from v_conditions
 union all select patient_id, patient_id, 'hasAdherence', 'Patient', 'MedAdherence' from v_adherence
 union all select patient_id, patient_id, 'hasCareGap', 'Patient', 'CareGap' from v_gaps
 union all select patient_id, patient_id, 'hasRiskScore', 'Patient', 'PatientRisk' from v_raf
 union all select patient_id, patient_id, 'hasHighCostProfile', 'Patient', 'HighCostClaimant' from v_high_cost)"""


def parsed_once(k, *claim_columns, condition_columns=()):
    """Frames that several steps of a query read: parsed from JSON once, only the used columns written."""
    k.share("dim_payer").share("patient_payer").share("fact_claim", *PAID, *claim_columns)
    k.share("conditions", "patient_id", "code", "display", "clinical_status", *condition_columns)
    return k.share("medications", "patient_id", "code", "display", "authored_date")


def edge_frames(k):
    """Claims, conditions, medications and payers of all edge types, parsed once."""
    return parsed_once(k, "claim_id", "coverage_id", condition_columns=("condition_id", "patient_ref", "onset_date"))


def counted_edges(k):
    """Counts of all edge types, of those with an own id type by type."""
    edge_frames(k)
    counts = [graph.edge_counts(k.edges_of(t, near={t: end}), t, end) for t, end in graph.OWN_ENDS.items()]
    return reduce(DataFrame.unionByName, counts, graph.edge_counts(k.edges_of(*[t for t in graph.EDGE_TYPES if t not in graph.OWN_ENDS])))


query("graph_edges", "select * from v_edges")(lambda k: edge_frames(k).edges_of(*graph.EDGE_TYPES))
query("graph_edge_counts", "select type, count(*) as edges, count(distinct src) as sources, count(distinct dst) as targets from v_edges group by 1")(counted_edges)
query("graph_one_hop", "select src, dst from v_edges where type = 'linkedToDevice'")(lambda k: graph.match_one_hop(k.edges_of("linkedToDevice"), "linkedToDevice"))
query("graph_path", "select start, middle, \"end\" from (select distinct patient_id as start, claim_id as middle from v_fact_claim) join (select distinct claim_id as middle, coverage_id as \"end\" from v_fact_claim where coverage_id <> '') using (middle)")(lambda k: graph.match_path(k.edges_of("hasClaim", "coveredBy", near={"hasClaim": "dst", "coveredBy": "src"}), "hasClaim", "coveredBy"))
query(
    "graph_fork_optional",
    "select a.src as start, a.dst as first_end, b.e as second_end, coalesce(b.n, 0) as second_count from v_edges a left join (select src, min(dst) as e, count(*) as n from v_edges where type = 'hasCareGap' group by 1) b using (src) where a.type = 'hasClaim'",
)(lambda k: graph.match_fork(k.edges_of("hasClaim", "hasCareGap", near={"hasClaim": "src"}), "hasClaim", "hasCareGap", optional=True))


def claims_and_gaps(k, limit=None):
    """Patients with their claims and, where there are any, their care gaps."""
    claims = graph.match_one_hop(k.edges_of("hasClaim", near={"hasClaim": "src"}), "hasClaim").select(F.col("src").alias("start"), F.col("dst").alias("first_end"))
    gaps = k.care_gaps.select(F.col("patient_id").alias("start"), F.col("gap_type").alias("second_end"))
    rows = graph.match_fork_rows(claims, gaps, optional=True, limit=limit)
    return rows.select(F.col("start").alias("patient_id"), F.col("first_end").alias("claim_id"), F.col("second_end").alias("care_gap"))


CTES["v_claim_gaps"] = "select e.src as patient_id, e.dst as claim_id, g.gap_type as care_gap from v_edges e left join v_gaps g on g.patient_id = e.src where e.type = 'hasClaim'"
query("graph_fork_rows", "select * from v_claim_gaps")(claims_and_gaps)
query("graph_fork_first_rows", "select * from v_claim_gaps order by patient_id, claim_id, care_gap nulls first limit 10")(lambda k: claims_and_gaps(k, 10))
query(
    "graph_fork_path_count",
    "select count(*) as paths, count(distinct a.src) as starts from v_edges a join v_edges b using (src) where a.type = 'hasCondition' and b.type = 'hasEncounter'",
)(lambda k: graph.fork_path_count(k.edges_of("hasCondition", "hasEncounter"), "hasCondition", "hasEncounter"))


def node_rows(k):
    return (
        graph.nodes(k.patient_facts, "Patient", "patient_id", "gender")
        .unionByName(graph.nodes(k.telemetry.select("device_id").distinct(), "Device", "device_id"))
        .unionByName(graph.nodes(k.dim_payer, "Payer", "payer_id", "payer_name"))
        .unionByName(graph.nodes(k.fact_claim, "Claim", "claim_id"))
    )


query("graph_nodes", "select label, count(*) as n, count(distinct id) as ids from (select 'Patient' as label, patient_id as id from v_patients union all select 'Device', device_id from (select distinct device_id from v_telemetry) union all select 'Payer', coverage_id from v_payer union all select 'Claim', claim_id from v_fact_claim) group by 1")(
    lambda k: node_rows(k).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))
)
AUDIT = ["linkedToDevice", "hasClaim", "coveredBy", "hasProcedure"]
query(
    "graph_edge_audit",
    """select t.type, count(e.src) as edges, count(e.src) filter (where s.id is null) as dangling_src, count(e.src) filter (where d.id is null) as dangling_dst, count(e.src) = 0 as is_empty from (values ('linkedToDevice'), ('hasClaim'), ('coveredBy'), ('hasProcedure')) t(type)
 left join v_moved_edges e using (type) left join v_node_ids s on s.id = e.src and s.label = e.src_label left join v_node_ids d on d.id = e.dst and d.label = e.dst_label group by 1""",
)(lambda k: graph.edge_audit(moved_edges(k), node_rows(k), AUDIT))
CTES["v_moved_edges"] = "select case when type = 'hasClaim' and src like '%7' then src || '-moved' else src end as src, case when type = 'linkedToDevice' and dst like '%3' then 'unknown' else dst end as dst, type, src_label, dst_label from v_edges"


def moved_edges(k):
    """Edges of which some ends name nodes that do not exist."""
    src = F.when((F.col("type") == "hasClaim") & F.col("src").endswith("7"), F.concat("src", F.lit("-moved"))).otherwise(F.col("src"))
    dst = F.when((F.col("type") == "linkedToDevice") & F.col("dst").endswith("3"), F.lit("unknown")).otherwise(F.col("dst"))
    return k.edges_of(*AUDIT[:3]).withColumns({"src": src, "dst": dst})


CTES["v_node_ids"] = "select distinct 'Patient' as label, patient_id as id from v_patients union all select distinct 'Device', device_id from v_telemetry union all select distinct 'Payer', coverage_id from v_payer union all select distinct 'Claim', claim_id from v_fact_claim"
