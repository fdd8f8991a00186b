"""Gold dimensions, facts, quality, risk and cost queries."""

from pyspark.sql import functions as F

from carespark.functions.fhir import age_at, age_by_year, is_pediatric, strip_ref
from carespark.operators import cost, gold, payer, quality, risk, silver
from carespark.refdata import clinical as ref

from .lake import AS_OF_DAY
from .q_payer import MONTH, VEL, cost as trajectory, fraud
from .registry import CTES, day_text, num_text, query, rdiv, ts_text

quoted = lambda codes: ", ".join(f"'{c}'" for c in codes)
DAY0, DAY1 = f"date '{ref.PERIOD_START}'", f"date '{ref.PERIOD_END}'"
ASOF = f"date '{AS_OF_DAY}'"
AGE = f"cast(floor(date_diff('day', birth_date, {ASOF}) / 365.25::double) as int)"

# --- G ---
CTES["v_cov"] = "select * from v_coverage union all select * from v_coverage2"
SIG = "lower(concat_ws(' ', type_code, type_display, type_text, payer_name))"
CTES["v_payer"] = f"""select *, case when regexp_matches({SIG}, 'medicare|\\bmcr\\b') then 'Medicare' when regexp_matches({SIG}, 'medicaid|\\bmcd\\b') then 'Medicaid'
 when regexp_matches({SIG}, 'self[- ]pay|uninsured|no insurance') then 'Uninsured'
 when regexp_matches({SIG}, 'commercial|private|employer|blue cross|bcbs|aetna|cigna|united|humana|anthem|kaiser') then 'Commercial' else 'Unknown' end as payer_category from v_cov"""
CTES["v_patient_payer"] = "select * from v_payer qualify row_number() over (partition by patient_id order by cov_start desc nulls last, coverage_id desc) = 1"
query(
    "dim_payer",
    f"select coverage_id as payer_id, payer_name, payer_category as payer_type, payer_category, {day_text('cov_start')} as coverage_start, {day_text('cov_end')} as coverage_end, 'Patient/' || patient_id as patient_ref, 1 as is_active from v_payer",
)(lambda k: k.dim_payer.drop("payer_key"))
query("patient_payer", "select patient_id, coverage_id as primary_payer_id, payer_category, payer_name from v_patient_payer")(
    lambda k: k.patient_payer.drop("primary_payer_key")
)
query("payer_category_counts", "select payer_category, count(*) as coverages, count(distinct patient_id) as patients from v_payer group by 1")(
    lambda k: k.dim_payer.groupBy("payer_category").agg(F.count("*").alias("coverages"), F.count_distinct("patient_ref").alias("patients"))
)
query(
    "dim_diagnosis",
    """select code as icd_code, min(display) as icd_description, case when system = 'http://snomed.info/sct' then 'SNOMED-CT' when system like '%icd%' then 'ICD-10' else 'Other' end as code_system,
 cast(regexp_matches(lower(min(display)), 'diabetes|hypertension|asthma|copd|heart failure|chronic|obesity') as int) as is_chronic, 1 as is_active from v_conditions group by code, system""",
)(lambda k: gold.dim_diagnosis(k.conditions).drop("diagnosis_key"))
CTES["v_fact_claim"] = """select e.claim_id, e.patient_id, e.provider_id, e.facility_id, e.coverage_id, e.claim_type, coalesce(e.outcome, 'complete') as claim_status, coalesce(bill_start, created) as service_date,
 billed as billed_amount, paid as paid_amount, coalesce(payment, 0) as payment_amount, case when outcome <> 'complete' then 1 else 0 end as denial_flag,
 coalesce(o.payer_category, p.payer_category, 'Unknown') as payer_category from v_eob e left join v_payer o on o.coverage_id = e.coverage_id left join v_patient_payer p on p.patient_id = e.patient_id"""
query(
    "fact_claim",
    f"""select claim_id, 'Patient/' || patient_id as patient_ref, patient_id, 'Practitioner/' || provider_id as provider_ref, 'Location/' || facility_id as facility_ref, case when coverage_id = '' then null else 'Coverage/' || coverage_id end as coverage_ref,
 claim_type, claim_status, {day_text('service_date')} as service_date, cast(billed_amount as double) as billed_amount, cast(paid_amount as double) as paid_amount, cast(payment_amount as double) as payment_amount, denial_flag,
 cast(billed_amount - paid_amount as double) as patient_responsibility, cast(billed_amount as double) as allowed_amount, payer_category from v_fact_claim""",
)(lambda k: k.fact_claim.drop("claim_key", "coverage_id"))
query(
    "fact_diagnosis",
    f"select condition_id as diagnosis_id, 'Patient/' || patient_id as patient_ref, 'Encounter/' || encounter_id as encounter_ref, code as icd_code, display as diagnosis_description, 'principal' as diagnosis_type, 1 as diagnosis_sequence, clinical_status, {day_text('onset_date')} as diagnosis_date from v_conditions",
)(lambda k: gold.fact_diagnosis(silver.conditions(k.silver("condition"), with_encounter=True)).drop("fact_diagnosis_key"))

# --- H ---
CTES["v_aged"] = f"select patient_id, birth_date, gender, {AGE} as age from v_patients"
query("patients_as_of", f"select patient_id, {day_text('birth_date')} as birth_date, gender, age from v_aged")(
    lambda k: quality.patients_as_of(k.patient_facts, k.as_of_day)
)
query(
    "age_definitions",
    f"""select patient_id, date_part('year', {ASOF}) - date_part('year', birth_date) - cast(strftime({ASOF}, '%m%d') < strftime(birth_date, '%m%d') as int) as calendar_age,
 date_part('year', {ASOF}) - date_part('year', birth_date) as year_age, (date_part('year', {ASOF}) - date_part('year', birth_date) - cast(strftime({ASOF}, '%m%d') < strftime(birth_date, '%m%d') as int)) < 21 as pediatric from v_patients""",
)(
    lambda k: k.patient_facts.select(
        "patient_id",
        age_at(F.col("birth_date"), k.as_of_day).cast("bigint").alias("calendar_age"),
        age_by_year(F.col("birth_date"), k.as_of_day).cast("bigint").alias("year_age"),
        is_pediatric(F.col("birth_date"), k.as_of_day).alias("pediatric"),
    )
)
query(
    "patient_conditions",
    f"select condition_id, patient_id, code, display, clinical_status, {day_text('onset_date')} as onset_date from v_conditions",
)(lambda k: k.conditions.select("condition_id", "patient_id", "code", "display", "clinical_status", "onset_date"))
query(
    "patient_observations",
    f"select observation_id, patient_id, code, display, cast(value as double) as value, unit, {day_text('obs_date')} as obs_date from v_observations where obs_date between {DAY0} and {DAY1}",
)(lambda k: quality.in_period(k.observations, "obs_date", ref.PERIOD_START, ref.PERIOD_END))
query(
    "patient_immunizations",
    f"select immunization_id, patient_id, code, display, {day_text('imm_date')} as imm_date from v_immunizations where imm_date between {DAY0} and {DAY1}",
)(lambda k: quality.in_period(k.immunizations, "imm_date", ref.PERIOD_START, ref.PERIOD_END))


def newest(code: str) -> str:
    return f"arg_max(value, row(obs_date, value)) filter (where code = '{code}')"


query(
    "latest_observation",
    f"select patient_id, cast({newest('4548-4')} as double) as value, {day_text('max(obs_date)')} as obs_date from v_observations where code = '4548-4' group by 1",
)(lambda k: quality.latest_observation(k.observations, ref.HBA1C))
CTES["v_f_cond"] = f"""select patient_id, bool_or(code in ({quoted(ref.DIABETES)})) as dm, bool_or(code in ({quoted(ref.HYPERTENSION)})) as htn, bool_or(code in ({quoted(ref.HEART_FAILURE)})) as hf
 from v_conditions where clinical_status in ('active', 'recurrence') group by 1"""
CTES["v_f_obs"] = f"""select patient_id, {newest('4548-4')} as hba1c, {newest('8480-6')} as sbp, {newest('8462-4')} as dbp, bool_or(code = '39156-5') as bmi, bool_or(code in ({quoted(ref.URINE_ALBUMIN)})) as albumin
 from v_observations where obs_date between {DAY0} and {DAY1} group by 1"""
CTES["v_f_med"] = f"select patient_id, bool_or(regexp_matches(lower(display), '{ref.ACE_ARB}')) as ace, bool_or(regexp_matches(lower(display), '{ref.BETA_BLOCKER}')) as bb from v_medications group by 1"
CTES["v_f_imm"] = f"select patient_id, bool_or(code in ({quoted(ref.PNEUMOCOCCAL_CVX)})) as pneumo, bool_or(code in ({quoted(ref.INFLUENZA_CVX)})) as flu from v_immunizations where imm_date between {DAY0} and {DAY1} group by 1"
CTES["v_feat"] = "select a.patient_id, age, coalesce(dm, false) as dm, coalesce(htn, false) as htn, coalesce(hf, false) as hf, hba1c, sbp, dbp, coalesce(bmi, false) as bmi, coalesce(albumin, false) as albumin, coalesce(ace, false) as ace, coalesce(bb, false) as bb, coalesce(pneumo, false) as pneumo, coalesce(flu, false) as flu from v_aged a left join v_f_cond using (patient_id) left join v_f_obs using (patient_id) left join v_f_med using (patient_id) left join v_f_imm using (patient_id)"
NAMES = {m[0]: m[1] for m in ref.MEASURES}
RULES = {
    "CMS122v12": ("dm and age between 18 and 75", "coalesce(hba1c > 9, true)", "coalesce(hba1c <= 9, false)"),
    "CMS165v12": ("htn and age between 18 and 85", "coalesce(sbp < 140 and dbp < 90, false)", None),
    "CMS69v12": ("age >= 18", "bmi", None),
    "CMS127v12": ("age >= 65", "pneumo", None),
    "CMS147v13": ("age >= 1", "flu", None),
    "CMS134v12": ("dm and age between 18 and 75", "albumin or ace", None),
    "CMS144v12": ("hf and age >= 18", "bb", None),
}
CTES["v_measures"] = "select m.*, coalesce(p.payer_category, 'Unknown') as payer_category from (" + " union all ".join(
    f"select patient_id, '{m}' as measure_id, '{NAMES[m]}' as measure_name, {n} as in_numerator, {q or n} as quality_met from v_feat where {d}" for m, (d, n, q) in RULES.items()
) + ") m left join v_patient_payer p using (patient_id)"
MCOLS = "patient_id, measure_id, measure_name, true as in_initial_population, true as in_denominator, in_numerator, false as in_exclusion, quality_met, 2026 as measurement_year, payer_category"
query("quality_measures", f"select {MCOLS} from v_measures")(lambda k: k.measures)
for _id, _name in [
    ("CMS122v12", "measure_hba1c_poor_control"), ("CMS165v12", "measure_blood_pressure"), ("CMS69v12", "measure_bmi_screening"),
    ("CMS127v12", "measure_pneumococcal"), ("CMS147v13", "measure_influenza"), ("CMS134v12", "measure_nephropathy"), ("CMS144v12", "measure_beta_blocker"),
]:
    query(_name, f"select {MCOLS} from v_measures where measure_id = '{_id}'")(lambda k, m=_id: quality.single_measure(k.measures, m))
BENCH = "case measure_id " + " ".join(f"when '{m[0]}' then {m[2]}" for m in ref.MEASURES) + " else 75.0 end"
WEIGHT = "case " + " ".join(f"when measure_id = '{m[0]}' then {m[3]}" for m in ref.MEASURES) + " when measure_id like 'PDC%' then 3 else 1 end"
ACTIONS = "case measure_id " + " ".join(f"when '{m[0]}' then '{m[4]}'" for m in ref.MEASURES) + " end"
CTES["v_summary"] = f"""select measure_id, measure_name, payer_category, count(*) as denominator_count, count(*) filter (where in_numerator) as numerator_count, count(*) filter (where quality_met) as quality_met_count,
 cast({BENCH} as double) as benchmark_rate from v_measures group by 1, 2, 3"""
query(
    "quality_summary",
    f"select measure_id, measure_name, 2026 as measurement_year, payer_category, denominator_count, numerator_count, 0 as exclusion_count, quality_met_count, {rdiv('100 * quality_met_count', 'denominator_count', 1)} as quality_rate, benchmark_rate from v_summary",
)(lambda k: k.quality_summary)
CLS = {name: pat for name, pat in __import__("carespark.functions.fhir", fromlist=["DRUG_CLASSES"]).DRUG_CLASSES}
CLASS = "case " + " ".join(f"when regexp_matches(lower(display), '{p}') then '{n}'" for n, p in CLS.items()) + " end"
CTES["v_classed"] = f"select * from (select *, {CLASS} as medication_class from v_medications where authored_date between {DAY0} and {DAY1}) where medication_class is not null"
CTES["v_adherence"] = f"""select *, case when pdc_score >= 0.8 then 'Adherent' else 'Non-Adherent' end as adherence_category, cast(case when pdc_score < 0.8 then round((1 - pdc_score) * 365) else 0 end as int) as gap_days from (
 select patient_id, medication_class, count(distinct strftime(authored_date, '%Y-%m')) as months_with_rx, count(*) as total_fills, min(authored_date) as first_fill, max(authored_date) as last_fill,
 least({rdiv("count(distinct strftime(authored_date, '%Y-%m'))", '12', 2)}, 1.0::double) as pdc_score from v_classed group by 1, 2)"""
query(
    "medication_adherence",
    f"select patient_id, medication_class, months_with_rx, total_fills, {day_text('first_fill')} as first_fill, {day_text('last_fill')} as last_fill, pdc_score, adherence_category, gap_days, 1 as is_chronic from v_adherence",
)(lambda k: k.adherence)
query("drug_class", f"select display, {CLASS} as medication_class, count(*) as n from v_medications group by 1, 2")(
    lambda k: k.medications.groupBy("display", quality.drug_class(F.col("display")).alias("medication_class")).agg(F.count("*").alias("n"))
)
query(
    "days_covered",
    f"""select patient_id, medication_class, count(distinct d) as days_covered, {day_text('min(authored_date)')} as first_fill, {rdiv('count(distinct d)', f"(date_diff('day', min(authored_date), {DAY1}) + 1)", 4)} as pdc_days
 from (select patient_id, medication_class, authored_date, unnest(range(authored_date, least(authored_date + 30, {DAY1} + 1), interval 1 day)) as d from v_classed) group by 1, 2""",
)(lambda k: quality.days_covered(k.medications))
CTES["v_gaps"] = f"select patient_id, measure_id, measure_name as gap_type, 'open' as gap_status, 90 as days_overdue, {ACTIONS} as recommended_action from v_measures where not quality_met"
query("care_gaps", "select * from v_gaps")(lambda k: k.care_gaps)
CTES["v_rated0"] = """select measure_id, measure_name, sum(quality_met_count) as total_met, sum(denominator_count) as total_denom, max(benchmark_rate) as benchmark_rate from v_summary group by 1, 2
 union all select 'PDC-' || case when medication_class like '%PDC-DR%' then 'DR' when medication_class like '%RASA%' then 'RASA' else 'STA' end, medication_class, count(*) filter (where adherence_category = 'Adherent'), count(*), 80.0 from v_adherence group by medication_class"""
STAR = "case when {r} >= 86 then 5 when {r} >= 75 then 4 when {r} >= 64 then 3 when {r} >= 52 then 2 else 1 end"
CTES["v_rated"] = f"select *, {STAR.format(r='quality_rate')} as star_rating, {WEIGHT} as measure_weight from (select *, {rdiv('100 * total_met', 'total_denom', 1)} as quality_rate from v_rated0)"
query(
    "star_detail",
    f"""select measure_id, measure_name, cast(total_met as bigint) as total_met, cast(total_denom as bigint) as total_denom, cast(benchmark_rate as double) as benchmark_rate, quality_rate, star_rating, measure_weight, star_rating * measure_weight as weighted_score,
 round(case star_rating when 5 then null when 4 then 86 - quality_rate when 3 then 75 - quality_rate when 2 then 64 - quality_rate else 52 - quality_rate end, 6) as rate_to_next_star,
 (select {rdiv('sum(star_rating * measure_weight)', 'sum(measure_weight)', 1)} from v_rated) as overall_weighted_star from v_rated""",
)(lambda k: quality.star_detail(k.rated))
SIM = rdiv("100 * (total_met + closeable_gaps)", "total_denom", 1)
query(
    "star_simulation",
    f"""select measure_id, measure_name, gaps_to_close, closeable_gaps, quality_rate as current_rate, {SIM} as simulated_rate, star_rating as current_star, {STAR.format(r=SIM)} as simulated_star, measure_weight, total_open_gaps from (
 select *, least(gaps_to_close, total_open_gaps) as closeable_gaps from (select r.*, coalesce(g.n, 0) as total_open_gaps, s.n as gaps_to_close from v_rated r
 left join (select measure_id, cast(count(*) as int) as n from v_gaps group by 1) g using (measure_id), (values (10), (25), (50), (100), (250)) s(n)))""",
)(lambda k: quality.star_simulation(k.share("measures").rated, k.care_gaps))

# --- I ---
HCC = ", ".join(f"('{a}', '{b}', '{c}', {d}::double, '{e}')" for a, b, c, d, e in ref.HCC_MAP)
CTES["v_hcc_map"] = f"select * from (values {HCC}) t(code, hcc_code, hcc_name, coefficient, hierarchy_group)"
CTES["v_patient_hcc"] = """select distinct patient_id, code as condition_code, display as condition_display, hcc_code, hcc_name, coefficient, hierarchy_group from v_conditions join v_hcc_map using (code)
 where clinical_status is null or clinical_status in ('active', 'recurrence', 'relapse')"""
query("patient_hcc", "select * from v_patient_hcc")(lambda k: risk.patient_hcc(k.conditions))
CTES["v_hier"] = "select *, cast(row_number() over (partition by patient_id, hierarchy_group order by coefficient desc, condition_code, condition_display) as int) as hierarchy_rank from v_patient_hcc"
query("hcc_hierarchy", "select *, hierarchy_rank = 1 as hierarchy_applied from v_hier")(lambda k: k.patient_hcc)
BANDS = ", ".join(f"('{g}', {lo}, {hi}, {c}::double)" for lo, hi, m, f in ref.AGE_BANDS for g, c in (("male", m), ("female", f)))
CTES["v_bands"] = f"select * from (values {BANDS}) t(g, lo, hi, c)"
CTES["v_demo"] = "select patient_id, gender, age, coalesce(c, 0.395::double) as demographic_score from v_aged left join v_bands on g = lower(gender) and age between lo and hi"
query("demographic_band", "select * from v_demo")(lambda k: risk.demographic_band(k.patient_facts, k.as_of_day))
CTES["v_raf"] = """select *, case when raf_score >= 2 then 'Very High' when raf_score >= 1.5 then 'High' when raf_score >= 1 then 'Moderate' when raf_score >= 0.5 then 'Low' else 'Minimal' end as risk_tier, round(raf_score * 12000, 2) as annual_revenue from (
 select d.patient_id, gender, age, demographic_score, coalesce(hcc_score, 0) as hcc_score, coalesce(hcc_count, 0) as hcc_count, coalesce(hcc_list, '') as hcc_list,
 cast(cast(demographic_score as decimal(6,3)) + cast(coalesce(hcc_score, 0) as decimal(6,3)) as double) as raf_score, coalesce(p.payer_category, 'Unknown') as payer_category from v_demo d
 left join (select patient_id, cast(sum(cast(coefficient as decimal(6,3))) as double) as hcc_score, count(*) as hcc_count, string_agg(distinct hcc_code, ', ' order by hcc_code) as hcc_list from v_hier where hierarchy_rank = 1 group by 1) h using (patient_id)
 left join v_patient_payer p using (patient_id))"""
query("risk_scores", "select * from v_raf")(lambda k: k.risk_scores)
RAF_INT = "cast(sum(cast(raf_score * 1000 as bigint)) as hugeint)"
query(
    "risk_summary",
    f"select payer_category, risk_tier, count(*) as member_count, {rdiv('sum(cast(round(raf_score * 1000) as bigint))', '(count(*) * 1000)', 3)} as avg_raf, {rdiv('sum(hcc_count)', 'count(*)', 1)} as avg_hcc_count, cast(sum(cast(annual_revenue as decimal(18,2))) as double) as total_annual_revenue from v_raf group by 1, 2",
)(lambda k: risk.risk_summary(k.risk_scores))
OPP = "patient_id, raf_score, hcc_count, hcc_list, risk_tier, 0.3::double as potential_additional_raf, 3600.0::double as potential_revenue_uplift, payer_category"
query("revenue_opportunity", f"select {OPP}, 'derived' as scenario_source from v_raf where hcc_count >= 2 and raf_score < 1.5")(lambda k: risk.revenue_opportunity(k.risk_scores))
CTES["v_enc"] = "select encounter_id, patient_id, encounter_class, type_display, date_trunc('second', start_time) as admit_date, date_trunc('second', end_time) as discharge_date from v_encounters"
CTES["v_stays"] = """select *, cast(greatest(date_diff('day', cast(admit_date as date), cast(discharge_date as date)), 1) as int) as los_days from v_enc where discharge_date is not null
 and (lower(encounter_class) in ('inpatient', 'imp', 'emergency') or regexp_matches(lower(type_display), 'inpatient|hospital|emergency'))"""
ST = f"encounter_id, patient_id, encounter_class, type_display, {ts_text('admit_date')} as admit_date, {ts_text('discharge_date')} as discharge_date, los_days"
query("inpatient_stays", f"select {ST} from v_stays")(lambda k: risk.inpatient_stays(k.encounters))
CTES["v_readmit"] = "select a.*, cast(exists (select 1 from v_stays b where b.patient_id = a.patient_id and b.admit_date > a.discharge_date and date_diff('day', cast(a.discharge_date as date), cast(b.admit_date as date)) <= 30) as int) as readmitted_30d from v_stays a"
query("readmit_30d", f"select {ST}, readmitted_30d from v_readmit")(lambda k: risk.readmit_30d(risk.inpatient_stays(k.encounters)))
CTES["v_rfeat"] = f"""select r.encounter_id, r.patient_id, r.admit_date, r.discharge_date, a.age, cast(a.gender = 'male' as int) as sex_male, r.los_days, coalesce(c.n, 0) as comorbidity_count, coalesce(m.n, 0) as medication_count,
 coalesce(u.adm, 0) as prior_admits_12mo, coalesce(u.ed, 0) as prior_ed_visits_6mo, coalesce(c.dm, 0) as has_diabetes, coalesce(c.chf, 0) as has_chf, coalesce(c.copd, 0) as has_copd,
 cast(coalesce(p.payer_category = 'Medicare', false) as int) as payer_is_medicare, cast(coalesce(p.payer_category = 'Medicaid', false) as int) as payer_is_medicaid, r.readmitted_30d
 from v_readmit r join v_aged a using (patient_id) left join (select patient_id, count(distinct code) as n, max(cast(code in ({quoted(ref.DIABETES)}) as int)) as dm, max(cast(code in ({quoted(ref.HEART_FAILURE)}) as int)) as chf, max(cast(code in ({quoted(ref.COPD)}) as int)) as copd from v_conditions group by 1) c using (patient_id)
 left join (select patient_id, count(distinct code) as n from v_medications group by 1) m using (patient_id)
 left join (select patient_id, count(*) filter (where lower(encounter_class) in ('inpatient', 'imp')) as adm, count(*) filter (where lower(encounter_class) = 'emergency') as ed from v_enc where discharge_date is not null group by 1) u using (patient_id)
 left join v_patient_payer p using (patient_id)"""
RF = f"encounter_id, patient_id, {ts_text('admit_date')} as admit_date, {ts_text('discharge_date')} as discharge_date, age, sex_male, los_days, comorbidity_count, medication_count, prior_admits_12mo, prior_ed_visits_6mo, has_diabetes, has_chf, has_copd, payer_is_medicare, payer_is_medicaid, readmitted_30d"
query("readmission_features", f"select {RF} from v_rfeat")(lambda k: k.readmission_features)
query(
    "bounded_prior_use",
    """select s.encounter_id, s.patient_id, cast(coalesce((select sum(a) from v_daily_use d where d.patient_id = s.patient_id and date_diff('day', d.day, cast(s.admit_date as date)) between 1 and 365), 0) as bigint) as prior_admits_12mo,
 cast(coalesce((select sum(e) from v_daily_use d where d.patient_id = s.patient_id and date_diff('day', d.day, cast(s.admit_date as date)) between 1 and 183), 0) as bigint) as prior_ed_visits_6mo from v_stays s""",
)(lambda k: risk.bounded_prior_use(k.encounters))
CTES["v_daily_use"] = "select patient_id, cast(admit_date as date) as day, count(*) filter (where lower(encounter_class) in ('inpatient', 'imp')) as a, count(*) filter (where lower(encounter_class) = 'emergency') as e from v_enc where discharge_date is not null group by 1, 2"
CTES["v_scored"] = """select *, case when risk_probability >= 0.3 then 'High' when risk_probability >= 0.15 then 'Medium' else 'Low' end as risk_tier from (
 select *, cast(least(greatest(0.05 + age * 0.002 + comorbidity_count * 0.015 + los_days * 0.04 + prior_admits_12mo * 0.06 + (cast('0x' || substr(md5(patient_id), 1, 6) as int) % 100) * 0.001 - 0.05, 0.01), 0.99) as double) as risk_probability from v_rfeat)"""
query("readmission_rule_score", f"select {RF}, risk_probability, risk_tier from v_scored")(lambda k: risk.readmission_rule_score(k.readmission_features))
CTES["v_rscores"] = "select s.*, coalesce(p.payer_category, 'Unknown') as payer_category, 'observed' as scenario_source from v_scored s left join v_patient_payer p using (patient_id)"
query("readmission_scores", f"select {RF}, risk_probability, risk_tier, payer_category, scenario_source from v_rscores")(lambda k: k.readmission)
MILLI = "sum(cast(round(risk_probability * 1000) as bigint))"
query(
    "readmission_summary",
    f"select risk_tier, payer_category, count(*) as encounter_count, {rdiv(MILLI, '(count(*) * 1000)', 3)} as avg_risk_probability, cast(sum(readmitted_30d) as bigint) as actual_readmissions, {rdiv('sum(readmitted_30d)', 'count(*)', 3)} as actual_readmission_rate from v_rscores group by 1, 2",
)(lambda k: risk.readmission_summary(k.readmission))
CTES["v_ranked"] = """select readmitted_30d, risk_probability, rank() over (order by risk_probability) + (count(*) over (partition by risk_probability) - 1) / 2.0 as low_rank from v_scored"""
CTES["v_rule_auc"] = """select case when pos > 0 and neg > 0 then (s - pos * (pos + 1) / 2.0) / (pos * neg) else 0.5 end as auc from (
 select count(*) filter (where readmitted_30d = 1) as pos, count(*) filter (where readmitted_30d = 0) as neg, coalesce(sum(low_rank) filter (where readmitted_30d = 1), 0) as s from v_ranked)"""
CTES["v_rule_quality"] = """select avg(cast(hit = truth as int)) as accuracy, coalesce(count(*) filter (where hit and truth) / nullif(cast(count(*) filter (where hit) as double), 0), 0) as precision,
 coalesce(count(*) filter (where hit and truth) / nullif(cast(count(*) filter (where truth) as double), 0), 0) as recall from (select risk_probability > 0.5 as hit, readmitted_30d = 1 as truth from v_scored)"""
WEIGHT_ROWS = ", ".join(f"('{n}', 'coefficient', {ref.READMISSION_WEIGHTS.get(n, 0.0)}::double)" for n in ref.FEATURE_DEFAULTS)
query(
    "readmission_rule_performance",
    f"""select * from (select unnest(['auc_roc', 'accuracy', 'precision', 'recall', 'total_encounters', 'readmission_rate', 'high_risk_count', 'medium_risk_count', 'low_risk_count']) as name, 'metric' as type,
 round(unnest([(select auc from v_rule_auc), (select accuracy from v_rule_quality), (select precision from v_rule_quality), (select recall from v_rule_quality), count(*), avg(readmitted_30d), count(*) filter (where risk_tier = 'High'), count(*) filter (where risk_tier = 'Medium'), count(*) filter (where risk_tier = 'Low')]), 9) as value from v_scored
 union all select * from (values {WEIGHT_ROWS}) w(name, type, value))""",
)(lambda k: risk.rule_performance(risk.readmission_rule_score(k.readmission_features)).withColumn("value", F.round("value", 9)))
CTES["v_split"] = """select *, sum(n) over (partition by readmitted_30d order by part) * 100 <= sum(n) over (partition by readmitted_30d) * 20 as is_test from (
 select readmitted_30d, substr(md5(encounter_id), 1, 4) as part, count(*) as n from v_rfeat group by 1, 2)"""
CTES["v_marked"] = "select f.encounter_id, f.readmitted_30d, s.is_test from v_rfeat f join v_split s on s.readmitted_30d = f.readmitted_30d and s.part = substr(md5(f.encounter_id), 1, 4)"
query(
    "readmission_split",
    """select encounter_id, readmitted_30d, is_test, case when is_test then null else round(cast(n as double) / (2 * (case when readmitted_30d = 1 then pos else n - pos end)), 9) end as weight
 from v_marked, (select count(*) as n, sum(readmitted_30d) as pos from v_marked where not is_test)""",
)(
    lambda k: risk.balance_weights(risk.holdout(k.readmission_features)).select(
        "encounter_id", "readmitted_30d", "is_test", F.round("weight", 9).alias("weight")
    )
)
query("readmission_model_scores")(lambda k: risk.readmission_model(k.readmission_features)[0])
query("readmission_model_performance")(lambda k: risk.readmission_model(k.readmission_features)[1])
query(
    "readmission_model_balance",
    "select name, true as balanced from (select unnest([" + ", ".join(f"'{n}'" for n in ref.FEATURE_DEFAULTS) + "]) as name)",
)(
    lambda k: risk.model_balance(*risk.readmission_model(k.readmission_features)).select(
        "name", (F.abs("slope") < 2e-3).alias("balanced")
    )
)
query(
    "rule_score_auc",
    "select round(auc, 9) as value from v_rule_auc",
)(lambda k: risk.auc(risk.readmission_rule_score(k.readmission_features), "readmitted_30d").select(F.round("value", 9).alias("value")))
E1 = f"coalesce(cov_end, {ASOF})"
MB = f"""(date_part('year', {E1}) - date_part('year', cov_start)) * 12 + date_part('month', {E1}) - date_part('month', cov_start) + case when date_part('day', {E1}) = date_part('day', cov_start)
 or ({E1} = last_day({E1}) and cov_start = last_day(cov_start)) then 0 else (date_part('day', {E1}) - date_part('day', cov_start)) / 31.0::double end"""
CTES["v_months"] = f"select coverage_id, patient_id, cov_start, {E1} as cov_end, cast(greatest(round({MB}), 1) as int) as member_months from v_cov"
query("member_months", f"select coverage_id, patient_id, {day_text('cov_start')} as coverage_start, {day_text('cov_end')} as coverage_end, member_months from v_months")(lambda k: k.months)
CTES["v_class"] = """select encounter_id, patient_id, encounter_class, cast(admit_date as date) as admit_date, cast(discharge_date as date) as discharge_date, cast(greatest(date_diff('day', cast(admit_date as date), cast(discharge_date as date)), 0) as int) as los_days,
 case when lower(encounter_class) in ('inpatient', 'imp') then 'Inpatient' when lower(encounter_class) = 'emergency' then 'Emergency' when lower(encounter_class) in ('outpatient', 'ambulatory', 'amb') then 'Outpatient' else 'Other' end as service_category, strftime(admit_date, '%Y-%m') as service_month from v_enc"""
query(
    "classify_encounters",
    f"select encounter_id, patient_id, encounter_class, {day_text('admit_date')} as admit_date, {day_text('discharge_date')} as discharge_date, los_days, service_category, service_month from v_class",
)(lambda k: k.classified)
IP = "service_category = 'Inpatient'"
USE = f"""count(distinct patient_id) as {{m}}, count(*) filter (where {IP}) as inpatient_admits, count(*) filter (where service_category = 'Emergency') as ed_visits, count(*) filter (where service_category = 'Outpatient') as outpatient_visits,
 cast(coalesce(sum(los_days) filter (where {IP}), 0) as bigint) as {{b}}, case when count(los_days) filter (where {IP}) = 0 then null else {rdiv(f'sum(los_days) filter (where {IP})', f'nullif(count(los_days) filter (where {IP}), 0)', 1)} end as avg_los"""
CTES["v_rates"] = f"""select {rdiv('cast(paid * 100 as bigint)', '(months * 100)', 2)} as pmpm, {rdiv('ip * 1000', 'members', 1)} as ip_per_1k, {rdiv('ed * 1000', 'members', 1)} as ed_per_1k, {rdiv('bd * 1000', 'members', 1)} as bed_days_per_1k
 from (select count(*) filter (where {IP}) as ip, count(*) filter (where service_category = 'Emergency') as ed, coalesce(sum(los_days) filter (where {IP}), 0) as bd from v_class), (select sum(paid_amount) as paid from v_fact_claim), (select sum(member_months) as months, count(distinct patient_id) as members from v_months)"""
query("population_rates", "select * from v_rates")(lambda k: k.rates)
CTES["v_util"] = f"select u.*, r.*, 950.0::double as benchmark_pmpm, 300.0::double as benchmark_ip_per_1k, 500.0::double as benchmark_ed_per_1k, 5.0::double as benchmark_alos from (select service_month, {USE.format(m='unique_members', b='bed_days')} from v_class group by 1) u, v_rates r"
query("utilization_monthly", "select * from v_util")(lambda k: k.utilization)
CTES["v_util_payer"] = f"select payer_category, {USE.format(m='member_count', b='total_bed_days')} from (select c.*, coalesce(p.payer_category, 'Unknown') as payer_category from v_class c left join v_patient_payer p using (patient_id)) group by 1"
query("utilization_by_payer", "select * from v_util_payer")(lambda k: cost.utilization_by_payer(k.classified, k.patient_payer))
CAT = "case when regexp_matches(lower(claim_type), 'inpatient|institutional') then 'Inpatient' when lower(claim_type) like '%emergency%' then 'Emergency' when regexp_matches(lower(claim_type), 'outpatient|ambulatory') then 'Outpatient' when regexp_matches(lower(claim_type), 'pharmacy|rx') then 'Pharmacy' when regexp_matches(lower(claim_type), 'professional|physician') then 'Professional' else 'Other' end"
query(
    "cost_by_category",
    f"select {CAT} as service_category, payer_category, count(*) as claim_count, cast(sum(billed_amount) as double) as total_billed, cast(sum(paid_amount) as double) as total_paid, {rdiv('cast(sum(billed_amount) * 100 as hugeint)', '(count(*) * 100)', 2)} as avg_claim_amount, cast(sum(denial_flag) as bigint) as denied_claims from v_fact_claim group by 1, 2",
)(lambda k: cost.cost_by_category(k.fact_claim))
CTES["v_pcost"] = "select patient_id, payer_category, sum(paid_amount) as total_paid, sum(billed_amount) as total_billed, count(*) as claim_count, cast(sum(denial_flag) as bigint) as denied_claims from v_fact_claim group by 1, 2"
CTES["v_p95"] = "select total_paid as p from v_pcost qualify row_number() over (order by total_paid) = (select cast(ceil(count(*) * 0.95::double) as bigint) from v_pcost)"
CTES["v_high_cost"] = """select patient_id, payer_category, cast(total_paid as double) as total_paid, cast(total_billed as double) as total_billed, claim_count, denied_claims, percent_rank() over (order by total_paid desc) as percentile_rank,
 total_paid >= 2 * (select p from v_p95) as is_stop_loss, conditions_list from v_pcost left join (select patient_id, string_agg(distinct display, ', ' order by display) as conditions_list from v_conditions group by 1) using (patient_id) where total_paid >= (select p from v_p95)"""
query("high_cost_claimants", "select * from v_high_cost")(lambda k: k.high_cost)
GROUPS = ", ".join(f"('{c}', '{g}')" for g, cs in ref.CHRONIC_GROUPS.items() for c in cs)
query(
    "condition_pmpm",
    f"""select condition_name, cast(count(*) as int) as patient_count, cast(sum(coalesce(paid, 0)) as double) as total_cost, {rdiv('cast(sum(coalesce(paid, 0)) * 100 as hugeint)', '(count(*) * 1200)', 2)} as condition_pmpm, (select pmpm from v_rates) as overall_pmpm
 from (select distinct patient_id, condition_name from v_conditions join (values {GROUPS}) g(code, condition_name) using (code)) left join (select patient_id, sum(paid_amount) as paid from v_fact_claim group by 1) using (patient_id) group by 1""",
)(lambda k: cost.condition_pmpm(k.fact_claim, k.conditions, k.rates))

# --- payer operators that read Gold ---
CTES["v_gap_alerts"] = "select 'CAREGAP-' || patient_id || '-' || measure_id as alert_id, patient_id, '' as facility_id, measure_id, gap_type as measure_name, days_overdue as gap_days_overdue, 'HIGH' as alert_priority, recommended_action as alert_text from v_gaps"


def gap_alerts(k):
    return payer.care_gap_on_alert(k.spark, k.care_gaps, k.claims_as_of)


query(
    "care_gap_on_alert",
    f"select *, {ts_text('(select as_of from v_claims_as_of)')} as alert_timestamp, cast(null as double) as latitude, cast(null as double) as longitude, '' as provider_id, '' as claim_id, 0.0::double as fraud_score from v_gap_alerts",
)(gap_alerts)
query("critical_care_gaps", "select alert_id, patient_id, measure_name, gap_days_overdue, alert_priority, alert_text, alert_text as recommended_action from v_gap_alerts")(lambda k: payer.critical_care_gaps(gap_alerts(k)))
CTES["v_worklist"] = f"""select score_id as alert_id, 'FRAUD' as alert_domain, risk_tier as priority, patient_id, provider_id, claim_id, fraud_score as metric_value, 'fraud_score' as metric_name,
 'Fraud risk ' || {num_text('v_fraud.fraud_score')} || ' for claim ' || claim_id || ' provider ' || provider_id as message, latitude, longitude from v_fraud where risk_tier in ('CRITICAL', 'HIGH')
 union all select alert_id, 'HIGH_COST', risk_tier, patient_id, '', '', cast(s30 as double), 'rolling_spend_30d', '30d spend $' || {num_text('s30')} || '; ED visits=' || ed || '; trend=' || cost_trend, latitude, longitude from v_cost where risk_tier in ('CRITICAL', 'HIGH')
 union all select alert_id, 'CARE_GAP', alert_priority, patient_id, '', '', cast(gap_days_overdue as double), 'gap_days_overdue', alert_text, null, null from v_gap_alerts"""


def worklist(k):
    return payer.payer_ops_worklist(fraud(k), trajectory(k), gap_alerts(k))


query("payer_ops_worklist", f"select *, {ts_text('(select as_of from v_claims_as_of)')} as alert_time from v_worklist")(worklist)
query(
    "priority_summary",
    f"""select alert_domain, priority, provider_id, count(*) as alert_count, count(distinct patient_id) as affected_members, count(distinct nullif(provider_id, '')) as affected_providers, max(metric_value) as max_metric,
 {ts_text('(select as_of from v_claims_as_of)')} as latest_alert, case alert_domain when 'FRAUD' then 'Route to SIU review' when 'HIGH_COST' then 'Assign care management outreach' else 'Send provider outreach' end as recommended_action from v_worklist group by 1, 2, 3""",
)(lambda k: payer.priority_summary(worklist(k)))
query(
    "claim_counts_by_grain",
    "select event_type as grain, count(*) as claim_count, cast(sum(claim_amount) as double) as amount, 'claims_events' as source from v_claims group by 1 union all select 'ALL_HISTORY', count(*), cast(sum(paid_amount) as double), 'fact_claim' from v_fact_claim",
)(lambda k: payer.claim_counts_by_grain(k.claims, k.fact_claim))
query("imaging_summary", "select modality, count(*) as study_count, 'SilverImagingStudy' as source_name from v_imaging group by 1")(lambda k: payer.imaging_summary(k.imaging))
