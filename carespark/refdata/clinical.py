"""Code lists, measure definitions, coefficients and cut points.

Everything here must equal the published tables for results to match.
"""

from __future__ import annotations

# Measurement period (both ends included) and age reference day.
PERIOD_START = "2025-07-01"
PERIOD_END = "2026-07-01"
MEASUREMENT_YEAR = 2026

# Condition code lists.
DIABETES = ["44054006", "73211009"]
HYPERTENSION = ["59621000"]
HEART_FAILURE = ["42343007", "84114007"]
COPD = ["13645005"]
ACTIVE = ["active", "recurrence"]
ACTIVE_OR_RELAPSE = ["active", "recurrence", "relapse"]

# Observation, vaccine and drug lists.
HBA1C, SYSTOLIC, DIASTOLIC, BMI = "4548-4", "8480-6", "8462-4", "39156-5"
URINE_ALBUMIN = ["14959-1", "14957-5", "13705-9", "1754-1", "1755-8"]
PNEUMOCOCCAL_CVX = ["33", "100", "109", "133", "152", "215"]
INFLUENZA_CVX = ["140", "141", "150", "155", "158", "161", "166", "171", "185", "186", "197", "205"]
ACE_ARB = "lisinopril|enalapril|ramipril|losartan|valsartan|irbesartan|olmesartan|candesartan|benazepril|captopril|fosinopril|quinapril|trandolapril|perindopril|eprosartan|telmisartan|azilsartan"
BETA_BLOCKER = "metoprolol|carvedilol|bisoprolol|atenolol|propranolol|nebivolol|nadolol|labetalol"
CHRONIC_WORDS = "diabetes|hypertension|asthma|copd|heart failure|chronic|obesity"

# Id, name, benchmark rate, star weight, gap action.
MEASURES = [
    ("CMS122v12", "Diabetes: Hemoglobin A1c Poor Control", 65.0, 3, "Order HbA1c lab test; consider medication adjustment"),
    ("CMS165v12", "Controlling High Blood Pressure", 72.0, 3, "Recheck blood pressure; consider medication titration"),
    ("CMS69v12", "Preventive Care: BMI Screening", 85.0, 1, "Record BMI and create follow-up plan"),
    ("CMS127v12", "Pneumococcal Vaccination Status", 78.0, 1, "Administer pneumococcal vaccine (PCV20 or PPSV23)"),
    ("CMS147v13", "Preventive Care: Influenza Immunization", 55.0, 1, "Administer seasonal influenza vaccine"),
    ("CMS134v12", "Diabetes: Medical Attention for Nephropathy", 88.0, 3, "Order urine albumin test or start ACE/ARB therapy"),
    ("CMS144v12", "Heart Failure: Beta-Blocker Therapy", 90.0, 3, "Start beta-blocker therapy (carvedilol, metoprolol, bisoprolol)"),
]
DEFAULT_BENCHMARK = 75.0
DEFAULT_ACTION = "Follow up with provider"
ADHERENCE_BENCHMARK = 80.0
ADHERENCE_WEIGHT = 3
GAP_DAYS_OVERDUE = 90

# Star cut points, best first, and gap-closure scenarios.
STAR_CUTS = [(86.0, 5), (75.0, 4), (64.0, 3), (52.0, 2)]
GAP_SCENARIOS = [10, 25, 50, 100, 250]

# Condition code, category, name, coefficient, hierarchy group.
HCC_MAP = [
    ("73211009", "HCC37", "Diabetes with Acute Complications", 0.302, "Diabetes"),
    ("44054006", "HCC38", "Diabetes with Chronic Complications", 0.302, "Diabetes"),
    ("15777000", "HCC19", "Diabetes without Complication", 0.104, "Diabetes"),
    ("E11.65", "HCC38", "Diabetes with Chronic Complications", 0.302, "Diabetes"),
    ("E11.9", "HCC19", "Diabetes without Complication", 0.104, "Diabetes"),
    ("42343007", "HCC85", "Congestive Heart Failure", 0.323, "Heart_Failure"),
    ("84114007", "HCC85", "Heart Failure", 0.323, "Heart_Failure"),
    ("I50.9", "HCC85", "Congestive Heart Failure", 0.323, "Heart_Failure"),
    ("13645005", "HCC111", "COPD", 0.328, "COPD"),
    ("J44.1", "HCC111", "COPD", 0.328, "COPD"),
    ("46177005", "HCC326", "CKD Stage 5", 0.191, "CKD"),
    ("431855005", "HCC327", "CKD Stage 4", 0.191, "CKD"),
    ("433144002", "HCC329", "CKD Stage 3", 0.069, "CKD"),
    ("N18.5", "HCC326", "CKD Stage 5", 0.191, "CKD"),
    ("N18.4", "HCC327", "CKD Stage 4", 0.191, "CKD"),
    ("230690007", "HCC100", "Ischemic Stroke", 0.230, "Stroke"),
    ("I63.9", "HCC100", "Ischemic Stroke", 0.230, "Stroke"),
    ("49436004", "HCC96", "Specified Heart Arrhythmias", 0.279, "Arrhythmia"),
    ("I48.91", "HCC96", "Atrial Fibrillation", 0.279, "Arrhythmia"),
    ("363406005", "HCC12", "Breast Cancer", 0.146, "Cancer_Breast"),
    ("93761005", "HCC11", "Colorectal Cancer", 0.296, "Cancer_GI"),
    ("254637007", "HCC9", "Lung Cancer", 0.963, "Cancer_Lung"),
    ("C50.919", "HCC12", "Breast Cancer", 0.146, "Cancer_Breast"),
    ("C18.9", "HCC11", "Colorectal Cancer", 0.296, "Cancer_GI"),
    ("69896004", "HCC40", "Rheumatoid Arthritis", 0.301, "Autoimmune"),
    ("M06.9", "HCC40", "Rheumatoid Arthritis", 0.301, "Autoimmune"),
    ("36923009", "HCC155", "Major Depression", 0.309, "Psych"),
    ("F32.9", "HCC155", "Major Depressive Disorder", 0.309, "Psych"),
    ("195967001", "HCC112", "Asthma", 0.223, "Asthma"),
    ("J45.50", "HCC112", "Severe Persistent Asthma", 0.223, "Asthma"),
    ("162864005", "HCC48", "Morbid Obesity", 0.250, "Obesity"),
    ("E66.01", "HCC48", "Morbid Obesity", 0.250, "Obesity"),
    ("26929004", "HCC51", "Alzheimer Disease", 0.191, "Dementia"),
    ("G30.9", "HCC51", "Alzheimer Disease", 0.191, "Dementia"),
    ("84757009", "HCC79", "Epilepsy", 0.150, "Neuro"),
    ("G40.909", "HCC79", "Epilepsy", 0.150, "Neuro"),
]

# Age band (inclusive), male and female coefficient.
AGE_BANDS = [
    (0, 34, 0.089, 0.089),
    (35, 44, 0.137, 0.131),
    (45, 54, 0.173, 0.162),
    (55, 59, 0.231, 0.209),
    (60, 64, 0.290, 0.261),
    (65, 69, 0.395, 0.342),
    (70, 74, 0.502, 0.431),
    (75, 79, 0.597, 0.527),
    (80, 84, 0.728, 0.649),
    (85, 89, 0.917, 0.820),
    (90, 120, 1.040, 0.946),
]
DEFAULT_DEMOGRAPHIC = 0.395
BENCHMARK_PMPM = 1000.0
RISK_TIERS = [(2.0, "Very High"), (1.5, "High"), (1.0, "Moderate"), (0.5, "Low")]

# Utilisation benchmarks.
UTILISATION_BENCHMARKS = {"pmpm": 950.0, "ip_per_1k": 300.0, "ed_per_1k": 500.0, "alos": 5.0}

# Condition groups of the cost report.
CHRONIC_GROUPS = {
    "Diabetes": ["44054006", "73211009"],
    "Heart Failure": ["42343007", "84114007"],
    "COPD": ["13645005"],
    "Hypertension": ["59621000"],
    "CKD": ["46177005", "431855005", "433144002"],
    "Asthma": ["195967001"],
    "Depression": ["36923009"],
}

# Readmission tiers and rule weights.
READMISSION_TIERS = [(0.3, "High"), (0.15, "Medium")]
READMISSION_WEIGHTS = {"age": 0.002, "comorbidity_count": 0.015, "los_days": 0.04, "prior_admits_12mo": 0.06}
READMISSION_BASE = 0.05
FEATURE_DEFAULTS = {
    "age": 65, "sex_male": 0, "los_days": 1, "comorbidity_count": 0, "medication_count": 0,
    "prior_admits_12mo": 0, "prior_ed_visits_6mo": 0, "has_diabetes": 0, "has_chf": 0, "has_copd": 0,
    "payer_is_medicare": 0, "payer_is_medicaid": 0,
}
